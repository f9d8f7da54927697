"""Operator 3: MinHash near-duplicate removal with odd sketches.

A document's 120 MinHash samples are cut into 24 bands of 5, and folded into a parity bitmap of 256
bits, its odd sketch.  Documents that share a band are candidates; the population count of their
sketches' XOR estimates the similarity, precisely where it is high, and throws out what lies far below
the threshold; the rest is confirmed on full shingle sets (see ``near``).  A pair of similarity 0.85
shares no band with probability 8e-7, and fails the sketch with far less.

Defined results: null, empty and wordless texts have an empty set and no links; a text of fewer than
five words is one shingle; a null id is its own component and kept; rows of one id are one document,
whose links are those of all its texts; equal sets are linked whatever their number; whole texts are
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.near import Linker, Rule

RULE = Rule(per=85)


def classes(docs: DataFrame, rule: Rule = RULE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, component for each row."""
    return Linker(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rule).labelled()


def report(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def deduplicated(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; same columns.

    Of rows that are equal in id and text one stays; an empty text of an id goes if the id's other texts go.
    """
    key = (docs["doc_id"], F.xxhash64(docs["text"]))
    again = docs.filter(docs["doc_id"].isNotNull()).groupBy(key[0].alias("_id"), key[1].alias("_tag")).count().filter("count > 1").select("_id", "_tag")
    if not again.isEmpty():
        same = (docs["doc_id"] == again["_id"]) & (key[1] == again["_tag"])
        docs = docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    gone = classes(docs, rule).filter(F.col("id") != F.col("component")).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
