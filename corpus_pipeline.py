"""The training-corpus pipeline: STAGES, applied in order to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next one's docs.  All but the last return the columns of ``documents``.

1. language: documents without a letter, or with a probability below 0.3 for every learned language, go.
2. near_duplicates: the document with the smallest id of each near-duplicate group (similarity 0.8) stays.
3. decontaminate: benchmark passages are cut out; documents with passages of two items or more, or hit
   in over half of their words, go.
4. secrets: every secret is replaced by ``[secret]``.
5. packing: the rest is packed into sequences of tokens.

Null ids, null and empty texts, repeated rows and empty tables are treated as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, language, neardup, packing, secrets
from folioscope.llm.common import Shelf, table
from folioscope.llm.near import Rule

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.fit(docs)).select(*COLUMNS)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, Rule(per=80)).select(*COLUMNS)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(secrets.redact(docs))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("language", _language),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("secrets", _secrets),
    ("packing", _packing),
]

#: SQL can express neither the network nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shelf.put(docs)
    return docs
