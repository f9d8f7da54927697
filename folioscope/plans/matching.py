"""A query tree compiled to a DataFrame plan over postings: matched rows with BM25 scores.

Postings are first cut down to the query's terms, a filter that reaches the Parquet scan.  Each distinct
phrase becomes (phrase, rowid, f): the length of a posting for one term, a join of postings by row for
several, which keeps the positions that follow one another.  One aggregate per row then yields the score
and tests the tree, so rows meet in one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import Options
from folioscope.functions.analysis import python_terms
from folioscope.operators.postings import Index
from folioscope.plans.querylang import Query


def phrase_counts(index: Index, phrases: list[list[str]]) -> DataFrame:
    """(phrase, rowid, f, doc_len): occurrences of each phrase (a list of terms) in each row that has it."""
    terms = sorted({t for p in phrases for t in p})
    hits = index.postings.filter(F.col("term").isin(terms))
    parts = []
    single = {p[0]: i for i, p in enumerate(phrases) if len(p) == 1}
    if single:
        number = F.create_map(*(x for t, i in single.items() for x in (F.lit(t), F.lit(i))))
        own = hits.filter(F.col("term").isin(list(single)))
        if index.unique:
            own = own.select("term", "rowid", F.size("pos").cast("long").alias("f"), "doc_len")
        else:
            own = own.groupBy("term", "rowid").agg(F.sum(F.size("pos")).alias("f"), F.max("doc_len").alias("doc_len"))
        parts.append(own.select(number[F.col("term")].alias("phrase"), "rowid", "f", "doc_len"))
    for i, p in enumerate(phrases):
        if len(p) > 1:
            parts.append(_phrase(index, hits, p).select(F.lit(i).alias("phrase"), "rowid", "f", "doc_len"))
    return reduce(DataFrame.unionByName, parts)


def _phrase(index: Index, hits: DataFrame, terms: list[str]) -> DataFrame:
    """(rowid, f, doc_len): where the terms stand one after another."""
    if not index.unique:  # rows that share an id count as one row whose positions repeat
        hits = hits.withColumn("pos", F.explode("pos"))
    at = hits.filter(F.col("term") == terms[0]).select("rowid", "pos", "doc_len")
    for k, term in enumerate(terms[1:], 1):
        nxt = hits.filter(F.col("term") == term)
        if index.unique:
            begins = F.array_intersect("pos", F.transform("next", _back(k)))
            at = at.join(nxt.select("rowid", F.col("pos").alias("next")), "rowid").select("rowid", begins.alias("pos"), "doc_len").filter(F.size("pos") > 0)
        else:
            at = at.join(nxt.select("rowid", (F.col("pos") - k).alias("pos")), ["rowid", "pos"])
    if index.unique:
        return at.select("rowid", F.size("pos").cast("long").alias("f"), "doc_len")
    return at.groupBy("rowid").agg(F.count("*").alias("f"), F.max("doc_len").alias("doc_len"))


def _back(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def idf(rows: int, n: Column) -> Column:
    raw = F.log((F.lit(float(rows)) - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def matched(index: Index, query: Query, options: Options | None = None) -> DataFrame:
    """(rowid, score) of the rows that satisfy the query; greater is better."""
    options = options or Options()
    as_terms = lambda p: tuple(python_terms(p, index.analyser))
    groups = [[t for t in map(as_terms, g) if t] for g in query.groups]
    excluded = [t for t in map(as_terms, query.excluded) if t]
    if not all(groups):  # a group of phrases without a term can't match
        return index.docs.select("rowid", F.lit(0.0).alias("score")).limit(0)
    wanted = list(dict.fromkeys(t for g in groups for t in g))
    phrases = list(dict.fromkeys([*wanted, *excluded]))
    place = {p: i for i, p in enumerate(phrases)}
    counts = phrase_counts(index, [list(p) for p in phrases])
    # a handful of rows, one for each phrase of the query
    spread = counts.groupBy("phrase").agg(F.count("*").alias("n"))
    weights = spread.select("phrase", idf(index.rows, F.col("n").cast("double")).alias("idf"))
    norm = options.k1 * (1 - options.b + options.b * F.col("doc_len") / F.lit(index.mean or 1.0))
    scored = counts.join(F.broadcast(weights), "phrase")
    part = F.col("idf") * F.col("f") * (options.k1 + 1) / (F.col("f") + norm)
    held = [F.max(F.col("phrase") == i) for i in range(len(phrases))]
    # a phrase named in several groups counts once for each of them
    times = F.create_map(*(x for p in wanted for x in (F.lit(place[p]), F.lit(float(sum(g.count(p) for g in groups))))))
    rows = scored.groupBy("rowid").agg(F.sum(F.when(F.col("phrase").isin([place[p] for p in wanted]), part * times[F.col("phrase")])).alias("score"), *(h.alias(f"h{i}") for i, h in enumerate(held)))
    keep = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.col(f"h{place[p]}") for p in g)) for g in groups))
    for p in excluded:
        keep = keep & ~F.col(f"h{place[p]}")
    return rows.filter(keep).select("rowid", "score")
