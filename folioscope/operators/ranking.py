"""Ranking operators: fusion of ranked lists, a cap per work, paging, facets, snippets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.analysis import ANALYSERS, collapse, porter, python_terms


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def ranked(rows: DataFrame, n: int, *order: Column, out: str = "rank") -> DataFrame:
    """The n first rows with their places from 1; n bounds what the one window task holds."""
    return top(rows, n, *order).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def rrf(lists: list[DataFrame], k: int = 60, n: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of frames (rowid, rank): rowid and score, best first, ties by rowid."""
    both = reduce(DataFrame.unionByName, (x.select("rowid", "rank") for x in lists))
    out = both.groupBy("rowid").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), F.asc("rowid"))
    return out if n is None else out.limit(n)


def capped(rows: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows of each work; Spark limits the groups before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def paged(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def facets(rows: DataFrame, column: str, n: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(n)).orderBy(F.desc(n), F.asc(column))


def snippets(rows: DataFrame, phrases: list[str], analyser: str = "simple", tokens: int = 18, chars: int = 160, text: str = "text") -> DataFrame:
    """A column ``snippet`` for the few rows of a page of results.

    The window of ``tokens`` words with the most distinct query terms, the earliest of such, its hits
    in <mark>; rows without a hit give their first characters.
    """
    stems = ANALYSERS[analyser][1]
    wanted = {t for p in phrases for t in python_terms(p, analyser)}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        word = regex.compile(r"[\p{L}\p{N}]+")

        def one(x: str | None) -> str | None:
            spans = [(m.start(), m.end(), porter(m.group().lower()) if stems else m.group().lower()) for m in word.finditer(x or "")]
            hits = [i for i, s in enumerate(spans) if s[2] in wanted]
            if not hits:
                return None
            def score(i: int) -> tuple[int, int]:
                return len({spans[j][2] for j in hits if i <= j < i + tokens}), -i

            start = max((max(0, min(i, len(spans) - tokens)) for i in hits), key=score)
            end = min(len(spans), start + tokens)
            out, at = [], spans[start][0]
            for a, b, term in spans[start:end]:
                out += [x[at:a], f"<mark>{x[a:b]}</mark>" if term in wanted else x[a:b]]
                at = b
            return (" … " if start else "") + "".join(out) + (" … " if end < len(spans) else "")

        for batch in batches:
            yield batch.map(one)

    flat = collapse(F.coalesce(F.col(text), F.lit("")))
    start = F.concat(F.substring(flat, 1, chars), F.when(F.char_length(flat) > chars, F.lit(" …")).otherwise(F.lit("")))
    if not wanted:
        return rows.withColumn("snippet", start)
    return rows.withColumn("snippet", F.coalesce(F.pandas_udf(run, "string")(text), start))
