"""The vector layer: building, pruning, coverage and exact top-k by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ranking import top


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x.cast("double") / F.when(norm > 1e-12, norm).otherwise(F.lit(1.0))).cast("float"))


def top_k(vectors: DataFrame, query: list[float], k: int, rows: DataFrame | None = None, key: str = "rowid", vec: str = "vec") -> DataFrame:
    """The k rows (key, score) nearest to one query vector, ties by key; ``rows`` restricts the search.

    The query is a literal, so the scan, the product and a partial top-k run in one stage.
    """
    own = vectors if rows is None else vectors.join(rows.select(key), key, "left_semi")
    asked = F.array(*(F.lit(float(x)) for x in query))
    return top(own.select(key, dot(F.col(vec), asked).alias("score")), k, F.desc("score"), F.asc(key))


def pending(texts: DataFrame, vectors: DataFrame, least: int = 40, key: str = "rowid", text: str = "text") -> DataFrame:
    """Rows long enough that have no vector yet."""
    return texts.filter(F.char_length(text) >= least).join(vectors.select(key), key, "left_anti")


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], model_id: str, chars: int = 1200, key: str = "rowid", text: str = "text") -> DataFrame:
    """(key, vec, model_id) by an injected model; texts are cut to what the model reads."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            found = np.asarray(model(b.tolist()), np.float64).reshape(len(b), -1)
            norm = np.sqrt((found**2).sum(1, keepdims=True))
            yield pd.Series(list((found / np.where(norm > 1e-12, norm, 1.0)).astype(np.float32)))

    vec = F.pandas_udf(run, "array<float>")(F.substring(text, 1, chars))
    return texts.select(key, vec.alias("vec"), F.lit(model_id).alias("model_id"))


def build(texts: DataFrame, vectors: DataFrame, model: Callable, model_id: str, least: int = 40, chars: int = 1200) -> DataFrame:
    """All vectors after an incremental build: those of this model that still have a row, and new ones."""
    held = prune(vectors.filter(F.col("model_id") == model_id), texts)
    return held.select("rowid", "vec", "model_id").unionByName(embed(pending(texts, held, least), model, model_id, chars))


def build_in_batches(texts: DataFrame, table, model: Callable, model_id: str, least: int = 40, chars: int = 1200, rows: int = 1_000_000, stop: Callable[[], bool] = lambda: False) -> Iterator[tuple[int, int]]:
    """An incremental build that is committed batch by batch: yields (rows embedded, rows in all) after each.

    ``table`` is a ``Versioned`` table of vectors; each batch is one appended version, so a build that was
    stopped, by ``stop`` or a lost job, goes on with what is still pending.
    """
    spark = texts.sparkSession
    held = table.read() if table.exists() else spark.createDataFrame([], f"rowid {texts.schema['rowid'].dataType.simpleString()}, vec array<float>, model_id string")
    own = prune(held.filter(F.col("model_id") == model_id), texts).select("rowid", "vec", "model_id")
    table.write(own)
    total = pending(texts, table.read(), least).count()
    parts = max(1, -(-total // rows))
    for k in range(parts if total else 0):
        if stop():
            return
        todo = pending(texts.filter(F.pmod(F.xxhash64("rowid"), F.lit(parts)) == k), table.read(), least)
        table.append(embed(todo, model, model_id, chars))
        yield total - pending(texts, table.read(), least).count(), total


def reset(table, dim_schema: str = "rowid long, vec array<float>, model_id string") -> None:
    """Empties a table of vectors; the next build makes all anew."""
    table.write(table.spark.createDataFrame([], dim_schema))


def prune(vectors: DataFrame, texts: DataFrame, key: str = "rowid") -> DataFrame:
    """Vectors whose row still exists."""
    return vectors.join(texts.select(key), key, "left_semi")


def coverage(texts: DataFrame, vectors: DataFrame, least: int = 40, key: str = "rowid", text: str = "text") -> DataFrame:
    """One row: pages, skipped (too short), embedded, and the percentage, at most 100."""
    marked = texts.select(key, (F.char_length(F.coalesce(text, F.lit(""))) < least).alias("short")).join(vectors.select(key).distinct().withColumn("has", F.lit(True)), key, "left")
    counts = marked.agg(F.count("*").alias("pages"), F.count_if("short").alias("skipped"), F.count_if(F.col("has").isNotNull()).alias("embedded"))
    todo = F.col("pages") - F.col("skipped")
    return counts.withColumn("pct", F.least(F.lit(100), F.when(todo > 0, F.round(100 * F.col("embedded") / todo)).otherwise(F.lit(0))).cast("int"))


def ready(coverage_row, dim: int, min_vectors: int = 100, min_coverage: int = 20) -> bool:
    """Whether the layer may take part in ranking."""
    return bool(dim) and coverage_row.embedded >= min_vectors and coverage_row.pct >= min_coverage
