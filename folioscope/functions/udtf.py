"""Table functions for SQL: ``SELECT * FROM tokenize('some text')`` gives (pos, term)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioscope.functions.analysis import python_terms


class Tokenize:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(python_terms(text or ""))


def register(spark: SparkSession) -> None:
    """Makes ``tokenize`` known to the session's SQL."""
    spark.udtf.register("tokenize", udtf(Tokenize, returnType="pos int, term string"))
