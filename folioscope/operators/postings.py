"""The inverted index: postings, document figures, corpus figures.

A posting is one term's positions in one row.  Postings are written in segments: each task inverts the
rows that it reads, a few million tokens at a time, and writes every segment sorted by term and row, so
building the index moves no token between tasks and sorts nothing beyond a segment.  A query reads only
the pages that its few terms lie in and never tokenises a text.  Each posting has its row's length, so
scoring joins nothing, and nothing that ranks reads the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.analysis import ANALYSERS, FINAL_FORM, Letters, letters, stem

#: Tokens that are inverted at once, about, but for a longer row; a token's bytes with what follows it; and rows of an
#: Arrow batch that is handed back.
SEGMENT_TOKENS = 2_000_000
TOKEN_BYTES = 6
BATCH_ROWS = 50_000


@dataclass(frozen=True)
class Index:
    """postings(term, rowid, pos, doc_len), docs(rowid, doc_len, ...), and the number and mean length of rows.

    ``pos`` lists a term's positions in a row, ascending.  ``unique``: no id is that of two rows, so a term
    and an id have one posting.
    """

    postings: DataFrame
    docs: DataFrame
    rows: int
    mean: float
    analyser: str = "simple"
    unique: bool = True


def _runs(texts) -> tuple:
    """Runs of ASCII letters and digits and of all characters beyond ASCII: their number in each text, and all of them.

    Letters A-Z are lower-cased; runs are byte strings.
    """
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.binary())
    kept = np.zeros(256, np.uint8)
    for c in (*range(48, 58), *range(97, 123), *range(128, 256)):
        kept[c] = c
    kept[65:91] = kept[97:123]
    own = kept[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    inside = own != 0
    at = offsets - offsets[0]
    heads = at[:-1][at[:-1] < at[1:]]  # runs end with their text
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[heads] = inside[heads]
    ends[:-1] &= ~inside[1:]
    ends[heads[1:] - 1] = inside[heads[1:] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    places = np.concatenate([[0], np.cumsum(ends + 1 - begins)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(own[inside])])
    return np.diff(np.searchsorted(begins, at)), found


def _order(key):
    """A stable order of numbers from 0, by 16 bits at a time."""
    import numpy as np

    by = np.argsort(key.astype(np.uint16), kind="stable")
    for bits in range(16, int(key.max(initial=0)).bit_length(), 16):
        by = by[np.argsort((key >> bits).astype(np.uint16)[by], kind="stable")]
    return by


def _inverter(fields: int, attributes: list[str], table: Letters, stems: bool) -> Callable[[Iterator], Iterator]:
    """Arrow batches of (rowid, t0, ..., attributes...), t0 a text, to batches of (term, rowid, pos, doc_len, attributes...)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        def terms_of(runs: pa.Array) -> tuple:
            """Distinct terms of distinct runs; each run's number of terms, the first one's place, and codes by place."""
            size, first = np.ones(len(runs), np.int64), np.arange(len(runs))
            offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
            data = np.frombuffer(runs.buffers()[2] or b"", np.uint8)[: offsets[-1]]
            odd = np.zeros(len(runs), bool)
            odd[np.searchsorted(offsets, np.flatnonzero(data >= 128), "right") - 1] = True
            parts = [table.terms(x.decode("utf-8", "replace")) for x in runs.filter(pa.array(odd)).to_pylist()]
            plain = runs.filter(pa.array(~odd)).cast(pa.string())
            size[odd] = [len(x) for x in parts]
            first[~odd] = np.arange(len(plain))
            first[odd] = len(plain) + np.cumsum(size[odd]) - size[odd]
            words = pa.concat_arrays([plain, pa.array([t for x in parts for t in x], pa.string())])
            if stems:
                words = pa.array([stem(w) for w in words.to_pylist()], pa.string())
            coded = words.dictionary_encode()
            return coded.dictionary, size, first, np.asarray(coded.indices)

        def inverted(part: pa.RecordBatch) -> pa.Table:
            n, begin = part.num_rows, np.zeros(part.num_rows, np.int64)
            found = [_runs(part.column(f"t{k}")) for k in range(fields)]
            coded = pa.concat_arrays([x for _, x in found]).dictionary_encode()
            terms, number, first, codes = terms_of(coded.dictionary)
            code = np.asarray(coded.indices)
            rows = np.concatenate([np.repeat(np.arange(n), size) for size, _ in found])
            times = number[code]
            ends = np.cumsum(times)
            cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) for _, x in found)])]
            if (times != 1).any():
                rows = np.repeat(rows, times)
                code = codes[np.repeat(first[code] - (ends - times), times) + np.arange(len(rows))]
            else:
                code = codes[first[code]]
            places = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                size = np.bincount(rows[a:b], minlength=n)
                places.append(np.arange(b - a) + np.repeat(begin - (np.cumsum(size) - size), size))
                begin = begin + size + 1
            length = (begin - fields).astype(np.int32)
            order = np.asarray(pa.compute.sort_indices(terms))
            rank = np.empty(len(terms), np.int64)
            rank[order] = np.arange(len(terms))
            key = rank[code] * n + rows
            by = _order(key)  # fields follow one another, so positions stay in order
            key = key[by]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            row = key[at] % n
            empty, whole = pa.nulls(n, terms.type), np.arange(n)
            ends = np.concatenate([np.zeros(n, np.int32), at, [len(key)]]).astype(np.int32)
            columns = {
                "term": pa.concat_arrays([empty, terms.take(pa.array(order[key[at] // n]))]),
                "rowid": part.column("rowid").take(pa.array(np.concatenate([whole, row]))),
                "pos": pa.ListArray.from_arrays(ends, np.concatenate(places)[by].astype(np.int32)),
                "doc_len": pa.array(length[np.concatenate([whole, row])]),
            }
            for c in attributes:
                own = part.column(f"a_{c}")
                columns[f"a_{c}"] = pa.concat_arrays([own, pa.nulls(len(at), own.type)])
            return pa.table(columns)

        for batch in batches:
            size = sum(np.asarray(pa.compute.binary_length(batch.column(f"t{k}")), np.int64) for k in range(fields))
            segment, begin = np.cumsum(size) // (TOKEN_BYTES * SEGMENT_TOKENS), 0
            for end in [*np.flatnonzero(np.diff(segment)) + 1, batch.num_rows]:
                if end > begin:
                    yield from inverted(batch.slice(begin, end - begin)).to_batches(BATCH_ROWS)
                begin = end

    return run


def _text(field: str) -> Column:
    """A field as it is tokenised; where lower case depends on neighbours, lower-cased already."""
    own = F.coalesce(F.col(field), F.lit(""))
    return F.when(F.contains(own, F.lit(FINAL_FORM)), F.lower(own)).otherwise(own)


def _inverted(texts: DataFrame, attributes: list[str], analyser: str, fields: tuple[str, ...]) -> DataFrame:
    """Postings, and for each row one with a null term that has its attributes (as ``a_<name>``)."""
    listed = texts.select("rowid", *(_text(c).alias(f"t{k}") for k, c in enumerate(fields)), *(F.col(c).alias(f"a_{c}") for c in attributes))
    own = [T.StructField(f"a_{c}", texts.schema[c].dataType) for c in attributes]
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField("rowid", texts.schema["rowid"].dataType), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("doc_len", T.IntegerType()), *own])
    return listed.mapInArrow(_inverter(len(fields), attributes, letters(analyser), ANALYSERS[analyser][1]), out)


def postings_of(texts: DataFrame, analyser: str = "simple", *fields: str) -> DataFrame:
    """(term, rowid, pos, doc_len) of every term of each row's fields (``text``); rowid as given.

    Between fields a position is left free, so no phrase goes over the end of one.
    """
    return _inverted(texts, [], analyser, fields or ("text",)).filter("term IS NOT NULL")


def save(texts: DataFrame, path: str, attributes: list[str], analyser: str = "simple", fields: tuple[str, ...] = ("text",)) -> None:
    """Writes the index of texts(rowid, fields..., attributes...) below ``path``."""
    spark = texts.sparkSession
    if texts.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        texts = texts.select("rowid", *dict.fromkeys([*fields, *attributes])).repartition("rowid")  # a single file is read by one task
    # texts are tokenised once: the rows of docs are written with the postings and copied from there
    _inverted(texts, attributes, analyser, fields).write.mode("overwrite").parquet(f"{path}/postings")
    whole = spark.read.parquet(f"{path}/postings").filter("term IS NULL")
    whole.select("rowid", *(F.col(f"a_{c}").alias(c) for c in attributes), F.col("doc_len").cast("long").alias("doc_len")).write.mode("overwrite").parquet(f"{path}/docs")
    by_id = spark.read.parquet(f"{path}/docs").groupBy("rowid").agg(F.count("*").alias("n"), F.sum("doc_len").alias("len"))
    figures = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.sum("len") / F.sum("n")).alias("mean"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("unique"))
    figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark: SparkSession, path: str, analyser: str = "simple") -> Index:
    figures = spark.read.parquet(f"{path}/corpus").first()
    postings = spark.read.parquet(f"{path}/postings").filter("term IS NOT NULL").select("term", "rowid", "pos", "doc_len")
    return Index(postings, spark.read.parquet(f"{path}/docs"), figures.rows, figures.mean or 0.0, analyser, figures.unique)


def term_df(index: Index, terms: list[str] | None = None) -> DataFrame:
    """Rows in which each term occurs."""
    found = index.postings if terms is None else index.postings.filter(F.col("term").isin(terms))
    pairs = found.select("term", "rowid")
    return (pairs if index.unique else pairs.distinct()).groupBy("term").agg(F.count("rowid").alias("df"))
