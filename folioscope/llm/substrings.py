"""Operator 5: substring de-duplication by MinHash banding of paragraphs.

A passage often stands inside text of its own, so line ends do not tell paragraphs: every stretch of
``SPAN`` words is a paragraph.  Its set are its shingles of ``SHINGLE`` words, and its signature is one
band of one row, the MinHash sample of that set.  Neighbouring paragraphs mostly have the same sample;
it is kept once, with its place.  This is the tuning for high recall: equal paragraphs always share
the band, so documents that share ``SPAN`` words in a row, and thus any with a passage of ``PASSAGE``
words of similarity 0.8 (one changed word in about 45), collide for certain; twelve words keep chance
collisions rare however large the corpus is.

Paragraphs that share a band are joined with the one of the smallest document, the keeper, never with
each other.  Samples that follow the keeper's without a hole make up a run of equal words.  Both sides of
a run carry ``REACH`` words around it, which are compared word by word: the equal stretch is found
exactly, and past a gap of ``GAP`` differing words at most a second one of five words or more.  Stretches of a document that touch, or have ``GAP`` words or fewer between them, are a
passage if they are ``PASSAGE`` words long together and their five-word shingles have a Jaccard
similarity of 0.8 to the other side's.

Only words that stand in the same order in a document of smaller id are taken out, so what a near copy
has of its own stays, and each removed stretch stands in an earlier document.  Removals are clustered
by connected components of the documents that share passages.

Defined results: null, empty and wordless texts have no paragraphs and are their own component, as is
a null id, which neither gives nor takes passages; texts of fewer than ``PASSAGE`` words have no
passage; rows of one id are one document, and a repetition inside one document is none; in text that
repeats the same few words some equal shingles are left out; where a document shares overlapping
stretches with several earlier ones, up to ``SHINGLE`` words at an end may be left in; whole texts are
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_BYTES, Shelf, release_memory, slices
from folioscope.llm.components import components
from folioscope.llm.shingles import chunks, mix, power, words

SHINGLE = 12
SPAN = 24
#: Words of a passage, and the similarity of its five-word shingles as a fraction.
PASSAGE = 50
PER, OF, K = 80, 100, 5
GAP = 6
REACH = 24

_U = np.uint64
_TURN = 0xC2B2AE3D27D4EB4F | 1
_BACK = pow(_TURN, -1, 1 << 64)


def _digests(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each range of words, wherever it stands."""
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power(_TURN, len(hashes))[: len(hashes)], out=total[1:])
    return mix((total[ends] - total[starts]) * power(_BACK, len(hashes) + 1)[starts] + (ends - starts).astype(_U))


def samples(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the samples of all paragraphs; a text shorter than ``SPAN`` is one paragraph."""
    choice = SPAN - SHINGLE + 1
    count = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    place = np.concatenate(([0], np.cumsum(count)))
    start = np.arange(place[-1]) - np.repeat(place[:-1], count) + np.repeat(first[:-1], count)
    value = _digests(hashes, start, start + SHINGLE) if len(start) else np.zeros(0, _U)
    least, at, span = value, np.arange(len(value)), 1
    while span < choice and len(least):  # the last smallest of ever more neighbours
        step = min(span, choice - span)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    room = (np.repeat(place[1:], count) - np.arange(len(value)))[: len(at)] >= choice
    few = [place[i + 1] - 1 - np.argmin(value[place[i] : place[i + 1]][::-1]) for i in np.flatnonzero((count > 0) & (count < choice))]
    picked = np.unique(np.concatenate((at[room], np.array(few, np.int64))))
    start, digest = start[picked], value[picked].view(np.int64)
    # of equal samples close together, as in the same few words over and over, the first, the last and some between stay
    same = np.zeros(len(start) + 1, bool)
    same[1:-1] = (digest[1:] == digest[:-1]) & (np.diff(start) < SHINGLE)
    run = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(start)))) if len(start) else start
    step = (start - start[run]) // (choice // 2)
    inner = same[:-1] & same[1:] & (step == np.append(-1, step[:-1])[: len(step)])
    return start[~inner], digest[~inner]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text")
    )


def bands(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of the text), at (word), digest: the samples of all texts of ``PASSAGE`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            ids, tags, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                hashes, first = words(texts[lo:hi], WORD_BYTES)
                start, digest = samples(hashes, first)
                text = np.searchsorted(first, start, "right") - 1
                long = np.diff(first)[text] >= PASSAGE
                start, digest, text = start[long], digest[long], text[long]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(ids[text + lo], pa.int64()), "tag": pa.array(tags[text + lo], pa.int64()), "at": pa.array(start - first[text], pa.int32()), "digest": pa.array(digest)}
                )
        release_memory()

    return _keyed(docs).mapInArrow(run, "doc_id long, tag long, at int, digest long")


def _merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Samples of a text that follow its keeper's without a hole between them, as runs (lo, hi, keeper, k_tag, k_lo).

    Their shingles touch, so all words of a run are equal, and only its two ends are left to compare.
    """
    for batch in batches:
        parts = []
        for part in slices(batch):
            flat, row = part.flatten(), np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            at, keeper, k_tag, k_at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "keeper", "k_tag", "k_at"))
            order = np.lexsort((at, at - k_at, k_tag, keeper, row))
            keys = [c[order] for c in (row, keeper, k_tag, at - k_at)]
            at = at[order]
            begins = np.ones(len(at), bool)
            begins[1:] = np.any([c[1:] != c[:-1] for c in keys], 0) | (np.diff(at) > SHINGLE)
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            runs = [at[first], at[last] + np.int32(SHINGLE), keys[1][first], keys[2][first], k_at[order][first]]
            ends = np.concatenate(([0], np.cumsum(np.bincount(keys[0][first], minlength=len(part)))))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in runs], ["lo", "hi", "keeper", "k_tag", "k_lo"])))
        if parts:
            yield pa.concat_arrays(parts)
    release_memory()


_RUN = "lo:int,hi:int,keeper:long,k_tag:long,k_lo:int"
_CONTEXT = "doc_id long, tag long, lo int, hi int, keeper long, k_tag long, k_lo int, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``REACH`` words before (nearest first) and behind the runs ``u`` of each text.

    A word is four bytes of its hash; zero stands for no word.
    """
    steps = np.arange(REACH)
    for b in (part for batch in batches for part in slices(batch, 128)):
        texts, found = b.column("text").to_pylist(), b.column("u")
        for lo, hi in chunks(texts):
            hashes, first = words(texts[lo:hi], WORD_BYTES)
            code = np.append((hashes.astype(np.uint32) | np.uint32(1)).astype("<u4"), np.zeros(1, "<u4"))
            part = found.slice(lo, hi - lo)
            count, flat = part.value_lengths().to_numpy(), part.flatten()
            begin, end = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            text = np.repeat(np.arange(hi - lo), count)
            start, n = first[text], np.diff(first)[text]
            sides = []
            for room, place in ((begin, (start + begin)[:, None] - 1 - steps), (n - end, (start + end)[:, None] + steps)):
                around = code[np.where(steps < room[:, None], place, len(code) - 1)]
                ends = pa.py_buffer(np.arange(0, 4 * REACH * len(begin) + 1, 4 * REACH, dtype=np.int32))
                sides.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, ends, pa.py_buffer(around.tobytes())]))
            take = lambda c, lo=lo, hi=hi, text=text: b.column(c).slice(lo, hi - lo).take(pa.array(text))  # noqa: E731, B023
            columns = [take("doc_id"), take("tag"), *(flat.field(c) for c in ("lo", "hi", "keeper", "k_tag", "k_lo")), *sides]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CONTEXT.split(", ")])
    release_memory()


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far rows of words agree: all words reached, those before a gap, those behind it, in one number.

    The number grows with the reach, so the greatest is the best.
    """
    n = a.shape[1]
    same = np.concatenate(((a == b) & (a != 0), np.zeros((len(a), 1), bool)), 1)
    exact = np.argmin(same, 1)
    cut = np.arange(n + 1)[None, :]
    best = np.stack((exact, exact, np.zeros_like(exact)), 1)
    for gap in range(1, GAP + 1):  # the nearest five words that agree again
        begin = np.minimum(exact + gap, n)
        more = np.argmax(~same & (cut >= begin[:, None]), 1) - begin
        fine = (more >= K) & (best[:, 2] == 0)
        best[fine] = np.stack((begin + more, exact, more), 1)[fine]
    return (best[:, 0].astype(np.int64) << 32) | (best[:, 1].astype(np.int64) << 16) | best[:, 2]


def _compared(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in batches:
        rows = [np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, REACH) if len(c) else np.zeros((0, REACH), "<u4") for c in columns]
        yield pa.StructArray.from_arrays([pa.array(_agreement(rows[0], rows[2])), pa.array(_agreement(rows[1], rows[3]))], ["l", "r"])


def _pieces(lo: int, hi: int, left: int, right: int) -> list[tuple[int, int]]:
    """Word ranges that agree in and around a run."""
    out = [(lo - (left >> 16 & 0xFFFF), hi + (right >> 16 & 0xFFFF))]
    if m := left & 0xFFFF:
        out.append((lo - (left >> 32), lo - (left >> 32) + m))
    if m := right & 0xFFFF:
        end = hi + (right >> 32)
        out.append((end - m, end))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def passages_of(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The word ranges that belong to passages, of all that agree."""
    parts = _union(pieces)
    common = [max(0, hi - lo - K + 1) for lo, hi in parts]
    keep = [hi - lo >= PASSAGE for lo, hi in parts]
    for i in range(len(parts)):
        shared, j = common[i], i
        while j + 1 < len(parts) and parts[j][1] - parts[i][0] < PASSAGE and parts[j + 1][0] - parts[j][1] <= GAP:
            j += 1
            shared += common[j]
        whole = parts[j][1] - parts[i][0]
        if j > i and whole >= PASSAGE and OF * shared >= PER * (2 * (whole - K + 1) - shared):
            keep[i : j + 1] = [True] * (j + 1 - i)
    return [p for p, k in zip(parts, keep, strict=True) if k]


def _within(spans: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans inside the parts; both in order, no span crosses the border of a part."""
    out, k = [], 0
    for lo, hi in spans:
        while k < len(parts) and parts[k][1] < hi:
            k += 1
        if k < len(parts) and parts[k][0] <= lo:
            out.append((lo, hi))
    return out


def _common(spans: list[tuple[int, int]], parts: list[tuple[int, int]], shift: int) -> list[tuple[int, int]]:
    """The words of the spans that are in the parts when they are moved by ``shift``."""
    cut = ((max(lo, a + shift), min(hi, b + shift)) for lo, hi in spans for a, b in parts)
    return [(lo, hi) for lo, hi in cut if lo < hi]


def _found(rows: list[tuple[int, int, int, int, int | None, int | None]]) -> dict:
    """Repeated and lost stretches of one text, and the earlier documents that hold the lost ones.

    A row with ``k_lo`` is a second place in the keeper itself; it counts as far as the first one is shared.
    """
    found = [(_pieces(lo, hi, left, right), keeper) for lo, hi, left, right, keeper, k_lo in rows if k_lo is None]
    shared = _union([p for pieces, _ in found for p in pieces])
    again = [p for lo, hi, left, right, _, k_lo in rows if k_lo is not None for p in _common(_pieces(lo, hi, left, right), shared, lo - k_lo)]
    repeated = passages_of(shared + again)
    lost = _within(_union([p for pieces, keeper in found if keeper is not None for p in pieces]), repeated)
    links = {keeper for pieces, keeper in found if keeper is not None and _within(sorted(pieces), repeated)}
    pack = lambda spans: [{"lo": lo, "hi": hi} for lo, hi in spans]
    return {"repeated": pack(repeated), "lost": pack(lost), "links": sorted(links)}


_SPANS = "array<struct<lo:int,hi:int>>"


def _gathered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    kind = pa.struct([("repeated", spans), ("lost", spans), ("links", pa.list_(pa.int64()))])
    for batch in batches:
        parts = []
        for part in slices(batch):
            count, flat = part.value_lengths().to_numpy(), part.flatten()
            rows = list(zip(*(flat.field(c).to_pylist() for c in ("lo", "hi", "l", "r", "keeper", "k_lo")), strict=True))
            ends = np.cumsum(count).tolist()
            parts.append(pa.array([_found(rows[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)], kind))
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)
    release_memory()


def passages(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """doc_id, tag, repeated and lost (arrays of first word and end), links: for texts with passages."""
    shelf = shelf or Shelf(docs.sparkSession)
    own = shelf.put(bands(docs))
    # written down, so that joins with them have exchanges of their own, which adaptive execution can split
    shared = shelf.put(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first != last").drop("last"))
    hits = shelf.put(own.join(shared, "digest"))
    shelf.drop(own, shared)
    shelf.sweep()
    first = hits.filter("doc_id = first").groupBy("digest").agg(F.min(F.struct("tag", "at")).alias("k"))
    keepers = shelf.put(first.select("digest", F.col("k.tag").alias("k_tag"), F.col("k.at").alias("k_at")))
    others = hits.join(keepers, "digest").filter("doc_id != first or tag != k_tag or at != k_at")
    sample = F.struct("at", F.col("first").alias("keeper"), "k_tag", "k_at")
    merged = F.arrow_udf(_merged, f"array<struct<{_RUN}>>")
    runs = shelf.put(others.groupBy("doc_id", "tag").agg(F.collect_set(sample).alias("u")).select("doc_id", "tag", F.inline(merged("u"))))
    shelf.drop(hits, keepers)
    shelf.sweep()
    # the keepers' places are asked for in the same reading of the texts
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("keeper", "long"), ("k_tag", "long"), ("k_lo", "int"))]
    places = runs.select(F.col("keeper").alias("doc_id"), F.col("k_tag").alias("tag"), F.col("k_lo").alias("lo"), (F.col("k_lo") + F.col("hi") - F.col("lo")).alias("hi")).distinct()
    asked = shelf.put(runs.unionByName(places.select("*", *nothing)).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi", "keeper", "k_tag", "k_lo")).alias("u")))
    shelf.drop(runs)
    around = shelf.put(asked.join(_keyed(docs), ["doc_id", "tag"]).select("doc_id", "tag", "text", "u").mapInArrow(_contexts, _CONTEXT))
    shelf.drop(asked)
    shelf.sweep()
    renamed = {"doc_id": "keeper", "tag": "k_tag", "lo": "k_lo", "hi": "k_hi", "before": "k_before", "after": "k_after"}
    kept = shelf.put(around.filter("keeper is null").dropDuplicates(["doc_id", "tag", "lo", "hi"]).select(*(F.col(c).alias(n) for c, n in renamed.items())))
    mine = around.filter("keeper is not null").withColumn("k_hi", F.col("k_lo") + F.col("hi") - F.col("lo"))
    compare = F.arrow_udf(_compared, "struct<l:long,r:long>")("before", "after", "k_before", "k_after")
    keys = ["doc_id", "tag", "lo", "hi", "keeper", "k_tag", "k_lo", "k_hi"]
    agreed = shelf.put(mine.join(kept, ["keeper", "k_tag", "k_lo", "k_hi"]).select(*keys, compare.alias("c")).select(*keys, "c.l", "c.r"))
    shelf.drop(around, kept)
    shelf.sweep()
    # the keeper's places reach as far as the best of the others does, its own second ones as far as the first
    own_place, same_text = F.col("keeper") == F.col("doc_id"), F.col("tag") == F.col("k_tag")
    reach = lambda c: F.when(own_place & ~same_text, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    given = agreed.select("doc_id", "tag", "lo", "hi", reach("l"), reach("r"), F.when(~own_place, F.col("keeper")).alias("keeper"), F.when(own_place & same_text, F.col("k_lo")).alias("k_lo"))
    exact = lambda c: F.shiftright(c, 16).bitwiseAND(0xFFFF)
    plain = lambda c: F.max(exact(c) * (2**32 + 2**16)).alias(f"plain_{c}")
    best = agreed.filter(~own_place).groupBy("keeper", "k_tag", "k_lo", "k_hi").agg(F.max("l").alias("l"), F.max("r").alias("r"), plain("l"), plain("r"))
    # the one that reaches furthest may have its gap where another one has none
    reached = F.inline(F.array(F.struct("l", "r"), F.struct(F.col("plain_l").alias("l"), F.col("plain_r").alias("r"))))
    firsts = best.select("keeper", "k_tag", "k_lo", "k_hi", reached).select(F.col("keeper").alias("doc_id"), F.col("k_tag").alias("tag"), F.col("k_lo").alias("lo"), F.col("k_hi").alias("hi"), "l", "r", *nothing[:1], *nothing[2:])
    grouped = given.unionByName(firsts).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi", "l", "r", "keeper", "k_lo")).alias("u"))
    found = grouped.withColumn("x", F.arrow_udf(_gathered, f"struct<repeated:{_SPANS},lost:{_SPANS},links:array<long>>")("u"))
    return found.select("doc_id", "tag", "x.*").filter(F.size("repeated") > 0)


def report(docs: DataFrame) -> DataFrame:
    """Per document: repeated stretches and words in passages, what it loses, and its component."""
    shelf = Shelf(docs.sparkSession)
    found = shelf.put(passages(docs, shelf))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0), lambda n, x: n + x["hi"] - x["lo"]))
    counts = found.groupBy("doc_id").agg(
        F.sum(F.size("repeated")).alias("n_repeated"), total("repeated").alias("repeated_words"), F.sum(F.size("lost")).alias("n_removed"), total("lost").alias("removed_words")
    )
    parts = components(found.select(F.col("doc_id").alias("a"), F.explode("links").alias("b")), shelf)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(counts, "doc_id", "left").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), *(zero(c) for c in ("n_repeated", "repeated_words", "n_removed", "removed_words")))


def _without(text: bytes, spans: list[dict]) -> bytes:
    """The text without those words, from each stretch's first to its last."""
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    parts, at = [], 0
    for x in spans:
        parts.append(text[at : edge[2 * x["lo"]]])
        at = edge[2 * x["hi"] - 1]
    return b"".join([*parts, text[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts have lost the stretches that an earlier document holds; same columns and rows."""
    gone = passages(docs).filter(F.size("lost") > 0).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("lost").alias("_cut"))

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                out.append(None if text is None else _without(text, found or []).decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    joined = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_tag"]), "left")
    text = F.when(gone["_cut"].isNull(), docs["text"]).otherwise(F.arrow_udf(cut, "string")(docs["text"].cast("binary"), gone["_cut"]))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))
