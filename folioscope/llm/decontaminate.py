"""Operator 1: benchmark decontamination with a generalised suffix automaton.

The words of all test items form one suffix automaton.  Training words are streamed through it; at
each word the automaton knows the longest run of words, ending there, that occurs inside an item.
Where the run reaches ``window`` words, all its words are hit, and the state that holds the run's
last ``window`` words names the items.  A cheap gate goes first: only stretches whose neighbouring
words are neighbours in some item too can hold a window, so all else is skipped unread.

Defined results: null, empty or wordless texts have no words and no hits; null, empty or wordless
items are never found; a null item id marks words but names no item; repeated items count once per
id; rows are never merged, so repeated documents each get their own result; input columns with the
names of the result columns are replaced.  Any text is held whole by one task at a time.

Test items are shipped to the executors in passes of at most ``PASS_BYTES`` of text; a benchmark
beyond that takes several passes, with the hits of earlier passes kept in shared storage between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_BYTES, Shelf, release_memory, split_words, text_bytes

#: Item text in one automaton; about 100 MB of Python objects in each worker.
PASS_BYTES = 1_000_000
WINDOW = 8

_RESULT = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,text:string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, data in items:
            if words := split_words(data):
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        for _, ids in sequences:
            self._insert(ids)
        self._label(sequences)
        self._gate(sequences)

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _label(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        n, link, length, window = len(self.next), self.link, self.length, self.window
        #: For a state of at least a window's length: the state of its last window.
        self.base = [0] * n
        for v in sorted(range(n), key=length.__getitem__):
            if length[v] >= window:
                self.base[v] = v if length[link[v]] < window else self.base[link[v]]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for item, ids in sequences:
            v = 0
            for i, w in enumerate(ids):
                v = self.next[v][w]
                if i + 1 >= window:
                    self.items.setdefault(self.base[v], set()).update([item] if item is not None else [])
            if len(ids) < window:
                while length[link[v]] >= len(ids):
                    v = link[v]
                self.short.setdefault(v, (len(ids), set()))[1].update([item] if item is not None else [])
        #: The nearest state on the suffix path, itself included, that is a whole short item.
        self.near = [-1] * n
        for v in sorted(range(n), key=length.__getitem__):
            self.near[v] = v if v in self.short else self.near[link[v]] if v else -1

    def _gate(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        self.least = min([self.window, *(len(ids) for _, ids in sequences)])
        pairs = {a * (len(self.vocabulary) + 1) + b for _, ids in sequences for a, b in zip(ids, ids[1:], strict=False)}
        self.bits = max(16, (64 * len(pairs)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        if pairs:
            self.table[self._slot(np.fromiter(pairs, np.uint64, len(pairs)))] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where a window may be: maximal stretches of words in an item's vocabulary and neighbourhoods."""
        if self.least == 1:
            ok, more = ids > 0, 0
        else:
            known = ids > 0
            codes = ids[:-1].astype(np.uint64) * np.uint64(len(self.vocabulary) + 1) + ids[1:].astype(np.uint64)
            ok, more = self.table[self._slot(codes)] & known[:-1] & known[1:], 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + more
        keep = ends - starts >= self.least
        return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word intervals, merged and in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.least or not self.vocabulary:
            return spans, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        nxt, link, length, window = self.next, self.link, self.length, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                before = spans.pop()
                start, end = min(start, before[0]), max(end, before[1])
            spans.append((start, end))

        for lo, hi in self.stretches(ids):
            v = run = 0
            for i, w in enumerate(ids[lo:hi].tolist(), lo):
                while v and w not in nxt[v]:
                    v = link[v]
                    run = length[v]
                if w in nxt[v]:
                    v = nxt[v][w]
                    run += 1
                else:
                    run = 0
                    continue
                if run >= window:
                    hit(i + 1 - run, i + 1)
                    items |= self.items[self.base[v]]
                u = self.near[v]
                while u > 0:
                    n, names = self.short[u]
                    if n <= run:
                        hit(i + 1 - n, i + 1)
                        items |= names
                    u = self.near[link[u]]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    own = items.select(F.col(id_col).cast("string").alias("item"), text_bytes(text_col).alias("data"))
    size = own.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    for k in range(passes):
        part = own if passes == 1 else own.filter(F.pmod(F.xxhash64("data"), F.lit(passes)) == k)
        yield Automaton([(r.item, bytes(r.data)) for r in part.collect()], window)


def _cut_all(data: bytes, spans: list[tuple[int, int]], machine: Automaton) -> bytes:
    """Cuts until nothing is hit, should the words around a cut make a window together."""
    while spans:
        data = _cut(data, spans)
        spans = machine.scan(split_words(data))[0]
    return data


def _scanner(shared, cut: bool):
    """The Arrow function of ``match`` for an automaton that was sent to the executors."""

    def scan(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = shared.value
        for data, spans, names in batches:
            count, hits, ids, texts = [], [], [], []
            for i, text in enumerate(data):
                text = text.as_py()
                words = split_words(text)
                new, own = machine.scan(words)
                new = merged(new + [(x["start"], x["end"]) for x in spans[i].as_py() or []])
                count.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in new])
                ids.append(sorted(own.union(names[i].as_py() or [])))
                texts.append(_cut_all(text, new, machine).decode("utf-8", "replace") if cut and new else None)
            yield pa.StructArray.from_arrays(
                [pa.array(count, pa.int64()), pa.array(hits, _SPANS), pa.array(ids, pa.list_(pa.string())), pa.array(texts, pa.string())], ["n_words", "spans", "items", "text"]
            )
        release_memory()

    return scan


def match(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "match", cut: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hit word spans (end exclusive), item ids.

    With ``cut`` it also has the text without the spans, where there are any.
    """
    spark = docs.sparkSession
    found, shelf = docs, Shelf(spark)
    nothing = (F.lit(None).cast("array<struct<start:long,end:long>>"), F.lit(None).cast("array<string>"))
    for k, automaton in enumerate(_automata(items, item_id, item_text, window)):
        if k:  # a benchmark of several passes: each adds to what the earlier ones found
            found = shelf.put(found)
        before = (F.col(f"{out}.spans"), F.col(f"{out}.items")) if k else nothing
        # not to be evaluated again where a filter on its result is moved below it
        scan = F.arrow_udf(_scanner(spark.sparkContext.broadcast(automaton), cut), _RESULT).asNondeterministic()
        found = found.withColumn(out, scan(text_bytes(text_col), *before))
    return found


def _hit_words(spans) -> F.Column:
    """Number of words in spans that are in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
        F.greatest(a["to"], s["end"]).alias("to"),
    )
    return F.aggregate(spans, start, step, lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit_items: int = 2) -> DataFrame:
    """Per document: counts of words, hit words and items, a digest of the item ids, the verdict."""
    m = match(docs.select("doc_id", "text"), items, window=window, out="_m")
    names = F.array_sort("_m.items")
    return m.select(
        "doc_id",
        F.col("_m.n_words").alias("n_words"),
        _hit_words(F.col("_m.spans")).alias("n_hit"),
        F.size("_m.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (F.size("_m.items") >= limit_items).alias("contaminated"),
    )


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; a line break stands where words were."""
    plain = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : edge[2 * a]])
        at = edge[2 * b - 1]
    return b"\n".join([*parts, data[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_run: int = WINDOW, max_cover: float = 0.5, limit_items: int = 2) -> DataFrame:
    """``docs`` without benchmark passages; same columns.

    Runs of ``max_run`` words or more that stand in an item are cut out of the text.  A document goes
    altogether if windows of ``limit_items`` items occur in it, or if over ``max_cover`` of its words
    are hit.  Texts without hits are unchanged.  A null text stays null.
    """
    found = match(docs, items, text_col, window=max_run, out="_match", cut=True)
    kept = found.filter((F.size("_match.items") < limit_items) & (_hit_words(F.col("_match.spans")) <= F.col("_match.n_words") * F.lit(max_cover)))
    return kept.withColumn(text_col, F.coalesce("_match.text", text_col)).drop("_match")
