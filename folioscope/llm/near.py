"""Near-duplicate links among texts: banded MinHash candidates, odd sketches, exact confirmation.

1. Texts with equal shingle sets form a class; only a class's smallest id goes on.
2. Classes that share a band key are candidates.  No bucket is paired up: each member is compared
   with its bucket's smallest member, and confirmed links are folded into components; then those of
   other components are compared with a member of the bucket's last component.
3. Such a candidate is checked by the sizes of its sets, then by the XOR population count of the odd
   sketches, which throws out pairs far below the threshold, then on the full shingle sets.
4. Buckets that still hold several components are taken together where they share members.  In such a
   group the members outside its largest component are compared with all, in blocks of bounded size,
   on full sets; a block returns only links that join its components.  So no two members of a bucket
   stay apart that ought to be linked, and the work grows with the stragglers, not with the square of
   the group.

An item is an id and a text; rows of one id with several texts are several items of one node, so all
of them give their node links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BLANK_BYTES, Shelf, release_memory, slices
from folioscope.llm.components import components
from folioscope.llm.shingles import Sketcher, chunks, shingles, words


@dataclass(frozen=True)
class Rule:
    """Words by a byte table, shingles of ``k`` words, links at ``per / of`` or more of the union."""

    per: int = 80
    of: int = 100
    k: int = 5
    bands: int = 24
    rows: int = 5
    bits: int = 256
    table: bytes = BLANK_BYTES
    #: Items, and shingles, of a group that one task compares with as many others.
    block_items: int = 1024
    block_shingles: int = 1_000_000
    #: Items (16 bytes each) that may be broadcast to pick texts; more are joined by a shuffle.
    broadcast_ids: int = 500_000
    #: A bucket of more members than this is joined by a broadcast of its key; ``hot_keys`` bounds their number.
    hot_members: int = 1024
    hot_keys: int = 100_000


def _sets(texts: list[bytes], rule: Rule) -> list[np.ndarray]:
    out = []
    for lo, hi in chunks(texts):
        found, place = shingles(*words(texts[lo:hi], rule.table), rule.k)
        out += [np.unique(found[a:b]) for a, b in zip(place, place[1:], strict=False)]
    return out


def sketches(items: DataFrame, rule: Rule) -> DataFrame:
    """id, t (digest of the text), n (distinct shingles), h1 and h2 (digest of the set), bands, odd; items has id and text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.StructArray.from_arrays(sketched(part.to_pylist(), rule), SKETCH_FIELDS) for part in slices(batch)]
            yield pa.concat_arrays(parts)
        release_memory()

    return items.select("id", F.xxhash64("text").alias("t"), F.arrow_udf(run, SKETCH)(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("s")).select("id", "t", "s.*")


SKETCH_FIELDS = ["n", "h1", "h2", "bands", "odd"]
SKETCH = "struct<n:long,h1:long,h2:long,bands:array<long>,odd:array<long>>"


def sketched(texts: list[bytes], rule: Rule) -> list[pa.Array]:
    """Arrays of the sketch fields."""
    sketcher = _sketcher(rule.bands, rule.rows, rule.bits)
    size, digests, keys, odd = [], [], [], []
    for lo, hi in chunks(texts):
        found, place = shingles(*words(texts[lo:hi], rule.table), rule.k)
        samples = sketcher.samples(found, place)
        for a, b in zip(place, place[1:], strict=False):
            own = np.unique(found[a:b])
            size.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        keys.append(sketcher.keys(samples))
        odd.append(sketcher.odd(samples))
    digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)

    def wide(parts: list[np.ndarray], width: int) -> pa.Array:
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)

    return [pa.array(size, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), wide(keys, rule.bands), wide(odd, rule.bits // 64)]


@lru_cache(4)
def _sketcher(bands: int, rows: int, bits: int) -> Sketcher:
    return Sketcher(bands, rows, bits)


def _confirm(rule: Rule):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for lefts, rights in zip(slices(left), slices(right), strict=True):
                a, b = lefts.to_pylist(), rights.to_pylist()
                new = list({*a, *b})
                known = dict(zip(new, _sets(new, rule), strict=True))
                for x, y in zip(a, b, strict=True):
                    s, t = known[x], known[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    out.append(both > 0 and both * rule.of >= rule.per * (len(s) + len(t) - both))
            yield pa.array(out, pa.bool_())
        release_memory()

    return F.arrow_udf(run, "boolean")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of one block.

    Rare shingles are counted pair by pair, frequent ones by a product of 0/1 matrices; shingles of one
    set alone are left out.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(column, minlength=len(values))
    order = np.argsort(column, kind="stable")
    owner, starts = owner[order], np.concatenate(([0], np.cumsum(count)))[:-1]
    out = np.zeros(n * n, np.int64)
    few, codes, held = min(n, 32), [], 0
    for c in range(2, few + 1):
        at = starts[count == c]
        x, y = np.triu_indices(c, 1)
        for lo in range(0, len(at), 1 + (1 << 20) // len(x)):
            part = owner[at[lo : lo + 1 + (1 << 20) // len(x), None] + np.arange(c)[None, :]]
            codes.append((part[:, x] * n + part[:, y]).ravel())
            held += len(codes[-1])
            if held > 1 << 22:
                out += np.bincount(np.concatenate(codes), minlength=n * n)
                codes, held = [], 0
    if held:
        out += np.bincount(np.concatenate(codes), minlength=n * n)
    out = out.reshape(n, n)
    often = np.flatnonzero(count > few)
    for lo in range(0, len(often), 4096):
        part = often[lo : lo + 4096]
        dense = np.zeros((n, len(part)), np.float32)
        for k, c in enumerate(part):
            dense[owner[starts[c] : starts[c] + count[c]], k] = 1
        out += np.triu(dense @ dense.T, 1).astype(np.int64)
    return out


def _joining(ids: list[int], owner: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links between different components, no more than are needed to join them."""
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    union = size[:, None] + size[None, :] - both
    linked = (both > 0) & (both * rule.of >= rule.per * union)
    names, own = np.unique(owner, return_inverse=True)
    linked &= own[:, None] != own[None, :]
    x, y = np.nonzero(linked)
    first = np.unique(own[x] * len(names) + own[y], return_index=True)[1]  # one pair for each two components
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
        a, b = find(int(own[i])), find(int(own[j]))
        if a != b:
            root[a] = b
            out.append((ids[i], ids[j]))
    return out


class Linker:
    """Links among items (id, text) under a rule; ``items`` must be cheap to read again.  Nodes are ids."""

    def __init__(self, items: DataFrame, rule: Rule):
        self.items, self.rule = items, rule
        self.shelf = Shelf(items.sparkSession)
        self.sketched = self.shelf.put(sketches(items, rule))
        self.filled = self.sketched.filter((F.col("n") > 0) & F.col("id").isNotNull())
        # written down, so that joins with it have exchanges of their own, which adaptive execution can split
        self.classes = self.shelf.put(self.filled.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
        own = self.filled.join(self.classes, ["h1", "h2"]).filter(F.col("id") == F.col("rep"))
        self.reps = self.shelf.put(own.dropDuplicates(["id", "h1", "h2"]).select("id", "t", "n", "odd", "bands"))
        self.rows = self._buckets()

    def _buckets(self) -> DataFrame:
        """key, id, t, centre, centre_t, hot: the members of all buckets with several."""
        rule = self.rule
        rows = self.reps.select(F.explode(F.array_distinct("bands")).alias("key"), "id", "t")
        shared = rows.groupBy("key").agg(F.min("id").alias("centre"), F.min_by("t", "id").alias("centre_t"), F.count("*").alias("members")).filter("members > 1")
        shared = self.shelf.put(shared)
        # at most total / limit buckets have more than limit members, so the hot ones are few enough to be sent to all
        total = shared.agg(F.sum("members")).first()[0] or 0
        limit = max(rule.hot_members, total // rule.hot_keys)
        shared = shared.withColumn("hot", F.col("members") > limit)
        hot, self.hot = F.broadcast(shared.filter("hot")), F.broadcast(shared.filter("hot").select("key"))
        both = rows.join(hot, "key").unionByName(rows.join(self.hot, "key", "left_anti").join(shared.filter("not hot"), "key"))
        return self.shelf.put(both.select("key", "id", "t", "centre", "centre_t", "hot"))

    def _with(self, rows: DataFrame, by_key: DataFrame) -> DataFrame:
        """Members joined with one row for each bucket; that of a hot one is sent to all, so no task gets its members."""
        return rows.filter("hot").join(F.broadcast(by_key.join(self.hot, "key", "left_semi")), "key").unionByName(rows.filter("not hot").join(by_key, "key"))

    def _same_id(self) -> DataFrame | None:
        """Links (a, b) between an id of several texts and the nodes of their classes; None where there is none."""
        several = self.shelf.put(self.filled.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("id"))
        if several.isEmpty():
            return None
        found = self.filled.join(several, "id", "left_semi").join(self.classes, ["h1", "h2"])
        return self.shelf.put(found.select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct())

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """Those links (a, b) that the distinct pairs of items (a, ta, b, tb) give."""
        rule = self.rule
        side = lambda c: self.reps.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
        both = pairs.join(side("a"), ["a", "ta"]).join(side("b"), ["b", "tb"])
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        most = Sketcher(rule.bands, rule.rows, rule.bits).most_bits(rule.per / rule.of)
        differing = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(rule.bits // 64)), F.lit(0))
        likely = self.shelf.put(both.filter((small * rule.of >= large * rule.per) & (differing <= most)).select("a", "ta", "b", "tb"))
        item = lambda c: likely.select(F.col(c).alias("id"), F.col(f"t{c}").alias("t"))
        texts = self._texts(item("a").unionByName(item("b")))
        text = lambda c: texts.select(F.col("id").alias(c), F.col("t").alias(f"t{c}"), F.col("text").alias(f"text_{c}"))
        found = likely.join(text("a"), ["a", "ta"]).join(text("b"), ["b", "tb"]).filter(_confirm(rule)(F.col("text_a"), F.col("text_b")))
        links = self.shelf.put(found.select("a", "b"))
        self.shelf.drop(likely, texts)
        return links

    def _placed(self, parts: DataFrame) -> DataFrame:
        """The members of the buckets with their components, ids without links being their own."""
        named = parts.withColumnRenamed("node", "id")
        return self.shelf.put(self.rows.join(named, "id", "left").select("key", "id", "t", "centre", "hot", F.coalesce("component", "id").alias("component")))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links that hold the components together, and the components (node, component)."""
        shelf = self.shelf
        pair = lambda b, tb: (F.col("id").alias("a"), F.col("t").alias("ta"), F.col(b).alias("b"), F.col(tb).alias("tb"))
        links = self._checked(self.rows.filter("id != centre").select(*pair("centre", "centre_t")).distinct())
        if (same := self._same_id()) is not None:
            links = shelf.put(links.unionByName(same))
        parts = shelf.put(components(links, shelf))
        placed = self._placed(parts)
        last = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max(F.struct("component", "id", "t")).alias("top"))
        last = shelf.put(last.filter(F.col("lo") != F.col("top.component")).select("key", F.col("top.component").alias("other"), F.col("top.id").alias("far"), F.col("top.t").alias("far_t")))
        if last.isEmpty():
            return links, parts
        apart = self._with(placed, last).filter(F.col("component") != F.col("other"))
        links = shelf.put(links.unionByName(self._checked(apart.select(*pair("far", "far_t")).distinct())))
        parts = shelf.put(components(links, shelf))
        placed = self._placed(parts)
        mixed = shelf.put(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key"))
        loose = shelf.put(self._with(placed, mixed).filter("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
        if loose.isEmpty():
            return links, parts
        more = self._blocks(components(loose, shelf), parts.withColumnRenamed("node", "id"))
        links = shelf.put(links.unionByName(more))
        return links, shelf.put(components(links, shelf))

    def _blocks(self, loose: DataFrame, named: DataFrame) -> DataFrame:
        """Links (a, b) between components inside the loose groups (node, component), compared in blocks.

        The members outside a group's largest component are dealt to blocks, which meet each other and
        all chunks of that component; small groups are taken together.  A task holds two blocks of
        ``block_items`` items, and returns no more links than join its components.
        """
        rule, shelf = self.rule, self.shelf
        members = loose.select(F.col("node").alias("id"), F.col("component").alias("loose")).join(named, "id", "left").join(self.reps.select("id", "t", "n"), "id")
        members = shelf.put(members.select("id", "t", "loose", F.coalesce("component", "id").alias("component"), "n"))
        by_part = members.groupBy("loose", "component").agg(F.count("*").alias("items"), F.sum("n").alias("n"))
        top = F.max(F.struct("items", "n", "component")).alias("top")
        sizes = by_part.groupBy("loose").agg(F.sum("items").alias("items"), F.sum("n").alias("n"), top)
        blocks = lambda items, n: F.ceil(F.greatest(items / rule.block_items, n / rule.block_shingles)).cast("long")
        sizes = shelf.put(
            sizes.select(
                "loose", F.col("top.component").alias("largest"), (blocks(F.col("items"), F.col("n")) > 1).alias("large"),
                blocks(F.col("items") - F.col("top.items"), F.col("n") - F.col("top.n")).alias("few"), blocks(F.col("top.items"), F.col("top.n")).alias("many"),
            )
        )
        total = members.agg(F.count("*"), F.sum("n")).first()
        bins = int(max(1, -(-total[0] // rule.block_items), -(-total[1] // rule.block_shingles)))
        zero = F.lit(0).cast("long")
        code, to = F.xxhash64("id", "t"), lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        mine, chunk = F.pmod(code, F.col("few")), F.pmod(code, F.col("many")) + F.col("few")
        upto = lambda n: F.sequence(zero, F.col(n) - 1)
        meets = F.concat(
            F.transform(F.filter(upto("few"), lambda o: o != mine), lambda o: to(F.least(o, mine), F.greatest(o, mine))),
            F.transform(upto("many"), lambda c: to(mine, c + F.col("few"))),
        )
        places = F.when(~F.col("large"), F.array(to(zero, zero))).when(F.col("component") == F.col("largest"), F.transform(upto("few"), lambda i: to(i, chunk))).otherwise(meets)
        dealt = members.join(sizes, "loose").withColumn("place", F.explode(places))
        bin_ = F.when(F.col("large"), F.col("loose")).otherwise(F.pmod(F.xxhash64("loose"), F.lit(bins)))
        dealt = dealt.select("large", bin_.alias("bin"), "place.i", "place.j", "id", "t", "loose", "component")

        def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([s.tobytes() for part in slices(batch) for s in _sets(part.to_pylist(), rule)], pa.binary())
            release_memory()

        sets = shelf.put(self._texts(members.select("id", "t")).select("id", "t", F.arrow_udf(packed, "binary")("text").alias("set")))

        def run(group: pa.Table) -> pa.Table:
            ids, loose, owner = (group.column(c).to_numpy() for c in ("id", "loose", "component"))
            sets = group.column("set").to_pylist()
            order = np.lexsort((ids, loose))
            edges: list[tuple[int, int]] = []
            for rows in np.split(order, np.flatnonzero(np.diff(loose[order])) + 1):
                if len(set(owner[rows].tolist())) > 1:
                    edges += _joining(ids[rows].tolist(), owner[rows].tolist(), [np.frombuffer(sets[i], np.uint64) for i in rows], rule)
            return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

        return shelf.put(dealt.join(sets, ["id", "t"]).groupBy("large", "bin", "i", "j").applyInArrow(run, "a long, b long"))

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(id, t, text) of those items, written down."""
        needed = self.shelf.put(wanted.distinct())
        few = needed.count() <= self.rule.broadcast_ids
        items = self.items.select("id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
        texts = items.join(F.broadcast(needed) if few else needed, ["id", "t"], "left_semi")
        out = self.shelf.put(texts.dropDuplicates(["id", "t"]))
        self.shelf.drop(needed)
        return out

    def labelled(self) -> DataFrame:
        """id, n, component: one row for each item; null ids and empty texts are their own component."""
        _, parts = self.links()
        own = self.sketched.select("id", "n", "h1", "h2")
        named = self.classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
        return own.join(named, ["h1", "h2"], "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"))
