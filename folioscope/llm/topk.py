"""Operator 8: exact top-k inner-product search by ball-tree branch and bound.

Candidates are dealt by row number to shards of about ``SHARD_ROWS`` rows and queries to blocks of
about ``BLOCK_ROWS``; a task holds one shard and one block, both of bounded size.  It builds a ball tree
over the shard and descends it with the whole block at once: a node's upper bound for a query is the
inner product with its centre plus the query's norm times its radius, the child with the greater bound
goes first, and a query leaves the set as soon as the bound falls below its current k-th score.

The current k-th score is shared: the shards are searched in waves of growing size, and a wave starts
from each query's k-th score over all shards before it, so only the first shard begins from nothing.

Scores are integers, ties go to the smaller id.  Defined results: rows with a null id, a null vector,
or a null or non-finite component take no part; components, and scores, beyond 64 bits are the nearest
64-bit number; vectors only meet vectors of their own length; rows with the query's id are the query's
own; queries of one id share one ranking; repeated rows are ranked each; fewer than k candidates are
all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Shelf

SHARD_ROWS = 16_384
BLOCK_ROWS = 16_384
LEAF_ROWS = 512
#: Each wave searches so many times the shards searched before.
WAVE = 8
#: Room for a row's place behind its score in one 64-bit key.
_PLACE_BITS = 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        if len(rows) <= self.leaf:
            self.nodes.append((centre, radius, np.sort(rows), -1, -1))
        else:
            along = own[:, int(np.argmax(own.var(0)))]
            order = np.argpartition(along, len(rows) // 2)
            half = len(rows) // 2
            a, b = self._build(rows[order[:half]]), self._build(rows[order[half:]])
            self.nodes.append((centre, radius, None, a, b))
        return len(self.nodes) - 1


    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Inner products that no point of the node exceeds, rounding included."""
        centre, radius, *_ = self.nodes[node]
        return queries @ centre + norms * radius + 1e-9 * norms * (np.sqrt(centre @ centre) + radius) + 1e-3


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(1))


class Search:
    """Best k of a tree for a block of queries; keys hold score and place, so that ties are settled."""

    def __init__(self, tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.tree, self.ids, self.queries, self.query_ids, self.k = tree, ids, queries, query_ids, k
        self.norm = _norms(queries)
        self.keys = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.least = floor.astype(np.float64)
        self.scored = 0

    def _bound(self, node: int, active: np.ndarray) -> np.ndarray:
        return self.tree.bound(node, self.queries[active], self.norm[active])

    def descend(self, node: int, active: np.ndarray, bound: np.ndarray) -> None:
        active = active[bound >= self.least[active]]
        if not len(active):
            return
        _, _, rows, a, b = self.tree.nodes[node]
        if rows is not None:
            return self._score(rows, active)
        ba, bb = self._bound(a, active), self._bound(b, active)
        for child, limit in ((a, ba), (b, bb)) if ba.sum() >= bb.sum() else ((b, bb), (a, ba)):
            self.descend(child, active, limit)

    def _score(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.scored += len(rows) * len(active)
        scores = (self.queries[active] @ self.tree.points[rows].T).astype(np.int64)
        keys = (scores << _PLACE_BITS) + ((1 << _PLACE_BITS) - 1 - rows)
        keys[self.query_ids[active][:, None] == self.ids[rows][None, :]] = np.iinfo(np.int64).min
        both = np.concatenate((self.keys[active], keys), 1)
        best = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
        self.keys[active] = best
        last = best.min(1)
        full = last != np.iinfo(np.int64).min
        self.least[active[full]] = np.maximum(self.least[active[full]], last[full] >> _PLACE_BITS)

    def run(self) -> None:
        active = np.arange(len(self.queries))
        self.descend(self.tree.root, active, self._bound(self.tree.root, active))


def _wide(tree: BallTree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray):
    """For scores beyond the keys' room: each query by itself, the node with the greatest bound first, in whole numbers of any size."""
    q = queries.astype(np.float64)
    norms = _norms(q)
    for i, own in enumerate(query_ids.tolist()):
        bound = lambda node, i=i: -float(tree.bound(node, q[i : i + 1], norms[i : i + 1])[0])
        best: list[tuple[int, int]] = []
        least, heap = float(floor[i]), [(bound(tree.root), tree.root)]
        while heap and -heap[0][0] >= least:
            _, _, rows, a, b = tree.nodes[heapq.heappop(heap)[1]]
            if rows is None:
                for child in (a, b):
                    heapq.heappush(heap, (bound(child), child))
                continue
            rows = rows[ids[rows] != own]
            scores = points[rows].astype(object) @ queries[i].astype(object) if len(rows) and points.shape[1] else [0] * len(rows)
            best = sorted(best + [(-max(_LEAST, min(_MOST, int(s))), r) for s, r in zip(scores, ids[rows].tolist(), strict=True)])[:k]
            if len(best) == k:
                least = max(least, float(-best[-1][0]))
        yield own, [(r, -s) for s, r in best]


def _search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """(query id, [(id, score)]) of vectors of one length; ``floor`` is a score that k others reach, or minus infinity."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    size = max(1, points.shape[1]) * float(np.abs(points.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0))
    tree = BallTree(points.astype(np.float64))
    if size >= 2.0 ** (62 - _PLACE_BITS) or len(ids) >= 1 << _PLACE_BITS:
        yield from _wide(tree, points, ids, queries, query_ids, k, floor)
        return
    search = Search(tree, ids, queries.astype(np.float64), query_ids, k, floor)
    search.run()
    for own, keys in zip(query_ids.tolist(), search.keys, strict=True):
        keys = np.sort(keys[keys != np.iinfo(np.int64).min])[::-1]
        places = (1 << _PLACE_BITS) - 1 - (keys & ((1 << _PLACE_BITS) - 1))
        yield own, list(zip(ids[places].tolist(), (keys >> _PLACE_BITS).tolist(), strict=True))


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and integer components of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _wave(dealt: DataFrame, asked: DataFrame, lo: int, hi: int, blocks: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each shard from ``lo`` to below ``hi``."""
    upto = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    rows = dealt.filter((F.col("shard") >= lo) & (F.col("shard") < hi))
    rows = rows.select(F.lit(False).alias("asks"), F.col("shard").cast("int").alias("shard"), upto(0, blocks).alias("block"), "id", "v", F.lit(None).cast("long").alias("floor"))
    asking = asked.select(F.lit(True).alias("asks"), upto(lo, hi).alias("shard"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), "id", "v", "floor")

    def run(group: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("id").to_numpy()
        floor = group.column("floor").to_pandas().to_numpy(np.float64, na_value=-np.inf) if len(ids) else np.zeros(0)
        v = group.column("v").combine_chunks()
        lengths = np.asarray(v.value_lengths())
        ends = np.cumsum(lengths)
        flat = np.asarray(v.flatten())
        for d in np.unique(lengths[asks]):
            own, rest = np.flatnonzero(asks & (lengths == d)), np.flatnonzero(~asks & (lengths == d))
            if not len(rest):
                continue
            take = lambda rows, d=d: flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]].astype(np.int64)
            least = np.nan_to_num(floor[own], nan=-np.inf, neginf=-np.inf)
            for query, found in _search(ids[rest], take(rest), ids[own], take(own), least, k):
                out[0].extend([query] * len(found))
                out[1].extend(x for x, _ in found)
                out[2].extend(s for _, s in found)
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return rows.unionByName(asking).groupBy("shard", "block").applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest inner products; both inputs have columns id, v."""
    shelf = Shelf(candidates.sparkSession)
    shards, blocks = max(1, -(-candidates.count() // shard_rows)), max(1, -(-queries.count() // block_rows))
    # by row number, so that repeated rows are spread too
    dealt = shelf.put(candidates.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "id", "v"))
    asked, found, done = queries.distinct(), None, 0
    floor = F.lit(None).cast("long").alias("floor")
    while done < shards:
        upto = min(shards, max(1, done * (WAVE + 1)))
        if found is not None:
            kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            now = asked.join(kth, "id", "left")
        else:
            now = asked.withColumn("floor", floor)
        more = _wave(dealt, now, done, upto, blocks, k)
        found = _ranked(more if found is None else more.unionByName(found.drop("rank")), k)
        done = upto
        if done < shards:
            found = shelf.put(found)
    return found.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k best of every row whose id is divisible by ``every``, against all rows."""
    base = whole_numbers(vectors)
    return top_k(base, base.filter(F.col("id") % every == 0), k)
