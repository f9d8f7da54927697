"""Operator 7: language identification by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a whole text are cut into windows of ``STEPS`` bytes.  One GRU reads a window
forwards, one backwards; at every byte a softmax over both states gives the probabilities of the
languages there, and their mean over all bytes is the document's.  The network is trained here, in
numpy, by backpropagation through time with the label of the document as the target at every byte.

Training takes a bounded sample: at most ``SAMPLE_DOCS`` labelled texts of each language, chosen by a
hash of id and text, and at most ``SAMPLE_WINDOWS`` windows of each.  Everything else covers all rows.
The network's state begins anew every ``STEPS`` bytes, so that windows are read side by side.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text if
nothing is labelled; whole texts are read; equal probabilities go to the first language in order;
repeated rows get equal results, and are learned from once; null and repeated ids are as good as any;
input columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import release_memory

STEPS = 64
HIDDEN = 8
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
#: Languages that are learned at most, the most frequent first.
LANGUAGES = 256
#: Optimiser steps and windows in each.
ROUNDS = 220
BATCH = 128
#: Windows that go through the network together, so that its state stays in the processor's cache.
BLOCK = 2048

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights, feature-major: byte tables, recurrent matrices and biases of both directions, output."""

    labels: list[str]
    table: list[np.ndarray]  # 3H x 256 each
    recur: list[np.ndarray]  # 3H x H
    bias: list[np.ndarray]  # 3H x 1, of the recurrent side
    out: np.ndarray  # L x 2H
    level: np.ndarray  # L x 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _fresh(labels: list[str], rng: np.random.Generator, h: int = HIDDEN) -> Network:
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    return Network(
        labels,
        [draw(3 * h, 256) for _ in range(2)],
        [draw(3 * h, h) for _ in range(2)],
        [np.zeros((3 * h, 1), np.float32) for _ in range(2)],
        draw(len(labels), 2 * h),
        np.zeros((len(labels), 1), np.float32),
    )


def _forward(net: Network, side: int, x: np.ndarray):
    """States after each byte, with what the way back needs; x is steps x windows."""
    h_size = net.recur[side].shape[1]
    h = np.zeros((h_size, x.shape[1]), np.float32)
    kept = []
    states = np.empty((len(x), h_size, x.shape[1]), np.float32)
    for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
        g = net.table[side][:, x[t]]
        a = net.recur[side] @ h + net.bias[side]
        zr = _sigmoid(g[: 2 * h_size] + a[: 2 * h_size])
        z, r = zr[:h_size], zr[h_size:]
        n = np.tanh(g[2 * h_size :] + r * a[2 * h_size :])
        kept.append((t, h, z, r, n, a[2 * h_size :]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(net: Network, side: int, x: np.ndarray, kept: list, d_states: np.ndarray):
    h_size = net.recur[side].shape[1]
    d_table, d_recur, d_bias = (np.zeros_like(w[side]) for w in (net.table, net.recur, net.bias))
    dh = np.zeros_like(d_states[0])
    eye = np.eye(256, dtype=np.float32)
    for t, before, z, r, n, a in reversed(kept):
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        d_in = np.concatenate((dz, dr, dn))
        d_rec = np.concatenate((dz, dr, dn * r))
        d_table += d_in @ eye[x[t]]
        d_recur += d_rec @ before.T
        d_bias += d_rec.sum(1, keepdims=True)
        dh = dh * z + net.recur[side].T @ d_rec
    return d_table, d_recur, d_bias


def _weights(net: Network) -> list[np.ndarray]:
    return [*net.table, *net.recur, *net.bias, net.out, net.level]


def gradients(net: Network, x: np.ndarray, y: np.ndarray, valid: np.ndarray):
    """Mean cross-entropy over all valid bytes and its gradient, in the order of ``_weights``."""
    h_size = net.recur[0].shape[1]
    fwd, kept_f = _forward(net, 0, x)
    bwd, kept_b = _forward(net, 1, x)
    both = np.concatenate((fwd, bwd), 1)  # steps x 2H x windows
    logits = np.einsum("lh,thn->tln", net.out, both) + net.level
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    at = np.arange(x.shape[1])
    total = max(1, int(valid.sum()))
    loss = float(-(np.log(p[:, y, at] + 1e-9) * valid).sum() / total)
    d = p
    d[:, y, at] -= 1
    d *= valid[:, None, :] / np.float32(total)
    d_out = np.einsum("tln,thn->lh", d, both)
    d_both = np.einsum("lh,tln->thn", net.out, d)
    f = _backward(net, 0, x, kept_f, d_both[:, :h_size])
    b = _backward(net, 1, x, kept_b, d_both[:, h_size:])
    return loss, [f[0], b[0], f[1], b[1], f[2], b[2], d_out, d.sum((0, 2))[:, None]]


def cut(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows x steps of bytes, their valid lengths and the text of each."""
    counts = np.array([-(-len(t) // steps) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t + b"\0" * (-len(t) % steps) for t in texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(of), steps, np.int64)
    ends = np.cumsum(counts)[counts > 0] - 1
    sizes[ends] = [len(t) - steps * (-(-len(t) // steps) - 1) for t in texts if t]
    return flat.reshape(-1, steps), sizes, of


def train(samples: list[tuple[str, bytes]], rounds: int = ROUNDS, seed: int = 7) -> Network | None:
    """A network for (language, bytes) samples, languages drawn equally often."""
    labels = sorted({lang for lang, data in samples if data})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = _fresh(labels, rng)
    by = []
    for lang in labels:
        windows, sizes, _ = cut([data for own, data in samples if own == lang])
        by.append((windows, sizes))
    weights = _weights(net)
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = max(1, BATCH // len(labels))
    for step in range(1, rounds + 1):
        pick = [rng.integers(0, len(w), share) for w, _ in by]
        x = np.concatenate([w[k] for (w, _), k in zip(by, pick, strict=True)]).T
        sizes = np.concatenate([s[k] for (_, s), k in zip(by, pick, strict=True)])
        y = np.repeat(np.arange(len(labels)), share)
        valid = (np.arange(len(x))[:, None] < sizes[None, :]).astype(np.float32)
        _, grads = gradients(net, x, y, valid)
        rate = 0.03 * (1 - step / (rounds + 1)) + 0.001
        for w, g, m, v in zip(weights, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """A trained network made ready to label bytes: halved gates let one tanh serve as the sigmoid."""

    def __init__(self, net: Network):
        self.labels, h = net.labels, net.recur[0].shape[1]
        self.h = h
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5
        # the candidate's recurrent bias is inside the reset gate, the gates' own one joins the table
        self.table, self.recur, self.inner = [], [], []
        for s in range(2):
            gate_bias = net.bias[s].copy()
            gate_bias[2 * h :] = 0
            self.table.append(np.ascontiguousarray((net.table[s] + gate_bias) * half))
            self.recur.append(np.ascontiguousarray(net.recur[s] * half))
            self.inner.append(net.bias[s][2 * h :].copy())
        self.out, self.level = net.out, net.level

    def _run(self, side: int, x: np.ndarray, each) -> None:
        h = self.h
        table, recur, inner = self.table[side], self.recur[side], self.inner[side]
        state = np.zeros((h, x.shape[1]), np.float32)
        g = np.empty((3 * h, x.shape[1]), np.float32)
        a = np.empty_like(g)
        for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(recur, state, out=a)
            gates = g[: 2 * h]
            gates += a[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = a[2 * h :]
            n += inner
            n *= gates[h:]
            n += g[2 * h :]
            np.tanh(n, out=n)
            state -= n
            state *= gates[:h]
            state += n
            each(t, state)

    def block(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of probabilities and numbers of bytes by label, labels x windows; x is windows x steps."""
        x = np.ascontiguousarray(x.T)
        n = x.shape[1]
        forward = np.empty((len(x), self.h, n), np.float32)
        total = np.zeros((len(self.labels), n), np.float32)
        counts = np.zeros_like(total)
        short = int(sizes.min()) if n else 0

        def keep(t: int, state: np.ndarray) -> None:
            forward[t] = state

        def label(t: int, state: np.ndarray) -> None:
            p = self.out[:, : self.h] @ forward[t]
            p += self.out[:, self.h :] @ state
            p += self.level
            top = p.max(0)
            p -= top
            said = p == 0
            np.exp(p, out=p)
            p /= p.sum(0)
            if t >= short:
                valid = sizes > t
                p *= valid
                said &= valid
            np.add(total, p, out=total)
            np.add(counts, said, out=counts)

        self._run(0, x, keep)
        self._run(1, x, label)
        return total, counts

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities and shares of bytes by label; texts x labels, zero for empty texts."""
        windows, sizes, of = cut(texts)
        total = np.zeros((len(texts), len(self.labels)))
        counts = np.zeros_like(total)
        for at in range(0, len(of), BLOCK):
            part = slice(at, at + BLOCK)
            p, c = self.block(windows[part], sizes[part])
            first = np.flatnonzero(np.diff(of[part], prepend=-1))
            total[of[part][first]] += np.add.reduceat(p, first, 1).T
            counts[of[part][first]] += np.add.reduceat(c, first, 1).T
        length = np.maximum(1, [len(t) for t in texts])[:, None]
        return total / length, counts / length


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document may not be learned from: CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, windows_each: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """Windows of at most ``docs_each`` learnable texts of each of the ``LANGUAGES`` most frequent languages.

    The texts are those whose hash, with their id, is smallest, repeated ones once; so neither null nor
    repeated ids change the draw.  What is collected is bounded whatever the table holds.
    """
    may = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    seed = F.struct("doc_id", F.xxhash64("text"))
    draw = F.xxhash64(F.lit("language"), seed).bitwiseAND(F.lit((1 << 62) - 1))
    counts = may.groupBy("lang").agg(F.approx_count_distinct(draw).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    # four times as many as are wanted go on, so that only few rows are ranked; their number is bounded for any table
    wide = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 4 * docs_each / r.n) * (1 << 62))) for r in counts], "lang string, most long"))
    data = F.col("text").cast("binary")
    size = F.octet_length(data)
    place = lambda i: F.pmod(F.xxhash64(F.lit("window"), seed, i), F.greatest(F.lit(1), size - STEPS))
    pieces = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(windows_each), F.greatest(F.lit(1), (size / STEPS).cast("int")))),
        lambda i: F.substring(data, (place(i) + 1).cast("int"), F.lit(STEPS)),
    )
    drawn = may.select("lang", draw.alias("draw"), pieces.alias("pieces")).join(wide, "lang").filter(F.col("draw") < F.col("most")).dropDuplicates(["lang", "draw"])
    best = Window.partitionBy("lang").orderBy("draw")
    rows = drawn.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= docs_each).select("lang", "draw", "pieces").collect()
    rows.sort(key=lambda r: (r.lang, r.draw))
    return [(r.lang, bytes(p)) for r in rows for p in r.pieces]


def fit(docs: DataFrame) -> Network | None:
    return train(sample(docs))


_RESULT = "struct<lang:string,score:double,share:double>"


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: language, its probability, its share of labelled bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(shared.value) if shared.value else None
        for batch in texts:
            langs, scores, shares = ["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            lo = 0
            while reader and lo < len(batch):
                hi, size, part = lo, 0, []
                while hi < len(batch) and size < 4_000_000:
                    text = batch[hi].as_py()
                    part.append(text.encode() if text and _LETTER.search(text) else b"")
                    size += len(part[-1])
                    hi += 1
                p, c = reader.read(part)
                for i, k in enumerate(p.argmax(1).tolist()):
                    if part[i]:
                        langs[lo + i], scores[lo + i], shares[lo + i] = reader.labels[k], min(1.0, p[i, k]), min(1.0, c[i, k])
                lo = hi
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(shares)], ["lang", "score", "share"])
        release_memory()

    return docs.withColumn(out, F.arrow_udf(run, _RESULT)(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    net = fit(docs)
    found = identify(docs.select("doc_id", "text"), net, out="_l")
    return found.select("doc_id", held_out().alias("held_out"), F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"), F.col("_l.share").alias("share"))


def recognised(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in a learned language with at least that probability; same columns."""
    found = identify(docs, net, out="_language")
    return found.filter((F.col("_language.lang") != "und") & (F.col("_language.score") >= least)).drop("_language")
