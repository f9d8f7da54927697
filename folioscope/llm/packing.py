"""Operator 10: sum-of-squares online packing.

Documents become token ids and one end id.  Whole windows of ``WINDOW`` ids are cut off first; what
is left, one piece of 1 to ``WINDOW - 1`` ids, is placed online.  N(h) counts the open windows filled
to level h, in a level array; a piece of size s goes to the level (or a new window) that makes the
sum of N(h)^2 smallest, ties to the fullest level.  At the end of a partition its open windows are
joined by cutting pieces at window borders; the last, shorter one is cut into powers of two, which
need no padding.

Each partition is packed by itself in the order of its rows, as a stream: nothing is shuffled, nothing
waits for the whole corpus, and a lost task is simply run again.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as they
occur; whole texts are packed; every id lies in exactly one piece; extra input columns are ignored.

Tokens: a boundary between a character and a following blank is a boundary of the tokenizer's own
pre-tokens unless blanks meet other white space, so is one between a letter and a full stop or comma;
the words between are encoded once and kept in a bounded cache; a text in which a blank stands between white space is encoded as one.
Strings of the tokenizer's special tokens are those tokens, as the tokenizer itself reads them; with
``special`` false they are ordinary text.
"""

from __future__ import annotations

import operator
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import release_memory, slices
from folioscope.llm.shingles import chunks

WINDOW = 1024
END = 0
#: Open windows that a task may hold, about 30 MB; beyond that they are joined as at the end.  Pieces of
#: even sizes leave some 400 open whatever the input, so this only bounds memory.
MAX_OPEN = 8192
#: Words that a worker keeps encoded, about; 40 bytes each.
CACHE_WORDS = 800_000
#: Characters whose words are looked up together.
GROUP_CHARS = 6_000_000

class Encoder:
    """Token ids of texts by a ``tokenizers`` file.

    Each distinct word is encoded once and kept: words in an Arrow array, their ids in one flat array.
    When ``size`` words are exceeded, those used longest ago go, so memory is bounded.  Texts are cut at
    special tokens first, so none stands in a word.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS, special: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if special else {}
        self.special = {t: np.array([i], np.uint32).tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokenizer.encode_special_tokens = True  # between the cuts, and in joined words, there is none
        self.size, self.round = size, 0
        #: Bytes of each token: byte-level vocabularies spell a byte by a character.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.words = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.int64)
        #: White space at a word's end (1) or after its blank (2).
        self.edge = np.zeros(0, np.int8)
        self.used = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word; the words go through the tokenizer as one text.

        Words that begin with a blank follow each other as they stand, others after a line break, which
        is a token by itself.
        """
        gaps = np.fromiter((w[0] != " " for w in words), np.int64, len(words))
        size = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        ids = self._whole(["".join([w if w[0] == " " else "\n" + w for w in words])])[0]
        ends, last = np.cumsum(self.bytes[ids]), np.cumsum(size + gaps)
        to = np.searchsorted(ends, last) + 1
        if len(ids) and (ends[-1] != last[-1] or (ends[to - 1] != last).any()):
            raise ValueError("the tokenizer is not byte-level, or joins words")
        since = np.concatenate(([0], to[:-1]))
        keep = np.ones(len(ids), bool)
        keep[since[gaps > 0]] = False
        return ids[keep], to - since - gaps

    def _learn(self, new: list[str]) -> np.ndarray:
        """Adds words and tells their places; those with white space at an end are encoded alone."""
        edge = np.fromiter(map(_edge, new), np.int8, len(new))
        by_itself = (edge > 0) | np.fromiter(map(operator.not_, new), bool, len(new))
        order = np.concatenate((np.flatnonzero(~by_itself), np.flatnonzero(by_itself)))
        split = len(new) - int(by_itself.sum())
        ordered = [new[i] for i in order.tolist()]
        fine, alone = ordered[:split], ordered[split:]
        flat, count = [self.flat], [self.count]
        for lo in range(0, len(fine), 4096):
            ids, sizes = self._joined(fine[lo : lo + 4096])
            flat.append(ids)
            count.append(sizes)
        for ids in self._whole(alone):
            flat.append(ids)
            count.append(np.array([len(ids)]))
        places = np.empty(len(new), np.int64)
        places[order] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, pa.array(ordered, pa.large_string())])
        self.flat, self.count = np.concatenate(flat), np.concatenate(count)
        self.edge = np.concatenate((self.edge, edge[order]))
        self.used = np.concatenate((self.used, np.full(len(new), self.round)))
        return places

    def _forget(self) -> None:
        """Keeps the half that was used last."""
        keep = np.zeros(len(self.used), bool)
        keep[np.argsort(-self.used, kind="stable")[: self.size // 2]] = True
        self.words = self.words.filter(pa.array(keep))
        self.flat = self.flat[np.repeat(keep, self.count)]
        self.count, self.edge, self.used = self.count[keep], self.edge[keep], self.used[keep]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.cut.split(t) if any(x in t for x in self.special) else [t] for t in texts] if self.cut else [[t] for t in texts]
        found = iter(self._plain([x for p in parts for x in p[::2]]))
        return [next(found) if len(p) == 1 else b"".join(self.special[x] if k % 2 else next(found) for k, x in enumerate(p)) for p in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        self.round += 1
        # each word but the first has the blank before it
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 ")
        # a full stop or comma after a letter begins a pre-token too
        cut = pc.split_pattern(pc.replace_substring_regex(marked, "([A-Za-z])([,.])", "\\1\0\\2"), "\0")
        place = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))
        coded = cut.flatten().dictionary_encode()
        if len(self.words) > self.size:
            self._forget()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        word = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            word[word < 0] = self._learn(coded.dictionary.filter(pc.is_null(found)).to_pylist())
        self.used[word] = self.round
        at = word[coded.indices.to_numpy()]
        # texts in which a blank stands between white space, or a zero, are encoded as one
        edge = self.edge[at]
        odd = np.flatnonzero((edge[:-1] & 1) & (edge[1:] >> 1))
        whole = sorted({*(np.searchsorted(place, odd, "right") - 1).tolist(), *(i for i, t in enumerate(texts) if "\0" in t)})
        first, sizes = (np.cumsum(self.count) - self.count)[at], self.count[at]
        out_at = np.concatenate(([0], np.cumsum(sizes)))
        gathered = self.flat[np.repeat(first - out_at[:-1], sizes) + np.arange(out_at[-1])].tobytes()
        bounds = (4 * out_at[place]).tolist()
        out = [gathered[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        return out


def _edge(w: str) -> int:
    return w[-1:].isspace() + 2 * (w == " " or w[1:2].isspace())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Levels:
    """Open windows by fill level; N(h) in an array."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, s: int) -> int:
        """Fill level of the best window for a piece of ``s`` ids, 0 for a new one.

        Moving a window from level h to h + s changes the sum of squares by
        2 (N(h+s) - N(h)) + 2; a new window by 2 N(s) + 1; levels 0 and full don't count.
        """
        n, size = self.count, self.size
        best, cost = 0, 2 * int(n[s]) + 1 if s < size else 0
        h = size - s
        if h > 0 and n[h]:
            # closing a window only takes a square away
            closing = 1 - 2 * int(n[h])
            if closing <= cost:
                best, cost = h, closing
        if size - s > 1:
            low = n[1 : size - s]
            change = np.where(low > 0, 2 * (n[1 + s : size] - low) + 2, np.iinfo(np.int64).max)
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if low[k] > 0 and int(change[k]) < cost:
                best = k + 1
        return best


class Packer:
    """Packs a stream of documents; rows are (document, start, ids, total, sequence, offset)."""

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.levels = Levels(size)
        self.members: dict[int, list[tuple]] = {}
        self.sequences = 0
        self.rows: list[tuple] = []

    def _sequence(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def add(self, doc, ids: bytes) -> None:
        size, levels = self.size, self.levels
        total = len(ids) // 4
        whole = total // size * size
        for start in range(0, whole, size):
            self.rows.append((doc, start, ids[4 * start : 4 * (start + size)], total, self._sequence(), 0))
        s = total - whole
        if not s:
            return
        h = levels.place(s)
        if h:
            k = levels.open[h].pop()
            levels.count[h] -= 1
        else:
            k = self._sequence()
            self.members[k] = []
        self.members[k].append((doc, whole, ids[4 * whole :], total))
        if h + s < size:
            levels.open[h + s].append(k)
            levels.count[h + s] += 1
            if len(self.members) > self.max_open:
                self.join()
        else:
            self._close(k)

    def _close(self, k: int) -> None:
        offset = 0
        for doc, start, ids, total in self.members.pop(k):
            self.rows.append((doc, start, ids, total, k, offset))
            offset += len(ids) // 4

    def join(self, last: bool = False) -> None:
        """Joins the open windows by cutting pieces; a rest stays open, or is cut into powers of two."""
        pieces = [x for k in sorted(self.members) for x in self.members[k]]
        spare = sorted(self.members)
        left = sum(len(x[2]) // 4 for x in pieces)
        self.members, self.levels = {}, Levels(self.size)
        room = k = offset = 0
        for doc, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.size if left >= self.size or not last else 1 << (left.bit_length() - 1)
                    k, offset = spare.pop(0) if spare else self._sequence(), 0
                    self.members[k] = []
                take = min(len(ids) // 4, room)
                self.members[k].append((doc, start, ids[: 4 * take], total))
                start, ids = start + take, ids[4 * take :]
                room, left, offset = room - take, left - take, offset + take
                if not room:
                    self._close(k)
        for k in self.members:  # one at most
            self.levels.open[offset].append(k)
            self.levels.count[offset] += 1


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents; with ``with_ids`` also a binary column of their ids.

    Each partition is packed as it is read: nothing is shuffled, and a task holds its open windows
    only.  A sequence's id is the partition's number times 2^32 and its number there.  A sequence is
    as long as its pieces; whoever writes it out pads it to the window unless that length is a power
    of two.  ``tokenizer`` is a path that every machine has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        encoder, packer = Encoder(tokenizer or default_tokenizer()), Packer()
        end = array("I", [END]).tobytes()

        def out() -> pa.RecordBatch:
            rows = packer.rows[:]
            packer.rows.clear()
            cols = {
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                "doc_tokens": pa.array([r[3] for r in rows], pa.int64()),
                "sequence_id": pa.array([shard + r[4] for r in rows], pa.int64()),
                "offset": pa.array([r[5] for r in rows], pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.array([r[2] for r in rows], pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for b in (part for batch in batches for part in slices(batch, 2048)):
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts, GROUP_CHARS):
                for doc, found in zip(ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    packer.add(doc, found + end)
                    if len(packer.rows) >= 10_000:
                        yield out()
        packer.join(last=True)
        yield out()
        del encoder, packer
        release_memory()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, _OUT + (", ids binary" if with_ids else ""))


def windows(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """One row per sequence: its ids in order, padded ids not included, and the documents' pieces."""
    pieces = packed(docs, tokenizer, with_ids=True, **options)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length")))
    out = pieces.groupBy("sequence_id").agg(rows.alias("p"))
    return out.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
