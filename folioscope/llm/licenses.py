"""Operator 6: license scans by fuzzy search for short notices.

A notice that may hold ``k`` errors is cut into ``k + 1`` seeds: by the pigeonhole principle one of
them stands unharmed in any copy, so an Aho-Corasick automaton over the seeds finds every place
where a copy can be.  Only there the ``regex`` library matches the notice with a bounded number of
errors, which gives the span and the number of errors.

The base labels are exact phrases of whole words; they are counted over all words of the text.

Defined results: null, empty and wordless texts have no words, no labels and score 0; the word
offsets are null without a base phrase; rows are independent; whole texts are scanned; input columns
named like results are replaced.  Where notices overlap, the one with the fewest errors is reported,
then the longest, then the first.  The time grows with the text's length: searches run in
stretches of bounded length only, and words are counted once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_BYTES, slices, text_bytes

#: Exact phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices, as words, and the labels they stand for.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: One error for so many characters.
PER_ERROR = 12


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces, with their places, that cover the notice."""
    step = len(notice) / (errors + 1)
    cuts = [round(i * step) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(1)
def _machine():
    import ahocorasick

    machine, patterns = ahocorasick.Automaton(), []
    of: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _) in enumerate(NOTICES):
        errors = len(notice) // PER_ERROR
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={errors}}}"), errors, len(notice)))
        for at, seed in seeds(notice, errors):
            of.setdefault(seed, []).append((k, at))
    for seed, places in of.items():
        machine.add_word(seed, (len(seed), places))
    machine.make_automaton()
    return machine, patterns


def _regions(text: str) -> dict[int, list[tuple[int, int]]]:
    """Where copies of each notice can be: stretches around the starts that its seeds imply.

    Starts within twice the errors of a stretch's first one belong to it, so its length is bounded.
    """
    machine, patterns = _machine()
    starts: dict[int, list[int]] = {}
    for end, (size, places) in machine.iter(text):
        for k, at in places:
            starts.setdefault(k, []).append(end + 1 - size - at)
    out: dict[int, list[tuple[int, int]]] = {}
    for k, found in sorted(starts.items()):
        _, errors, length = patterns[k]
        spots: list[list[int]] = []
        for s in sorted(set(found)):
            if spots and s <= spots[-1][0] + 2 * errors:
                spots[-1][1] = s
            else:
                spots.append([s, s])
        out[k] = [(max(0, a - errors), min(len(text), b + length + errors)) for a, b in spots]
    return out


def fuzzy(text: str) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) in the normalised text, by start, without overlaps."""
    patterns, found = _machine()[1], set()
    for k, regions in _regions(text).items():
        for region in regions:
            left = [region]
            while left:  # the best match comes first, so there may be others on both sides
                a, b = left.pop()
                if m := patterns[k][0].search(text, a, b):
                    found.add((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                    left += [(a, m.start()), (m.end(), b)]
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
        at = bisect_right(kept, x[1], key=lambda y: y[1])  # those kept are apart and in order
        if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or kept[at][1] >= x[2]):
            kept.insert(at, x)
    return kept


def normalised(data: bytes) -> bytes:
    """The words, each with one blank before and after."""
    return b" " + b" ".join(data.translate(WORD_BYTES).split()) + b" "


#: A phrase between blanks; the blank behind it may be the one before the next.
_BASE = tuple((re.compile(b" " + re.escape(phrase.encode()) + b"(?= )"), label) for phrase, label in PHRASES)


def scan_one(data: bytes) -> dict:
    flat = normalised(data)
    n_words = flat.count(b" ") - 1 if len(flat) > 2 else 0
    starts, base, place, n = [], set(), 0, 0
    hits = sorted((m.start(), label) for pattern, label in _BASE for m in pattern.finditer(flat))
    for at, label in hits:  # words are counted on from hit to hit
        n += flat.count(b" ", place, at)
        place = at
        starts.append(n)
        base.add(label)
    notices, score = [], 1.0 if starts else 0.0
    if n_words:
        text, place, n = flat.decode("utf-8", "replace"), 0, -1
        for k, a, b, errors in fuzzy(text):
            n += text.count(" ", place, a + 1)
            place = a + 1
            notices.append({"label": NOTICES[k][1], "start_word": n, "end_word": n + 1 + text.count(" ", a + 1, b), "errors": errors})
            score = max(score, 1.0 - errors / len(NOTICES[k][0]))
    return {
        "n_words": n_words,
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {n["label"] for n in notices})),
        "score": score,
        "notices": notices,
    }


_NOTICE = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64())])
_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(_NOTICE))]
)
_RESULT = (
    "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
    "notices:array<struct<label:string,start_word:long,end_word:long,errors:long>>>"
)


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([scan_one(text.as_py()) for part in slices(batch) for text in part], _TYPE)


def scan(docs: DataFrame, text_col: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct column ``out``: counts, labels, score and the fuzzy notices' word spans."""
    return docs.withColumn(out, F.arrow_udf(_scan, _RESULT)(text_bytes(text_col)))


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), out="_l")
    return found.select("doc_id", *(F.col(f"_l.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))
