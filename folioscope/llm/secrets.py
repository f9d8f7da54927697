"""Operator 2: secret scans.

Three steps.  An Aho-Corasick automaton over the lower-cased text finds keywords (``password``,
``akia``, ``ghp_`` ...).  A regular expression anchored at a hit, and only there, decides the span.
Kinds whose tokens carry a checksum are then validated: the CRC-32 tail of hosting and package
registry tokens, the MOD-97 digits of bank account numbers, the decodable header of signed tokens.
Runs of hexadecimal digits have no keyword; every run of 24 holds a multiple of 12 whose next 12
neighbours are digits too, so a strided look at the bytes takes the keyword's place.

Offsets are code points, end exclusive: the scan works on a copy of the text in which every
non-ASCII character is one ``?``, which no pattern accepts.

Every pattern is tried at hits alone and reads on from there; a signed token that fails gives up all of
its run of characters, where no later start can do better, so the time grows with the text's length.

Defined results: null and empty texts have no spans; rows are independent, repeated rows get equal
results; whole texts are scanned, however long; input columns named like results are replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import release_memory

#: Order of kinds at equal starts; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "hosting", "registry", "jwt", "iban", "pem")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
_HEX = re.compile(r"[0-9a-f]+")
_HOSTING = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.A)
_REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.A)
_JWT = re.compile(r"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]{16,}", re.A)
_JWT_RUN = re.compile(r"[0-9A-Za-z_-]+")
_IBAN = re.compile(r"(?i:iban)[:\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])", re.A)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", re.A)

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_tail(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS62[d] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    return crc_tail(m[1]) == m[2]


def _jwt_ok(m: re.Match) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


def _iban_ok(m: re.Match) -> bool:
    plain = m[1].replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _always(_: re.Match) -> bool:
    return True


#: Keyword, kind, anchored pattern, test of a match.  A failing match still takes its characters.
RULES: tuple[tuple[str, str, re.Pattern, Callable[[re.Match], bool]], ...] = (
    *((k, "assign", _ASSIGN, lambda m: len(m[1]) >= 6) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("akia", "access", _ACCESS, lambda m: m.end() - m.start() >= 20),
    *((f"gh{c}_", "hosting", _HOSTING, _crc_ok) for c in "pousr"),
    ("npm_", "registry", _REGISTRY, _crc_ok),
    ("eyj", "jwt", _JWT, _jwt_ok),
    ("iban", "iban", _IBAN, _iban_ok),
    ("-----begin ", "pem", _PEM, _always),
)


def _machine():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, rule in enumerate(RULES):
        machine.add_word(rule[0], (len(rule[0]), k))
    machine.make_automaton()
    return machine


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_STRIDE = 12


def _hex_runs(data: bytes, text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of 24 or more lower-case hexadecimal digits."""
    hit = _HEX_BYTE[np.frombuffer(data, np.uint8)[::_STRIDE]]
    done = 0
    for at in (np.flatnonzero(hit[:-1] & hit[1:]) * _STRIDE).tolist():
        if at < done:
            continue
        start = at
        while start > done and _HEX_BYTE[data[start - 1]]:
            start -= 1
        done = _HEX.match(text, start).end()
        if done - start >= 24:
            yield start, done


def find(text: str, machine=None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed."""
    machine = machine or _machine()
    data = text.encode("ascii", "replace")
    plain = data.decode("ascii")
    found = [("hex", a, b) for a, b in _hex_runs(data, plain)] if len(data) >= 24 else []
    ends: dict[str, int] = {}
    hits = sorted((end + 1 - size, k) for end, (size, k) in machine.iter(plain.lower()))
    for start, k in hits:
        _, kind, pattern, accept = RULES[k]
        if start < ends.get(kind, 0):
            continue
        if m := pattern.match(plain, start):
            ends[kind] = m.end()
            if accept(m):
                found.append((kind, start, m.end()))
        elif kind == "jwt" and plain.startswith("eyJ", start):
            ends[kind] = _JWT_RUN.match(plain, start).end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_RESULT = "struct<spans:array<struct<kind:string,start:long,end:long>>,base_sha256:string>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    machine = _machine()
    for batch in texts:
        spans, digests = [], []
        for text in batch:
            found = find(text.as_py() or "", machine)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            digests.append(hashlib.sha256(joined([s for s in found if s[0] in BASE]).encode()).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(spans, _ARROW), pa.array(digests, pa.string())], ["spans", "base_sha256"])
    release_memory()


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``out``: spans (kind, start, end) and a digest of the base ones."""
    return docs.withColumn(out, F.arrow_udf(_scan, _RESULT)(F.coalesce(F.col(text_col), F.lit(""))))


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), out="_s")
    count = lambda kind: F.size(F.filter("_s.spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.col("_s.base_sha256").alias("base_sha256"),
        F.concat_ws(",", F.transform("_s.spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
    )


def _redacted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    machine = _machine()
    for batch in texts:
        out = []
        for text in batch:
            plain = text.as_py()
            if plain:
                found = find(plain, machine)
                parts, at = [], 0
                for _, a, b in found:
                    if b > at:
                        parts += [plain[at : max(a, at)], "[secret]"] if a >= at else []
                        at = b
                plain = "".join([*parts, plain[at:]]) if found else plain
            out.append(plain)
        yield pa.array(out, pa.string())
    release_memory()


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``[secret]`` in place of every span, overlapping ones as one; same columns and rows."""
    return docs.withColumn(text_col, F.arrow_udf(_redacted, "string")(F.col(text_col)))
