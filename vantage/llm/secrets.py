"""Secret scan: keyword automaton, anchored patterns at its hits, embedded checksums."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "forge", "package")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 or more are the runs that the contract keeps; a shorter run can't hide a longer one.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens that end in a checksum: 30 characters, then the CRC-32 of them in six base-62 digits.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,value_start:int>>"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    """Keywords in every case they may take, so that texts need no case folding (which can change offsets)."""
    found = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        for spelt in itertools.product(*[sorted({c.lower(), c.upper()}) for c in word]):
            found.add_word("".join(spelt), ("assign", len(word)))
    found.add_word("AKIA", ("access", 4))
    for mark in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        found.add_word(mark, ("forge" if mark[0] == "g" else "package", 4))
    found.make_automaton()
    return found


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret part) by start, then kind; offsets count code points, end exclusive.

    Per kind, matches are the leftmost non-overlapping ones: a failing match still uses up its characters.
    """
    if not text:
        return []
    out, upto = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(text):
        start = last + 1 - size
        if start < upto[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED).match(text, start)
        if not m:
            continue
        if kind == "assign":
            good, value = len(m[2]) >= 6, m.start(2)
        elif kind == "access":
            good, value = len(m[0]) >= 20, start
        else:
            good, value = (start == 0 or not text[start - 1].isalnum()) and base62_crc(m[1]) == m[2], start
        upto[kind] = m.end() if good or kind in BASE_KINDS else start + 1
        if good:
            out.append((kind, start, m.end(), value))
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every document's secrets, one row per row of ``docs``; a null text has none.

    Keyword kinds are looked for with the automaton and matched only at its hits. Hex runs have no keyword; one pattern
    pass finds them. ``forge`` and ``package`` tokens count only if their embedded CRC-32 agrees.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in find_secrets(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(doc_id, text).mapInArrow(scan, SCHEMA)


def redact(text: str | None, spans: list) -> str | None:
    """The text with the secret part of every span as ``<secret>``; overlapping spans become one mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for lo, hi in sorted((s["value_start"], s["end"]) for s in spans):
        if lo >= at:
            out += [text[at:lo], "<secret>"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; every row and every other column stays as it is."""
    place = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for t in b.column(place).to_pylist():
                clean.append(redact(t, [dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in find_secrets(t)]))
            cols = [pa.array(clean, b.schema.field(place).type) if i == place else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(mask, docs.schema)
