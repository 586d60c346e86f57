"""Exact substring dedup by a distributed merge sort of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it starts earlier as well. Every such string holds an anchor: the
leftmost k-byte run with the smallest hash among those that start in its first ``length - k + 1`` bytes. Equal strings have
their anchor at the same offset, so it is enough to sort the suffixes at anchors, with the bytes to their left:

1. Anchors whose k bytes occur once in the corpus are dropped; hashes are counted exactly and a fixed-size filter of those
   that repeat goes to the tasks.
2. Each task sorts its anchors' suffixes into runs, collapses equal contexts, and sends front-coded runs to partitions
   by the hash of the k bytes.
3. A partition merges its runs with a loser tree that remembers common prefixes; no prefix known to be equal is
   compared again. The common prefixes of neighbours give the classes of equal bytes to the right at every depth, those
   of the sorted left contexts the classes to the left; a string's first occurrence is the first of both classes.
4. Anchors with more rows than a partition's share are resolved window by window: no partition holds them all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import mix, pack, powers, prefix_sums, small_batches, stored, text_slices, tree_join
from vantage.operators.ranking import ordered_positions

LENGTH, ANCHOR = 100, 40
#: Bits of the filter of repeated anchors (fixed: a fuller one costs speed only), and rows of a partition.
FILTER_BITS, PART_ROWS = 1 << 26, 150_000
#: A task sorts a run when it holds so many anchors.
RUN_ROWS = 150_000


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the k bytes) of the anchors of all windows that lie inside one text."""
    n, wide = len(data) - k + 1, length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    h = mix((sums[k:] - sums[:n]) * powers(len(data) + 1)[1][:n])
    low = np.uint64(0xFFFFFFFF)
    best = (h & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < wide:
        best = np.minimum(best[:len(best) - (wide - span)], best[wide - span:])
    bad = np.zeros(len(data) + 1, np.int32)  # steps into and out of the starts of windows that cross into the next text
    np.add.at(bad, np.maximum(off[1:] - length + 1, off[:-1]), 1)
    np.add.at(bad, off[1:], -1)
    inside = np.cumsum(bad)[:len(best)] == 0
    at = (best[inside] & low).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, h[at]


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((x % np.uint64(FILTER_BITS)).astype(np.int64) for x in (h, mix(h + np.uint64(1))))


def repeated(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(h, n): hashes of anchors that occur more than once, over all rows (id, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        held, size = [], 0
        for b in batches:
            for _, _, data, off in text_slices(b, "text"):
                held.append(anchors(data, off, length, k)[1])
                size += len(held[-1])
                if size > 1_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return rows.mapInArrow(scan, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def bit_filter(hashes: DataFrame) -> np.ndarray:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            for s in slots(b.column(0).to_numpy().view(np.uint64)):
                bits[s] = True
        yield pa.RecordBatch.from_arrays([pa.array([pack(np.packbits(bits))], pa.binary())], ["bits"])

    return tree_join(hashes.select("h").mapInArrow(scan, "bits binary"), np.uint8, np.bitwise_or, FILTER_BITS // 8)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = slots(h)
    return ((bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)


class Contexts:
    """Anchors with the bytes around them: ``left`` reads backwards from the anchor, ``right`` forwards, zero-filled."""

    def __init__(self, left, llen, right, rlen, doc, pos, h):
        self.left, self.llen, self.right, self.rlen, self.doc, self.pos, self.h = left, llen, right, rlen, doc, pos, h

    @classmethod
    def cut(cls, data, off, ids, at, h, length, k):
        row = np.searchsorted(off, at, "right") - 1
        wide = length - k
        padded = np.concatenate((np.zeros(wide, np.uint8), data, np.zeros(length, np.uint8)))
        view = np.lib.stride_tricks.sliding_window_view(padded, wide + length)[at]
        llen = np.minimum(at - off[row], wide).astype(np.uint8)
        rlen = np.minimum(off[row + 1] - at, length).astype(np.uint8)
        left = view[:, :wide][:, ::-1] * (np.arange(wide) < llen[:, None])
        right = view[:, wide:] * (np.arange(length) < rlen[:, None])
        return cls(left, llen, right, rlen, ids[row], at - off[row], h)

    @classmethod
    def joined(cls, parts):
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("left", "llen", "right", "rlen", "doc", "pos", "h")])

    def take(self, i):
        return Contexts(self.left[i], self.llen[i], self.right[i], self.rlen[i], self.doc[i], self.pos[i], self.h[i])


def as_keys(*columns: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings to sort; a last byte that isn't zero keeps zeros at the end."""
    n = len(columns[0])
    flat = np.concatenate([c.reshape(n, -1) for c in columns] + [np.ones((n, 1), np.uint8)], axis=1)
    return np.ascontiguousarray(flat).view(f"S{flat.shape[1]}").ravel()


def shared_prefix(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of every row with the row before it, within the sizes of both; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], np.minimum(first, np.minimum(size[1:], size[:-1]))))


def sorted_runs(c: Contexts, parts: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Front-coded runs by partition, from the anchors of a task.

    Anchors with equal contexts become one, the first; the others' windows all start earlier as well, so their spans
    travel as results.
    """
    c = c.take(np.lexsort((c.pos, c.doc)))
    keys = as_keys(c.right, c.rlen, c.left, c.llen)
    order = np.argsort(keys, kind="stable")
    c, keys = c.take(order), keys[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    own = np.flatnonzero(first)[np.cumsum(first) - 1]
    gone = ((c.doc != c.doc[own]) | (c.pos != c.pos[own])) & (c.llen.astype(int) + c.rlen >= length)
    done = np.stack((c.doc, c.pos - c.llen, c.pos + c.rlen), axis=1)[gone]
    done_part = (c.h[gone] % np.uint64(parts)).astype(np.int64)
    c = c.take(np.flatnonzero(first))
    part = (c.h % np.uint64(parts)).astype(np.int64)
    for p in np.unique(np.concatenate((part, done_part))):
        own = c.take(np.flatnonzero(part == p))
        lcp = shared_prefix(own.right, own.rlen)
        n = len(own.rlen)
        new = np.ones(n, bool)
        new[1:] = (lcp[1:] < own.rlen[1:]) | (own.rlen[1:] != own.rlen[:-1])
        items = np.flatnonzero(new)
        rest = b"".join(own.right[i, lcp[i]:own.rlen[i]].tobytes() for i in items)
        run = (lcp[items].astype(np.uint8), own.rlen[items], rest, np.diff(np.append(items, n)), own.left, own.llen, own.doc, own.pos, done[done_part == p])
        yield int(p), zstandard.compress(pickle.dumps(run, 5), 3)


def decoded(lcp: np.ndarray, size: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix shared with the string before, string) of a front-coded run."""
    at, s = 0, b""
    for keep, n in zip(lcp.tolist(), size.tolist(), strict=True):
        s = s[:keep] + rest[at:at + n - keep]
        at += n - keep
        yield keep, s


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, prefix shared with the string before) in sorted order of all strings of the sorted runs.

    A loser tree whose nodes hold, with the loser, the prefix it shares with the winner that passed. Of two strings that
    are not less than the last one out, the one that shares more with it is the smaller; only at a tie are bytes
    compared, from the tied prefix on.
    """
    k = len(runs)
    head: list[bytes | None] = [None] * k
    node_run, node_lcp = [-1] * max(k, 1), [0] * max(k, 1)

    def climb(run: int, h: int) -> tuple[int, int]:
        v = (run + k) >> 1
        while v:
            other = node_run[v]
            if other < 0:
                node_run[v], node_lcp[v] = run, h
                return -1, 0
            g = node_lcp[v]
            if h == g >= 0:
                a, b = head[run], head[other]
                m = min(len(a), len(b))
                x = int.from_bytes(a[h:m], "big") ^ int.from_bytes(b[h:m], "big")
                same = m - (x.bit_length() + 7) // 8
                if (a[same] > b[same]) if same < m else len(a) > len(b):
                    node_run[v], node_lcp[v], run, h = run, same, other, g
                else:
                    node_lcp[v] = same
            elif h < g:
                node_run[v], node_lcp[v], run, h = run, h, other, g
            v >>= 1
        return run, h

    winner, lcp = -1, 0
    for r in range(k):
        first = next(runs[r], None)
        head[r] = first[1] if first else None
        winner, lcp = climb(r, 0 if first else -1)
    while winner >= 0 and lcp >= 0:
        yield winner, lcp
        item = next(runs[winner], None)
        head[winner] = item[1] if item else None
        winner, lcp = climb(winner, item[0] if item else -1)


def resolved(blobs: list[bytes], length: int, k: int) -> np.ndarray:
    """(doc, from, to) of every anchor's bytes that go, from the runs of one partition."""
    runs = [pickle.loads(zstandard.decompress(b)) for b in blobs]
    done = np.concatenate([r[8] for r in runs])
    full = [r for r in runs if len(r[0])]
    if not full:
        return done
    order = list(merged([decoded(*r[:3]) for r in full]))
    which, lcp = np.array([x[0] for x in order]), np.array([x[1] for x in order])
    # Items come out of a run in order: the i-th of a run is its i-th item.
    item = np.zeros(len(which), np.int64)
    for r in range(len(full)):
        item[which == r] = np.arange(len(full[r][0]))
    item_first = np.cumsum([0, *[len(r[0]) for r in full]])
    rows_of = np.concatenate([r[3] for r in full])
    row_first = np.cumsum([0, *rows_of])
    items = item_first[which] + item
    n_rows = rows_of[items]
    rows = np.repeat(row_first[items] - np.concatenate(([0], np.cumsum(n_rows)[:-1])), n_rows) + np.arange(n_rows.sum())
    rlen = np.repeat(np.concatenate([r[1] for r in full])[items].astype(np.int64), n_rows)
    rlcp = rlen.copy()
    rlcp[np.concatenate(([0], np.cumsum(n_rows)[:-1]))] = lcp
    left, llen, doc, pos = (np.concatenate([r[f] for r in full])[rows] for f in (4, 5, 6, 7))
    llen = llen.astype(np.int64)
    by_left = np.argsort(as_keys(left, llen.astype(np.uint8)), kind="stable")
    llcp = shared_prefix(left[by_left], llen[by_left])
    n, wide = len(rows), length - k
    in_order = np.lexsort((pos, doc))
    most, least = np.full(n, -1), np.full(n, wide + 1)
    left_class = np.zeros(n, np.int64)
    for o in range(wide + 1):
        right_class = np.cumsum(rlcp < length - o)
        left_class[by_left] = np.cumsum(llcp < o)
        key = (right_class * (n + 1) + left_class)[in_order]
        fits = ((rlen >= length - o) & (llen >= o))[in_order]
        own = in_order[fits]
        _, firsts, at = np.unique(key[fits], return_index=True, return_inverse=True)
        source = own[firsts[at]]
        dup = own[(doc[own] != doc[source]) | (pos[own] != pos[source])]
        most[dup] = o
        least[dup] = np.minimum(least[dup], o)
    # The windows of one anchor all hold its k bytes, so their union is one span.
    hit = np.flatnonzero(most >= 0)
    return np.concatenate((done, np.stack((doc[hit], pos[hit] - most[hit], pos[hit] + length - least[hit]), axis=1)))


def spans_batch(spans: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(spans[:, i]).astype(np.int64)) for i in range(3)]


SPANS = "id long, lo long, hi long"


def cold_spans(rows: DataFrame, bits: np.ndarray, hot: np.ndarray, parts: int, length: int, k: int) -> DataFrame:
    """Spans to remove from the runs of all anchors but hot ones."""
    shared = rows.sparkSession.sparkContext.broadcast((bits, hot))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held):
            out = list(sorted_runs(Contexts.joined(held), parts, length))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["part", "run"])

        known, hot = shared.value
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, off in text_slices(b, "text"):
                at, h = anchors(data, off, length, k)
                keep = has(known, h) & ~np.isin(h, hot)
                if keep.any():
                    held.append(Contexts.cut(data, off, ids[i:j], at[keep], h[keep], length, k))
                    size += int(keep.sum())
                    if size > RUN_ROWS:
                        yield sent(held)
                        held, size = [], 0
        if held:
            yield sent(held)

    def reduce(table: pa.Table) -> pa.Table:
        spans = resolved([x.as_py() for x in table.column("run")], length, k)
        return pa.Table.from_arrays(spans_batch(spans), ["id", "lo", "hi"])

    return rows.mapInArrow(scan, "part long, run binary").groupBy("part").applyInArrow(reduce, SPANS)


def joined_spans(row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """(row, from, to) of the unions of windows that start at ``start``; rows come sorted by (row, start)."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return np.stack((row[at], start[at], start[last] + length), axis=1)


def hot_windows(data: np.ndarray, off: np.ndarray, ids: np.ndarray, hot: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first windows as (key, key, id, start), spans) of the windows at hot anchors of a slice.

    A window's key is the hashes of its two halves. Windows that have an earlier equal one in the slice are spans at once.
    """
    at, h = anchors(data, off, length, k)
    at = at[np.isin(h, hot)]
    row = np.searchsorted(off, at, "right") - 1
    lo, hi = np.maximum(off[row], at - (length - k)), np.minimum(at, off[row + 1] - length) + 1
    size = np.maximum(hi - lo, 0)
    s = np.unique(np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())) if len(at) else at
    if not len(s):
        return np.zeros((0, 4), np.int64), np.zeros((0, 3), np.int64)
    sums, inverse, mid = prefix_sums(data), powers(len(data) + 1)[1], s + length // 2
    a, b = mix((sums[mid] - sums[s]) * inverse[s]).view(np.int64), mix((sums[s + length] - sums[mid]) * inverse[mid]).view(np.int64)
    row = np.searchsorted(off, s, "right") - 1
    doc, start = ids[row], s - off[row]
    order = np.lexsort((start, doc, b, a))
    first = np.ones(len(s), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    source = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = np.sort(order[(doc[order] != doc[source]) | (start[order] != start[source])])
    spans = joined_spans(row[later], start[later], length)
    spans[:, 0] = ids[spans[:, 0]]
    kept = order[first]
    return np.stack((a[kept], b[kept], doc[kept], start[kept]), axis=1), spans


def hot_spans(rows: DataFrame, hot: np.ndarray, length: int, k: int) -> DataFrame:
    """Spans to remove at hot anchors: windows by key, the first of each slice standing for the slice's."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, off in text_slices(b, "text"):
                firsts, spans = hot_windows(data, off, ids[i:j], shared.value, length, k)
                none = [None] * len(spans)
                cols = [pa.array(list(firsts[:, c]) + none, pa.int64()) for c in range(2)]
                cols += [pa.array(np.concatenate((firsts[:, 2], spans[:, 0]))), pa.array(np.concatenate((firsts[:, 3], spans[:, 1]))),
                         pa.array(np.concatenate((firsts[:, 3] + length, spans[:, 2])))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "id", "lo", "hi"])

    found = stored(rows.mapInArrow(scan, "a long, b long, id long, lo long, hi long"))
    windows = found.filter("a is not null")
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("id", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(firsts, ["a", "b"]).filter(F.struct("id", "lo") != F.col("first"))
    return found.filter("a is null").select("id", "lo", "hi").unionByName(later.select("id", "lo", "hi"))


def removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes that go, maximal runs that go)."""
    keep, at, runs, end = [], 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            keep.append(text[at:lo])
            runs += 1
        end = max(end, hi)
        at = max(at, end)
    kept = b"".join([*keep, text[at:]])
    return kept, len(text) - len(kept), runs


def placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, id): rows with the whole number that orders them; equal rows share it, rows without an id have none.

    It is the id itself unless an id comes with different texts: then all rows are numbered by id, and within an id by the
    text's hash, so that every text has a place of its own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = rows.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("mark"))
    several = marked.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a < b")
    if several.isEmpty():
        return rows.withColumn("id", F.col("doc_id"))
    places = ordered_positions(marked.distinct(), ["doc_id", "mark"], "id")
    return stored(rows.withColumn("mark", F.xxhash64("text")).join(places, ["doc_id", "mark"], "left").select("doc_id", "text", "id"))


def placed_spans(rows: DataFrame, length: int, k: int, part_rows: int) -> DataFrame:
    """(id, lo, hi) of rows with their place."""
    rows = rows.filter("id is not null and text is not null").select("id", "text")
    again = stored(repeated(rows, length, k))
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_rows))
    # At most as many hashes as there are partitions can have more rows than a partition's share.
    hot = np.array(sorted(r[0] for r in again.filter(F.col("n") > part_rows).select("h").collect()), np.int64).view(np.uint64)
    spans = cold_spans(rows, bit_filter(again), hot, parts, length, k)
    return spans.unionByName(hot_spans(rows, hot, length, k)) if len(hot) else spans


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR,
                 part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): every row without the bytes that strings of ``length`` bytes cover that start earlier too.

    Earlier: in a document with a smaller id, or before in the same one. A null text is empty; rows with a null id keep all.
    Equal rows are one document at one place: they don't remove each other. Different texts of one id are documents of
    their own, the one with the smaller hash first.
    """
    docs = placed(docs, doc_id, text)
    with small_batches(docs.sparkSession):
        spans = stored(placed_spans(docs, length, k, part_rows))
    listed = spans.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(listed, "id", "left").select("doc_id", "text", "spans")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode()
                out.append((*removed(raw, [(x["lo"], x["hi"]) for x in s or []]), len(raw)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(scan, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
