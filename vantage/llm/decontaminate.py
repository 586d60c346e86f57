"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

Passages of the corpus and of the benchmark are TF-IDF vectors over hashed words. A randomised SVD (a sparse random sketch
of the passage matrix, summed over all tasks, then decomposed on the driver at a fixed size) gives a latent space; windows
of every whole text are compared in it with benchmark passages, a block of passages at a time. A window that could share
enough words with a passage holds some of the passage's rarest ones: only those pairs are compared, which loses none. Pairs
above the cosine bound are decided word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import byte_kinds, category_table, mix, pack, small_batches, text_slices, unpack, word_hashes, word_spans

#: Fixed sizes of the latent space: hashed terms, rows of the two sketches, entries per passage in each, and the rank kept.
TERMS, BASIS_ROWS, SCALE_ROWS, ENTRIES, RANK = 1 << 14, 72, 160, 4, 64
#: Words of a passage, words from one passage of an item to the next, words of a step of the window, benchmark passages in a block.
PASSAGE, GRID, STEP, BLOCK = 24, 4, 8, 20_000
#: Cosine from which a pair is looked at; share of the passage's words in common order that is a leak, and the share that
#: is one if the item's answer is there as well.
COSINE, STRONG, WEAK, ANSWER = 0.4, 0.75, 0.6, 0.9

#: Under CONTIGUOUS words an item must stand as it is, under ALONE words it must be the whole text.
CONTIGUOUS, ALONE = 8, 4
#: Scripts without spaces between words: each character is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
WORD, SINGLE = 1, 2


def word_kinds() -> np.ndarray:
    """For every code point WORD if it is a letter, mark or digit, SINGLE if it is one of a script without spaces, else 0."""
    table = category_table("words", {"L": WORD, "M": WORD, "N": WORD})
    for lo, hi in UNSPACED:
        table[lo:hi + 1][table[lo:hi + 1] > 0] = SINGLE
    return table


def hashed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in lower case, and the first word of each text (with an end mark)."""
    sigma = np.flatnonzero(data[:-1] == 0xCF)
    if len(sigma := sigma[data[sigma + 1] == 0x82]):  # a final sigma is a sigma
        data = data.copy()
        data[sigma + 1] = 0x83
    kinds = byte_kinds(data, word_kinds())
    starts, ends, row = word_spans(kinds, off, np.arange(256) == 0)
    lead = (data & 0xC0) != 0x80
    single = kinds == SINGLE
    if single.any():
        # Cut before every character of an unspaced script, and before what follows one.
        before = np.concatenate(([False], single[:-1]))
        cuts = np.flatnonzero((kinds > 0) & lead & (single | before))
        starts = np.union1d(starts, cuts)
        row = np.searchsorted(off, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), ends[np.searchsorted(ends, starts, "right")])
    return word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(off)))


def text_words(text: str) -> list[int]:
    """Hashes of a text's words, folded by the same function as the columns of ``text_slices``."""
    raw = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0].tolist()


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % TERMS


def add_passages(sums: np.ndarray, df: np.ndarray, h: np.ndarray, first: np.ndarray) -> int:
    """Add the passages of some texts to both sketches, one below the other and flat, and to ``df``; how many they are."""
    if not len(h):
        return 0
    starts = np.flatnonzero((np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))) % PASSAGE == 0)
    passage = np.zeros(len(h), np.int64)
    passage[starts] = 1
    seen = np.sort((np.cumsum(passage) - 1) * TERMS + terms(h))
    seen = seen[np.concatenate(([True], seen[1:] != seen[:-1]))]
    own, term = seen // TERMS, seen % TERMS
    df += np.bincount(term, minlength=TERMS)
    key = np.bitwise_xor.reduceat(h, starts)
    for k in range(2 * ENTRIES):
        r = mix(key + np.uint64(k + 1))
        at = (r >> np.uint64(8)).astype(np.int64)
        at = at % BASIS_ROWS if k < ENTRIES else BASIS_ROWS + at % SCALE_ROWS
        # Signs have the type of the sums: add.at converts others entry by entry, which takes fifteen times as long.
        sign = (r & np.uint64(1)).astype(sums.dtype) * 2 - 1
        np.add.at(sums, at[own] * TERMS + term, sign[own])
    return len(starts)


def sketches(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketches of the passage matrix (terms present, unweighted), passages per term, and passages, over all ``texts``.

    Every passage adds its terms to a few rows of each sketch, with random signs; rows and signs are hashes of the
    passage's words. All sums are of whole numbers, so their order does not matter.
    """
    rows = BASIS_ROWS + SCALE_ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, df, n = np.zeros(rows * TERMS, np.int32), np.zeros(TERMS, np.int64), 0
        for b in batches:
            for _, _, data, off in text_slices(b, "text", lower=True):
                n += add_passages(sums, df, *hashed_words(data, off))
        if n:
            # One row of the sketches at a time, so that no process holds a second copy of them. A task's own sums, at
            # most one a passage, are 32-bit; all further ones are 64-bit.
            parts = [pack(sums[r * TERMS:(r + 1) * TERMS].astype(np.int64)) for r in range(rows)] + [pack(np.append(df, n))]
            yield pa.RecordBatch.from_arrays([pa.array(range(rows + 1), pa.int32()), pa.array(parts, pa.binary())], ["row", "part"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1)):
                part = unpack(x.as_py(), np.int64)
                if r == at:
                    total += part
                    continue
                if at is not None:
                    yield one(at, total)
                at, total = r, part.copy()
        if at is not None:
            yield one(at, total)

    def one(r: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pack(total)], pa.binary())], ["row", "part"])

    kind = "row int, part binary"
    sums, last = np.zeros((rows, TERMS), np.int64), np.zeros(TERMS + 1, np.int64)
    with small_batches(texts.sparkSession):
        for r, part in texts.mapInArrow(scan, kind).repartition("row").sortWithinPartitions("row").mapInArrow(add_up, kind).collect():
            (sums[r] if r < rows else last)[:] = unpack(bytes(part), np.int64)
    return sums, last[:-1], int(last[-1])


def embedding(sums: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """A latent vector for every term: its idf times its row of the right singular vectors, at unit variance.

    The first sketch gives the space. The second, which is independent of it, gives the passages' second moments
    inside the space without bias; they turn it to principal axes and scale those alike.
    """
    idf = 1 + np.log((1 + n) / (1 + df))
    _, s, vt = np.linalg.svd(sums[:BASIS_ROWS] * idf, full_matrices=False)
    basis = vt[:RANK].T * (s[:RANK] > 1e-9 * max(s[0], 1e-300))
    inside = (sums[BASIS_ROWS:] * idf) @ basis
    w, turn = np.linalg.eigh(inside.T @ inside)
    # With few passages for the rank, equal scales would part a passage from its near copy: the moments are shrunk then.
    w = np.maximum(w, 0) + max(w[-1], 1e-300) * min(1.0, RANK / max(n, 1))
    scale = np.where(w > 1e-12 * w[-1], np.sqrt(w), np.inf)
    return (idf[:, None] * (basis @ turn / scale)).astype(np.float32)


@dataclass
class Passage:
    item: int
    words: list[int]
    answer: list[int]
    masks: dict[int, int]
    answer_masks: dict[int, int]


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(own: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a column of the table at a time as bits of one number."""
    v = full = (1 << size) - 1
    for w in words:
        if m := own.get(w):
            u = v & m
            v = (v + u) | (v - u)
    return size - (v & full).bit_count()


def passages(item: int, text: str | None) -> list[Passage]:
    """Runs of ``PASSAGE`` words from every ``GRID``th word of an item (the last one ends with it), each with the item's answer.

    Any ``PASSAGE`` words in a row of the item are one of them but for ``GRID / 2`` words at most.
    The answer is the item's last sentence, or its last five words if that is shorter.
    """
    words = text_words(text or "")
    if not words:
        return []
    sentences = [s for s in re.split(r"[.!?\n]+", text or "") if text_words(s)]
    answer = words[-max(5, len(text_words(sentences[-1]))):]
    starts = [*range(0, max(1, len(words) - PASSAGE), GRID), max(0, len(words) - PASSAGE)]
    answer_masks = masks(answer)  # one for all passages of the item
    return [Passage(item, w := words[i:i + PASSAGE], answer, masks(w), answer_masks) for i in dict.fromkeys(starts)]


def window_steps(size: int) -> int:
    """Steps of the narrowest window that holds a passage of ``size`` words wherever it starts."""
    return -(-(size + STEP - 1) // STEP)


#: How many of a passage's rarest words more than the fewest possible are looked up; so many more of them must be found.
EXTRA = 2


@dataclass
class Shelf:
    """Benchmark passages of one window width: their unit vectors, their terms (padded), the fewest shared words to look
    further, and an inverted list: the rare words in order, and for each its passages.

    A passage of n words that shares ``fewest`` of them with a window shares 1 + EXTRA at least of any n - fewest + 1 + EXTRA.
    """

    width: int
    units: np.ndarray
    own: list[Passage]
    terms: np.ndarray
    fewest: np.ndarray
    rare: np.ndarray
    lists: np.ndarray
    first: np.ndarray
    needed: np.ndarray


def candidates(h: np.ndarray, first: np.ndarray, shelf: Shelf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, step in the text, passage) of windows around which enough of a passage's rare words stand."""
    if not len(shelf.rare):
        return (np.zeros(0, np.int64),) * 3
    spot = np.minimum(np.searchsorted(shelf.rare, h), len(shelf.rare) - 1)
    at = np.flatnonzero(shelf.rare[spot] == h)
    spot = spot[at]
    # An occurrence stands for each passage with the word, and for each window whose surroundings hold the occurrence.
    size = shelf.first[spot + 1] - shelf.first[spot]
    q = shelf.lists[np.repeat(shelf.first[spot] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    at = np.repeat(at, size)
    row = np.searchsorted(first, at, "right") - 1
    steps = -(-(first[row + 1] - first[row]) // STEP)
    step = ((at - first[row]) // STEP)[:, None] + np.arange(-shelf.width, 2)
    whole = (step >= 0) & ((step + shelf.width <= steps[:, None]) | (step == 0))
    pair = np.broadcast_to((row * len(shelf.own) + q)[:, None], step.shape)[whole]
    # Sorted by pair and step; how many occurrences each has.
    longest = int(steps.max(initial=0)) + 1
    key, found = np.unique(pair * longest + step[whole], return_counts=True)
    pair, step = key // longest, key % longest
    enough = found >= shelf.needed[pair % len(shelf.own)]
    return pair[enough] // len(shelf.own), step[enough], pair[enough] % len(shelf.own)


def search(h: np.ndarray, first: np.ndarray, table: np.ndarray, shelves: list[Shelf], cosine: float = COSINE) -> list[dict[int, float]]:
    """For each text the items that it leaks, with the best share of a passage's words in common order."""
    out: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
    if not len(h):
        return out
    own_terms = terms(h).astype(np.int16)
    for shelf in shelves:
        # One window from each step; near the end of a text it is shorter, and a short text is one window.
        row, step, q = candidates(h, first, shelf)
        begin = first[row] + step * STEP
        for lo in range(0, len(q), 4096):
            b, r, p = begin[lo:lo + 4096], row[lo:lo + 4096], q[lo:lo + 4096]
            windows, of = np.unique(b, return_inverse=True)
            at = windows[:, None] + np.arange(shelf.width * STEP)
            inside = at < first[np.searchsorted(first, windows, "right")][:, None]
            vec = np.einsum("wkr,wk->wr", table[own_terms[np.minimum(at, len(h) - 1)]], inside.astype(table.dtype))
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
            near = np.flatnonzero(np.einsum("wr,wr->w", vec[of], shelf.units[p]) >= cosine)
            if len(near):
                decide(h, first, own_terms, b[near], r[near], p[near], shelf, out)
    return out


def decide(h: np.ndarray, first: np.ndarray, own_terms: np.ndarray, begin: np.ndarray, row: np.ndarray, q: np.ndarray, shelf: Shelf,
           out: list[dict[int, float]]) -> None:
    """Hold windows against passages word by word; those with too few of the passage's words are left out first."""
    lo, hi = np.maximum(first[row], begin - STEP), np.minimum(first[row + 1], begin + (shelf.width + 1) * STEP)
    at = lo[:, None] + np.arange((shelf.width + 2) * STEP)
    # A bound of the common subsequence: the passage's words that stand in the window.
    region = np.where(at < hi[:, None], own_terms[np.minimum(at, len(h) - 1)], np.int16(-1))
    present = (region[:, None, :] == shelf.terms[q][:, :, None]).any(axis=2).sum(axis=1)
    for c in np.flatnonzero(present >= shelf.fewest[q]).tolist():
        p, text = shelf.own[q[c]], int(row[c])
        if len(p.words) < CONTIGUOUS:
            if stands(p.words, h[first[text]:first[text + 1]] if len(p.words) < ALONE else h[lo[c]:hi[c]]):
                out[text][p.item] = 1.0
            continue
        share = common_subsequence(p.masks, len(p.words), h[lo[c]:hi[c]].tolist()) / len(p.words)
        need = STRONG
        if WEAK <= share < need:
            around = h[max(int(first[text]), int(begin[c]) - 2 * PASSAGE):min(int(first[text + 1]), int(begin[c]) + 4 * PASSAGE)].tolist()
            if common_subsequence(p.answer_masks, len(p.answer), around) >= ANSWER * len(p.answer):
                need = WEAK
        if share >= need:
            out[text][p.item] = max(share, out[text].get(p.item, 0.0))


def stands(words: list[int], text: np.ndarray) -> bool:
    """Whether the words stand in the text in a row; fewer than ALONE of them, whether they are the text."""
    text = text.tolist()
    if len(words) < ALONE:
        return text == words
    return any(text[i:i + len(words)] == words for i in range(len(text) - len(words) + 1))


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[Passage]]:
    """The benchmark's passages, ``BLOCK`` or so at a time: only a block is on the driver at once. A longer item is cut."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).filter("item is not null and text is not null")
    # An item of so many characters has no more passages than half of them over the grid.
    size = rows.agg(F.coalesce(F.sum(F.ceil(F.length("text") / (2 * GRID)) + 1), F.lit(0))).first()[0]
    n = -(-size // BLOCK)
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows
        held: list[Passage] = []
        for r in sorted(part.collect()):
            held += passages(r["item"], r["text"])
            while len(held) >= 2 * BLOCK:
                yield held[:BLOCK]
                held = held[BLOCK:]
        if held:
            yield held


def prepared(table: np.ndarray, own: list[Passage], df: np.ndarray | None = None) -> list[Shelf]:
    """The passages by window width; ``df`` tells how common a term is."""
    out = []
    for width in sorted({window_steps(len(p.words)) for p in own}):
        some = [p for p in own if window_steps(len(p.words)) == width]
        ids = [terms(np.array(p.words, np.uint64)) for p in some]
        vec = np.array([table[x].sum(axis=0) for x in ids])
        padded = np.full((len(some), PASSAGE), -2, np.int16)
        for i, x in enumerate(ids):
            padded[i, :len(x)] = x
        units = (vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        size = np.array([len(x) for x in ids])
        fewest = np.where(size >= CONTIGUOUS, np.ceil(WEAK * size - 1e-9), size).astype(np.int64)
        extra = np.minimum(EXTRA, fewest - 1)
        posts, needed = [], 1 + extra
        for i, (p, x) in enumerate(zip(some, ids)):
            order = np.argsort(df[x] if df is not None else np.zeros(len(x)), kind="stable")[:size[i] - fewest[i] + 1 + extra[i]]
            words = {p.words[k] for k in order}
            # A word that stands twice in the passage may stand once in the window.
            needed[i] = max(1, needed[i] - (len(order) - len(words)))
            posts += [(w, i) for w in words]
        word, place = np.array([w for w, _ in posts], np.uint64), np.array([i for _, i in posts], np.int64)
        order = np.argsort(word, kind="stable")
        rare, first = np.unique(word[order], return_index=True)
        out.append(Shelf(width, units, some, padded, fewest, rare, place[order], np.append(first, len(word)), needed))
    return out


def latent_terms(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The latent vectors of all terms, and their passages, learned from every passage of both tables."""
    sums, df, n = sketches(docs.select(F.col(text).alias("text")).unionByName(benchmark.select(F.col(item_text).alias("text"))))
    return embedding(sums, df, n), df


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, share): documents that hold a passage of a benchmark item or a paraphrase of one.

    Each row of ``docs`` is searched whole. Null texts and items, and an empty table on either side, give no rows; ids
    that repeat give a row each. ``share`` is the part of the passage's words found in common order.
    """
    table, df = latent_terms(docs, benchmark, text, item_text)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, share double")
    for own in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((table, prepared(table, own, df)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, data, off in text_slices(b, "text", lower=True):
                    hits = [(i + k, item, share) for k, x in enumerate(search(*hashed_words(data, off), *shared.value, cosine)) for item, share in sorted(x.items())]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([x[0] for x in hits], pa.int64())), pa.array([x[1] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.float64())],
                        ["doc_id", "item_id", "share"])

        out = out.unionByName(rows.mapInArrow(scan, f"doc_id {kind}, item_id long, share double"))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with all their columns; each block of the benchmark filters in place."""
    table, df = latent_terms(docs, benchmark, text, item_text)
    place = docs.columns.index(text)
    for own in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((table, prepared(table, own, df)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, data, off in text_slices(b, place, lower=True):
                    clean = [not x for x in search(*hashed_words(data, off), *shared.value, cosine)]
                    yield b.slice(i, j - i).filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
