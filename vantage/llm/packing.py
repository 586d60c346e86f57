"""Packing documents into training sequences, with lexically close documents in the same window.

Documents become token ids. A document fills windows of its own as long as it can; what remains of it is packed with others.
Every document is routed by the two tokens that stand out most in it, and documents in order of their route are dealt into
shards of about SHARD tokens, so that documents that share what is particular to them meet. A shard has an inverted index. A seed asks it for
unused neighbours by BM25; they fill the seed's window in order of their score, the last one is cut, and its rest is the next
seed. What a shard can't fill goes on to the next shard of the task. At the end of a task less than one window is left: it is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import LOWER, WHITE, pack, small_batches, stored, text_slices, tree_join, unpack, word_spans

WINDOW, END = 2048, 1
#: Tokens of a shard; tokens of a seed that ask the index; words whose ids a task remembers.
SHARD, ASKED, REMEMBERED = 4_000_000, 16, 700_000
K1, B = 1.2, 0.75


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: letters, marks that may end a word, white space, all else. Letters beyond ASCII come in pairs, see _classes.
OTHER, LETTER, CLOSING, SPACE = range(4)
KINDS = np.where(WHITE, np.int8(SPACE), np.int8(OTHER))
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[list(b'.,;:!?"()[]{}*#$%&+-/@_~')] = CLOSING
#: Byte-level vocabularies write each byte as one printable character: itself if it is one, else the next free one from 256 on.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
AS_CHAR = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Words of the letters that _classes knows.
LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of U+00C0 to U+024F are LETTER but for U+00D7, U+00F7 and U+0130, whose small form is two characters."""
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    after = data[np.minimum(lead + 1, len(data) - 1)]
    lead = lead[~(((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data[lead] == 0xC4) & (after == 0xB0)) | ((data[lead] == 0xC9) & (after > 0x8F)))]
    kinds[lead] = LETTER
    kinds[lead + 1] = LETTER
    return kinds


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, bytes to read) of the parts of the texts that can be encoded apart.

    White space separates tokens. Letters with closing marks behind them are two parts, and their ASCII case is folded, as the
    tokenizer does itself; any other word, such as one with an apostrophe, is left as it is.
    """
    start, end, row = word_spans(data, off)
    if not len(start):
        return start, end, row, data
    kinds = _classes(data)
    of = lambda places: np.searchsorted(start, places, "right") - 1
    plain = kinds[start] == LETTER
    plain[of(np.flatnonzero(kinds == OTHER))] = False
    closing = np.flatnonzero(kinds == CLOSING)
    plain[of(closing[kinds[np.minimum(closing + 1, len(kinds) - 1)] == LETTER])] = False
    word = of(closing)
    first = np.concatenate(([True], word[1:] != word[:-1]))[:len(word)] & plain[word]
    cut, places = word[first], closing[first]
    stem = end.copy()
    stem[cut] = places
    capital = np.flatnonzero((data >= 0x41) & (data <= 0x5A))
    capital = capital[plain[of(capital)]]
    data = data.copy()
    data[capital] = LOWER[data[capital]]
    starts = np.concatenate([start, places])
    order = np.argsort(starts, kind="stable")
    return starts[order], np.concatenate([stem, end[cut]])[order], np.concatenate([row, row[cut]])[order], data


class Words:
    """Token ids of texts, each different word encoded once."""

    def __init__(self, description: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        rest, known, tokenize = [], self.known, self.model.tokenize
        for word in words:
            text = word.decode()
            if LETTERS.fullmatch(text):
                # Letters alone are one word of the model: nothing is left to normalise but case, nothing to split.
                text = text.lower()
                text = text if text.isascii() else text.encode().decode("latin-1").translate(AS_CHAR)
                known[word] = array("H", [t.id for t in tokenize(text)]).tobytes()
            else:
                rest.append((word, text))
        for (word, _), found in zip(rest, self.tokenizer.encode_batch([t for _, t in rest], add_special_tokens=False)):
            known[word] = array("H", found.ids).tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = words
        self.learn(fresh)
        return [known[w] for w in words]

    def texts(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Ids of every text of the batch, END last."""
        for lo, hi, data, off in text_slices(batch, "text", 4 << 20):
            start, end, row, data = pieces_of(data, off)
            ends = np.concatenate(([0], np.cumsum(end - start)))
            letters = data[~WHITE[data]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
            found = self.ids(words.dictionary.to_pylist())
            code = words.indices.to_numpy()
            size = np.fromiter(map(len, found), np.int64, len(found)) >> 1
            whole = np.frombuffer(b"".join(found), np.uint16)
            first = np.concatenate(([0], np.cumsum(size)))[:-1]
            long = size[code]
            # A row's ids and END: each run of ids is shifted by the rows before it.
            rows = hi - lo
            total = int(long.sum())
            flat = np.full(total + rows, END, np.uint16)
            steps = np.arange(total)
            flat[steps + np.repeat(row, long)] = whole[steps + np.repeat(first[code] - np.cumsum(long) + long, long)]
            cuts = np.cumsum(np.bincount(row, long, rows).astype(np.int64) + 1)
            yield from np.split(flat, cuts[:-1])


def tokenised(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """(doc_id, tokens, ids, route, counts): every text as packed 16-bit ids, counts null; from each task a row with counts alone.

    The counts of a task are one array as long as the vocabulary: in how many of its documents each token stands. The route is
    made of the two tokens that stand out most, where a token counts as the rarer the later it came into the vocabulary.
    """
    description = Path(tokenizer).read_text()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(description), np.zeros(size, np.int64)
        names = ["doc_id", "tokens", "ids", "route", "counts"]
        late = np.log(np.arange(size) + 2.0)
        for batch in batches:
            ids = list(words.texts(batch))
            route = []
            for x in ids:
                tokens, weight = weights(x, late, WINDOW)
                total[tokens] += 1
                best = _best(tokens, weight, 2)
                route.append(int(best[0]) * size + int(best[-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary()), pa.array(route, pa.int64()), pa.nulls(len(ids), pa.binary()),
            ], names)
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([pack(total)], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, tokens long, ids binary, route long, counts binary")


def weights(ids: np.ndarray, rarity: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(different tokens, BM25 weight of each) of a document."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    tokens, times = ids[first], np.diff(np.append(first, len(ids)))
    return tokens, rarity[tokens] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(ids) / mean))


def _best(tokens: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    if len(weight) > 4 * most:
        least = np.partition(weight, len(weight) - most)[len(weight) - most]
        tokens, weight = tokens[weight >= least], weight[weight >= least]
    return tokens[np.argsort(-weight, kind="stable")[:most]]


class Shard:
    """Open pieces of documents, an inverted index over them, and the windows they fill."""

    def __init__(self, pieces: list[list], rarity: np.ndarray, mean: float) -> None:
        self.pieces, self.rarity, self.mean = pieces, rarity, mean
        self.left = np.array([len(p[3]) - p[2] for p in pieces], np.int64)
        found = [weights(p[3][p[2]:], rarity, mean) for p in pieces]
        self.asks = [_best(t, w, ASKED) for t, w in found]
        token = np.concatenate([t for t, _ in found]).astype(np.int64)
        of = np.repeat(np.arange(len(pieces)), [len(t) for t, _ in found])
        order = np.argsort(token, kind="stable")
        self.of, self.weight = of[order], np.concatenate([w for _, w in found])[order]
        self.first = np.searchsorted(token[order], np.arange(len(rarity) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces in order of their score for the seed, equal scores in order of their route."""
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.asks[seed]]
        score = np.bincount(np.concatenate([self.of[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.pieces))
        unused = np.flatnonzero(self.left)
        near = unused[score[unused] > 0]
        return np.concatenate([near[np.argsort(-score[near], kind="stable")], unused[score[unused] <= 0]])

    def windows(self) -> Iterator[list[tuple[int, int]]]:
        """Full windows as (piece, length); pieces that can't fill one stay."""
        rest, seed, at = int(self.left.sum()), None, 0
        while rest >= WINDOW:
            if seed is None:
                while not self.left[at]:
                    at += 1
                seed = at
            window, room = [(seed, int(self.left[seed]))], WINDOW - int(self.left[seed])
            self.left[seed] = 0
            chosen, seed = seed, None
            for i in self.neighbours(chosen):
                if not room:
                    break
                took = min(room, int(self.left[i]))
                window.append((int(i), took))
                self.left[i] -= took
                room -= took
                if self.left[i]:
                    seed = int(i)
            rest -= WINDOW
            yield window


OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Sequences:
    """Collects the pieces of sequences. A piece is [doc_id, tokens of its document, ids used so far, ids, place of the first id]."""

    def __init__(self, part: int) -> None:
        self.number, self.rows = part << 40, []

    def add(self, taken: list[tuple[list, int]]) -> None:
        offset = 0
        for piece, length in taken:
            doc, total, used, ids, base = piece
            crc = zlib.crc32(ids[used:used + length].astype("<u4").tobytes())
            self.rows.append((doc, base + used, length, crc, total, self.number, offset))
            piece[2] += length
            offset += length
        self.number += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(OUT))], schema=OUT)


def _packed(docs: Iterator[tuple[int, np.ndarray]], part: int, rarity: np.ndarray, mean: float, shard: int) -> Iterator[pa.RecordBatch]:
    out, pieces, size = Sequences(part), [], 0

    def fill() -> None:
        index = Shard(pieces, rarity, mean)
        for window in index.windows():
            out.add([(pieces[i], n) for i, n in window])
        pieces[:] = [p for p in pieces if p[2] < len(p[3])]

    for doc, ids in docs:
        own = len(ids) // WINDOW * WINDOW
        for at in range(0, own, WINDOW):
            out.add([([doc, len(ids), 0, ids[at:at + WINDOW], at], WINDOW)])
        if own < len(ids):
            pieces.append([doc, len(ids), 0, ids[own:].copy(), own])
            size += len(ids) - own
        if size >= shard:
            fill()
            size = sum(len(p[3]) - p[2] for p in pieces)
        if len(out.rows) > 50_000:
            yield out.batch()
    if pieces:
        fill()
    while pieces:
        # Fewer ids than a window: the largest power of two, again and again.
        room = 1 << (sum(len(p[3]) - p[2] for p in pieces).bit_length() - 1)
        taken = []
        for p in pieces:
            if room:
                taken.append((p, min(room, len(p[3]) - p[2])))
                room -= taken[-1][1]
        out.add(taken)
        pieces = [p for p in pieces if p[2] < len(p[3])]
    yield out.batch()


def packed(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    A null or empty text is the one id END. Rows with equal ids are documents of their own, equal texts too; a null doc_id stays
    null. An empty table gives no pieces. Other columns have no effect.
    """
    from tokenizers import Tokenizer

    tokenizer = tokenizer or vocabulary()
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    with small_batches(docs.sparkSession, 1000):
        encoded = stored(tokenised(docs, tokenizer, size))
    ids = encoded.where("counts is null").drop("counts")
    n, total = ids.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    found = tree_join(encoded.where("counts is not null").select("counts"), np.int64, np.add, size)
    rarity, mean = np.log1p((n - found + 0.5) / (found + 0.5)), total / max(n, 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d.as_py(), unpack(x.as_py(), np.uint16)) for batch in batches for d, x in zip(batch.column("doc_id"), batch.column("ids")))
        yield from _packed(rows, TaskContext.get().partitionId(), rarity, mean, shard)

    dealt = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(max(1, -(-int(total) // shard)), "route", "doc_id", "tie").sortWithinPartitions("route", "doc_id", "tie")
    with small_batches(docs.sparkSession):
        return stored(dealt.select("doc_id", "ids").mapInArrow(fill, ", ".join(f"{f.name} long" for f in OUT)))
