"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import BASE, beside, byte_kinds, category_table, mix, text_slices, word_spans

LONGEST = 5
UNKNOWN = "und"

#: Bounds of the model: documents read per language, words kept per language, n-grams kept per language and length.
SAMPLE_DOCS, KEEP_WORDS, KEEP_GRAMS = 5_000, 20_000, 5_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the ids that no model learns from; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with marked ends; single characters are taken without the marks."""
    marked = word if n == 1 else f" {word} "
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def letter_kinds() -> np.ndarray:
    """For every code point 1 if it is a letter, 2 if it is a mark (such as a vowel sign), else 0."""
    return category_table("letters", {"L": 1, "M": 2})


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of some texts in bytes: longest runs of letters and marks with at least one letter."""
    kinds = byte_kinds(data, letter_kinds())
    start, end, row = word_spans(kinds, off, np.arange(256) == 0)
    letters = np.concatenate(([0], np.cumsum(kinds == 1)))
    real = letters[end] > letters[start]
    return start[real], end[real], row[real]


def different_words(batch: pa.RecordBatch, column: int | str) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, end row, different words, code of each word, row of each word) of runs of rows; case is folded."""
    for lo, hi, data, off in text_slices(batch, column, 2 << 20, lower=True):
        start, end, row = words_of(data, off)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start] += 1
        np.subtract.at(inside, end, 1)
        letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        ends = np.concatenate(([0], np.cumsum(end - start)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        yield lo, hi, coded.dictionary, coded.indices.to_numpy().astype(np.int64), row


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the ``n`` code points from each place on."""
    key = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
    for k in range(n):
        key = mix(key * np.uint64(BASE) + codes[k:k + len(key)])
    return key


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


@dataclass
class Model:
    """Log frequencies of words and n-grams in each language. ``index`` has the words, then the n-grams of each length; the rows
    of ``logs`` are theirs, in this order."""

    langs: list[str]
    index: list[list[str]]
    logs: np.ndarray
    words: pa.Array = field(init=False)
    keys: list[np.ndarray] = field(init=False)
    places: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.words = pa.array([w.encode() for w in self.index[0]], pa.large_binary())
        first = np.cumsum([0, *map(len, self.index)])
        self.keys, self.places = [], []
        for n in range(1, LONGEST + 1):
            own = np.array([gram_keys(code_points(g), n)[0] for g in self.index[n]], np.uint64)
            order = np.argsort(own)
            self.keys.append(own[order])
            self.places.append(order + first[n])

    @classmethod
    def fitted(cls, rows: list[tuple[int, str, str, int]], add: float = 0.5) -> Model:
        """From (level, lang, gram, count) rows, where level 0 has the words; frequencies are smoothed with ``add``."""
        langs = sorted({r[1] for r in rows})
        at = {x: i for i, x in enumerate(langs)}
        index: list[list[str]] = []
        table: list[np.ndarray] = []
        for level in range(LONGEST + 1):
            own = [r for r in rows if r[0] == level]
            index.append(sorted({r[2] for r in own}))
            place = {g: i for i, g in enumerate(index[-1])}
            counts = np.zeros((len(place), len(langs)))
            for _, lang, gram, n in own:
                counts[place[gram], at[lang]] = n
            counts += add
            table.append(np.log(counts / counts.sum(axis=0)) if len(counts) else counts)
        return cls(langs, index, np.concatenate(table))

    def word_rows(self, words: pa.Array) -> np.ndarray:
        """For each word its row if it is known; else the mean of its known n-grams of the longest length that has any; else zeros."""
        known = pc.index_in(words, self.words)
        out = np.zeros((len(words), len(self.langs)))
        place = known.fill_null(-1).to_numpy().astype(np.int64)
        out[place >= 0] = self.logs[place[place >= 0]]
        rest = np.flatnonzero(place < 0)
        if not len(rest):
            return out
        # The unseen words in a row, with one space as the end of one and the start of the next.
        codes = code_points(" " + " ".join(w.decode() for w in words.take(pa.array(rest)).to_pylist()) + " ")
        space = codes == 32
        spaces = np.concatenate(([0], np.cumsum(space)))
        word = spaces[1:] - 1
        open_ = np.ones(len(rest) + 1, bool)
        open_[-1] = False
        for n in range(LONGEST, 0, -1):
            at = np.arange(len(codes) - n + 1)
            # Inside an n-gram there is no end of a word; single characters are taken without the ends.
            whole = (spaces[at + n - 1] == spaces[at + 1]) if n > 1 else ~space[at]
            at = at[whole & open_[word[at]]]
            key = gram_keys(codes, n)[at]
            keys = self.keys[n - 1]
            if not len(keys) or not len(at):
                continue
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[spot] == key
            owner, rows = word[at[hit]], self.places[n - 1][spot[hit]]
            found = np.bincount(owner, minlength=len(rest))[:len(rest)]
            for k in range(len(self.langs)):
                out[rest, k] += np.bincount(owner, self.logs[rows, k], len(rest))[:len(rest)] / np.maximum(found, 1)
            open_[:-1] &= found == 0
        return out

    def predictions(self, batch: pa.RecordBatch, column: int | str) -> tuple[list[str], np.ndarray]:
        """(language, score) of each row of the batch."""
        best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        for lo, _, words, code, row in different_words(batch, column) if self.langs else ():
            if not len(row):
                continue
            rows, first = np.unique(row, return_index=True)
            total = np.add.reduceat(self.word_rows(words)[code], first, axis=0)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            top = np.argmax(share, axis=1)  # ties: the first in order of name
            best[lo + rows], score[lo + rows] = top, share[np.arange(len(rows)), top] / share.sum(axis=1)
        return [UNKNOWN if i < 0 else self.langs[i] for i in best.tolist()], score

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, score = self.predictions(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]), 0)
        return langs[0], float(score[0])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_docs: int = SAMPLE_DOCS, keep_words: int = KEEP_WORDS, keep_grams: int = KEEP_GRAMS) -> Model:
    """A model of at most ``sample_docs`` documents per language (in expectation), chosen by a hash of their ids.

    Rows with a null language, text or id and held-out rows are not used. The counts that reach the driver are bounded
    by the number of languages times ``keep_words + 5 * keep_grams``.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chance = (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("double")) / F.lit(float(2**48))
    sample = known.join(beside(sizes), "lang").filter(chance < F.lit(float(sample_docs)) / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lo, hi, words, code, row in different_words(b, 1):
                names, own = [w.decode() for w in words.to_pylist()], langs[lo:hi]
                for la in dict.fromkeys(own):
                    times = np.bincount(code[(own == la)[row]], minlength=len(names))
                    seen[la].update({names[k]: int(times[k]) for k in np.flatnonzero(times)})
        for la, words in seen.items():
            levels = [words, *[Counter() for _ in range(LONGEST)]]
            for w, n in words.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        levels[k][g] += n
            for k, own in enumerate(levels):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(own), pa.int32()), pa.array([la] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())],
                    ["level", "lang", "gram", "n"])

    counts = sample.mapInArrow(count, "level int, lang string, gram string, n long").groupBy("level", "lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("level", "lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("rank", F.row_number().over(order)).filter(
        (F.col("rank") <= F.when(F.col("level") == 0, keep_words).otherwise(keep_grams)) & ((F.col("level") > 0) | (F.col("n") > 1)))
    return Model.fitted([tuple(r) for r in kept.select("level", "lang", "gram", "n").collect()])


def languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs``, from the whole text alone.

    ``und`` with score 0 for a null text, a text without letters, or a model that learned nothing. The score is the
    share of the predicted language in the likelihoods of all of them; equal ones go to the first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs, score = own.predictions(b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least`` as its score, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            langs, score = own.predictions(b, place)
            yield b.filter(pa.array([la != UNKNOWN and p >= least for la, p in zip(langs, score)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
