"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import BASE, LOWER, mix, pack, stored, text_slices, tree_join, word_hashes, word_spans
from vantage.llm.mixing import uniform

#: Buckets of the hashed n-gram models (a fixed size), and target documents that the target model reads at most, in expectation.
BUCKETS, TARGET_DOCS = 1 << 14, 20_000
#: A text's log-ratio is that of so many n-grams drawn from it, whatever its length, shrunk for texts of few n-grams.
DRAWN, SHRINK = 100, 10
SEED = "resample-1"


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words of the texts; A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    pair = mix(h[:-1] * np.uint64(BASE) + h[1:])[row[:-1] == row[1:]] if len(h) else h
    rows = np.concatenate((row, row[:-1][row[:-1] == row[1:]])) if len(h) else row
    return rows, (np.concatenate((h, pair)) >> np.uint64(24)).astype(np.int64) % BUCKETS


def log_ratios(rows: DataFrame, target: frozenset[int]) -> np.ndarray:
    """Log of target over raw probability for every bucket, from all ``rows`` (id, text); target ids are a bounded set."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(sorted(target), np.int64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            wanted = np.isin(b.column(0).fill_null(0).to_numpy(), shared.value) & ~b.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(b, "text"):
                row, bucket = ngrams(data, off)
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[wanted[i:j][row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([pack(sums)], pa.binary())], ["part"])

    raw, own = tree_join(rows.mapInArrow(scan, "part binary"), np.int64, np.add, 2 * BUCKETS).reshape(2, BUCKETS) + 1.0
    return np.log(own / own.sum()) - np.log(raw / raw.sum())


def scores(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, log_weight) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_slices(b, "text"):
                row, bucket = ngrams(data, off)
                n = np.bincount(row, minlength=j - i)
                total = np.bincount(row, weights=shared.value[bucket], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(DRAWN * total / (n + SHRINK))], ["id", "log_weight"])

    return rows.mapInArrow(scan, "id long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting ever finer ranges of its bits.

    Each of four rounds collects at most 65,536 counts, however many rows there are. None if k is 0 or there are fewer rows.
    """
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.filter(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("p")).count().collect() if k > 0 else []
        prefix = None
        for p, n in sorted((tuple(r) for r in counts), reverse=True):
            if left <= n:
                prefix = p
                break
            left -= n
        if prefix is None:
            return None
    return prefix


def resampled(docs: DataFrame, labels: DataFrame, share: float = 0.8, seed: str = SEED, doc_id: str = "doc_id", text: str = "text",
              target_docs: int = TARGET_DOCS) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected): one row per row of ``docs``.

    The raw model counts all documents; the target model those that ``labels`` (doc_id, quality, toxic) calls good, at
    most ``target_docs`` of them in expectation, chosen by a hash of the id. The ``share`` of rows with the largest key
    (log weight plus a Gumbel number from a hash of the id) is selected: sampling without replacement in proportion
    to the weights. Equal keys are selected together. Null texts have weight 0 in log; without target rows all do.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    n = good.count()
    target = frozenset(r[0] for r in good.filter(uniform("target-1", F.col("id")) < target_docs / max(n, 1)).collect())
    ratios = log_ratios(rows, target) if target else np.zeros(BUCKETS)
    gumbel = -F.log(-F.log(uniform(seed, F.col("id"))))
    # Keys are rounded to whole billionths, which order exactly and take no float care.
    keyed = stored(scores(rows, ratios).withColumn("gumbel_key", F.round((F.col("log_weight") + gumbel) * 1e9).cast("long")))
    total = keyed.count()
    least = kth_largest(keyed, "gumbel_key", round(total * share))
    return keyed.select(F.col("id").alias("doc_id"), "log_weight", (F.col("gumbel_key") / 1e9).alias("gumbel_key"),
                        (F.lit(False) if least is None else F.col("gumbel_key") >= least).alias("selected"))
