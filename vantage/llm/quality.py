"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rates that the rules bound, as (numerator, denominator, least width of the band in thousandths).
RATES = {"symbols": ("n_symbols", "n_words", 100), "dup_lines": ("n_dup_lines", "n_lines", 400),
         "repeats": ("n_repeat_words", "n_words", 300), "word_length": ("word_chars", "n_words", 2_000)}
#: A rate fails beyond so many interquartile ranges above its group's median.
SPREADS = 6
#: Groups with fewer documents take their language's thresholds, then those of all documents.
LEAST_GROUP = 100

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers in COUNTS for one whole text; a null text has none of anything."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    if len(often) < len(windows):
        upto = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, dup, repeated, lines


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, counts): one row per row of ``docs``; a null language or source is a group of its own."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(3)]
            cols = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], *cols], ["doc_id", "lang", "source", *COUNTS])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def rate(over: str, under: str) -> Column:
    """Thousandths, rounded down; 0 where there is nothing to divide by."""
    return F.when(F.col(under) > 0, F.floor(F.col(over) * 1000 / F.col(under))).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number: itself below 64, then 32 buckets per doubling (within 3.2 per cent).

    The doubling is the length in bits, so no logarithm is rounded at an edge.
    """
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value, shift)).cast("long")


def bucket_floor(b: Column) -> Column:
    """The smallest number in a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift * 32, shift)


def failed(n_words: str = "n_words", repeats: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(repeats) > MAX_REPEAT_PERCENT * F.col(n_words))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): quantile sketches of the documents that pass the fixed rules.

    Sketches of the same rate merge by adding the counts of equal buckets. A group has at most a few hundred buckets.
    """
    rates = F.explode(F.array(*[
        F.struct(F.lit(k).alias("rate"), bucket(rate(over, under)).alias("bucket")) for k, (over, under, _) in RATES.items()
    ]))
    return (
        rows.filter(~failed()).select("lang", "source", rates.alias("r")).select("lang", "source", "r.*")
        .groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and rate the number of documents and the three quartiles, from sketches merged over all else."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*keys, "rate")
    placed = merged.withColumn("upto", F.sum("n").over(one.orderBy("bucket"))).withColumn("all", F.sum("n").over(one))
    return placed.groupBy(*keys, "rate").agg(
        F.max("all").alias("docs"),
        *[bucket_floor(F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))).alias(f"q{k}") for k in (1, 2, 3)],
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): the highest accepted thousandths per rate for every language and source present."""
    band = F.create_map(*[F.lit(x) for k, (_, _, w) in RATES.items() for x in (k, w)])

    def limits(keys: list[str], name: str) -> DataFrame:
        high = F.col("q2") + F.greatest(SPREADS * (F.col("q3") - F.col("q1")), band[F.col("rate")])
        return quartiles(sketch, keys).groupBy(*keys).agg(
            F.max("docs").alias(f"{name}_docs"), F.map_from_entries(F.collect_list(F.struct("rate", high.cast("long").alias("high")))).alias(name))

    groups, by_lang, overall = limits(["lang", "source"], "own"), limits(["lang"], "language"), limits([], "overall")
    # The language's row and the overall row are one each, so these joins repeat no group.
    both = groups.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall))
    chosen = F.when(F.col("own_docs") >= LEAST_GROUP, F.col("own")).when(F.col("language_docs") >= LEAST_GROUP, F.col("language")).otherwise(F.col("overall"))
    return both.select("lang", "source", chosen.alias("limits"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every row's counts with ``base_failed``, ``kept`` and ``reasons`` (rates above their group's limit).

    Fixed rules first: too few words, or more than half of them in repeated three-word windows. Documents that pass
    are held against limits from the quantile sketches of their language and source: the median and ``SPREADS``
    interquartile ranges, at least a fixed band. A null text has no words and fails. An empty table gives no rows.
    """
    rows = stored(measured(docs, doc_id, text, lang, source))
    limits = thresholds(sketches(rows)).toDF("_lang", "_source", "_limits")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = F.array_compact(F.array(*[F.when(rate(a, b) > F.col("_limits")[k], F.lit(k)) for k, (a, b, _) in RATES.items()]))
    return joined.withColumn("base_failed", failed()).withColumn("reasons", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(over)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0)
    ).select("doc_id", "lang", "source", *COUNTS, "base_failed", "kept", "reasons")
