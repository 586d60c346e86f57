"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, then sorted-array intersection.

The steps, each linear in its input but for pairs that may truly link:

1. ``profiles``: each text's set size, a digest of the set and a parity bitmap; a bounded count sketch of all shingles.
   Equal sets meet by digest and go on as one.
2. ``prefix tokens``: under one global order (common shingles last, by the sketch), two sets of similarity t share a
   shingle among the first n - ceil(t n) + 1 of each. Tokens of one set alone are dropped in a streamed sort.
3. Tiles (token, size band): first each set is compared with the hubs it shares most tiles with, then, once sets have
   class labels, only sets of different classes that share a tile of fitting size, a token early enough and enough
   shared tokens for the overlap they need. Groups of copies thus need no pairs among them.
4. Candidate pairs must pass the bitmap bound; the rest are decided on their whole sorted shingle arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import BASE, LOWER, PIECES, joined, mix, pack, pieces, small_batches, stored, text_slices, unpack, word_hashes, word_spans
from vantage.operators.components import connected_components

WORDS, PERCENT = 5, 75
#: Counters of the count sketch, and bits of the filter of documents whose text is needed. Both are fixed sizes: more
#: data makes them fuller, which costs speed, never a link.
SKETCH, FILTER_BITS = 1 << 20, 1 << 23
BITMAP = 1024
#: Hubs that each set is compared with at first; what they leave apart is compared in full afterwards.
HUBS = 3


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted array of 64-bit hashes; empty without words."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, off)
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(len(off)))
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        rolled = rolled * np.uint64(BASE) + h[k:k + n]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= words:
            own = np.sort(rolled[lo:hi - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif hi > lo:
            # A short text is one shingle; the number of words keeps it apart from the windows above.
            value = int(hi - lo)
            for x in h[lo:hi]:
                value = (value * BASE + int(x)) % (1 << 64)
            out.append(mix(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity bits as longs: a shingle flips one bit, so differing bits never outnumber differing shingles."""
    return np.packbits(np.bincount((own >> np.uint64(40)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1).view(np.int64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(44)).astype(np.int64) % SKETCH


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, digest, bitmap) of every document, and one (sketch) row per task; docs has (id, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = ["id", "n", "digest", "bitmap", "sketch"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            for i, j, data, off in text_slices(b, "text"):
                sets = shingle_sets(data, off, words)
                if sum(map(len, sets)):
                    counts += np.bincount(_slots(np.concatenate(sets)), minlength=SKETCH)
                cols = [b.column(0).slice(i, j - i), [len(s) for s in sets],
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [bitmap(s) for s in sets], [None] * (j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(cols, kinds, strict=True)], names)
        if counts.any():
            packed = pack(counts)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, None, None, None, packed], kinds, strict=True)], names)

    return docs.mapInArrow(scan, "id long, n long, digest binary, bitmap array<long>, sketch binary")


def rarity(rows: DataFrame) -> np.ndarray:
    """Class of each sketch slot: the binary logarithm of its count over all documents."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pieces(unpack(x.as_py(), np.int64))

    counts = joined(rows.filter("sketch is not null").select("sketch").mapInArrow(split, PIECES), np.int64, np.add, SKETCH)
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)


def prefix_tokens(docs: DataFrame, order: np.ndarray, words: int, percent: int) -> DataFrame:
    """(id, n, tokens, last): the first shingles of every set, common ones last, and the place of the last in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            for i, j, data, off in text_slices(b, "text"):
                sets = shingle_sets(data, off, words)
                firsts, last = [], []
                for s in sets:
                    cls = rank[_slots(s)]
                    firsts.append(s[np.argsort(cls, kind="stable")[:prefix_length(len(s), percent)]] if len(s) else s)
                    last.append(int(rank[_slots(firsts[-1][-1:])][0]) << 56 | int(firsts[-1][-1]) >> 8 if len(s) else 0)
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), tokens, pa.array(last, pa.int64())],
                                                       ["id", "n", "tokens", "last"])

    return docs.mapInArrow(scan, "id long, n long, tokens array<long>, last long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """The rows whose token has another row; rows arrive sorted by token and are streamed."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_used = None, False  # the last row so far, and whether it has been given out
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            t = b.column(0).to_numpy()
            same = t[1:] == t[:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if held is not None and held_used:
                keep[0] = False  # given out before
            tail_used = bool(keep[-1]) or (len(t) == 1 and held_used)
            yield b.filter(pa.array(keep))
            held, held_used = b.slice(b.num_rows - 1), tail_used

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(scan, tokens.schema)


def band(n: Column, percent: int) -> Column:
    """Size band: sets within the similarity's size ratio lie in the same band or in neighbouring ones."""
    # The tiny stretch keeps sizes at the exact ratio from falling two bands apart by rounding.
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(percent / 100) * (1 + 1e-9))).cast("int")


def may_link(na: Column, nb: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Whether the overlap can be large enough: it is at most half of both sizes less the differing bits."""
    differing = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.floor((na + nb - differing) / 2) * (100 + percent) >= percent * (na + nb)


def linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle arrays intersect enough.

    The arrays are made again from the texts of documents that pass a filter of the ids on that side of ``pairs``.
    """
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros((2, FILTER_BITS), bool), False
        for b in batches:
            some |= b.num_rows > 0
            for c in range(2):
                out[c, _filter_slots(b.column(c).to_numpy())] = True
        if some:
            yield pieces(np.packbits(out))

    wanted = joined(pairs.select("a", "b").mapInArrow(bits, PIECES), np.uint8, np.bitwise_or, FILTER_BITS // 4).reshape(2, -1)

    def arrays(side: int) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(wanted[side])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mask = np.unpackbits(shared.value).astype(bool)
            for b in batches:
                b = b.filter(pa.array(mask[_filter_slots(b.column(0).to_numpy())]))
                for i, j, data, off in text_slices(b, "text"):
                    sets = [s.tobytes() for s in shingle_sets(data, off, words)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["id", "own"])

        return docs.mapInArrow(scan, "id long, own binary")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.select("a", "b").join(arrays(0).toDF("a", "own_a"), "a").join(arrays(1).toDF("b", "own_b"), "b")
        .select("a", "b", "own_a", "own_b").mapInArrow(decide, "a long, b long")
    )


def _filter_slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked by Jaccard similarity of their shingle sets.

    One row per row of ``docs``. A null, empty or blank text has no shingles and is a class of its own; so is a row with
    a null id, whose class is null. Equal sets always link. Rows that repeat an id get the class of their own text.
    The similarity is ``percent`` per hundred or more, decided in whole numbers.
    """
    with small_batches(docs.sparkSession):
        given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        rows = stored(profiles(given, words))
        known = given.filter("id is not null")
        order = rarity(rows)
        own = rows.filter("sketch is null").select("id", "n", "digest", "bitmap")
        sets = stored(
            own.filter("n > 0 and id is not null").groupBy("digest")
            .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
        )
        tokens = (
            prefix_tokens(known, order, words, percent).filter("n > 0").join(sets.select("id", "n"), ["id", "n"], "left_semi")
            .select(F.posexplode("tokens").alias("pos", "token"), "id", "n", "last").select("token", "id", "n", "pos", "last")
        )
        tiles = stored(shared_tokens(tokens).withColumn("band", band(F.col("n"), percent)))

        def bounded(pairs: DataFrame) -> DataFrame:
            a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("bits_a"))
            b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bits_b"))
            return pairs.join(a, "a").join(b, "b").filter(may_link(F.col("na"), F.col("nb"), F.col("bits_a"), F.col("bits_b"), percent)).select("a", "b")

        hubs = tiles.groupBy("token", "band").agg(F.min("id").alias("hub"), F.max("id").alias("_top")).filter("hub < _top").drop("_top")
        tried = tiles.join(hubs, ["token", "band"]).filter("id > hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).count()
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
        first = stored(bounded(tried.withColumn("rank", best).filter(F.col("rank") <= HUBS).select("a", "b")))
        links = stored(linked(known, first, words, percent))

        labels = connected_components(links)
        # Of a set's prefix only shared tokens can be in another set; the rest of the set may be.
        reach = tiles.groupBy("id").agg((F.count(F.lit(1)) + F.ceil(percent * F.first("n") / 100) - 1).alias("reach"))
        known_of = reach.join(labels, reach["id"] == labels["node"], "left").select("id", "reach", F.coalesce("component", "id").alias("label"))
        named = tiles.join(known_of, "id")
        mixed = named.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("token")
        open_tiles = stored(named.join(mixed, "token"))
        side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "last", "label", "reach")]
        left = open_tiles.select("token", F.col("band").alias("tile"), *side("a"))
        right = open_tiles.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("tile"), *side("b"), F.col("band").alias("band_b"))
        # The overlap that the pair needs; its first common token stands this early in both.
        need = F.floor((percent * (F.col("n_a") + F.col("n_b")) + 99 + percent) / (100 + percent))
        early = (F.col("pos_a") <= F.col("n_a") - need) & (F.col("pos_b") <= F.col("n_b") - need)
        # The prefix that ends first in the order is seen whole in both sets.
        most = F.when(F.col("last_a") < F.col("last_b"), F.col("reach_a")).when(F.col("last_a") > F.col("last_b"), F.col("reach_b")).otherwise(F.greatest("reach_a", "reach_b"))
        fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("label_a") != F.col("label_b")) & early & (most >= need)
        once = (F.col("band_b") > F.col("tile")) | (F.col("id_a") < F.col("id_b"))
        rest = (
            left.join(right, ["token", "tile"]).filter(fits & once)
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
        )
        more = stored(linked(known, stored(bounded(rest)), words, percent))
        final = connected_components(links.unionByName(more))
        classes = sets.join(final, sets["id"] == final["node"], "left").select("digest", F.coalesce("component", "id").alias("component"))
        return own.join(classes, "digest", "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"),
        )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, one row per id, with all their columns.

    Rows with a null id stay. Of rows that repeat an id the first by a hash of the whole row stays.
    """
    ids = similar_classes(docs, doc_id, text, words, percent).filter("doc_id = component_id").select("doc_id").distinct()
    row = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"))
    known = row.filter("_id is not null").join(ids.withColumnRenamed("doc_id", "_id"), "_id", "left_semi")
    order = Window.partitionBy("_id").orderBy(F.xxhash64("_row"))
    first = known.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_row")
    return first.unionByName(row.filter("_id is null").select("_row")).select("_row.*")
