"""Source divergence audit: how far the word use of each source lies from that of the others and of its language.

Words that at least LEAST documents of a language contain are its terms. They are dealt by hash into blocks of about BLOCK
terms. In a block every source has a segment tree over the terms' counts. Trees are hash-consed over all sources and places:
equal subtrees of counts, such as those without any occurrence, are one node. The trees of two sources are walked down
together, level by level, and a pair of nodes that comes up again is only counted, so that each pair is priced once.
Shares and distances are whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import LOWER, small_batches, stored, text_slices, word_spans

#: Documents of its language that a term must stand in; terms of a block; terms that a source reports.
LEAST, BLOCK, TOP = 30, 2048, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Text bytes counted at a time, and sources of a tile: two tiles are compared in a task.
BYTES, TILE = 8 << 20, 128

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(texts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Occurrences and documents of each word of each (lang, source) in some rows; a row without term for each such group."""
    table = pa.Table.from_batches(texts).combine_chunks()
    named: dict[tuple[str, str], int] = {}
    group = np.array([named.setdefault(g, len(named)) for g in zip(*[pc.fill_null(table[c], "").to_pylist() for c in ("lang", "source")])])
    words, rows, at = [], [], 0
    for batch in table.select(["text"]).to_batches():
        for lo, _, data, off in text_slices(batch, "text"):
            start, end, row = word_spans(data, off, BETWEEN)
            if len(start):
                ends = np.concatenate(([0], np.cumsum(end - start)))
                words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[data[~BETWEEN[data]]])]))
                rows.append(row + lo + at)
        at += batch.num_rows
    keys, counts, docs, terms = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    if words:
        coded = pa.concat_arrays(words).dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        both, times = np.unique(np.concatenate(rows) * len(terms) + codes, return_counts=True)
        keys, back, docs = np.unique(group[both // len(terms)] * len(terms) + both % len(terms), return_inverse=True, return_counts=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, back, times)
    of = np.concatenate([keys // max(len(terms), 1), np.arange(len(named))])
    names = np.array(list(named), object)
    none = pa.nulls(len(named), pa.string())
    zeros = np.zeros(len(named), np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(names[of, 0], pa.string()), pa.array(names[of, 1], pa.string()),
        pa.concat_arrays([terms.take(pa.array(keys % max(len(terms), 1))).cast(pa.binary()).cast(pa.string()), none]),
        pa.array(np.concatenate([counts, zeros])), pa.array(np.concatenate([docs, zeros])),
    ], schema=COUNTS)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with one, of every word; a null term for every group."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > BYTES:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    texts = docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers of up to 38 digits."""
    top = (n + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + PRIOR * terms).cast("decimal(20,0)")) + 1


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """As share(), by long division in steps of a thousand, which no count below 9e15 makes overflow."""
    whole, rest = np.divmod(n + PRIOR, total + PRIOR * terms)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total + PRIOR * terms)
        whole = whole * 1000 + more
    return whole + 1


def segment_trees(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash-consed trees over the rows of a matrix whose width is a power of two, from the leaves up.

    A level is (children of each different node, node of each row and place); a leaf's one child is its count.
    """
    kinds, nodes = np.unique(counts, return_inverse=True)
    levels = [(kinds[:, None], nodes.reshape(counts.shape))]
    while levels[-1][1].shape[1] > 1:
        below, size = levels[-1][1], len(levels[-1][0])
        kinds, nodes = np.unique(below[:, ::2].astype(np.int64) * size + below[:, 1::2], return_inverse=True)
        levels.append((np.stack([kinds // size, kinds % size], axis=1), nodes.reshape(len(below), -1)))
    return levels


def distances(levels: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray, terms: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each pair of rows the sum over all places of the difference of their shares; places of a negative count are none."""
    roots = levels[-1][1][:, 0]
    pair, a, b, times = np.arange(len(pairs[0])), roots[pairs[0]], roots[pairs[1]], np.ones(len(pairs[0]), np.int64)
    for (kinds, _), (under, _) in zip(levels[:0:-1], levels[-2::-1]):
        size = len(under)
        key = np.concatenate([(pair * size + kinds[a, side]) * size + kinds[b, side] for side in (0, 1)])
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, np.concatenate([times, times]), len(key)).astype(np.int64)
        pair, a, b = key // (size * size), key // size % size, key % size
    counted = levels[0][0][:, 0]
    gap = np.abs(_shares(counted[a], totals[pairs[0][pair]], terms) - _shares(counted[b], totals[pairs[1][pair]], terms)) * (counted[a] >= 0)
    out = np.zeros(len(pairs[0]), np.int64)
    np.add.at(out, pair, gap * times)
    return out


PRICES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Distances of all pairs of the two tiles of sources over the terms of one block."""
    if not len(sources):
        return PRICES.empty_table()
    names, totals, tile = np.array(sources["source"].to_pylist(), object), sources["total"].to_numpy(), sources["tile"].to_numpy()
    cells = pa.concat_arrays(terms["cells"].chunks) if len(terms) else pa.array([], terms.schema.field("cells").type)
    width = len(cells)
    size = np.diff(cells.offsets.to_numpy())
    place = {s: i for i, s in enumerate(names)}
    flat = cells.flatten()
    row = np.fromiter((place.get(s, -1) for s in flat.field("source").to_pylist()), np.int64, len(flat))
    # Terms of the most documents first: the places without occurrences then lie together.
    order = np.lexsort((np.array(terms["term"].to_pylist(), object), -terms["docs"].to_numpy()))
    spot = np.empty(width, np.int64)
    spot[order] = np.arange(width)
    matrix = np.full((len(names), 1 << max(width - 1, 0).bit_length()), -1, np.int64)
    matrix[:, :width] = 0
    here = row >= 0
    matrix[row[here], np.repeat(spot, size)[here]] = flat.field("n").to_numpy()[here]
    left, right = key[2].as_py(), key[3].as_py()
    a, b = np.meshgrid(np.flatnonzero(tile == left), np.flatnonzero(tile == right), indexing="ij")
    a, b = a.ravel(), b.ravel()
    if left == right:
        a, b = a[a < b], b[a < b]
    price = np.zeros(len(a), np.int64)
    if width:
        levels = segment_trees(matrix)
        step = max(1, (1 << 20) // matrix.shape[1])
        for i in range(0, len(a), step):
            price[i:i + step] = distances(levels, totals, sources["n_terms"][0].as_py(), (a[i:i + step], b[i:i + step]))
    lang = [key[0].as_py()] * (2 * len(a))
    return pa.table([lang, names[np.concatenate([a, b])], names[np.concatenate([b, a])], np.concatenate([price, price])], schema=PRICES)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language, and its outstanding terms.

    Null lang, source and text count as empty, and an empty source is a source; equal rows count as often as they stand there;
    without terms all distances are 0 and no term is reported; without documents there are no rows. Equal values rank by the
    UTF-8 of the item. Columns other than lang, source and text have no effect.
    """
    with small_batches(docs.sparkSession):
        counted = stored(counts(docs))
    terms = stored(counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.collect_list(F.struct("source", "n")).alias("cells"))
                   .where(F.col("docs") >= LEAST))
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("in_lang").alias("lang_total"))
    totals = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "n_terms", "lang_total"])
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.greatest(F.ceil(F.max("n_terms") / BLOCK).cast("int"), F.lit(1)).alias("blocks"))
    tile = lambda source: F.pmod(F.xxhash64(source), F.col("tiles")).cast("int")
    groups = stored(groups.join(sizes, "lang").withColumn("tile", tile(F.col("source"))))

    # Each two tiles of a language meet once in each of its blocks.
    cut = terms.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cut = cut.withColumn("b", F.explode(F.sequence(F.col("a"), F.col("tiles") - 1)))
    cut = cut.select("lang", "term", "docs", F.filter("cells", lambda c: tile(c["source"]).isin(F.col("a"), F.col("b"))).alias("cells"), "block", "a", "b")
    mine = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine = mine.select("lang", "source", "total", "n_terms", "tile", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    keys = ["lang", "block", "a", "b"]
    priced = cut.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInArrow(_block, "lang string, source string, item string, value long")
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    own = terms.select("lang", "term", "in_lang", F.explode("cells").alias("c")).select("lang", "c.source", F.col("term").alias("item"), "c.n", "in_lang").join(groups, ["lang", "source"])
    gap = share(F.col("n"), F.col("total"), F.col("n_terms")) - share(F.col("in_lang"), F.col("lang_total"), F.col("n_terms"))
    best = own.select("lang", "source", "item", gap.alias("value")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(best, "term").where(F.col("rank") <= TOP))
