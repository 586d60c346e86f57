"""Prefix trie of rebuilt conversations: one row for every distinct beginning.

Conversations that share their first turns share the nodes of those turns. Turns become 128-bit ids and every distinct sequence
is kept once, with its number of copies. Sequences are dealt by range of their ids, so neighbours in order are neighbours in
a task; there they form matrices of padded ids in which sorted rows and accumulated changes between them mark where the nodes
of every depth start, and segmented sums give their figures. Only nodes on the first and last row of a matrix can go on in
another one: those are joined again by their fingerprint.

A matrix is DEPTH turns wide. What lies deeper is a trie of its own below each shared sequence of DEPTH turns, built first and
hung in with its sums. A sequence that shares nothing below some multiple of DEPTH turns needs no matrix there: its nodes are
a plain chain. So no row, matrix or task holds more than DEPTH turns of a conversation, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import mix, stored

#: Turns in a matrix; rows of a matrix are those of one Arrow batch.
DEPTH = 64
#: A conversation starts with the first turns of the first of its family of so many ids; fewer than MOST of them.
FAMILY, MOST = 5, 9
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family, and leaves out of its own."""
    return (F.crc32(conv_id.cast("string")) % MOST).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, r, id, bytes): turns in order from 1, as ids of their role and text. Rows without conv_id belong to nothing."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(name).alias("id"), F.octet_length(text).alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return turns.select("conv_id", F.row_number().over(order).alias("r"), "id", "bytes")


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, b, ids, bytes, tx, ty, dx, dy, last): rebuilt conversations in blocks of DEPTH turns.

    (tx, ty) names all turns before the block, (dx, dy) all up to its end. A conversation without turns is one empty block.
    """
    h = taken(F.col("conv_id"))
    heads = (turns.where((F.col("r") < MOST) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("first"))
             .agg(F.sort_array(F.collect_list(F.struct("r", "id", "bytes"))).alias("head")))
    convs = turns.groupBy("conv_id").agg(F.max("r").alias("n")).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads, "first", "left").select("conv_id", "n", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), h).alias("head"))
    copied = convs.select("conv_id", F.posexplode("head")).select("conv_id", (F.col("pos") + 1).alias("pos"), "col.id", "col.bytes")
    own = turns.where(F.col("r") > h).join(convs.select("conv_id", F.size("head").alias("k")), "conv_id").select("conv_id", (F.col("r") - h + F.col("k")).alias("pos"), "id", "bytes")
    rows = copied.union(own).groupBy("conv_id", F.floor((F.col("pos") - 1) / DEPTH).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("turns"))
    none = convs.where((F.size("head") == 0) & (F.col("n") <= h)).select("conv_id", F.lit(0).alias("b"), F.array().cast(rows.schema["turns"].dataType).alias("turns"))
    rows = rows.union(none).select("conv_id", "b", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))
    rows = rows.withColumns({"x": F.xxhash64("b", "ids"), "y": F.xxhash64(F.lit("y"), "b", "ids")})
    order = Window.partitionBy("conv_id").orderBy("b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top = {"tx": F.coalesce(F.bit_xor("x").over(before), F.lit(0)), "ty": F.coalesce(F.bit_xor("y").over(before), F.lit(0)), "last": F.lead("b").over(order).isNull()}
    return rows.withColumns(top).withColumns({"dx": F.col("tx").bitwiseXOR(F.col("x")), "dy": F.col("ty").bitwiseXOR(F.col("y"))}).drop("x", "y")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, sha) of every run of equal (dx, dy): smallest id, number and digest of its ids, which come in ascending order."""
    key, rep, n, sha = None, 0, 0, None
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        out = []
        x, y, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "conv_id"))
        cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1), len(ids)] if len(ids) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if key != (x[lo], y[lo]):
                if sha:
                    out.append((rep, n, sha.hexdigest()))
                key, rep, n, sha = (x[lo], y[lo]), int(ids[lo]), 0, hashlib.sha256()
            sha.update((("," if n else "") + ",".join(map(str, ids[lo:hi].tolist()))).encode())
            n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((rep, n, sha.hexdigest()), schema)], schema=schema)


def sequences(parts: DataFrame) -> DataFrame:
    """Blocks of every distinct sequence once, under its smallest conversation: + rep, n, sha.

    The digest of a sequence's ids is one SHA-256 over all of them, so its ids pass one task, as a stream.
    """
    ends = parts.where("last").select("dx", "dy", "conv_id").repartition("dx", "dy").sortWithinPartitions("dx", "dy", "conv_id")
    kept = ends.mapInArrow(_copies, "rep long, n long, sha string")
    return parts.join(kept, parts["conv_id"] == kept["rep"]).drop("conv_id")


NODES = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("sha", pa.string()), ("bytes", pa.int64()), ("tx", pa.int64()), ("ty", pa.int64()),
    ("fp", pa.binary()), ("parent", pa.binary()), ("path", pa.list_(pa.binary())),
])
NODES_DDL = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, bytes long, "
             "tx long, ty long, fp binary, parent binary, path array<binary>")
#: What a row of NODES is: a whole node, a whole node below an open one, a part of an open node, or the sums below a shared top.
WHOLE, UNDER_OPEN, OPEN, TOP = range(4)


def _matrix(batch: pa.RecordBatch, above: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one matrix ``above`` turns down: rows of (tx, ty, top_conv, ids, bytes, n, conv, sha, below_*) in order of (tx, ty, ids)."""
    rows = batch.num_rows
    col = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = batch.column("ids")
    length = np.diff(ids.offsets.to_numpy())
    width = int(length.max())
    real = np.arange(width) < length[:, None]
    flat = ids.flatten().cast(pa.binary())
    m = np.zeros((rows, width, 2), np.uint64)
    if len(flat):
        at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset]
        m[real] = np.frombuffer(flat.buffers()[2], ">u8", 2 * len(flat), int(at)).reshape(-1, 2)
    size = np.zeros((rows, width), np.int64)
    size[real] = batch.column("bytes").flatten().to_numpy(zero_copy_only=False)
    tx, ty = col("tx"), col("ty")
    order = np.lexsort([m[:, j, k] for j in range(width - 1, -1, -1) for k in (1, 0)] + [ty, tx])
    m, size, real, length, tx, ty = m[order], size[order], real[order], length[order], tx[order], ty[order]
    n, conv, top_conv = (col(c)[order] for c in ("n", "conv", "top_conv"))
    below = [col(c)[order] for c in ("below_children", "below_leaves", "below_saved")]
    sha = np.array(batch.column("sha").to_pylist(), object)[order]
    edge = np.flatnonzero((order == 0) | (order == rows - 1))

    # Column d tells where a row differs from the one above it within its first d turns.
    change = np.ones((rows, width + 1), bool)
    change[1:, 0] = (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])
    change[1:, 1:] = (m[1:] != m[:-1]).any(axis=2) | (real[1:] != real[:-1])
    starts_at = np.logical_or.accumulate(change, axis=1)
    prints = [np.stack([tx, ty], axis=1).astype(np.uint64)]
    for d in range(width):
        prints.append(mix(prints[-1] * np.uint64(0x9E3779B97F4A7C15) + m[:, d]) + prints[-1][:, ::-1])

    name = lambda d, row: prints[d][row].tobytes()
    child = None
    made = []
    for d in range(width, -1, -1):
        there = np.flatnonzero(length >= d)
        cut = np.flatnonzero(starts_at[there, d])
        first = there[cut]
        ends = length[first] == d
        sums = [np.where(ends, x[first], 0) for x in below]
        open_ = np.zeros(len(first), bool)
        open_[np.searchsorted(first, edge[length[edge] >= d], "right") - 1] = True
        node = {"d": d, "first": first, "n": np.add.reduceat(n[there], cut), "conv": np.minimum.reduceat(conv[there], cut), "open": open_, "ends": ends}
        if child is not None:
            child["parent"] = np.searchsorted(first, child["first"], "right") - 1
            closed = ~child["open"]
            for into, values in zip(sums, (np.ones(len(closed), np.int64), child["leaves"], child["saved"])):
                np.add.at(into, child["parent"][closed], values[closed])
        node["bytes"] = size[first, d - 1] if d else np.zeros(len(first), np.int64)
        node["children"], node["leaves"], node["saved"] = sums[0], sums[1] + (~open_ & (sums[0] == 0)), sums[2] + np.where(open_, 0, (node["n"] - 1) * node["bytes"])
        made.append(node)
        child = node

    for node, up in zip(made, [*made[1:], None]):
        d, first, open_ = node["d"], node["first"], node["open"]
        count = len(first)
        kind = np.where(open_, OPEN, WHOLE)
        parent_conv, parent = np.full(count, -1), [None] * count
        known = np.zeros(count, bool)
        if d == 0:
            kind[~open_] = TOP
        else:
            if d == 1 and above:
                parent_conv, known = top_conv[first], np.ones(count, bool)
            else:
                parent_conv, known = up["conv"][node["parent"]], ~up["open"][node["parent"]]
            kind[~open_ & ~known] = UNDER_OPEN
            labels = {i: name(d - 1, up["first"][i]) for i in np.flatnonzero(up["open"])}
            parent = [labels.get(i) for i in node["parent"].tolist()]
        spots = np.flatnonzero(open_)
        fp, path = [None] * count, [None] * count
        for i in spots:
            fp[i], path[i] = name(d, first[i]), [name(k, first[i]) for k in range(d + 1)]
        values = [
            pa.array(kind, pa.int32()), pa.array(node["conv"]), pa.array(np.full(count, above + d)), pa.array(parent_conv, mask=~known), pa.array(node["n"]),
            pa.array(node["children"]), pa.array(node["leaves"]), pa.array(node["saved"]), pa.array([s if e else None for s, e in zip(sha[first], node["ends"])], pa.string()),
            pa.array(node["bytes"]), pa.array(tx[first]), pa.array(ty[first]), pa.array(fp, pa.binary()), pa.array(parent, pa.binary()), pa.array(path, pa.list_(pa.binary())),
        ]
        yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, NODES)], schema=NODES)


def _level(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, sums below each top) of the blocks of one level."""
    above = level * DEPTH

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _matrix(batch, above)

    dealt = rows.repartitionByRange("tx", "ty", "ids").sortWithinPartitions("tx", "ty", "ids")
    made = stored(dealt.mapInArrow(fold, NODES_DDL))
    parts = made.where(F.col("kind") == OPEN).groupBy("fp").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("depth", "sha", "bytes", "tx", "ty", "parent", "path", "parent_conv_id")])
    kids = parts.where("parent is not null").groupBy(F.col("parent").alias("fp")).agg(F.count("*").alias("more"))
    parts = parts.join(kids, "fp", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = parts.select(F.explode("path").alias("fp"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("s"))
    sums = own.groupBy("fp").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    parts = stored(parts.drop("n_leaves", "saved_tokens", "more").join(sums, "fp"))
    parents = parts.select(F.col("fp").alias("parent"), F.col("conv_id").alias("above"))
    under = made.where(F.col("kind") == UNDER_OPEN).unionByName(parts.withColumn("kind", F.lit(OPEN)), allowMissingColumns=True)
    under = under.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    nodes = made.where(F.col("kind") == WHOLE).unionByName(under.drop("above"))
    tops = made.where(F.col("kind") == TOP).unionByName(parts.where(F.col("depth") == above), allowMissingColumns=True)
    if level:
        nodes = nodes.where(F.col("depth") > above)
    return nodes.select(*OUT), tops.select("tx", "ty", *[F.col(c).alias(f"below_{c.split('_')[-1]}") for c in ("n_children", "n_leaves")], F.col("saved_tokens").alias("below_saved"))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]


def _chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, sums below each first top) of blocks that no other sequence shares: every turn is a node with at most one child."""
    weight = F.aggregate("bytes", F.lit(0).cast("long"), lambda a, x: a + x)
    order = Window.partitionBy("rep").orderBy(F.col("b").desc())
    rows = rows.withColumn("after", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight)
    # What a turn saves is summed from the last one up; inside a block by a running sum over its reversed bytes.
    tail = F.aggregate(F.reverse("bytes"), F.array().cast("array<long>"), lambda a, x: F.concat(F.array(F.coalesce(F.get(a, F.lit(0)), F.lit(0)) + x), a))
    one = rows.withColumn("first", F.min("b").over(Window.partitionBy("rep"))).select("*", F.posexplode(F.transform(tail, lambda s: s + F.col("after"))))
    ends = F.col("last") & (F.col("pos") == F.size("ids") - 1)
    starts = (F.col("pos") == 0) & (F.col("b") == F.col("first"))
    nodes = one.select(
        F.col("rep").alias("conv_id"), (F.col("b").cast("long") * DEPTH + F.col("pos") + 1).alias("depth"), F.when(starts, F.col("top_conv")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(ends, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("col")).alias("saved_tokens"), F.when(ends, F.col("sha")).alias("sha"))
    sums = one.where(starts).select("b", "tx", "ty", F.lit(1).cast("long").alias("below_children"), F.lit(1).cast("long").alias("below_leaves"), ((F.col("n") - 1) * F.col("col")).alias("below_saved"))
    return nodes, sums


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Null roles and texts are empty; turns with equal numbers come in the order of the MD5 of their role and text, repeated rows
    one after another; other columns have no effect. Rows without conv_id are left out; without any conversation there is no node.
    """
    turns = stored(numbered(conversations))
    parts = stored(sequences(stored(blocks(turns))))
    full = F.col("last") & (F.size("ids") == DEPTH)
    through = parts.where("b > 0").select("b", "tx", "ty", "rep", F.lit(1).alias("goes"))
    ending = parts.where(full).select((F.col("b") + 1).alias("b"), F.col("dx").alias("tx"), F.col("dy").alias("ty"), "rep", F.lit(0).alias("goes"))
    tops = through.union(ending).groupBy("b", "tx", "ty").agg(F.sum("goes").alias("goes"), F.min("rep").alias("top_conv")).where("goes > 0")
    deep = stored(parts.where("b > 0").join(tops, ["b", "tx", "ty"]))
    shared = deep.where("goes > 1")
    chains, below = _chains(deep.where("goes = 1"))
    found = [chains]
    for level in range(shared.agg(F.max("b")).first()[0] or 0, -1, -1):
        rows = (shared.where(F.col("b") == level) if level else parts.where("b = 0").withColumn("top_conv", F.lit(0).cast("long"))).drop("goes")
        rows = rows.groupBy("tx", "ty", "dx", "dy").agg(
            F.first("ids").alias("ids"), F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("rep").alias("conv"), F.min("top_conv").alias("top_conv"), F.max(F.when(F.col("last"), F.col("sha"))).alias("sha"))
        hung = below.where(F.col("b") == level + 1).select(F.col("tx").alias("dx"), F.col("ty").alias("dy"), "below_children", "below_leaves", "below_saved")
        rows = rows.join(hung, ["dx", "dy"], "left").drop("dx", "dy").na.fill(0, ["below_children", "below_leaves", "below_saved"])
        nodes, sums = _level(rows, level)
        found.append(nodes)
        below = below.unionByName(sums.withColumn("b", F.lit(level)))
    out = found[0]
    for nodes in found[1:]:
        out = out.unionByName(nodes)
    return out.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA256))).drop("sha")
