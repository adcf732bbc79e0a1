"""Prefix trie of conversations, with subtree totals rolled up by depth bands.

A node is a distinct sequence of first turns. It is known by 128 bits: each turn's role and text are hashed
together with its position, and a running exclusive-or over the turns gives the id of every prefix and of
the prefix before it. So no text is carried on once the turns are numbered.

Subtree totals do not follow the tree turn by turn. Depths are cut into bands of fixed height, and a node
adds its value only to its ancestors inside its own band, at most ``band`` of them. Nodes that head a band
form a tree of their own, lower by that factor, to which the same is done, until one band holds all. Then
the finished totals of band heads go back down, each to the at most ``band`` ancestors in the band above
it. A conversation of D turns needs ``log(D) / log(band)`` rounds each way, and a node is exploded to no
more than ``band`` rows a round, however deep the conversations are.

Long conversations are split everywhere: turns are numbered and hashed by blocks of bounded size, with the
blocks' offsets added afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitscore.llm.shared import ship
from pitscore.sources.io import materialize

BAND = 8
#: Turns of a conversation that are hashed in one group.
BLOCK = 4096
#: A key with more than this share of the rows is looked up by broadcast; there are at most 1000 such keys.
HOT_SHARE = 1000
#: Ids written into one piece of a node's list.
PIECE = 1 << 14
ID = ["h1", "h2"]
_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, t1, t2, n_bytes``: each turn's position in its conversation from 1, the hashes of its
    role and text, and the UTF-8 bytes of its text.

    Turns go by ``turn`` (null first), ties by role and text; null role or text is an empty one. Repeated
    rows are turns of their own. Rows without a conversation are in none and are left out. An empty table
    gives no rows. The table is sorted by ranges of all these columns, so one conversation may lie in many tasks; each
    numbers its own stretch, and the stretches before it are added: at most two conversations cross into or
    out of a task, so what is broadcast for that is two numbers a task.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    ).where("conv_id is not null").withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", *[F.xxhash64(F.lit(seed), "role", "text").alias(f"t{seed}") for seed in (1, 2)],
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )

    def count(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            pos = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
            if last is not None and ids[0] == last:
                pos[: sizes[0]] += seen
            last, seen = ids[-1], int(pos[-1])
            extra = [pa.array(pos, pa.int64()), pa.array(np.full(len(ids), part), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "pos", "part"])

    held = materialize(rows.mapInArrow(count, "conv_id bigint, t1 bigint, t2 bigint, n_bytes bigint, pos bigint, part bigint"))
    edges = held.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    sizes = held.join(F.broadcast(edges), "part").where("conv_id = low or conv_id = high")
    sizes = sizes.groupBy("conv_id", "part").agg(F.max("pos").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "part", before.alias("before")).where("before is not null")
    placed = held.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "n_bytes")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a table of one row per key, for rows of which a few keys may hold a large share.

    Keys with more than a thousandth of all rows, so fewer than a thousand, are broadcast with their values
    and their rows stay where they are; the others are shuffled.
    """
    counts = materialize(rows.groupBy(*keys).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > max(total // HOT_SHARE, 1)).select(*keys)
    found = rows.join(F.broadcast(hot.join(table, keys, "left")), keys)
    return found.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left"))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, pos, n_bytes, id, parent, block``: for numbered turns, the ids of the prefix that ends with
    each and of the one before it. The empty prefix has the id (0, 0)."""
    rows = turns.withColumn("block", F.floor((F.col("pos") - 1) / F.lit(block)))
    parts = [F.xxhash64(F.lit(seed), "pos", "t1", "t2").alias(f"e{seed}") for seed in (1, 2)]
    rows = rows.select("conv_id", "pos", "block", "n_bytes", *parts)
    window = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(*_RUNNING)
    run = [F.bit_xor(f"e{k}").over(window) for k in (1, 2)]
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("conv_id", "block", *[F.bit_xor(f"x{k}").over(earlier).alias(f"x{k}") for k in (1, 2)]).where("block > 0")
    rows = rows.select("*", run[0].alias("r1"), run[1].alias("r2")).join(heads, ["conv_id", "block"], "left")
    full = [F.col(f"r{k}").bitwiseXOR(F.coalesce(f"x{k}", F.lit(0))) for k in (1, 2)]
    return rows.select(
        "conv_id", "pos", "block", "n_bytes", F.struct(full[0].alias("h1"), full[1].alias("h2")).alias("id"),
        F.struct(*[full[k].bitwiseXOR(F.col(f"e{k + 1}")).alias(ID[k]) for k in (0, 1)]).alias("parent"),
    )


def _with_path(rows: DataFrame, band: int, *within: str) -> DataFrame:
    """``path``: the ids from the head of the band that row ``index`` lies in (a head: of the band above) down to
    its own."""
    rows = rows.withColumn("group", F.floor((F.col("index") - 1) / F.lit(band)))
    window = Window.partitionBy("conv_id", *within, "group").orderBy("index").rowsBetween(*_RUNNING)
    return rows.withColumn("path", F.concat(F.array(F.first("parent").over(window)), F.collect_list("id").over(window)))


def _reach(rows: DataFrame, band: int) -> DataFrame:
    """Per node ``h1, h2, inside, across``: the nodes of its band that its value counts for, itself included,
    and, if it heads a band, those of the band above that its finished total counts for."""
    head = F.col("index") % band == 0
    return rows.select(
        *ID, F.when(head, F.array(F.struct(*ID))).otherwise(F.col("path")).alias("inside"),
        F.when(head, F.slice("path", 1, F.size("path") - 1)).alias("across"),
    )


def _spread(values: DataFrame, reach: DataFrame, column: str, sums: list[str]) -> DataFrame:
    """Sums of the values over the nodes that each one's list names."""
    rows = values.join(reach.where(F.col(column).isNotNull()).select(*ID, column), ID)
    rows = rows.select(F.explode(column).alias("up"), *sums)
    return rows.groupBy(F.col("up.h1").alias("h1"), F.col("up.h2").alias("h2")).agg(*[F.sum(c).alias(c) for c in sums])


def rolled_up(values: DataFrame, levels: list[DataFrame], sums: list[str]) -> DataFrame:
    """Subtree sums of every node, from its own values and the reach of nodes level by level: level 0 holds
    all nodes, each later one the heads of the bands before."""
    own = []
    for reach in levels:
        values = materialize(_spread(values, reach, "inside", sums))
        own.append(values)
    done = own.pop()
    for reach, inside in zip(reversed(levels[:-1]), reversed(own), strict=True):
        total = inside.unionByName(_spread(done, reach, "across", sums))
        done = materialize(total.groupBy(*ID).agg(*[F.sum(c).alias(c) for c in sums]))
    return done


def _listed(ends: DataFrame) -> DataFrame:
    """``h1, h2, ends_sha256``: SHA-256 of the ids that end at each node, ascending and comma-joined.

    The ids are sorted by ranges and written out in pieces by many tasks. Only the digest itself, which is
    sequential by definition, runs over one node's pieces in one task, holding one piece at a time.
    """

    def pieces(batches):
        part, number, node, ids = TaskContext.get().partitionId(), 0, None, []
        made = []

        def close():
            if ids:
                made.append((*node, part, number, ",".join(ids)))

        def flush():
            columns = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*ID, "part", "number", "ids"])
            made.clear()
            return out

        for batch in batches:
            for h1, h2, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (h1, h2) != node or len(ids) >= PIECE:
                    close()
                    node, number, ids = (h1, h2), number + 1, []
                ids.append(str(conv))
            yield flush()
        close()
        yield flush()

    def digests(batches):
        node, digest, made = None, None, []

        def flush():
            columns = list(zip(*made, strict=True)) or [[]] * 3
            kinds = [pa.int64(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*ID, "ends_sha256"])
            made.clear()
            return out

        for batch in batches:
            for h1, h2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if (h1, h2) != node:
                    if node is not None:
                        made.append((*node, digest.hexdigest()))
                    node, digest = (h1, h2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield flush()
        if node is not None:
            made.append((*node, digest.hexdigest()))
        yield flush()

    order = [*ID, "conv_id"]
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(pieces, "h1 bigint, h2 bigint, part bigint, number bigint, ids string")
    rows = rows.repartition(*ID).sortWithinPartitions(*ID, "part", "number")
    return rows.mapInArrow(digests, "h1 bigint, h2 bigint, ends_sha256 string")


def _root(column: str) -> list[Column]:
    return [F.lit(0).cast("bigint").alias(f"{column}{k}") for k in (1, 2)]


def trie(turns: DataFrame, conversations: DataFrame | None = None, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of numbered turns (see :func:`numbered`): ``h1, h2`` (its id),
    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``
    (members), ``n_children``, ``n_leaves`` and ``saved_tokens`` (bytes of repeated last texts) of its
    subtree, and ``ends_sha256`` of the ids that end here.

    ``conversations`` names further conversations, in ``conv_id``, that may have no turn; they belong to the root alone.
    Without any conversation there is no node. ``block`` must be a multiple of ``band``.
    """
    if band < 2 or block % band:
        raise ValueError("band must be two or more, and block a multiple of it")
    ship(turns.sparkSession)
    rows = prefixes(turns, block).withColumn("index", F.col("pos"))
    rows = steps = materialize(_with_path(rows, band, "block").drop("group"))
    ids = rows.select("conv_id").distinct()
    if conversations is not None:
        ids = ids.union(conversations.select(F.col("conv_id").cast("bigint")).where("conv_id is not null")).distinct()

    key = [F.col("id")[h].alias(h) for h in ID]
    # every member of a node has the same path, parent and last text, so any of them will do
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"), F.min(F.col("parent")["h1"]).alias("p1"), F.min(F.col("parent")["h2"]).alias("p2"),
        F.any_value("path").alias("path"),
    )
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *_root("h"), "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs", F.lit(0).cast("bigint").alias("n_bytes"),
        *[F.lit(None).cast("bigint").alias(f"p{k}") for k in (1, 2)], F.array(F.struct(*_root("h"))).alias("path"),
    )
    nodes = materialize(nodes.unionByName(root))
    levels = [_reach(nodes.withColumn("index", F.col("depth")), band)]
    children = nodes.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))

    deepest = rows.agg(F.max("pos")).first()[0] or 0
    own_root = root.select(*ID, "path", F.lit(0).cast("bigint").alias("index"))
    while deepest >= band:
        deepest //= band
        heads = rows.where(F.col("index") % band == 0)
        rows = heads.select("conv_id", F.expr(f"index div {band}").alias("index"), "id", F.col("path")[0].alias("parent"))
        rows = materialize(_with_path(rows, band).drop("group"))
        found = rows.groupBy(*key).agg(F.any_value("path").alias("path"), F.min("index").alias("index"))
        levels.append(_reach(found.unionByName(own_root), band))
    values = nodes.select(
        *ID, (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = rolled_up(values, levels, ["n_leaves", "saved_tokens"])
    return _described(nodes, totals, steps, ids)


def _described(nodes: DataFrame, totals: DataFrame, steps: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds to the nodes their totals, their parents' names and the digests of what ends at them."""
    last = steps.groupBy("conv_id").agg(F.max_by("id", "pos").alias("id"))
    zero = F.struct(*_root("h"))
    ends = ids.join(last, "conv_id", "left").withColumn("id", F.coalesce("id", zero))
    ends = _listed(ends.select("conv_id", F.col("id")["h1"].alias("h1"), F.col("id")["h2"].alias("h2")))
    out = nodes.drop("path", "n_bytes").join(totals, ID).join(ends, ID, "left")
    out = materialize(out)
    parents = out.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    out = lookup(out.where("depth > 0"), parents, ["p1", "p2"]).unionByName(top)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        *ID, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
