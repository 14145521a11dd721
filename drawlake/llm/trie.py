"""The prefix trie of rebuilt conversations, from padded turn-id matrices.

Every turn becomes an id (128 bits, of its place and the digest of role and text) and a number of words; texts go no
further. A conversation is cut into blocks of ``WIDTH`` turns; a block is known by the ids of all turns before it, so that
the members of a node are neighbours wherever blocks are sorted by (block number, what lies before, ids).

1. Blocks are dealt to shards by ranges of that order. A shard is one padded matrix of ids: ``numpy.lexsort`` puts its rows in
   order, and the changes of each column against the row above, OR-accumulated from the left, mark where nodes start.
   A row keeps how many turns it shares with the row above and below; the first and last rows of neighbouring
   shards are compared by a join.
2. With these, whatever is asked of a node is a sum or minimum over its members: a row that shares s turns with the one above
   starts the nodes deeper than s, and is a further copy of the words of the others; a row that goes on behind the turns
   it shares with the one below, and ends there, is a childless node. ``reduceat`` gives all nodes of a depth at once.
   Nodes whose rows are all at hand are complete; the others recombine by key.

Scale. Shuffled are turns of some dozen bytes. No task holds more than a shard's cells or a batch; a conversation of very many
turns is many blocks, of which one window sees two numbers each. The members that end at one node are hashed in order by one
task, as SHA-256 is sequential; their ids come to it as joined text in pieces, and are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import materialize

WIDTH = 64
#: Cells of a shard, on average; and into how many parts children of one parent are dealt.
SHARD_CELLS = 1 << 18
SALT = 16
UNKNOWN = -2
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "array<struct<a:bigint,b:bigint,words:bigint>>"


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, key, words, h, taken, total)`` of each turn in order, and ``(conv_id, base, h, taken, total)`` of each conversation.

    Turns are range-sorted and written; a conversation that spans partitions gets offsets from one count a partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), words.alias("words")).where("conv_id is not null")
    order = ["conv_id", "turn", "key"]
    rows = materialize(turns, "turns").repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "sorted-turns")
    held = materialize(rows.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count("*").alias("n")), "held")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = held.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    known = held.select("conv_id", "part", (before - F.col("first")).alias("shift")).join(convs, "conv_id")
    placed = rows.join(known, ["conv_id", "part"]).withColumn("pos", F.col("id") + F.col("shift"))
    return placed.select("conv_id", "pos", "key", "words", "h", "taken", "total"), convs


def turn_blocks(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, k, p1, p2, turns, more)``: the rebuilt conversations in blocks; p1 and p2 stand for all turns before, ``more`` says that blocks follow."""
    placed, convs = numbered_turns(conversations)
    own = placed.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words", "total")
    heads = placed.where("conv_id % 20 = 0 and pos < 3").select(F.col("conv_id").alias("base"), "pos", "key", "words")
    copied = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv_id", "pos", "key", "words", "total")
    # a row for each conversation keeps those without a turn
    mark = convs.select("conv_id", "total").withColumns({"pos": F.lit(None).cast("long"), "key": F.lit(None).cast("binary"), "words": F.lit(None).cast("long")})
    rows = own.unionByName(copied).unionByName(mark).withColumn("k", F.coalesce(F.floor(F.col("pos") / width), F.lit(0)).cast("long"))
    real = F.col("pos").isNotNull()
    one = {n: F.when(real, F.xxhash64("key", "pos", F.lit(i))) for i, n in enumerate("ab")}
    rows = rows.withColumns(one)
    turn = F.when(real, F.struct("pos", "a", "b", "words"))
    blocks = rows.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *[F.coalesce(F.bit_xor(c), F.lit(0)).alias(f"x{c}") for c in "ab"], (F.max("total") > (F.col("k") + 1) * width).alias("more"))
    blocks = materialize(blocks.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words")))), "blocks")
    first = blocks.where("k = 0").select("conv_id", "k", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "turns", "more")
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.where("more or k > 0").select("conv_id", "k", F.bit_xor("xa").over(upto).alias("p1"), F.bit_xor("xb").over(upto).alias("p2")).where("k > 0")
    later = blocks.where("k > 0").join(before, ["conv_id", "k"]).select(*first.columns)
    return materialize(first.unionByName(later), "trie-blocks")


def _matrix(turns: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices, a row for each block and a column for each turn: ids (0 behind the end, in the order of a and b), a, b and words; and the sizes."""
    if isinstance(turns, pa.ChunkedArray):
        turns = turns.combine_chunks()
    offsets = turns.offsets.to_numpy().astype(np.int64)
    flat = turns.values.slice(offsets[0], offsets[-1] - offsets[0])
    a, b, words = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
    size = np.diff(offsets)
    order = np.lexsort((b, a))
    differs = np.ones(len(a), bool)
    differs[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    ids = np.zeros(len(a), np.int32)
    ids[order] = np.cumsum(differs)
    row = np.repeat(np.arange(len(size)), size)
    at = row, np.arange(len(a)) - np.repeat(offsets[:-1] - offsets[0], size)
    out = []
    for values in (ids, a, b, words):
        padded = np.zeros((len(size), int(size.max(initial=0))), values.dtype)
        padded[at] = values
        out.append(padded)
    return *out, size


def _marks(ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Column changes against the row above, OR-accumulated from the left; column 0 is ``fresh`` (nothing in common with it)."""
    changes = np.ones((len(ids), ids.shape[1] + 1), bool)
    changes[:, 0] = fresh
    changes[1:, 1:] = ids[1:] != ids[:-1]
    return np.logical_or.accumulate(changes, axis=1)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows in order, with the turns that each shares with the rows above and below; -1 if not even the block."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    conv, k, p1, p2, more = (table.column(n).to_numpy() for n in ("conv_id", "k", "p1", "p2", "more"))
    ids, _, _, _, size = _matrix(table.column("turns"))
    order = np.lexsort((conv, more, *ids.T[::-1], p2, p1, k))
    k, p1, p2, size = k[order], p1[order], p2[order], size[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    marks = _marks(ids[order], fresh)
    shared = np.minimum(marks.shape[1] - 1 - marks.sum(axis=1), size)
    shared[0] = UNKNOWN
    n, shard = len(order), TaskContext.get().partitionId()
    extra = {"shard": np.full(n, shard, np.int64), "at": np.arange(n), "above": shared, "below": np.append(shared[1:], UNKNOWN)}
    table = table.take(pa.array(order))
    for name, values in extra.items():
        table = table.append_column(name, pa.array(values))
    yield from table.to_batches(max_chunksize=4096)


def _joined_shards(ordered: DataFrame) -> DataFrame:
    """``ordered`` with what the first and last rows of neighbouring shards share."""
    spark = ordered.sparkSession
    heads = ordered.where(F.col("above") == UNKNOWN).select("shard", "k", "p1", "p2", "turns")
    tails = ordered.where(F.col("below") == UNKNOWN).select("shard", *[F.col(c).alias(f"_{c}") for c in ("k", "p1", "p2", "turns")])
    shards = sorted(r["shard"] for r in heads.select("shard").collect())  # one number a shard
    pairs = spark.createDataFrame(list(zip(shards[1:], shards[:-1])), "shard long, last long")
    differs = F.zip_with("turns", "_turns", lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True)
    same = (F.col("k") == F.col("_k")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2"))
    shared = F.when(~same, F.lit(-1)).when(at > 0, at - 1).otherwise(F.size("turns")).cast("long")
    found = materialize(pairs.join(heads, "shard").join(tails.withColumnRenamed("shard", "last"), "last").select("shard", "last", shared.alias("_shared")), "seams")
    up = F.broadcast(found.select("shard", F.col("_shared").alias("_up")))  # both have a row for each shard
    down = F.broadcast(found.select(F.col("last").alias("shard"), F.col("_shared").alias("_down")))
    fixed = lambda c, other: F.when(F.col(c) == UNKNOWN, F.coalesce(other, F.lit(-1))).otherwise(F.col(c)).alias(c)
    return ordered.join(up, "shard", "left").join(down, "shard", "left").select("conv_id", "k", "p1", "p2", "turns", "more", "shard", "at", fixed("above", "_up"), fixed("below", "_down"))


def _behind(rows: DataFrame) -> DataFrame:
    """Add ``saved`` and ``leaf`` of the blocks that follow each block of its conversation."""
    none = {"saved": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")}
    many = rows.where("more or k > 0")
    copies = F.aggregate(F.slice("turns", 1, F.greatest("above", F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    ends = (~F.col("more") & (F.col("below") < F.size("turns"))).cast("long")
    own = many.select("conv_id", "k", "more", copies.alias("s"), ends.alias("l"))
    after = Window.partitionBy("conv_id").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    later = own.withColumn("saved", F.sum("s").over(after)).withColumn("leaf", F.max("l").over(after)).where("more").select("conv_id", "k", "saved", "leaf")
    return rows.where("not more").withColumns(none).unionByName(rows.where("more").join(later, ["conv_id", "k"]))


NODES = "depth long, a long, b long, parent_a long, parent_b long, parent_conv_id long, parent_known boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, complete boolean, ends_sha256 string, ends string, first_end long"


def _nodes(width: int):
    """The nodes of each batch of rows; ``complete`` ones have all their members in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split(" ") for x in NODES.split(", ")))
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x] for x in kinds]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, k, p1, p2, more, shard, at, above, below, saved, leaf = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "k", "p1", "p2", "more", "shard", "at", "above", "below", "saved", "leaf"))
            ids, a, b, words, size = _matrix(batch.column(batch.schema.get_field_index("turns")))
            fresh = np.ones(len(conv), bool)
            fresh[1:] = (shard[1:] != shard[:-1]) | (at[1:] != at[:-1] + 1) | (above[1:] < 0)
            marks = _marks(ids, fresh)
            column = lambda first, rest, merge: merge.accumulate(np.concatenate([first[:, None], rest], axis=1), axis=1)
            key_a, key_b = column(p1, a, np.bitwise_xor), column(p2, b, np.bitwise_xor)
            upto = column(np.zeros(len(conv), np.int64), words, np.add)
            copied = upto[np.arange(len(conv)), np.maximum(above, 0)]
            leaf = np.where(more, leaf, below < size)
            parent_conv, parent_known = np.zeros(len(conv), np.int64), np.zeros(len(conv), bool)
            for j in range(ids.shape[1] + 1):
                rows = np.flatnonzero(size >= j)
                start = np.flatnonzero(marks[rows, j])
                first, last = rows[start], rows[np.append(start[1:], len(rows)) - 1]
                total = lambda x: np.add.reduceat(x[rows].astype(np.int64), start)
                low = np.minimum.reduceat(conv[rows], start)
                whole = (above[first] < j) & (below[last] < j)
                gains = np.where(above >= j, copied - (upto[:, j - 1] if j else 0), 0) + saved
                inner = np.full(len(first), True) if j else k[first] == 0  # a later block's column 0 is a node of the block before, to which it adds children
                if j == 0:
                    whole &= inner
                if j == width:
                    whole &= np.maximum.reduceat(more[rows], start) == 0
                numbers = [np.diff(np.append(start, len(rows))), total((above <= j) & (size > j)), total(leaf), total(gains)]
                numbers = [numbers[0] * inner, numbers[1], numbers[2] * inner, numbers[3] * inner]
                ending = np.flatnonzero((size == j) & ~more)
                of = np.searchsorted(first, ending, "right") - 1
                text, head = np.full(len(first), None, object), np.zeros(len(first), np.int64)
                cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else []
                for x, y in zip(cuts[:-1], cuts[1:]):
                    text[of[x]], head[of[x]] = ",".join(map(str, conv[ending[x:y]].tolist())), conv[ending[x]]
                digest = [hashlib.sha256(t.encode()).hexdigest() if w and t is not None else EMPTY if w else None for t, w in zip(text, whole)]
                open_end = ~whole & np.array([t is not None for t in text], bool)
                nothing = np.zeros(len(first), np.int64)
                known = parent_known[first] if j else inner
                columns = [
                    pa.array(k[first] * width + j), pa.array(key_a[first, j]), pa.array(key_b[first, j]),
                    pa.array(key_a[first, j - 1] if j else nothing, mask=np.full(len(first), not j)), pa.array(key_b[first, j - 1] if j else nothing, mask=np.full(len(first), not j)),
                    pa.array(parent_conv[first] if j else nothing, mask=~known if j else np.full(len(first), True)), pa.array(known), pa.array(low, mask=~inner),
                    *map(pa.array, numbers), pa.array(whole), pa.array(digest, pa.string()),
                    pa.array(np.where(open_end, text, None), pa.string()), pa.array(head, mask=~open_end),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], list(names))
                group = np.zeros(len(rows), np.int64)
                group[start[1:]] = 1
                group = np.cumsum(group)
                parent_conv[rows], parent_known[rows] = low[group], whole[group]

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which stand in order."""
    names = ["depth", "a", "b", "sha"]
    node, state, done = None, None, []
    for batch in batches:
        for depth, a, b, ends in zip(*(batch.column(n).to_pylist() for n in ("depth", "a", "b", "ends"))):
            if (depth, a, b) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
            done = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names)


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, width: int = WIDTH, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text, ...)``.

    Conversation c is rebuilt from the first h turns of conversation c - c % 20 (h = crc32 of c's decimal form, modulo 4)
    and its own turns after its first h. A node is a distinct sequence of first turns, from the root of depth 0 that all
    conversations share. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes in the subtree, which includes the node), saved_tokens (of the subtree: words of a node's last text, once for each
    member but one), ends_sha256 (of the ids of the members that end here, ascending, joined by commas).

    Turns are ordered by turn, null first, those of one number by the digest of role and text; repeated rows are turns
    each. Null role and text are empty, rows of a null conv_id belong to no conversation, very long texts are taken whole and very long
    conversations in blocks of ``width`` turns; ``shard_cells`` is the size of a shard. A conversation whose turns are all replaced by none ends at the root. No
    conversations give no rows. Other columns are ignored, whatever their names.
    """
    blocks = turn_blocks(conversations, width)
    cells = blocks.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()[0]
    order = ["k", "p1", "p2", "turns", "more", "conv_id"]
    dealt = blocks.repartitionByRange(max(1, -(-cells // shard_cells)), *order).select("conv_id", "k", "p1", "p2", "turns", "more")
    kinds = f"conv_id long, k long, p1 long, p2 long, turns {TURN}, more boolean, shard long, at long, above long, below long"
    ordered = materialize(dealt.mapInArrow(_ordered, kinds), "ordered")
    rows = _behind(_joined_shards(ordered))
    nodes = materialize(rows.mapInArrow(_nodes(width), NODES), "nodes")

    node = ["depth", "a", "b"]
    open_nodes = nodes.where("not complete")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = open_nodes.groupBy(*node).agg(*[F.max(c).alias(c) for c in ("parent_a", "parent_b", "parent_conv_id", "parent_known")], F.min("conv_id").alias("conv_id"), *sums)
    pieces = open_nodes.where("ends is not null").select(*node, "first_end", "ends").repartition(*node).sortWithinPartitions(*node, "first_end").drop("first_end")
    digests = pieces.mapInArrow(_hashed, "depth long, a long, b long, sha string")
    merged = materialize(merged.join(digests, node, "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha"), "merged")
    every = nodes.where("complete").select(*merged.columns).unionByName(merged)
    # a node whose parent recombines takes its smallest member from there; children of one parent go to several tasks
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("_parent")).withColumn("_salt", salt)
    lacking = every.where("not parent_known").withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALT)).cast("int"))
    found = lacking.join(parents, ["depth", "parent_a", "parent_b", "_salt"]).withColumn("parent_conv_id", F.col("_parent"))
    return every.where("parent_known").select(*OUT).unionByName(found.select(*OUT))
