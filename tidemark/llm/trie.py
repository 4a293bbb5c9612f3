"""Conversation prefix trie: which conversations share which beginnings, as one row a node.

1. Turns are numbered in the order of a range-partitioned sort: places within a partition plus the counts of
   the partitions before it, so one endless conversation is spread over many tasks. Texts then give way to hashes.
2. Conversations are rebuilt: the first turns of their family's head, then their own. A prefix's digest is the running
   xor of (place, turn) hashes, in chunks of `CHUNK` turns whose totals are added afterwards.
3. A count-min sketch of fixed size counts all prefix digests; tasks count on their own, cells saturate at two. An
   estimate of one proves that no other conversation has the prefix. From the first such depth on a conversation is
   alone: its tail of nodes is known without meeting anything and is emitted from one row.
4. Only prefixes that may be shared are shuffled and grouped exactly. What a subtree holds (leaves, saved tokens) is not
   gathered level by level: every node is charged to its smallest member, sums run up each
   conversation's own path, and a node adds what its members carry.

Turns are in order of `turn`, nulls first; ties in order of role, then text; repeated rows are turns of their own. A null
role or text is empty. Rows with a null conv_id are ignored. Other columns, whatever their names, are ignored. An empty
table has no conversations and so no nodes. A conversation that is left without turns belongs to the root alone. Very
long texts are hashed where they are read. Turns, and prefixes, are told apart by 128 bits of hash. A first turn, or a whole
conversation, that a third of the log shares is aggregated before it is shuffled and joined by broadcast; the ids
that end in one node are listed in blocks of `BLOCK` and hashed block by block. Where the log has more prefixes than the
sketch can tell apart, fewer of them are proved alone and more are shuffled; the result stays the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_copies, materialize

#: Conversations whose ids agree but for the last two digits are a family; its head lends up to so many turns.
FAMILY, LENT = 100, 5
#: Turns of one conversation that one window sees at once.
CHUNK = 1024
#: Rows of the sketch, and log2 of the most cells a row has (four cells a byte, so 4 MB each).
ROWS, MOST_BITS = 3, 24
#: Cells of a piece of a sketch.
PIECE = 4096
#: Ids of a node's ends that are listed in one row.
BLOCK = 1 << 16

NODE = ["d", "a", "b"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, ra, rb, n): every turn's place in its conversation, from 1, two hashes and its code points."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    clean = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    tie = F.concat("role", F.lit("\0"), "text")
    order = [F.col("conv"), F.col("turn").asc_nulls_first()]
    # bounds are sampled from the keys, so a key has a bounded length
    dealt = clean.repartitionByRange(*order, F.substring(tie, 1, 64)).sortWithinPartitions(*order, tie)
    rows = dealt.select("conv", F.monotonically_increasing_id().alias("g"), F.xxhash64("role", "text").alias("ra"), F.xxhash64(F.lit("second"), "text", "role").alias("rb"), F.char_length("text").cast("bigint").alias("n"))
    rows = materialize(rows.withColumn("part", F.shiftright("g", 33)), "turns")
    stretch = rows.groupBy("conv", "part").agg(F.min("g").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return rows.join(stretch, ["conv", "part"]).select("conv", (F.col("g") - F.col("first") + F.col("before") + 1).alias("pos"), "ra", "rb", "n")


def _running(rows: DataFrame, values: list[str], fold, backward: bool = False) -> DataFrame:
    """Running folds of `values` along each conversation, forward or backward in `d`, chunk by chunk. Rows need `conv`,
    `d` and `len`, the length of the conversation."""
    step = lambda c: F.col(c).desc() if backward else F.col(c).asc()
    rows = rows.withColumn("chunk", F.floor(F.col("d") / CHUNK))
    inside = Window.partitionBy("conv", "chunk").orderBy(step("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy(step("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.filter(F.col("len") >= CHUNK).groupBy("conv", "chunk").agg(*[fold(v).alias(v) for v in values])
    offsets = totals.select("conv", "chunk", *[fold(v).over(before).alias(f"_{v}") for v in values])
    local = rows.withColumns({v: fold(v).over(inside) for v in values})
    both = local.join(offsets, ["conv", "chunk"], "left")
    offset = lambda v: F.coalesce(F.col(f"_{v}"), F.lit(0))
    add = lambda v: F.col(v).bitwiseXOR(offset(v)) if fold is F.bit_xor else F.col(v) + offset(v)
    return both.withColumns({v: add(v) for v in values}).drop("chunk", *[f"_{v}" for v in values])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len) of every conversation, and (conv, len, d, ra, rb, n) of every turn after rebuilding."""
    placed = materialize(numbered(turns), "placed")
    lent = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(LENT + 1))
    convs = placed.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", lent).withColumn("head", F.col("conv") - F.col("conv") % FAMILY)
    heads = placed.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") <= LENT)).withColumnRenamed("conv", "head")
    sizes = heads.groupBy("head").agg(F.max("pos").alias("has"))
    kept = F.least("h", F.coalesce("has", F.lit(0)))
    convs = convs.join(sizes, "head", "left").withColumn("kept", kept).withColumn("len", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.drop("has"), "conversations")
    borrowed = convs.join(heads, "head").filter("pos <= h").select("conv", "len", F.col("pos").alias("d"), "ra", "rb", "n")
    own = join_copies(placed, convs.drop("head"), ["conv"], "own").filter("pos > h").select("conv", "len", (F.col("kept") + F.col("pos") - F.col("h")).alias("d"), "ra", "rb", "n")
    return convs.select("conv", "len"), borrowed.unionByName(own)


def _cells(a: np.ndarray, b: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = a.view(np.uint64) + np.uint64(row) * (b.view(np.uint64) | np.uint64(1))
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Count-min cells that saturate at two; two bits a cell when it travels."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def alone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which digests have an estimate of one."""
        out = np.zeros(len(a), dtype=bool)
        for row in range(ROWS):
            cell = (row << self.bits) + _cells(a, b, row, self.bits)
            out |= (self.packed[cell >> 2] >> (2 * (cell & 3)).astype(np.uint8)) & 3 == 1
        return out


def _pack(cells: np.ndarray) -> bytes:
    four = cells.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, dtype=np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)


def sketch(prefixes: DataFrame, most_bits: int = MOST_BITS) -> Sketch:
    """Counts of all digests (a, b). Each task counts into cells of its own and emits the pieces it touched; equal pieces
    are added up, and the sum, of bounded size, goes to the driver."""
    n = prefixes.count()
    bits = min(most_bits, max(12, int(8 * n).bit_length()))

    def count(batches):
        cells = np.zeros(ROWS << bits, dtype=np.uint8)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            for row in range(ROWS):
                at, times = np.unique((row << bits) + _cells(a, b, row, bits), return_counts=True)
                cells[at] = np.minimum(2, cells[at] + np.minimum(times, 2))
        pieces = cells.reshape(-1, PIECE)
        for k in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_pack(pieces[k])], pa.binary())], names=["piece", "cells"])

    def add(batches):
        piece, total = None, None
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([_pack(total)], pa.binary())], names=["piece", "cells"])
        for batch in batches:
            for k, raw in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if k != piece:
                    if piece is not None:
                        yield flush()
                    piece, total = k, np.zeros(PIECE, dtype=np.uint8)
                total = np.minimum(2, total + _unpack(raw))
        if piece is not None:
            yield flush()

    shape = "piece bigint, cells binary"
    counted = prefixes.select("a", "b").mapInArrow(count, shape).repartition("piece").sortWithinPartitions("piece").mapInArrow(add, shape)
    packed = np.zeros((ROWS << bits) // 4, dtype=np.uint8)
    for r in counted.collect():
        packed[r["piece"] * PIECE // 4 : (r["piece"] + 1) * PIECE // 4] = np.frombuffer(r["cells"], dtype=np.uint8)
    return Sketch(bits, packed)


def _screened(prefixes: DataFrame, counts) -> DataFrame:
    """The prefixes with `alone`: whether the sketch proves that one conversation only has them."""
    names = [*prefixes.columns, "alone"]

    def run(batches):
        known: Sketch = counts.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.alone(*(batch.column(c).to_numpy() for c in ("a", "b"))))], names=names)

    return prefixes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in prefixes.dtypes) + ", alone boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256) of nodes where conversations end: the ids in order, a block a row, hashed as they stream by."""
    names = [*NODE, "ends_sha256"]
    blocks = rows.groupBy(*NODE, F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))

    def run(batches):
        node, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, digest.hexdigest())], names=names)

    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.select(*NODE, "ids").mapInArrow(run, "d bigint, a bigint, b bigint, ends_sha256 string")


def _parents(children: DataFrame, nodes: DataFrame) -> DataFrame:
    """Children (with d, pa, pb) and `parent`, the smallest member of the node above."""
    keys = ["up", "pa", "pb"]
    above = nodes.select(F.col("d").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent"), F.col("n_children").alias("copies"))
    return join_copies(children.withColumn("up", F.col("d") - 1), above, keys).drop("up", "pa", "pb", "copies")


def nodes(turns: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per node: `conv_id` (smallest member), `depth`, `parent_conv_id` (null for the root), `n_convs`,
    `n_children`, `n_leaves` and `saved_tokens` of its subtree, `ends_sha256` of the members that end there."""
    convs, rows = rebuilt(turns)
    hashed = rows.select("conv", "len", "d", "n", F.xxhash64("d", "ra", "rb").alias("a"), F.xxhash64(F.lit("second"), "rb", "ra", "d").alias("b"))
    hashed = hashed.withColumns({"ha": F.col("a"), "hb": F.col("b")})
    running = _running(hashed, ["a", "b"], F.bit_xor)
    prefixes = materialize(running.select("conv", "len", "d", "n", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb")), "prefixes")
    counts = turns.sparkSession.sparkContext.broadcast(sketch(prefixes, most_bits))
    screened = materialize(_screened(prefixes, counts), "screened")
    counts.unpersist()

    first = screened.filter("alone").groupBy("conv").agg(F.min(F.struct("d", "pa", "pb")).alias("at"))
    cuts = convs.join(first, "conv", "left").select("conv", "len", F.col("at.d").alias("cut"), F.col("at.pa").alias("pa"), F.col("at.pb").alias("pb"))
    cuts = materialize(cuts, "cuts")
    tails = cuts.filter("cut is not null")

    zero = F.lit(0).cast("bigint")
    root = cuts.select("conv", "len", "cut", *[zero.alias(c) for c in ("d", "n", "a", "b", "pa", "pb")])
    maybe = join_copies(screened.filter("not alone").drop("alone"), cuts.select("conv", "cut", F.col("len").alias("copies")), ["conv"]).drop("copies")
    shared = root.unionByName(maybe.filter("cut is null or d < cut"))
    shared = materialize(shared.withColumn("ends", F.col("d") == F.col("len")).withColumn("tail", F.coalesce(F.col("d") + 1 == F.col("cut"), F.lit(False))), "shared")

    groups = shared.groupBy(*NODE).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("n").alias("n"))
    groups = materialize(groups, "groups")
    above = lambda df, d: df.select((F.col(d) - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = above(groups.filter("d > 0"), "d").unionByName(above(tails, "cut")).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    known = groups.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saves", (F.col("n_convs") - 1) * F.col("n"))
    known = materialize(known.drop("n"), "nodes")

    # each node counts for its smallest member, each leaf for the conversation that is charged with it
    charged = join_copies(shared.drop("n", "pa", "pb", "cut"), known.select(*NODE, "rep", "n_convs", "n_children", "saves"), NODE, "n_convs")
    mine = F.col("rep") == F.col("conv")
    leaf = (F.col("ends") & mine & (F.col("n_children") == 0)) | F.col("tail")
    charged = charged.select("conv", "len", *NODE, F.when(mine, F.col("saves")).otherwise(0).alias("saved_tokens"), leaf.cast("bigint").alias("n_leaves"))
    sums = _running(charged, ["saved_tokens", "n_leaves"], F.sum, backward=True).groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    empty = F.sha2(F.lit(""), 256)
    child = known.filter("d > 0").select(*NODE, "pa", "pb", F.lit(None).cast("bigint").alias("conv"))
    found = materialize(_parents(child.unionByName(tails.select(F.col("cut").alias("d"), zero.alias("a"), zero.alias("b"), "pa", "pb", "conv")), known), "parents")
    whole = known.join(sums, NODE).join(_ends(shared.filter("ends")), NODE, "left").join(found.filter("conv is null").drop("conv"), NODE, "left")
    whole = whole.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))

    # a tail is one row until here
    stretch = tails.join(found.filter("conv is not null").select("conv", "parent"), "conv").withColumn("from", F.explode(F.sequence("cut", "len", F.lit(CHUNK).cast("bigint"))))
    single = stretch.repartition("conv", "from").withColumn("depth", F.explode(F.sequence("from", F.least("len", F.col("from") + CHUNK - 1))))
    one = F.lit(1).cast("bigint")
    single = single.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("cut"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return whole.unionByName(single)
