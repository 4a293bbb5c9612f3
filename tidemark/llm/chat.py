"""Chat formatting: logged snapshots of growing conversations are collapsed before rendering.

Every turn gets a hash of (its place, role, text); the running xor over a conversation's turns is the hash
of each of its prefixes. A conversation whose whole hash occurs as a shorter prefix of another one is a
snapshot and drops out by an anti-join against the distinct prefixes, so a first turn that a third of the
log shares costs one row. Of equal conversations the smallest id stays. All steps are DataFrame functions.

Two 64-bit hashes with different seeds are carried, so different prefixes do not meet in practice.
Rows without a conversation id are ignored. A null role is `unknown`, a null text is empty, a null turn
number comes first. Rows repeated in full are one turn; rows that share a turn number are ordered by role,
then text. Other columns, whatever their names, are ignored. An empty table gives no rows. A very long text is hashed whole; a
very long conversation is one window partition and one row of the result (2 GB at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: One turn as rendered; {role} and {text} are replaced.
TURN_START, TURN_MIDDLE, TURN_END = "<|im_start|>", "\n", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, no, role, text) with `h1` and `h2`, the hashes of the prefix that ends there."""
    clean = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = clean.withColumn("no", F.row_number().over(order))
    hashed = placed.select("conv_id", "no", "role", "text", F.xxhash64("no", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "no").alias("b"))
    so_far = Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("conv_id", "no", "role", "text", F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that no longer one continues, one of each set of equals."""
    each = materialize(prefixes(turns).drop("role", "text"), "prefixes")
    whole = each.groupBy("conv_id").agg(F.max("no").alias("no"), F.max_by("h1", "no").alias("h1"), F.max_by("h2", "no").alias("h2"))
    distinct = whole.groupBy("no", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = each.join(whole.select("conv_id", F.col("no").alias("last")), "conv_id").filter("no < last").select("no", "h1", "h2").distinct()
    return distinct.join(inner, ["no", "h1", "h2"], "left_anti").select("conv_id", F.col("no").cast("bigint").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    kept = maximal(turns)
    clean = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    lines = clean.join(kept, "conv_id").groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit(TURN_MIDDLE), t["text"], F.lit(TURN_END))
    return lines.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", line), "\n").alias("rendered"))
