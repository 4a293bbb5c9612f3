"""Exact order statistics and longest streaks of groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Bins of one look at a range of values, and how many values a bin may hold that is sorted at the end.
BINS, FEW = 4096, 20_000
#: Looks at most; doubles have no more than six ranges of 4,096 bins in one another but for a few odd ones.
LOOKS = 12
#: Ranges up to this many go to all tasks.
SENT = 100_000


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def _within(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Values with the range of their group that holds them."""
    ends = ranges.select(*by, "lo", "hi").distinct()
    ends = F.broadcast(ends) if ends.limit(SENT + 1).count() <= SENT else ends
    inside = values["_x"].between(ends["lo"], ends["hi"])
    return values.join(ends, _same(values, ends, by) & inside).select(*[values[k] for k in by], "_x", "lo", "hi")


def quantiles(rows: DataFrame, by: list[str], x: str, probs: dict[str, float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """Exact quantiles of `x` in each group, with linear interpolation, in the columns that `probs` names.

    Values are counted in bins of the range that a wanted rank may lie in; the bin that holds the rank is the next
    range. Counts are added up before they are shuffled, so neither a group nor a value that a third of the rows share meets in
    one task. Once a range has few values, or one, the rank is read off. Nulls and NaN are left out; a group without other values has
    no row."""
    values = rows.select(*by, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    asked = sizes.withColumn("spot", F.explode(spots)).withColumn("at", F.col("spot.p") * (F.col("n") - 1))
    asked = asked.select(*by, "n", "lo", "hi", F.col("spot.name").alias("name"), F.floor("at").alias("rank"), (F.col("at") - F.floor("at")).alias("part"))
    ends = asked.select(*by, "lo", "hi", F.col("n").alias("held"), F.explode(F.array("rank", F.least(F.col("rank") + 1, F.col("n") - 1))).alias("rank")).distinct()
    want = written(ends.withColumn("below", F.lit(0).cast("bigint")).select(*by, "lo", "hi", "rank", "below", "held"), "ranks")
    key = [*by, "lo", "hi"]
    # ranges shrink by a factor of `bins` a look, or as far as neighbouring doubles allow
    for _ in range(LOOKS):
        if want.filter(F.col("lo") < F.col("hi")).filter(f"held > {few}").isEmpty():
            break
        open_ = want.filter("lo < hi")
        spot = F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        cells = _within(values, open_, by).groupBy(*key, spot.alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("from"), F.max("_x").alias("to"))
        upto = F.sum("c").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("upto", upto)
        left, right = open_.alias("l"), cells.alias("r")
        same = reduce(lambda u, v: u & v, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key))
        holds = (F.col("l.below") + F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("l.below") + F.col("upto"))
        found = left.join(right, same & holds).select(*[F.col(f"l.{k}").alias(k) for k in by], F.col("from").alias("lo"), F.col("to").alias("hi"), "rank", (F.col("l.below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("held"))
        want = written(found.unionByName(want.filter("lo = hi")), "ranks")
    # what is left has few values a range
    last = want.filter("lo < hi")
    order = Window.partitionBy(*key).orderBy("_x")
    sorted_ = _within(values, last, by).withColumn("place", F.row_number().over(order) - 1)
    same = reduce(lambda u, v: u & v, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key))
    read = last.alias("l").join(sorted_.alias("r"), same & (F.col("rank") - F.col("below") == F.col("place"))).select(*[F.col(f"l.{k}").alias(k) for k in by], "rank", F.col("_x").alias("value"))
    known = read.unionByName(want.filter("lo = hi").select(*by, "rank", F.col("lo").alias("value")))
    asked = asked.select(*by, "name", "rank", "part", F.least(F.col("rank") + 1, F.col("n") - 1).alias("next"))
    values_at = asked.alias("l")
    for end, out in (("rank", "a"), ("next", "b")):
        at = known.select(*by, F.col("rank").alias("_r"), F.col("value").alias(out)).alias(out)
        same = reduce(lambda u, v: u & v, (F.col(f"l.{k}").eqNullSafe(F.col(f"{out}.{k}")) for k in by), F.col(f"l.{end}") == F.col(f"{out}._r"))
        values_at = values_at.join(at, same).select("l.*", f"{out}.{out}").alias("l")
    each = values_at.select(*by, "name", (F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("value"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in probs])


def longest_streak(rows: DataFrame, by: list[str], hit: Column, order: list[str], chunk: str, out: str) -> DataFrame:
    """(by..., `out`): the longest run of rows that are a hit, in the given order, which begins with `chunk`. Each chunk of a
    group is summed up to how many rows it has, how many hits it begins and ends with, and its longest run; the
    summaries are merged in order. So a task sees one chunk of a group, or one row a chunk."""
    part = Window.partitionBy(*by, chunk)
    placed = rows.select(*by, *[c for c in dict.fromkeys([chunk, *order]) if c not in by], F.coalesce(hit, F.lit(False)).alias("_hit"))
    placed = placed.withColumn("_no", F.row_number().over(part.orderBy(*order)))
    # a run's rows share the number of misses before them
    misses = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(part.orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = placed.withColumn("_run", misses).groupBy(*by, chunk, "_run").agg(F.count("*").alias("n"), F.sum(F.col("_hit").cast("bigint")).alias("hits"))
    parts = runs.groupBy(*by, chunk).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("_run") == 0, F.col("hits"))), F.lit(0)).alias("begins"),
        F.max_by("hits", "_run").alias("ends"),
        F.max("hits").alias("best"),
    )
    listed = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(chunk, "n", "begins", "ends", "best"))).alias("parts"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("open"), zero.alias("best"))
    step = lambda s, p: F.struct(
        F.when(p["begins"] == p["n"], s["open"] + p["n"]).otherwise(p["ends"]).alias("open"),
        F.greatest(s["best"], p["best"], s["open"] + p["begins"]).alias("best"),
    )
    return listed.select(*by, F.aggregate("parts", start, step, lambda s: s["best"]).alias(out))
