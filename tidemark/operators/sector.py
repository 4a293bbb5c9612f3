"""Sector returns, rankings, breadth and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import change


def returns(daily: DataFrame, windows: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Percent returns over own rows of each sector."""
    w = Window.partitionBy("sector_code").orderBy("trade_date")
    return daily.select("*", *[(change(F.col("close"), F.lag("close", n).over(w)) * 100).alias(f"return_{n}") for n in windows])


def performance(moved: DataFrame, by: str = "return_5", limit: int | None = None) -> DataFrame:
    """Sectors of the last date, ranked by a field, nulls last, ties by code."""
    last = moved.agg(F.max("trade_date").alias("trade_date"))
    now = moved.join(F.broadcast(last), "trade_date")
    out = now.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.col(by).desc_nulls_last(), "sector_code")))
    return out if limit is None else out.filter(F.col("place") <= limit)


def performance_coverage(moved: DataFrame, flow: DataFrame) -> DataFrame:
    """One row: sectors with a row on the last date, and how many have each return and a flow."""
    now = moved.join(F.broadcast(moved.agg(F.max("trade_date").alias("trade_date"))), "trade_date")
    n = lambda c: F.count(F.when(F.col(c).isNotNull(), 1))
    return now.join(flow.select("sector_code", "trade_date", "net_amount"), ["sector_code", "trade_date"], "left").agg(F.max("trade_date").alias("trade_date"), F.count("*").alias("sectors"), n("return_5").alias("with_return_5"), n("return_20").alias("with_return_20"), n("net_amount").alias("with_flow"))


def auto_universe(master: DataFrame, daily: DataFrame, flow: DataFrame) -> DataFrame:
    """Sectors to follow: those with a flow on the flows' last date, or, of a kind where none has one, those with a
    close on the last day; with the rule that chose them."""
    have = flow_universe(daily.select("sector_code").distinct(), flow).withColumn("flow", F.lit(True))
    last = daily.join(F.broadcast(daily.agg(F.max("trade_date").alias("trade_date"))), "trade_date").filter("close is not null").select("sector_code", F.lit(True).alias("traded")).distinct()
    rows = master.join(have, "sector_code", "left").join(last, "sector_code", "left").withColumn("any_flow", F.max(F.coalesce("flow", F.lit(False))).over(Window.partitionBy("sector_type")))
    chosen = F.when(F.col("flow"), "flow_on_last_date").when(~F.col("any_flow") & F.col("traded"), "traded_on_last_date")
    return rows.select("sector_code", "sector_name", "sector_type", chosen.alias("rule")).filter("rule is not null")


def membership_counts(members: DataFrame) -> DataFrame:
    """Members of each sector's snapshots, and how many joined or left since the one before."""
    day = members.groupBy("sector_code", "trade_date").agg(F.countDistinct("con_code").alias("members"))
    w = Window.partitionBy("sector_code").orderBy("trade_date")
    days = day.withColumn("next_date", F.lead("trade_date").over(w))
    stay = members.select("sector_code", "trade_date", "con_code").distinct().join(days.select("sector_code", "trade_date", "next_date"), ["sector_code", "trade_date"])
    kept = stay.select("sector_code", F.col("next_date").alias("trade_date"), "con_code").join(members.select("sector_code", "trade_date", "con_code").distinct(), ["sector_code", "trade_date", "con_code"]).groupBy("sector_code", "trade_date").agg(F.count("*").alias("kept"))
    j = day.join(kept, ["sector_code", "trade_date"], "left").withColumn("before", F.lag("members").over(w)).withColumn("kept", F.when(F.col("before").isNotNull(), F.coalesce("kept", F.lit(0))))
    return j.select("sector_code", "trade_date", "members", (F.col("members") - F.col("kept")).alias("joined"), (F.col("before") - F.col("kept")).alias("left"))


def breadth(moved: DataFrame, x: str = "return_1") -> DataFrame:
    """Per date: sectors, advancing, declining, flat, missing, median move."""
    v = F.col(x)
    n = lambda c: F.count(F.when(c, 1))
    return moved.groupBy("trade_date").agg(F.count("*").alias("sectors"), n(v > 0).alias("up"), n(v < 0).alias("down"), n(v == 0).alias("flat"), n(v.isNull()).alias("missing"), F.percentile(v, F.lit(0.5)).alias("median_move"))


def breadth_change(days: DataFrame) -> DataFrame:
    """Difference of each breadth measure from the date before."""
    w = Window.orderBy("trade_date")
    return days.select("trade_date", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_change") for c in ("up", "down", "flat", "median_move")])


def rotation(moved: DataFrame, by: str = "return_5") -> DataFrame:
    """Rank of each sector on the last two dates and how many places it gained."""
    days = moved.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(2)
    dated = days.withColumn("k", F.row_number().over(Window.orderBy(F.col("trade_date").desc())))
    rows = moved.join(F.broadcast(dated), "trade_date").filter(F.col(by).isNotNull())
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy("trade_date").orderBy(F.col(by).desc())))
    now, then = rows.filter("k = 1"), rows.filter("k = 2").select("sector_code", F.col("rank").alias("previous_rank"))
    return now.join(then, "sector_code", "left").select("sector_code", by, "rank", "previous_rank", (F.col("previous_rank") - F.col("rank")).alias("rank_change"))


def flow_universe(daily: DataFrame, flow: DataFrame) -> DataFrame:
    """All rows of the sectors that have a flow on the last date of the flows."""
    last = flow.agg(F.max("trade_date").alias("trade_date"))
    have = flow.join(F.broadcast(last), "trade_date").filter("net_amount is not null").select("sector_code").distinct()
    return daily.join(have, "sector_code", "left_semi")
