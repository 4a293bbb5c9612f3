"""Panel construction: restated prices, the session grid, the screening panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def restate_qfq(bars: DataFrame) -> DataFrame:
    """Forward-adjusted prices against the last known factor of the loaded rows; where a price, a factor or
    a last factor is missing (or that one is zero) the cached price stays."""
    whole = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("adj_factor", ignorenulls=True).over(whole)
    out = bars.withColumn("_last", last)
    for k in ("open", "high", "low", "close"):
        stored = F.col(f"{k}_qfq") if f"{k}_qfq" in bars.columns else F.col(f"{k}_raw")
        restated = F.try_divide(F.col(f"{k}_raw") * F.col("adj_factor"), F.col("_last"))
        out = out.withColumn(f"{k}_qfq", F.coalesce(restated, stored))
    return out.drop("_last")


def forward_adjust(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """price x factor / last factor of the symbol; the factor is carried forward, missing sessions are not filled."""
    so_far = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol")
    joined = prices.join(factors.select("symbol", "trade_date", "adj_factor"), ["symbol", "trade_date"], "left")
    filled = joined.withColumn("adj_factor", F.last("adj_factor", ignorenulls=True).over(so_far))
    final = F.max_by("adj_factor", "trade_date").over(whole)
    return filled.withColumn("close_qfq", F.try_divide(F.col("close_raw") * F.col("adj_factor"), final))


def sessions(bars: DataFrame) -> DataFrame:
    """trade_date, session_no of every market session, from 1. The only unpartitioned order: one row a date."""
    return bars.select("trade_date").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("trade_date")))


def session_grid(bars: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """All market sessions by all symbols; a session without a bar is a row of nulls. `days` are the sessions, if they are at
    hand. Each bar stands for its own session and those without a bar up to the next one (the first also for those before
    it), so rows that are dealt by symbol stay where they are."""
    # a row a session
    days = F.broadcast((sessions(bars) if days is None else days).select("trade_date", "session_no", F.max("session_no").over(Window.partitionBy()).alias("_last")))
    own = Window.partitionBy("symbol").orderBy("trade_date")
    values = [c for c in bars.columns if c not in ("symbol", "trade_date")]
    at = days.select(F.col("trade_date").alias("_day"), F.col("session_no").alias("_own"), "_last")
    placed = bars.join(at, bars["trade_date"].eqNullSafe(at["_day"])).withColumn("_before", F.lag("_own").over(own)).withColumn("_next", F.lead("_own").over(own))
    first, last = F.when(F.col("_before").isNull(), 1).otherwise(F.col("_own")), F.greatest("_own", F.coalesce(F.col("_next") - 1, "_last"))
    cells = placed.withColumn("session_no", F.explode(F.sequence(first, last)))
    here = (F.col("session_no") == F.col("_own")) & F.col("symbol").isNotNull() & F.col("_day").isNotNull()
    cells = cells.select("symbol", "session_no", *[F.when(here, F.col(c)).alias(c) for c in values])
    return cells.join(days.select("session_no", "trade_date"), "session_no").select("symbol", "trade_date", "session_no", *values)


def screening_panel(bars: DataFrame, valuation: DataFrame, metadata: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per symbol and date with valuation, metadata and the list of limit types."""
    kinds = limits.groupBy("symbol", "trade_date").agg(F.array_join(F.sort_array(F.collect_set("limit_type")), ",").alias("limit_types"))
    return bars.join(valuation, ["symbol", "trade_date"], "left").join(metadata, "symbol", "left").join(kinds, ["symbol", "trade_date"], "left")


def amount_cny(panel: DataFrame) -> DataFrame:
    """Stored amount in thousands, else price times volume in lots."""
    price = F.coalesce(F.col("close_raw"), F.col("close_qfq"))
    return panel.withColumn("amount_cny", F.coalesce(F.col("amount") * 1000, price * F.col("volume") * 100))


def latest_cross_section(panel: DataFrame, as_of: str) -> DataFrame:
    """Rows of the last date at or before as_of, one a symbol."""
    known = panel.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    last = known.agg(F.max("trade_date").alias("trade_date"))
    return known.join(F.broadcast(last), "trade_date").dropDuplicates(["symbol"])


def load_windows(bars: DataFrame, requests: DataFrame, profiles: dict, year: str = "year") -> DataFrame:
    """Bars that requests (request_id, profile, start_date, end_date) need, once each request: a lead-in of twice the
    profile's history and a tail of twice its longest horizon, in calendar days. `bars` are partitioned by `year`; the years
    that any request reaches are found first, so that the scan opens their folders only."""
    days = lambda f: F.create_map(*[F.lit(x) for name, p in profiles.items() for x in (name, 2 * f(p))])[F.col("profile")]
    asked = requests.select("request_id", F.date_sub("start_date", days(lambda p: p.history)).alias("_from"), F.date_add("end_date", days(lambda p: max(p.horizons))).alias("_to")).filter("_from <= _to")
    # a number a year
    years = sorted(r[0] for r in asked.select(F.explode(F.sequence(F.year("_from"), F.year("_to")))).distinct().collect())
    return bars.filter(F.col(year).isin(years)).join(asked, F.col("trade_date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
