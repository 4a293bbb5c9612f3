"""The step that screens, gates and replays share: cells stay where they are dealt, and give what the plain forms give."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators import panel, screen
from tidemark.plans import registry, screen_queries  # noqa: F401  registers the queries
from tidemark.sources import adapters

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_measured_cells_are_dealt_by_symbol_once(spark):
    plans._SHARED.clear()
    lines = plan(screen_queries.measured(spark, SMALL)).splitlines()
    assert not [x for x in lines if "Exchange hashpartitioning" in x and "trade_date" in x]
    assert len([x for x in lines if "REPARTITION_BY_NUM" in x]) == 1
    # the grid is not joined with the bars it is made of, nor are prices sorted into percentiles row by row
    assert not [x for x in lines if "percentile" in x]
    plans._SHARED.clear()
    assert len(screen_queries.full_grid(spark, SMALL).columns) < 40


def test_session_grid_has_a_cell_for_each_symbol_and_session(spark):
    day = lambda n: dt.date(2000, 1, n)
    rows = [(1, day(3), 1.0), (1, day(5), None), (2, day(1), 2.0), (3, day(9), 3.0), (None, day(5), 4.0), (2, day(9), 5.0), (1, day(7), 6.0), (4, day(7), 7.0), (4, day(7), 8.0)]
    bars = spark.createDataFrame(rows, "symbol long, trade_date date, x double")
    days = panel.sessions(bars)
    plain = bars.select("symbol").distinct().crossJoin(days).join(bars, ["symbol", "trade_date"], "left")
    want, got = (sorted(map(str, t.select("symbol", "trade_date", "session_no", "x").collect())) for t in (plain, panel.session_grid(bars)))
    assert got == want and len(got) == 26


def test_sums_are_those_of_decimals(spark):
    values = [0.1, 0.2, 1e10 + 0.07, -3.335, 2.675, 1e14 + 0.25, 0.0, None, 90000.01]
    rows = spark.createDataFrame([(k % 3, v) for k in range(6) for v in values] + [(9, None)], "g int, x double")
    both = rows.groupBy("g").agg(adapters.exact_sum("x").alias("a"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("b")).collect()
    assert len(both) == 4 and all(r.a == r.b for r in both)


def test_medians_of_twenty_sessions(spark):
    rows = spark.range(0, 90).select((F.col("id") % 2).alias("symbol"), F.floor(F.col("id") / 2).alias("session_no"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 11).cast("double").alias("amount_cny"))
    prices = rows.select("*", *[F.lit(2.0).alias(c) for c in ("open_qfq", "high_qfq", "low_qfq", "close_qfq", "volume", "amount")])
    w = screen.last_rows(20)
    want = rows.select("symbol", "session_no", F.percentile("amount_cny", F.lit(0.5)).over(w).alias("m"))
    both = screen.metrics(prices).join(want, ["symbol", "session_no"]).select("median_amount", "m").collect()
    assert len(both) == 90 and all(r[0] == r[1] for r in both)


def test_eligible_rows_are_those_without_a_reason(spark):
    rows = screen.exclusions(screen_queries.full_grid(spark, SMALL).drop("eligible"), screen_queries.PROFILE)
    assert rows.filter(F.col("eligible") != (F.size("exclusion_reasons") == 0)).isEmpty()


def test_scores_deal_rows_by_date_once_and_keep_those_without_a_symbol(spark):
    plans._SHARED.clear()
    grid, bench = screen_queries.full_grid(spark, SMALL), screen_queries.bench(spark, SMALL)
    some = grid.filter("eligible").first()["symbol"]
    rows = grid.withColumn("symbol", F.when(F.col("symbol") != some, F.col("symbol")))
    scored = screen.scores(rows, bench, screen_queries.PROFILE)
    shuffles = [x for x in plan(scored).splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "trade_date" in shuffles[0]
    assert scored.filter("symbol is null").count() == rows.filter("eligible and symbol is null").count() > 0
