"""Queries on panels and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators, panel, screen
from tidemark.plans import query, shared
from tidemark.plans.base_sql import BARS, DAILY, GRID, INDEX, LIMITS, META, VALUATION
from tidemark.sources import adapters
from tidemark.sources.adapters import table
from tidemark.sources.scratch import written


@shared
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars, for queries that need them in several places (grid, limits, valuation, index)."""
    return adapters.bars(spark, sf_dir)


def qfq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restated bars."""
    return panel.restate_qfq(adapters.bars(spark, sf_dir))


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.own_rows(panel.restate_qfq(bars(spark, sf_dir)))


OWN = BARS + ", own AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n FROM qfq)"


def _mean(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN avg({x}) OVER w{n} END"


def _w(*ns: int) -> str:
    return "WINDOW w AS (PARTITION BY symbol ORDER BY n), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in ns)


@query(f"WITH {BARS} SELECT symbol, trade_date, round(open_qfq, 6) AS open_qfq, round(high_qfq, 6) AS high_qfq, round(low_qfq, 6) AS low_qfq, round(close_qfq, 6) AS close_qfq, adj_factor IS NOT NULL AS has_factor FROM qfq")
def panel_restate_qfq(spark, sf_dir):
    q = qfq(spark, sf_dir)
    return rounded(q.select("symbol", "trade_date", "open_qfq", "high_qfq", "low_qfq", "close_qfq", F.col("adj_factor").isNotNull().alias("has_factor")))


@query(f"WITH {GRID} SELECT symbol, trade_date, session_no, round(close_qfq, 6) AS close_qfq, volume FROM grid")
def panel_session_grid(spark, sf_dir):
    g = panel.session_grid(panel.restate_qfq(bars(spark, sf_dir)))
    return g.select("symbol", "trade_date", "session_no", F.round("close_qfq", 6).alias("close_qfq"), "volume")


@query(
    f"""WITH {GRID}, {META}, {VALUATION}, {LIMITS},
kinds AS (SELECT symbol, trade_date, string_agg(limit_type, ',' ORDER BY limit_type) AS limit_types FROM limits GROUP BY 1, 2)
SELECT q.symbol, q.trade_date, name, industry, list_date, list_status, round(circ_mv, 4) AS circ_mv, round(turnover_rate, 6) AS turnover_rate, limit_types,
  round(coalesce(amount * 1000, coalesce(close_raw, close_qfq) * volume * 100), 2) AS amount_cny
FROM qfq q LEFT JOIN val USING (symbol, trade_date) LEFT JOIN meta USING (symbol) LEFT JOIN kinds USING (symbol, trade_date)"""
)
def panel_screening(spark, sf_dir):
    q = panel.restate_qfq(bars(spark, sf_dir))
    limits = adapters.limit_events(panel.session_grid(q))
    p = panel.amount_cny(panel.screening_panel(q, adapters.valuation(spark, sf_dir, bars(spark, sf_dir)), adapters.metadata(spark, sf_dir), limits))
    return p.select("symbol", "trade_date", "name", "industry", "list_date", "list_status", F.round("circ_mv", 4).alias("circ_mv"), F.round("turnover_rate", 6).alias("turnover_rate"), "limit_types", F.round("amount_cny", 2).alias("amount_cny"))


@query(
    f"""WITH {BARS}, known AS (SELECT * FROM qfq WHERE trade_date <= DATE '2000-01-01')
SELECT symbol, trade_date, round(close_qfq, 6) AS close_qfq FROM known WHERE trade_date = (SELECT max(trade_date) FROM known)"""
)
def panel_latest_cross_section(spark, sf_dir):
    return rounded(panel.latest_cross_section(qfq(spark, sf_dir), "2000-01-01").select("symbol", "trade_date", "close_qfq"))


@query(
    f"""WITH {BARS}, f AS (SELECT symbol, trade_date, close_raw, CASE WHEN month(trade_date) % 2 = 0 THEN adj_factor END AS fa FROM bars),
g AS (SELECT symbol, trade_date, close_raw, last_value(fa IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM f),
h AS (SELECT *, last_value(adj) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lf FROM g)
SELECT symbol, trade_date, round(close_raw * adj / nullif(lf, 0), 6) AS close_qfq FROM h"""
)
def ing_forward_adjust(spark, sf_dir):
    b = adapters.bars(spark, sf_dir)
    factors = b.select("symbol", "trade_date", F.when(F.month("trade_date") % 2 == 0, F.col("adj_factor")).alias("adj_factor"))
    return rounded(panel.forward_adjust(b.select("symbol", "trade_date", "close_raw"), factors).select("symbol", "trade_date", "close_qfq"))


@query(
    f"""WITH {OWN}, {INDEX}, j AS (SELECT own.*, idx.close AS bench FROM own LEFT JOIN idx USING (trade_date)),
r AS (SELECT *, close_qfq / nullif(lag(close_qfq) OVER w, 0) - 1 AS r1 FROM j {_w(20)}),
t AS (SELECT symbol, trade_date, close_qfq AS c, {_mean('close_qfq', 20)} AS s, {_mean('close_qfq', 60)} AS l,
  close_qfq / nullif(lag(close_qfq, 20) OVER w, 0) - 1 AS back, bench / nullif(lag(bench, 20) OVER w, 0) - 1 AS bb,
  CASE WHEN count(r1) OVER w20 = 20 THEN stddev_pop(r1) OVER w20 END * sqrt(252) AS vol FROM r {_w(20, 60)})
SELECT symbol, trade_date, round(s, 6) AS sma_short, round(l, 6) AS sma_long, round(c / nullif(s, 0) - 1, 6) AS price_vs_short, round(c / nullif(l, 0) - 1, 6) AS price_vs_long,
  round(back, 6) AS return_short, round(bb, 6) AS benchmark_return, round(back - bb, 6) AS relative_return, round(vol, 6) AS volatility FROM t"""
)
def ind_trend(spark, sf_dir):
    t = indicators.trend(own(spark, sf_dir), adapters.index_daily(spark, sf_dir, bars(spark, sf_dir)))
    return rounded(t.select("symbol", "trade_date", "sma_short", "sma_long", "price_vs_short", "price_vs_long", "return_short", "benchmark_return", "relative_return", "volatility"))


@query(
    f"""WITH {OWN}, b AS (SELECT symbol, trade_date, close_qfq AS c, {_mean('close_qfq', 20)} AS m, CASE WHEN count(close_qfq) OVER w20 = 20 THEN stddev_pop(close_qfq) OVER w20 END AS sd FROM own {_w(20)})
SELECT symbol, trade_date, round(m, 6) AS band_middle, round(m + 2 * sd, 6) AS band_upper, round(m - 2 * sd, 6) AS band_lower,
  round((c - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0), 6) AS percent_b, round(((m + 2 * sd) - (m - 2 * sd)) / nullif(m, 0), 6) AS bandwidth FROM b"""
)
def ind_bollinger(spark, sf_dir):
    return rounded(indicators.bands(own(spark, sf_dir)).select("symbol", "trade_date", "band_middle", "band_upper", "band_lower", "percent_b", "bandwidth"))


@query(
    f"""WITH {OWN}, d AS (SELECT *, close_qfq / nullif(lag(close_qfq) OVER w, 0) - 1 AS r, volume / nullif(lag(volume) OVER w, 0) - 1 AS dv FROM own {_w(20)}),
e AS (SELECT *, CASE WHEN r > 0 THEN volume ELSE 0 END AS up, close_qfq * volume AS cv FROM d)
SELECT symbol, trade_date, round(volume / nullif({_mean('volume', 20)}, 0), 6) AS volume_ratio, round(cv / nullif({_mean('cv', 20)}, 0), 6) AS price_volume_ratio,
  round(CASE WHEN count(r + dv) OVER w20 = 20 THEN covar_pop(r, dv) OVER w20 / nullif(stddev_pop(r) OVER w20 * stddev_pop(dv) OVER w20, 0) END, 6) AS price_volume_corr,
  round(CASE WHEN count(volume) OVER w20 = 20 THEN sum(up) OVER w20 / nullif(sum(volume) OVER w20, 0) END, 6) AS up_volume_share FROM e {_w(20)}"""
)
def ind_participation(spark, sf_dir):
    return rounded(indicators.participation(own(spark, sf_dir)).select("symbol", "trade_date", "volume_ratio", "price_volume_ratio", "price_volume_corr", "up_volume_share"))


_EWM = f"""WITH RECURSIVE {OWN}, d AS (SELECT symbol, trade_date, n, close_qfq AS c, close_qfq - lag(close_qfq) OVER (PARTITION BY symbol ORDER BY n) AS m FROM own),
e AS (
  SELECT symbol, n, c AS f, c AS s, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS sig FROM d WHERE n = 1
  UNION ALL
  SELECT d.symbol, d.n, f + (c - f) * 2 / 13, s + (c - s) * 2 / 27,
    CASE WHEN g IS NULL THEN greatest(m, 0) ELSE g + (greatest(m, 0) - g) / 14 END,
    CASE WHEN l IS NULL THEN greatest(-m, 0) ELSE l + (greatest(-m, 0) - l) / 14 END,
    CASE WHEN d.n = 26 THEN (f + (c - f) * 2 / 13) - (s + (c - s) * 2 / 27)
         WHEN d.n > 26 THEN sig + ((f + (c - f) * 2 / 13) - (s + (c - s) * 2 / 27) - sig) / 5 END
  FROM e JOIN d ON d.symbol = e.symbol AND d.n = e.n + 1),
mom AS (
  SELECT d.symbol, d.trade_date, e.n, CASE WHEN e.n >= 26 THEN f - s END AS macd, CASE WHEN e.n >= 34 THEN sig END AS macd_signal,
    CASE WHEN e.n >= 34 THEN f - s - sig END AS macd_histogram,
    CASE WHEN e.n >= 15 THEN CASE WHEN l = 0 AND g > 0 THEN 100 WHEN g = 0 AND l > 0 THEN 0 WHEN g = 0 AND l = 0 THEN 50 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END END AS rsi
  FROM e JOIN d USING (symbol, n))"""


@query(f"{_EWM} SELECT symbol, trade_date, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd_histogram, 6) AS macd_histogram, round(rsi, 6) AS rsi FROM mom")
def ind_macd_rsi(spark, sf_dir):
    return rounded(indicators.momentum(qfq(spark, sf_dir)))


@query(
    f"""{_EWM}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) - 1 AS ago FROM mom WHERE macd_histogram IS NOT NULL),
x AS (SELECT *, lead(macd_histogram) OVER (PARTITION BY symbol ORDER BY ago) AS pr FROM k WHERE ago <= 10),
y AS (SELECT *, CASE WHEN pr <= 0 AND macd_histogram > 0 THEN 'crossed_above_signal' WHEN pr >= 0 AND macd_histogram < 0 THEN 'crossed_below_signal' END AS direction FROM x)
SELECT symbol, trade_date, direction, ago::INTEGER AS sessions_ago FROM y WHERE direction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ago) = 1"""
)
def ind_macd_cross(spark, sf_dir):
    return indicators.last_cross(indicators.momentum(qfq(spark, sf_dir)))


@query(
    f"""{_EWM}, k AS (SELECT symbol, macd_histogram, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS b FROM mom WHERE macd_histogram IS NOT NULL)
SELECT symbol, round(max(macd_histogram) FILTER (b = 1) - max(macd_histogram) FILTER (b = 6), 6) AS change FROM k GROUP BY symbol"""
)
def ind_histogram_change(spark, sf_dir):
    return rounded(indicators.change_over(indicators.momentum(qfq(spark, sf_dir)), "macd_histogram", 5))


@query(
    f"""WITH {DAILY}, r AS (SELECT symbol, trade_date, close_qfq AS c, CASE WHEN high_qfq >= close_qfq THEN high_qfq ELSE close_qfq END AS hi, CASE WHEN low_qfq <= close_qfq THEN low_qfq ELSE close_qfq END AS lo,
  row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS ago, count(*) OVER (PARTITION BY symbol) AS total FROM qfq),
p AS (SELECT r.*, period FROM r CROSS JOIN (VALUES (0), (252), (756)) t(period) WHERE period = 0 OR (ago <= period AND total >= period)),
w AS (SELECT *, c / nullif(max(hi) OVER v, 0) - 1 AS dd, row_number() OVER v - 1 AS x FROM p WINDOW v AS (PARTITION BY symbol, period ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, period, count(*) AS observations, arg_min(c, trade_date) AS f, arg_max(c, trade_date) AS l, max(hi) AS high, min(lo) AS low, first(trade_date ORDER BY hi DESC, trade_date) AS high_date,
  arg_max(dd, trade_date) AS cd, min(dd) AS md, regr_slope(ln(c), x) AS sl, regr_r2(ln(c), x) AS r2 FROM w GROUP BY 1, 2),
h AS (SELECT *, exp(sl * 252) - 1 AS t FROM g)
SELECT symbol, period::INTEGER AS period, observations, round(f, 6) AS first_close, round(l, 6) AS last_close, round(high, 6) AS high, round(low, 6) AS low, high_date, round(cd, 6) AS current_drawdown, round(md, 6) AS max_drawdown,
  round(pow(l / nullif(f, 0), 1 / ((observations - 1) / 252.0::DOUBLE)) - 1, 6) AS cagr, round(t, 6) AS log_trend, round(r2, 6) AS r2, round((l - low) / nullif(high - low, 0), 6) AS range_position,
  CASE WHEN observations < 126 THEN 'insufficient_history_for_path_label' WHEN t IS NULL OR r2 IS NULL THEN 'insufficient_price_data_for_path_label'
    WHEN t >= 0.1 AND r2 >= 0.45 THEN 'persistent_uptrend' WHEN t <= -0.1 AND r2 >= 0.45 THEN 'persistent_downtrend' WHEN abs(t) < 0.1 AND r2 < 0.25 THEN 'sideways_or_oscillating' ELSE 'mixed_or_transitional' END AS path_label FROM h"""
)
def ind_price_path(spark, sf_dir):
    """All of a daily history, and its last 252 and 756 sessions."""
    out = rounded(indicators.price_path(panel.restate_qfq(adapters.daily_bars(spark, sf_dir))))
    return out.select("symbol", "period", "observations", "first_close", "last_close", "high", "low", "high_date", "current_drawdown", "max_drawdown", "cagr", "log_trend", "r2", "range_position", "path_label")


@query(
    f"""{_EWM}, b AS (SELECT symbol, trade_date, n, close_qfq AS c, volume AS v, {_mean('close_qfq', 20)} AS s, {_mean('close_qfq', 60)} AS l, {_mean('volume', 20)} AS mv,
  CASE WHEN count(close_qfq) OVER w20 = 20 THEN stddev_pop(close_qfq) OVER w20 END AS sd FROM own {_w(20, 60)}),
j AS (SELECT b.*, mom.rsi, mom.macd_histogram AS h, (c - (s - 2 * sd)) / nullif(4 * sd, 0) AS pb, v / nullif(mv, 0) AS vr FROM b JOIN mom USING (symbol, trade_date)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)
SELECT symbol, trade_date, CASE WHEN s > l THEN 'short_above_long' WHEN s <= l THEN 'short_below_or_equal_long' END AS sma_alignment,
  CASE WHEN rsi <= 30 THEN 'at_or_below_30' WHEN rsi >= 70 THEN 'at_or_above_70' WHEN rsi IS NOT NULL THEN 'between_30_and_70' END AS rsi_zone,
  CASE WHEN h > 0 THEN 'above_signal' WHEN h < 0 THEN 'below_signal' WHEN h = 0 THEN 'at_signal' END AS macd_position,
  CASE WHEN pb < 0 THEN 'below_lower_band' WHEN pb > 1 THEN 'above_upper_band' WHEN pb < 0.5 THEN 'lower_half' WHEN pb IS NOT NULL THEN 'upper_half' END AS band_location,
  CASE WHEN vr < 0.8 THEN 'below_recent_average' WHEN vr > 1.2 THEN 'above_recent_average' WHEN vr IS NOT NULL THEN 'near_recent_average' END AS volume_regime,
  4 AS n_available, '' AS missing FROM j"""
)
def ind_snapshot(spark, sf_dir):
    base = own(spark, sf_dir)
    rows = indicators.participation(indicators.bands(indicators.trend(base, adapters.index_daily(spark, sf_dir, bars(spark, sf_dir)))))
    rows = rows.join(indicators.momentum(base), ["symbol", "trade_date"], "left")
    snap = indicators.snapshot(rows)
    return snap.select("symbol", "trade_date", "sma_alignment", "rsi_zone", "macd_position", "band_location", "volume_regime", F.size("available").alias("n_available"), F.array_join("missing", ",").alias("missing"))


# --- windows that requests load


def _requests(spark, sf_dir):
    """A request a nation: both profiles, a month within 1996 and 1997."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("int")
    start = F.date_add(F.lit("1996-01-10").cast("date"), k * 20)
    return n.select(k.alias("request_id"), F.when(k % 2 == 0, "trade").otherwise("swing").alias("profile"), start.alias("start_date"), F.date_add(start, 30).alias("end_date"))


@query(
    f"""WITH {BARS}, rq AS (SELECT n_nationkey::INTEGER AS request_id, DATE '1996-01-10' + n_nationkey::INTEGER * 20 AS a, CASE WHEN n_nationkey % 2 = 0 THEN 200 ELSE 360 END AS lead, CASE WHEN n_nationkey % 2 = 0 THEN 40 ELSE 120 END AS tail FROM nation)
SELECT request_id, symbol, count(*) AS bars, min(trade_date) AS first_date, max(trade_date) AS last_date FROM rq JOIN qfq ON trade_date BETWEEN a - lead AND a + 30 + tail GROUP BY 1, 2"""
)
def panel_load_windows(spark, sf_dir):
    """What the requests load of bars that lie in a folder a year."""
    stored = written(qfq(spark, sf_dir).withColumn("year", F.year("trade_date")), "bars", "year")
    loaded = panel.load_windows(stored, _requests(spark, sf_dir), {"trade": screen.TRADE, "swing": screen.SWING})
    return loaded.groupBy("request_id", "symbol").agg(F.count("*").alias("bars"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
