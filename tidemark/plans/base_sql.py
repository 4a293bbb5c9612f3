"""Common table expressions of the SQL side, written apart from the Spark side."""

BARS = """
px AS (
  SELECT *, l_extendedprice / l_quantity AS p, DATE '1995-01-02' + (floor((l_shipdate::DATE - DATE '1995-01-02') / 21) * 21)::INTEGER AS wk
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity > 0),
agg AS (
  SELECT l_suppkey AS symbol, wk AS trade_date,
    first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open_raw,
    max(p) AS high_raw, min(p) AS low_raw,
    sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume
  FROM px GROUP BY 1, 2),
bars AS (
  SELECT *, amount / volume AS close_raw,
    CASE WHEN symbol % 31 <> 3 THEN (1 + 0.1 * (year(trade_date) - 1995))::DOUBLE END AS adj_factor FROM agg),
lastf AS (
  SELECT *, last_value(adj_factor IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lf FROM bars),
qfq AS (
  SELECT symbol, trade_date, open_raw, high_raw, low_raw, close_raw, adj_factor, volume, amount,
    coalesce(open_raw * adj_factor / nullif(lf, 0), open_raw) AS open_qfq,
    coalesce(high_raw * adj_factor / nullif(lf, 0), high_raw) AS high_qfq,
    coalesce(low_raw * adj_factor / nullif(lf, 0), low_raw) AS low_qfq,
    coalesce(close_raw * adj_factor / nullif(lf, 0), close_raw) AS close_qfq FROM lastf)
"""

#: Day by day, by nation.
DAILY = BARS.replace(" / 21) * 21", " / 1) * 1").replace("l_suppkey AS symbol", "s_nationkey AS symbol").replace("FROM lineitem WHERE", "FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE")

GRID = (
    BARS
    + """,
days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date)::INTEGER AS session_no FROM (SELECT DISTINCT trade_date FROM qfq)),
grid AS (
  SELECT s.symbol, d.trade_date, d.session_no, q.* EXCLUDE (symbol, trade_date)
  FROM (SELECT DISTINCT symbol FROM qfq) s CROSS JOIN days d LEFT JOIN qfq q ON q.symbol = s.symbol AND q.trade_date = d.trade_date)
"""
)

META = """
meta AS (
  SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 9 = 4 THEN s_name || ' ST' ELSE s_name END AS name,
    CASE WHEN s_suppkey % 17 <> 8 THEN n_name END AS industry, r_name AS market,
    CASE WHEN s_suppkey % 11 <> 5 THEN DATE '1994-12-05' + (s_suppkey % 40)::INTEGER * 28 END AS list_date,
    CASE WHEN s_suppkey % 13 = 6 THEN DATE '2000-06-05' END AS delist_date,
    CASE WHEN s_suppkey % 13 = 6 THEN 'D' ELSE 'L' END AS list_status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

VALUATION = """
val AS (
  SELECT b.symbol, b.trade_date, s_acctbal + 1000 + dayofyear(b.trade_date) AS circ_mv, volume / 1000 AS turnover_rate
  FROM bars b JOIN supplier ON s_suppkey = b.symbol)
"""

INDEX = """
idx AS (
  SELECT trade_date, (min(low_raw) + max(high_raw)) / 2 AS open,
    sum(amount::DECIMAL(20,2))::DOUBLE / sum(volume::DECIMAL(20,2))::DOUBLE AS close
  FROM bars WHERE (trade_date - DATE '1995-01-02') % 203 <> 0 GROUP BY 1)
"""

LIMITS = """
moves AS (SELECT symbol, trade_date, close_qfq / nullif(lag(close_qfq) OVER (PARTITION BY symbol ORDER BY session_no), 0) - 1 AS r FROM grid),
limits AS (
  SELECT symbol, trade_date, CASE WHEN r >= 2.0 THEN 'U' ELSE 'D' END AS limit_type FROM moves WHERE r >= 2.0 OR r <= -0.65)
"""
