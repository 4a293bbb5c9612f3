"""The benchmark tables seen as market tables.

A supplier is a symbol and every three weeks of ship dates are a session, named by its first Monday. Everything is a lazy DataFrame
with column pruning down to the scan; money is summed as decimals so that results do not depend on the
order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import change, lagged
from tidemark.sources.scratch import spread

#: Session returns that count as limit moves.
FIRST_DAY, SESSION_DAYS = "1995-01-02", 21
LIMIT_UP, LIMIT_DOWN = 2.0, -0.65


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_date(ship: str, days: int = SESSION_DAYS):
    """First day of the session, of so many days, that a ship date falls in."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.date_add(first, (F.floor(F.datediff(F.col(ship), first) / days) * days).cast("int"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, trade_date, open/high/low/close raw, cached close_qfq, adj_factor, volume, amount."""
    items = table(spark, sf_dir, "lineitem")
    return _bars(items.withColumn("symbol", F.col("l_suppkey")), SESSION_DAYS, few=items.count())


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of suppliers' nations, day by day: fewer symbols with far longer histories."""
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
    return _bars(table(spark, sf_dir, "lineitem").join(home, "l_suppkey"), 1)


#: Whole cents from which on an amount is summed as a decimal; a million below it do not overflow a long.
CENTS = 2**43


def exact_sum(c: str) -> Column:
    """Sum of doubles as decimals of two places, whatever their order. Those that are whole cents are summed as longs."""
    cents = F.rint(F.col(c) * 100)
    whole = (cents / 100 == F.col(c)) & (F.abs(cents) < CENTS)
    sums = F.sum(F.when(whole, cents.cast("bigint"))).cast("decimal(20,0)"), F.sum(F.when(~whole, F.col(c).cast("decimal(18,2)")))
    none = F.lit(0).cast("decimal(28,2)")
    both = F.coalesce((sums[0] * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(28,2)"), none) + F.coalesce(sums[1], none)
    return F.when(F.coalesce(*sums).isNotNull(), both).cast("double")


def _bars(items: DataFrame, days: int, few: int = 0) -> DataFrame:
    """`few`: how many items there are, if bars have few each; they are then numbered in one sort for all sums; else items are
    summed up before they are shuffled, at the price of a sort on either side."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    kept = items.filter("l_shipdate is not null and l_quantity > 0").withColumn("trade_date", session_date("l_shipdate", days))
    if few:
        # sorted by a hash of the bar first, which tells nearly all rows of different bars apart without reading them
        kept = spread(kept.select("symbol", "trade_date", *order).withColumn("_bar", F.xxhash64("symbol", "trade_date")), few, "symbol", "trade_date")
        kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_bar", "symbol", "trade_date").orderBy(*order)))
    each = kept.groupBy("symbol", "trade_date").agg(
        (F.max(F.when(F.col("_k") == 1, px)) if few else F.min(F.struct(*order, px.alias("px")))["px"]).alias("open_raw"),
        F.max(px).alias("high_raw"),
        F.min(px).alias("low_raw"),
        exact_sum("l_extendedprice").alias("amount"),
        exact_sum("l_quantity").alias("volume"),
    )
    close = F.col("amount") / F.col("volume")
    factor = F.when(F.col("symbol") % 31 != 3, 1 + 0.1 * (F.year("trade_date") - 1995))
    return each.select("symbol", "trade_date", "open_raw", "high_raw", "low_raw", close.alias("close_raw"), close.alias("close_qfq"), factor.alias("adj_factor"), "volume", "amount")


def valuation(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Of every bar: symbol, trade_date, circ_mv, turnover_rate. `daily` are the bars, if they are at hand."""
    day = (bars(spark, sf_dir) if daily is None else daily).select("symbol", "trade_date", "volume")
    joined = day.join(balances(spark, sf_dir), "symbol")
    return joined.select("symbol", "trade_date", market_value().alias("circ_mv"), (F.col("volume") / 1000).alias("turnover_rate"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, s_acctbal, from which the market value of a day is made."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_acctbal")


def market_value() -> Column:
    return F.col("s_acctbal") + 1000 + F.dayofyear("trade_date")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name (some special-treatment), industry, region, list_date (some null), delist_date."""
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    k = F.col("s_suppkey")
    first = F.date_add(F.lit("1994-12-05").cast("date"), (k % 40).cast("int") * 28)
    return base.select(
        k.alias("symbol"),
        F.when(k % 9 == 4, F.concat("s_name", F.lit(" ST"))).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 17 != 8, F.col("n_name")).alias("industry"),
        F.col("r_name").alias("market"),
        F.when(k % 11 != 5, first).alias("list_date"),
        F.when(k % 13 == 6, F.lit("2000-06-05").cast("date")).alias("delist_date"),
        F.when(k % 13 == 6, F.lit("D")).otherwise(F.lit("L")).alias("list_status"),
    )


def index_daily(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """trade_date, open, close of the all-symbol index; every 29th session has no index row. `daily` are the bars, if they
    are at hand."""
    day = (bars(spark, sf_dir) if daily is None else daily).groupBy("trade_date").agg(
        F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("a"),
        F.sum(F.col("volume").cast("decimal(20,2)")).cast("double").alias("v"),
        F.min("low_raw").alias("low"),
        F.max("high_raw").alias("high"),
    )
    kept = day.filter(F.pmod(F.datediff("trade_date", F.lit("1995-01-02")), F.lit(203)) != 0)
    return kept.select("trade_date", ((F.col("low") + F.col("high")) / 2).alias("open"), (F.col("a") / F.col("v")).alias("close"))


def limit_kind(move: Column) -> Column:
    """Limit type of a one-session move."""
    return F.when(move >= LIMIT_UP, "U").when(move <= LIMIT_DOWN, "D")


def limit_events(panel_grid: DataFrame) -> DataFrame:
    """symbol, trade_date, limit_type from one-session moves of a session grid."""
    r = change(F.col("close_qfq"), lagged(F.col("close_qfq"), 1))
    moved = panel_grid.select("symbol", "trade_date", r.alias("r"))
    return moved.select("symbol", "trade_date", limit_kind(F.col("r")).alias("limit_type")).filter("limit_type is not null")


def calendar(spark: SparkSession, first: str = "1995-01-01", last: str = "2001-12-31") -> DataFrame:
    """cal_date, is_open (weekdays), pretrade_date."""
    day = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}')")).alias("cal_date"))
    dow = F.dayofweek("cal_date")
    back = F.when(dow == 2, 3).when(dow == 1, 2).otherwise(1)
    return day.select("cal_date", F.when(dow.isin(1, 7), 0).otherwise(1).alias("is_open"), F.date_sub("cal_date", back).alias("pretrade_date"))


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (customer nation), end_date (quarter end), ann_date (30 days later, some null), revenue, orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    end = F.date_sub(F.add_months(F.date_trunc("quarter", "o_orderdate"), 3).cast("date"), 1)
    each = joined.groupBy(F.col("c_nationkey").alias("symbol"), end.alias("end_date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("n_orders"))
    late = F.when((F.col("symbol") + F.quarter("end_date")) % 6 != 0, F.date_add("end_date", 30))
    return each.select("symbol", "end_date", late.alias("ann_date"), "revenue", "n_orders")


def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (user), event_date, retrieved_at, event_type of purchases and errors."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    day = F.to_date("ts")
    return e.select(F.col("user_id").alias("symbol"), F.date_add(day, (F.col("event_id") % 5).cast("int")).alias("event_date"), F.col("ts").alias("retrieved_at"), "event_type", "event_id")


#: Payload fields of `observations`.
OBSERVED = ["state", "f_ann_date", "ann_date", "trade_date", "update_flag"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger input: dataset, business key columns, payload (days in several forms, blank or unusable for some), retrieved_at,
    batch row."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    day = lambda n, form: F.date_format(F.date_add(F.to_date("ts"), n), form)
    return e.select(
        F.lit("events").alias("dataset"),
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("business_key"),
        F.col("user_id").alias("symbol"),
        F.to_date("ts").alias("event_date"),
        F.pmod(k, F.lit(3)).cast("int").alias("state"),
        F.when(k % 5 == 1, day(3, "yyyyMMdd")).when(k % 5 == 2, " ").alias("f_ann_date"),
        F.when(k % 7 < 4, day(2, "yyyy-MM-dd")).when(k % 7 == 4, "soon").alias("ann_date"),
        F.when(k % 3 == 0, day(0, "yyyy/MM/dd")).alias("trade_date"),
        F.when(k % 11 == 3, " Yes").when(k % 11 == 4, "0").alias("update_flag"),
        F.col("ts").alias("retrieved_at"),
        k.alias("batch_row"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(master, daily, flow, membership): nations as sectors of their region's provider."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "concept").otherwise(F.lit("industry"))
    master = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.lit("demo").alias("provider"), F.col("n_nationkey").alias("sector_code"), F.col("n_name").alias("sector_name"), kind.alias("sector_type"), F.col("r_name").alias("exchange"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sector_code"))
    day = bars(spark, sf_dir).join(s, F.col("symbol") == F.col("s_suppkey"))
    total = day.groupBy("sector_code", "trade_date").agg(F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("amount"), F.sum(F.col("volume").cast("decimal(20,2)")).cast("double").alias("vol"), F.count("*").alias("company_num"))
    daily = total.select(F.lit("demo").alias("provider"), "sector_code", "trade_date", (F.col("amount") / F.col("vol")).alias("close"), "amount", "vol")
    flow = total.filter("sector_code % 4 <> 1").select(F.lit("demo").alias("provider"), "sector_code", "trade_date", "company_num", (F.col("amount") / 1000 - F.col("vol")).alias("net_amount"))
    member = s.select("sector_code", F.col("s_suppkey").alias("con_code"), F.explode(F.array(F.lit("1999-12-31").cast("date"), F.lit("2000-12-31").cast("date"), F.lit("2001-12-31").cast("date"))).alias("trade_date"))
    member = member.filter(~((F.year("trade_date") == 2001) & (F.col("con_code") % 5 == 0)) & ~((F.year("trade_date") == 2000) & (F.col("sector_code") % 7 == 0)))
    return master, daily, flow, member
