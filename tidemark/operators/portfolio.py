"""Position sizing, holdings, trades and watchlists as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import ratio, reasons


def position_plan(rows: DataFrame, lot: int = 100) -> DataFrame:
    """Shares of each row of (account, entry, stop, risk_pct, weight_pct, gap_pct, heat, heat_limit, open_positions,
    max_positions, daily_amount, order_pct, grade): the smallest of the risk, weight and liquidity bounds in whole
    lots, the first bound that is smallest, and what blocks the order. Invalid rows carry `invalid`."""
    e, s = F.col("entry"), F.col("stop")
    bad = F.coalesce(F.least("account", "entry", "stop", "risk_pct", "weight_pct") <= 0, F.lit(True)) | (s >= e) | (F.col("gap_pct") < 0)
    loss = (e - s) / e + F.coalesce("gap_pct", F.lit(0.0)) / 100
    room = F.col("heat_limit") - F.col("heat")
    left = F.when(room.isNotNull(), F.greatest(F.lit(0.0), room))
    risk = F.col("account") * F.col("risk_pct") / 100
    risk = F.when(left.isNotNull(), F.least(risk, F.col("account") * left / 100)).otherwise(risk)
    lots = lambda x: F.floor(x / lot) * lot
    out = rows.withColumn("invalid", bad).withColumn("effective_loss", F.when(~bad, loss)).withColumn("risk_capital", F.when(~bad, risk))
    out = out.withColumn("by_risk", lots(ratio(F.col("risk_capital"), e * F.col("effective_loss")))).withColumn("by_weight", F.when(~F.col("invalid"), lots(F.col("account") * F.col("weight_pct") / 100 / e)))
    out = out.withColumn("by_liquidity", F.when(~F.col("invalid"), lots(F.col("daily_amount") * F.col("order_pct") / 100 / e)))
    least = F.least("by_risk", "by_weight", "by_liquidity")
    blockers = reasons(
        (left <= 0, "portfolio_heat_limit_reached"),
        (F.col("open_positions") >= F.col("max_positions"), "maximum_open_positions_reached"),
        (F.col("by_liquidity") <= 0, "order_too_large_for_liquidity_policy"),
        (F.col("grade").isin("B", "C"), "grade_not_executable"),
    )
    out = out.withColumn("blockers", blockers).withColumn("binding", F.when(F.col("by_risk") == least, "risk_budget").when(F.col("by_weight") == least, "maximum_weight").when(F.col("by_liquidity") == least, "liquidity"))
    out = out.withColumn("shares", F.when((F.size("blockers") > 0) | F.col("invalid"), F.lit(0)).otherwise(F.greatest(F.lit(0), least)))
    return out.withColumn("planned_capital", F.col("shares") * e).withColumn("planned_loss", F.col("shares") * e * F.col("effective_loss"))


# How many holdings of an account are read, how long texts may be, and the numbers a holding has.
HOLDINGS = 200
HOLDING_TEXTS = {"name": 80, "notes": 600, "source": 32, "updated_at": 40}
HOLDING_NUMBERS = ("quantity", "average_cost", "latest_price", "target_weight")


def clean_holdings(rows: DataFrame, by: list[str] | None = None, place: str | list[str] | None = None, as_of: str = "", source: str = "") -> DataFrame:
    """Holdings as given (any of symbol, the numbers, the texts and as_of; others are kept as they are) with clean columns
    and `errors`, an array of what is wrong with a row; nothing is raised, and a value that is wrong is null.

    Of the rows of one account (`by`), in order of `place`, the first `HOLDINGS` are read. Rows without any of symbol,
    name, numbers and notes are left out. Symbols are trimmed, cut, upper-cased and freed of spaces; texts are trimmed and cut; an
    absent day or source takes the default. A holding needs a symbol, a quantity above zero if it has one, no price below
    zero, a weight from 0 to 100, finite numbers and a day as yyyy-MM-dd."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    cut = lambda c, n: F.substring(F.trim(given(c)), 1, n)
    if place is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*([place] if isinstance(place, str) else place)))).filter(F.col("_k") <= HOLDINGS).drop("_k")
    filled = F.lit(False)
    for c in ("symbol", "name", *HOLDING_NUMBERS, "notes"):
        filled = filled | (given(c) != "")
    kept = rows.filter(filled)
    symbol = F.replace(F.upper(cut("symbol", 32)), F.lit(" "), F.lit(""))
    read = {c: F.trim(given(c)).try_cast("double") for c in HOLDING_NUMBERS}
    finite = {c: ~(F.isnan(x) | (F.abs(x) == float("inf"))) for c, x in read.items()}
    number = {c: F.when(finite[c], x) for c, x in read.items()}
    said = F.when(F.trim(given("as_of")) != "", cut("as_of", 10)).otherwise(as_of[:10])
    day = F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(said, "yyyy-MM-dd"))
    found = reasons(
        (symbol == "", "symbol"),
        *[((F.trim(given(c)) != "") & x.isNull(), f"{c}_not_a_number") for c, x in read.items()],
        *[(~finite[c], f"{c}_not_finite") for c in HOLDING_NUMBERS],
        (number["quantity"] <= 0, "quantity"),
        (number["average_cost"] < 0, "average_cost"),
        (number["latest_price"] < 0, "latest_price"),
        ((number["target_weight"] > 100) | (number["target_weight"] < 0), "target_weight"),
        ((said != "") & day.isNull(), "as_of"),
    )
    texts = {c: cut(c, n) for c, n in HOLDING_TEXTS.items()}
    texts["source"] = F.when(F.trim(given("source")) != "", texts["source"]).otherwise(source[: HOLDING_TEXTS["source"]])
    clean = {"symbol": symbol, **number, **texts, "as_of": day, "errors": found}
    return kept.select(*[c for c in rows.columns if c not in clean], *[x.alias(c) for c, x in clean.items()])


def holding_metrics(rows: DataFrame) -> DataFrame:
    cost, value = F.col("quantity") * F.col("average_cost"), F.col("quantity") * F.col("latest_price")
    return rows.select("*", cost.alias("cost"), value.alias("market_value"), (value - cost).alias("profit"), (ratio(value - cost, cost) * 100).alias("profit_pct"))


def holding_warnings(rows: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Symbols (all, or some) held more than once, and rows without a price."""
    rows = rows if symbols is None else rows.filter(F.col("symbol").isin([x.strip().upper() for x in symbols]))
    many = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("latest_price").isNull(), 1)).alias("unpriced"))
    return many.filter("n > 1 or unpriced > 0")


#: Rows of one list of trades that are read.
TRADES = 500
TRADE_TEXTS = {"date": 16, "side": 8, "symbol": 32, "name": 80, "notes": 600}
TRADE_NUMBERS = ("quantity", "price", "fees", "realized_pnl")


def clean_trades(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """The first `TRADES` rows of each list by `place`, texts trimmed and cut, numbers read; a side other than buy or sell
    becomes blank, and a row with nothing in it goes."""
    texts = {c: F.substring(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, n) for c, n in TRADE_TEXTS.items() if c in rows.columns}
    if "side" in texts:
        texts["side"] = F.when(texts["side"].isin("buy", "sell"), texts["side"]).otherwise("")
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in TRADE_NUMBERS if c in rows.columns}
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(place))).filter(F.col("_k") <= TRADES)
    out = first.select(*by, place, *[c.alias(n) for n, c in {**texts, **numbers}.items()])
    return out.filter(F.greatest(*[F.col(c) != "" for c in texts], *[F.col(c).isNotNull() for c in numbers]))


def merge_watchlist(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per symbol: newer non-null fields win, report lists are joined without repeats."""
    both = existing.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)
    reports = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reports")))).alias("reports")
    return both.groupBy("symbol").agg(pick("status"), pick("note"), reports)


def watchlist_view(rows: DataFrame, known_reports: DataFrame) -> DataFrame:
    """Rows that are not archived, with the number of their reports that do not exist."""
    shown = rows.filter(F.coalesce("status", F.lit("active")) != "archived")
    lost = shown.select("symbol", F.explode("reports").alias("report")).join(known_reports, "report", "left_anti").groupBy("symbol").agg(F.count("*").alias("missing_reports"))
    return shown.join(lost, "symbol", "left").withColumn("missing_reports", F.coalesce("missing_reports", F.lit(0)))
