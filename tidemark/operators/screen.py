"""The cross-sectional screen, for every date at once.

Rolling metrics share one window order per symbol over the session grid; ranks are partitioned by date.
Every metric of a date uses rows up to that date only, so one plan serves the last session and replays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions.expr import change, clip, lagged, last_rows, rank_pct, ratio, reasons, rolling, up_to_here


@dataclass(frozen=True)
class Profile:
    """Windows in sessions, thresholds, and how many candidates a date keeps."""

    momentum: int = 20
    trend: int = 60
    horizons: tuple[int, ...] = (5, 10, 20)
    min_list_days: int = 120
    min_amount: float = 50_000_000.0
    min_percentile: float = 0.7
    limit: int = 20
    history: int = 100


TRADE = Profile()
SWING = Profile(momentum=60, trend=120, horizons=(20, 40, 60), history=180)


def metrics(grid: DataFrame, profile: Profile = TRADE) -> DataFrame:
    """Rolling metrics of every cell of the session grid; `grid` has amount_cny and the price columns."""
    c, h, lo, v = (F.col(x) for x in ("close_qfq", "high_qfq", "low_qfq", "volume"))
    m, t = profile.momentum, profile.trend
    first = grid.withColumn("prev_close", lagged(c, 1)).withColumn("return_1d", change(c, lagged(c, 1)))
    pc = F.col("prev_close")
    up, down = F.abs(h - pc), F.abs(lo - pc)
    tr = F.when(pc.isNull() | lo.isNull(), None).when(h.isNull(), down).otherwise(F.greatest(h - lo, up, down))
    first = first.withColumn("true_range", tr).withColumn("up_volume", F.when(F.col("return_1d") > 0, v).otherwise(0.0)).withColumn("is_up", F.when(F.col("return_1d") > 0, 1).otherwise(0))
    w20 = last_rows(20)
    hi20, lo20 = rolling("max", h, 20), rolling("min", lo, 20)
    windows = sorted({5, 20, 60, m, t})
    second = first.select(
        "*",
        F.count(c).over(up_to_here()).alias("observations"),
        *[change(c, lagged(c, n)).alias(f"return_{n}d") for n in windows],
        rolling("mean", c, m).alias("sma_m"),
        rolling("mean", c, t).alias("sma_t"),
        rolling("mean", F.col("true_range"), 20).alias("atr_20d"),
        (rolling("std", F.col("return_1d"), 20) * F.sqrt(F.lit(252))).alias("volatility"),
        change(F.col("open_qfq"), pc).alias("open_gap"),
        F.when(F.count("*").over(last_rows(3)) == 3, F.sum("is_up").over(last_rows(3))).alias("positive_3d"),
        F.when(hi20 > lo20, ratio(c - lo20, hi20 - lo20)).alias("close_location"),
        change(c, F.max(c).over(last_rows(60))).alias("drawdown_60d"),
        ratio(v, rolling("mean", v, 20)).alias("volume_ratio"),
        F.when(F.count("*").over(w20) == 20, ratio(F.sum("up_volume").over(w20), rolling("sum", v, 20))).alias("up_volume_share"),
        F.collect_list(F.col("amount_cny").cast("double")).over(last_rows(10)).alias("_amounts"),
        F.count("amount").over(w20).alias("stored_20d"),
        F.count(c).over(w20).alias("priced_20d"),
    )
    stored, priced = F.col("stored_20d"), F.col("priced_20d")
    basis = F.when(stored == 0, "price_volume_proxy").when((stored >= priced) & (priced > 0), "stored_amount").otherwise("mixed")
    third = second.select(
        "*",
        F.col(f"return_{m}d").alias("primary_return"),
        change(c, F.col("sma_m")).alias("price_vs_ma"),
        ratio(F.col("atr_20d"), c).alias("atr_pct"),
        ratio(c - F.col("sma_m"), F.col("atr_20d")).alias("extension_atr"),
        (F.col("return_5d") - 0.25 * F.col("return_20d")).alias("acceleration"),
        basis.alias("amount_basis"),
        F.sort_array(F.concat(_or_empty(lagged(F.col("_amounts"), 10)), "_amounts")).alias("_sorted"),
    ).drop("true_range", "up_volume", "is_up", "_amounts")
    ranked = own_percentile(third, "price_vs_ma", 120, "own_extension_pct")
    n = F.size("_sorted")
    middle = [F.try_element_at("_sorted", F.floor((n + k) / 2).cast("int")) for k in (1, 2)]
    return ranked.withColumn("median_amount", F.when(n > 0, 0.5 * middle[0] + 0.5 * middle[1])).drop("_sorted")


def _or_empty(listed: Column) -> Column:
    """A list of doubles, empty where it is null; neither holds nulls, so that sorting needs no objects."""
    return F.coalesce(listed, F.array().cast(ArrayType(DoubleType(), False)))


def own_percentile(rows: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """Average rank of the last non-null value among the non-null ones of the last n rows of each symbol; null where there
    are none, NaN counts as null. Rows are already dealt by symbol for the windows before, so no shuffle is added. Values are
    collected over a part of the rows, and the lists of n rows are put together from those of earlier rows."""
    # a longer frame costs less than another column of lists
    few = max(d for d in range(1, max(n // 3, 1) + 1) if n % d == 0)
    value = F.when(~F.isnan(x), F.col(x).cast("double"))
    parts = rows.withColumn("_part", F.collect_list(value).over(last_rows(few)))
    before = [_or_empty(lagged(F.col("_part"), k)) for k in range(n - few, 0, -few)]
    listed = parts.withColumn("_seen", F.concat(*before, "_part"))
    mine = F.try_element_at("_seen", F.lit(-1))
    counted = listed.withColumn("_mine", mine)
    below, same = F.array_position(F.sort_array("_seen"), F.col("_mine")) - 1, F.size("_seen") - F.size(F.array_remove("_seen", F.col("_mine")))
    return counted.withColumn(out, F.when(F.col("_mine").isNotNull(), (below + (same + 1) / 2) / F.size("_seen"))).drop("_part", "_seen", "_mine")


def benchmark_returns(days: DataFrame, index: DataFrame, profile: Profile = TRADE) -> DataFrame:
    """trade_date, aligned, bench_<n>: returns over the index's own rows, as of each session."""
    order = Window.orderBy("trade_date")
    windows = sorted({5, 20, 60, profile.momentum, profile.trend})
    own = index.select("trade_date", *[change(F.col("close"), F.lag("close", n).over(order)).alias(f"b{n}") for n in windows], F.lit(True).alias("has_row"))
    packed = own.select("trade_date", F.struct(*[f"b{n}" for n in windows]).alias("pack"), "has_row")
    asof = days.select("trade_date").join(packed, "trade_date", "left")
    carried = asof.withColumn("pack", F.last("pack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return carried.select("trade_date", F.coalesce("has_row", F.lit(False)).alias("aligned"), *[F.col("pack")[f"b{n}"].alias(f"bench_{n}") for n in windows])


def has_limit(kinds: Column, direction: str) -> Column:
    """Whether a comma list of limit types names a move in the direction."""
    tokens = F.transform(F.split(F.coalesce(kinds, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    # fixed values: accepted tokens and the sign that marks them in provider text
    names, sign = (["U", "UP", "LIMIT_UP"], "涨") if direction == "up" else (["D", "DOWN", "LIMIT_DOWN"], "跌")
    return F.when(kinds.isNull(), False).otherwise(F.exists(tokens, lambda x: x.isin(*names) | x.contains(sign)))


def exclusion_rules(profile: Profile = TRADE) -> list[tuple[Column, str]]:
    """When a row is excluded, and the reason."""
    name, d = F.coalesce("name", F.lit("")), F.col("trade_date")
    age = F.datediff(d, F.col("list_date"))
    return [
        (F.upper(name).contains("ST") | name.contains("退"), "special_treatment_or_delisting"),
        (F.col("list_date").isNull(), "missing_list_date"),
        (age < profile.min_list_days, "insufficient_listing_age"),
        (d >= F.col("delist_date"), "delisted_before_effective_date"),
        (F.coalesce("volume", F.lit(0.0)) <= 0, "not_tradable_on_effective_date"),
        (has_limit(F.col("limit_types"), "up"), "entry_blocked_by_limit_up"),
        (F.col("observations") < profile.trend + 1, "insufficient_price_history"),
        (F.col("median_amount").isNull(), "missing_liquidity"),
        (F.col("median_amount") < profile.min_amount, "insufficient_liquidity"),
        (F.col("primary_return").isNull(), "missing_primary_return"),
    ]


def is_eligible(profile: Profile = TRADE) -> Column:
    """Whether a measured row has a bar and no rule excludes it; a rule that is null does not."""
    none = [~F.coalesce(rule, F.lit(False)) for rule, _ in exclusion_rules(profile)]
    return reduce(Column.__and__, none, F.col("close_raw").isNotNull())


def exclusions(rows: DataFrame, profile: Profile = TRADE) -> DataFrame:
    """Rows with a bar, `exclusion_reasons` in rule order, and `eligible`."""
    kept = rows.filter("close_raw is not null").withColumn("exclusion_reasons", reasons(*exclusion_rules(profile)))
    return kept.withColumn("eligible", is_eligible(profile))


def exclusion_counts(rows: DataFrame) -> DataFrame:
    return rows.select("trade_date", F.explode("exclusion_reasons").alias("reason")).groupBy("trade_date", "reason").agg(F.count("*").alias("n"))


def exact_round(x: Column) -> Column:
    return F.round(x.cast("decimal(18,8)"), 2).cast("double")


def scores(rows: DataFrame, bench: DataFrame, profile: Profile = TRADE) -> DataFrame:
    """Percentiles among eligible rows of each date, states, chase-risk and buyability scores."""
    e = rows.filter("eligible").join(bench, "trade_date", "left")
    b = F.col(f"bench_{profile.momentum}")
    e = e.withColumn("strength", F.when(F.col("aligned") & b.isNotNull(), F.col("primary_return") - b).otherwise(F.col("primary_return"))).withColumn("bench_primary", b)
    day = ["trade_date"]
    ranked = {"momentum_pct": "strength", "liquidity_pct": "median_amount", "participation_pct": "volume_ratio", "volatility_pct": "volatility", "extension_pct": "price_vs_ma", "acceleration_pct": "acceleration"}
    # rows are dealt by date once: sorting them whole costs less than reading, dealing and sorting them again for a join
    for out, x in ranked.items():
        e = e.withColumn(out, rank_pct(x, day))
    c, s, t = F.col("close_qfq"), F.col("sma_m"), F.col("sma_t")
    vr, us = F.coalesce("volume_ratio", F.lit(0.0)), F.coalesce("up_volume_share", F.lit(0.0))
    tail = F.greatest(F.coalesce("extension_pct", F.lit(0.0)), F.coalesce("own_extension_pct", F.lit(0.0)))
    e = e.withColumn("trend_state", F.when((c > s) & (s > t), "supportive").when((c < s) & (s < t), "adverse").otherwise("mixed"))
    e = e.withColumn("participation_state", F.when((vr >= 1.0) & (us >= 0.5), "supportive").when((vr < 0.8) & (us < 0.5), "adverse").otherwise("mixed"))
    e = e.withColumn("extension_state", F.when((tail >= 0.9) & (F.coalesce("price_vs_ma", F.lit(0.0)) > 0), "stretched").otherwise("not_stretched"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    chase = (
        25 * clip((tail - 0.8) / 0.2)
        + 25 * clip((F.greatest(F.lit(0.0), zero("extension_atr")) - 1.5) / 1.5)
        + 15 * F.when(zero("acceleration") > 0, clip((zero("acceleration_pct") - 0.8) / 0.2)).otherwise(0.0)
        + 15 * clip((zero("volume_ratio") - 1.5) / 1.5)
        + 10 * clip(F.greatest(F.lit(0.0), zero("open_gap")) / 0.08)
        + 10 * clip((F.coalesce(F.col("positive_3d").cast("double"), F.lit(0.0)) - 1) / 2)
    )
    e = e.withColumn("chase_risk", exact_round(chase))
    buy = (
        30 * clip(F.col("momentum_pct"))
        + F.when(F.col("trend_state") == "supportive", 20.0).otherwise(10.0)
        + F.when(F.col("participation_state") == "supportive", 15.0).when(F.col("participation_state") == "mixed", 8.0).otherwise(0.0)
        + 20 * (1 - clip(F.col("chase_risk") / 100))
        + 15 * clip(F.col("liquidity_pct"))
    )
    return e.withColumn("buyability", exact_round(buy))


def event_summary(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Known events of each row's symbol and the earliest one on or after its date."""
    e = events.groupBy("symbol").agg(F.count("event_date").alias("known_events"), F.sort_array(F.collect_set("event_date")).alias("_days"))
    joined = scored.join(e, "symbol", "left")
    return joined.withColumn("known_events", F.coalesce("known_events", F.lit(0))).withColumn("next_event", F.array_min(F.filter("_days", lambda x: x >= F.col("trade_date")))).drop("_days")


def candidates(scored: DataFrame, profile: Profile = TRADE) -> DataFrame:
    """The best rows of each date by four keys, ties by symbol, with their place."""
    pool = scored.filter((F.col("momentum_pct") >= profile.min_percentile) & F.col("trend_state").isin("supportive", "mixed"))
    order = Window.partitionBy("trade_date").orderBy(*[F.col(x).desc_nulls_last() for x in ("buyability", "momentum_pct", "participation_pct", "liquidity_pct")], "symbol")
    return pool.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= profile.limit)


def regime(scored: DataFrame) -> DataFrame:
    """Advancer share and state of the market, per date."""
    day = scored.groupBy("trade_date").agg(F.avg(F.when(F.col("return_1d") > 0, 1.0).otherwise(0.0)).alias("advancer_share"), F.percentile("return_1d", F.lit(0.5)).alias("median_return"), F.first("bench_primary").alias("bench_primary"))
    b, a = F.col("bench_primary"), F.col("advancer_share")
    state = F.when((a >= 0.55) & (b.isNull() | (b > 0)), "supportive").when((a <= 0.35) & (b.isNull() | (b < 0)), "hostile").otherwise("mixed")
    return day.withColumn("market_state", state)


def industry(scored: DataFrame, memberships: DataFrame) -> DataFrame:
    """Per date: where industries come from, variance share between them, concentration of the top decile,
    alignment of the leaders, and the signal of four checks. `memberships` has symbol, sector_code, sector_type."""
    typed = memberships.filter("symbol is not null and sector_code is not null")
    is_industry = F.lower(F.coalesce("sector_type", F.lit(""))).rlike("industry|^i$")
    any_typed = typed.agg(F.coalesce(F.max(is_industry), F.lit(False)).alias("any"))
    typed = typed.crossJoin(F.broadcast(any_typed)).filter(~F.col("any") | is_industry)
    mapping = typed.groupBy("symbol").agg(F.min("sector_code").cast("string").alias("member_code"), F.countDistinct("sector_code").alias("codes"))
    ambiguous = mapping.agg(F.count(F.when(F.col("codes") > 1, 1)).alias("ambiguous"))
    rows = scored.select("trade_date", "symbol", "industry", "return_1d", "primary_return").join(mapping.drop("codes"), "symbol", "left").crossJoin(F.broadcast(ambiguous))
    own = F.trim(F.coalesce("industry", F.lit("")))
    rows = rows.withColumn("own_code", F.when(own != "", own))
    day = Window.partitionBy("trade_date")
    n = F.count("*").over(day)
    rows = rows.withColumn("n", n).withColumn("member_cov", F.count("member_code").over(day) / n).withColumn("own_cov", F.count("own_code").over(day) / n)
    fall = (F.col("member_cov") < 0.5) | (F.col("ambiguous") / F.col("n") > 0.1)
    source = F.when(~fall, "provider_membership").when(F.col("own_cov") >= 0.5, "stock_basic_current_snapshot").otherwise("insufficient_coverage")
    rows = rows.withColumn("source", source).withColumn("code", F.when(source == "provider_membership", F.col("member_code")).when(source == "stock_basic_current_snapshot", F.col("own_code")))
    used = rows.filter("code is not null and primary_return is not null")
    p = F.col("primary_return")
    used = used.withColumn("grand", F.avg("primary_return").over(day)).withColumn("used", F.count("*").over(day))
    used = used.withColumn("sector_median", F.percentile("primary_return", F.lit(0.5)).over(Window.partitionBy("trade_date", "code")))
    sign = F.signum("sector_median")
    by_sector = used.groupBy("trade_date", "code").agg(F.count("*").alias("members"), F.avg("primary_return").alias("mean"), F.first("grand").alias("grand"), F.first("sector_median").alias("median"), F.avg(F.when(p * sign > 0, 1.0).otherwise(0.0)).alias("same_sign"))
    large = by_sector.filter("members >= 3").withColumn("same_sign", F.when(F.col("median") != 0, F.col("same_sign")))
    lead = Window.partitionBy("trade_date").orderBy(F.col("median").desc(), "code")
    large = large.withColumn("k", F.row_number().over(lead))
    sectors = large.groupBy("trade_date").agg(F.sum(F.col("members") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"), F.avg(F.when(F.col("k") <= 3, F.col("same_sign"))).alias("alignment"), F.count("*").alias("sectors"))
    best = Window.partitionBy("trade_date").orderBy(p.desc(), "symbol")
    top = used.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("used") * 0.1)))
    top = top.groupBy("trade_date", "code").count().groupBy("trade_date").agg((F.max("count") / F.sum("count")).alias("top_share"))
    totals = used.groupBy("trade_date").agg(F.sum(F.pow(p - F.col("grand"), 2)).alias("total"), F.first("used").alias("used"))
    head = rows.groupBy("trade_date").agg(F.first("n").alias("n"), F.first("source").alias("source"))
    out = head.join(totals, "trade_date", "left").join(sectors, "trade_date", "left").join(top, "trade_date", "left")
    cov, share = F.coalesce("used", F.lit(0)) / F.col("n"), F.coalesce(ratio(F.coalesce("between", F.lit(0.0)), F.col("total")), F.lit(0.0))
    passed = sum(F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0) for x in (cov >= 0.5, share >= 0.15, F.col("top_share") >= 0.3, F.col("alignment") >= 0.6))
    missing = (F.col("source") == "insufficient_coverage") | F.col("used").isNull()
    signal = F.when(missing, "unknown").when(passed >= 3, "significant").when(passed == 2, "mixed").otherwise("not_significant")
    return out.select("trade_date", "source", cov.alias("coverage"), share.alias("variance_share"), "top_share", "alignment", F.coalesce("sectors", F.lit(0)).alias("sectors"), signal.alias("signal"))


def style(scored: DataFrame) -> DataFrame:
    """Per date with at least 30 sized rows: size terciles, variance share between them, spread of medians."""
    rows = scored.filter("circ_mv is not null and primary_return is not null").select("trade_date", "symbol", "circ_mv", "primary_return")
    day = Window.partitionBy("trade_date")
    rows = rows.withColumn("n", F.count("*").over(day)).withColumn("r", F.row_number().over(day.orderBy("circ_mv", "symbol"))).withColumn("grand", F.avg("primary_return").over(day))
    bucket = F.when(3 * (F.col("r") - 1) < F.col("n") - 1, "small").when(3 * (F.col("r") - 1) < 2 * (F.col("n") - 1), "mid").otherwise("large")
    rows = rows.filter("n >= 30").withColumn("bucket", bucket)
    by = rows.groupBy("trade_date", "bucket").agg(F.count("*").alias("k"), F.avg("primary_return").alias("mean"), F.percentile("primary_return", F.lit(0.5)).alias("median"), F.first("grand").alias("grand"))
    total = rows.groupBy("trade_date").agg(F.sum(F.pow(F.col("primary_return") - F.col("grand"), 2)).alias("total"), F.countDistinct("circ_mv").alias("sizes"))
    out = by.groupBy("trade_date").agg(F.sum(F.col("k") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"), (F.max("median") - F.min("median")).alias("spread")).join(total, "trade_date").filter("sizes >= 3")
    share = F.coalesce(ratio(F.col("between"), F.col("total")), F.lit(0.0))
    return out.select("trade_date", share.alias("variance_share"), "spread", F.when(share >= 0.12, "significant").otherwise("not_significant").alias("signal"))


def driver(regimes: DataFrame, industries: DataFrame, styles: DataFrame) -> DataFrame:
    """The dominant driver of each date by fixed precedence."""
    j = regimes.join(industries.select("trade_date", F.col("signal").alias("industry_signal")), "trade_date", "left").join(styles.select("trade_date", F.col("signal").alias("style_signal")), "trade_date", "left")
    out = (
        F.when(F.col("industry_signal") == "significant", "industry_theme")
        .when(F.col("style_signal") == "significant", "style_factor")
        .when(F.col("market_state").isin("supportive", "hostile"), "market_beta")
        .when(F.col("industry_signal") == "not_significant", "idiosyncratic_or_mixed")
        .otherwise("mixed_or_unknown")
    )
    return j.withColumn("driver", out)


def quality(grid: DataFrame, bench: DataFrame, profile: Profile = TRADE, lifecycle: bool = False) -> DataFrame:
    """Per date: coverage of the cross-section and of 20 sessions, blockers, status. The request is for the date itself."""
    c, w = F.col("close_qfq"), last_rows(20)
    counts = {"observations": F.count(c).over(up_to_here()), "priced_20d": F.count(c).over(w), "stored_20d": F.count("amount").over(w)}
    # a measured grid has them
    cells = grid.withColumns({k: x for k, x in counts.items() if k not in grid.columns})
    have = F.col("close_raw").isNotNull()
    share = lambda x: F.avg(F.when(have, F.when(x, 1.0).otherwise(0.0)))
    day = cells.groupBy("trade_date").agg(
        F.count(F.when(have, 1)).alias("rows"),
        F.floor(F.percentile(F.when(F.col("observations") > 0, F.col("observations")), F.lit(0.5))).alias("median_history"),
        share(F.col("open_qfq").isNotNull()).alias("adjusted_open"),
        ratio(F.sum("stored_20d").cast("double"), F.greatest(F.sum("priced_20d"), F.lit(1)).cast("double")).alias("stored_amount"),
        share(F.col("high_qfq").isNotNull() & F.col("low_qfq").isNotNull()).alias("high_low"),
        share(F.col("adj_factor").isNotNull()).alias("adjustment"),
        share(F.col("list_date").isNotNull()).alias("metadata"),
        share(F.col("list_status").isNotNull()).alias("lifecycle"),
    )
    j = day.join(bench, "trade_date", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    found = reasons(
        (F.col("median_history") < profile.trend, "insufficient_history_for_standard_screen"),
        (~(F.col("aligned") & F.col("bench_20").isNotNull()), "benchmark_missing_or_misaligned"),
        (zero("stored_amount") < 0.95, "stored_amount_incomplete_proxy_used"),
        (zero("adjusted_open") < 0.95, "adjusted_open_incomplete"),
        (zero("adjustment") < 0.95, "raw_adjustment_contract_incomplete"),
        (F.lit(lifecycle) & (zero("lifecycle") < 0.95), "historical_stock_lifecycle_incomplete"),
    )
    j = j.withColumn("blockers", found)
    only = F.array_join("blockers", ",") == "raw_adjustment_contract_incomplete"
    return j.withColumn("status", F.when(F.size("blockers") == 0, "ready").when(only, "usable_with_caveats").otherwise("blocked_for_execution")).select("trade_date", "rows", "median_history", "adjusted_open", "high_low", "stored_amount", "adjustment", "metadata", "lifecycle", "blockers", "status")


def business_day_lag(effective: Column, requested: Column) -> Column:
    """Weekdays after the effective day up to the requested one."""
    days = F.when(requested > effective, F.sequence(F.date_add(effective, 1), requested))
    return F.coalesce(F.size(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7))), F.lit(0))


#: Business days by which prices may lag behind a request.
MAX_LAG = 2


def summary(requests: DataFrame, qualities: DataFrame, exclusions: DataFrame, picks: DataFrame, industries: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each requested day (requested_as_of): the last session by then, how many business days it lags, data
    quality with the blocker of stale prices in its place, counts of the universe, the screen's status and what data
    lack. Days before the first session are left out."""
    sessions = qualities.select(F.col("trade_date").alias("requested_as_of"), F.lit(0).alias("_r"), "trade_date")
    asked = requests.select("requested_as_of", F.lit(1).alias("_r"), F.lit(None).cast("date").alias("trade_date"))
    so_far = Window.orderBy("requested_as_of", "_r").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    last = sessions.unionByName(asked).withColumn("trade_date", F.last("trade_date", ignorenulls=True).over(so_far)).filter("_r = 1 and trade_date is not null").drop("_r")
    universe = exclusions.groupBy("trade_date").agg(F.count("*").alias("observed"), F.count(F.when(F.col("eligible"), 1)).alias("eligible"))
    chosen = picks.groupBy("trade_date").agg(F.count("*").alias("selected"), F.max(F.col("candidate_state") == "evidence_ready").alias("any_ready"))
    j = last.join(qualities, "trade_date").join(universe, "trade_date", "left").join(chosen, "trade_date", "left").join(industries.select("trade_date", F.col("source").alias("industry_source")), "trade_date", "left").join(bench.select("trade_date", "aligned", F.col("bench_20")), "trade_date", "left")
    j = j.withColumn("lag", business_day_lag(F.col("trade_date"), F.col("requested_as_of")))
    short = "insufficient_history_for_standard_screen"
    stale = F.when(F.col("lag") > MAX_LAG, F.lit("stale_price_data"))
    blockers = F.array_compact(F.concat(F.filter("blockers", lambda b: b == short), F.array(stale), F.filter("blockers", lambda b: b != short)))
    j = j.withColumn("blockers", blockers)
    only = F.array_join("blockers", ",") == "raw_adjustment_contract_incomplete"
    quality_status = F.when(F.size("blockers") == 0, "ready").when(only, "usable_with_caveats").otherwise("blocked_for_execution")
    status = F.when(F.coalesce("selected", F.lit(0)) == 0, "no_edge_found").when(F.col("any_ready"), "research_candidates_available").otherwise("candidates_require_waiting_or_review")
    low = lambda c: F.coalesce(F.col(c), F.lit(0.0)) < 0.95
    gaps = reasons(
        (~(F.coalesce("aligned", F.lit(False)) & F.col("bench_20").isNotNull()), "benchmark_relative_return"),
        (F.coalesce("industry_source", F.lit("insufficient_coverage")) == "insufficient_coverage", "industry_membership"),
        (F.col("lag") > 0, "price_data_not_at_requested_as_of"),
        (low("stored_amount"), "turnover_amount_partly_proxied"),
        (low("adjusted_open"), "adjusted_open_history"),
        (low("high_low"), "intraday_high_low_history"),
        (low("adjustment"), "raw_price_and_adjustment_factor_history"),
    )
    gaps = F.concat(gaps, F.transform(F.filter("blockers", lambda b: b != "stale_price_data"), lambda b: F.concat(F.lit("quality:"), b)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("requested_as_of", F.col("trade_date").alias("effective_trade_date"), "lag", quality_status.alias("quality_status"), "blockers", zero("observed"), zero("eligible"), zero("selected"), status.alias("screen_status"), gaps.alias("data_gaps"))


def states(picked: DataFrame, qualities: DataFrame, regimes: DataFrame) -> DataFrame:
    """Technical pattern and state of each candidate."""
    j = picked.join(qualities.select("trade_date", F.col("status").alias("quality_status")), "trade_date", "left").join(regimes.select("trade_date", "market_state"), "trade_date", "left")
    up, far = F.col("trend_state") == "supportive", F.col("extension_state") == "stretched"
    pattern = F.when(up & far, "trend_pullback").when(up & (F.col("participation_state") == "supportive"), "momentum_breakout").when(up, "trend_pullback").otherwise("unconfirmed")
    state = (
        F.when(F.col("quality_status") == "blocked_for_execution", "data_quality_review")
        .when(far, "waiting_price")
        .when(F.col("participation_state") == "adverse", "waiting_confirmation")
        .when(F.coalesce("volatility_pct", F.lit(0.0)) >= 0.9, "high_risk_review")
        .when(F.col("market_state") == "hostile", "hostile_market_review")
        .otherwise("evidence_ready")
    )
    return j.withColumn("pattern", pattern).withColumn("candidate_state", state)
