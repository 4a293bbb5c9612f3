"""Event-study replay: signals, entries, triggers, stops, delayed exits, outcome distributions.

All signal dates run in one plan. Path questions are equi-joins on the symbol with a bounded session range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import change, ratio
from tidemark.functions.selection import longest_streak, quantiles
from tidemark.operators.gates import CONTRACTS
from tidemark.operators.screen import has_limit


def signal_days(days: DataFrame, start: str, end: str, every: int = 5, cap: int = 60, split: str | None = None) -> DataFrame:
    """trade_date, session_no, sample: every n-th session of the range, thinned to `cap` evenly spaced ones."""
    asked = days.filter(F.col("trade_date").between(start, end))
    order = Window.orderBy("trade_date")
    stepped = asked.withColumn("i", F.row_number().over(order) - 1).filter(F.col("i") % every == 0).withColumn("j", (F.col("i") / every).cast("int"))
    n = F.count("*").over(Window.partitionBy())
    spots = F.transform(F.sequence(F.lit(0), F.lit(max(cap - 1, 0))), lambda k: F.bround(k * (F.col("n") - 1) / max(cap - 1, 1)).cast("int"))
    kept = stepped.withColumn("n", n).filter((F.col("n") <= cap) | (F.col("j") == F.col("n") - 1 if cap == 1 else F.array_contains(spots, F.col("j"))))
    sample = F.lit("all") if split is None else F.when(F.col("trade_date") >= split, "out_of_sample").otherwise("development")
    return kept.select("trade_date", "session_no", sample.alias("sample"))


def entries(picked: DataFrame, grid: DataFrame) -> DataFrame:
    """Candidates with the bar of the next session and why it cannot be entered, if so."""
    nxt = grid.select("symbol", (F.col("session_no") - 1).alias("session_no"), *[F.col(c).alias(f"e_{c}") for c in ("trade_date", "open_qfq", "high_qfq", "low_qfq", "close_qfq", "volume", "limit_types")])
    j = picked.join(nxt, ["symbol", "session_no"])
    skip = F.when(F.coalesce("e_volume", F.lit(0.0)) <= 0, "untradable").when(has_limit(F.col("e_limit_types"), "up"), "limit_up")
    return j.withColumn("skip", skip)


def triggers(entered: DataFrame, strategy: str = "momentum_trade") -> DataFrame:
    """Level, status, price and basis of the frozen trigger of each enterable candidate."""
    c = CONTRACTS[strategy]
    setup = F.when(F.col("pattern").isin(*c.setups), F.col("pattern")).otherwise(c.default_setup)
    e = entered.filter("skip is null").withColumn("setup", setup)
    close, ma = F.col("close_qfq"), F.coalesce("sma_m", "sma_t")
    level = (
        F.when(F.col("setup") == "momentum_breakout", F.greatest(close * 1.002, F.coalesce("high_qfq", close)))
        .when(F.col("setup") == "event_continuation", close * 1.002)
        .otherwise(F.when(ma < close, ma).otherwise(close * 0.995))
    )
    e = e.withColumn("level", level)
    o, h, lo, x, lv = F.col("e_open_qfq"), F.col("e_high_qfq"), F.col("e_low_qfq"), F.col("e_close_qfq"), F.col("level")
    cross = F.coalesce(o >= lv, F.lit(False)) | F.coalesce(h >= lv, F.lit(False)) | (x >= lv)
    touch = F.coalesce(lo <= lv, F.lit(False)) & (x >= lv) & (F.col("trend_state") == "supportive")
    pull = F.col("setup") == "trend_pullback"
    hit = F.when(pull, touch).otherwise(cross)
    status = F.when(close.isNull() | x.isNull(), "unknown").when(hit, "triggered").otherwise("not_triggered")
    gap = F.coalesce(o >= lv, F.lit(False))
    price = F.when(status == "triggered", F.when(pull, lv).when(gap, o).otherwise(lv))
    basis = F.when(status == "triggered", F.when(pull, "low_touch_reclaim").when(gap, "open").otherwise("intraday_high"))
    return e.withColumn("status", status).withColumn("entry_price", price).withColumn("basis", basis)


def only_symbols(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of the symbols that `of` has."""
    return rows.join(of.select("symbol").distinct(), "symbol", "left_semi")


def own_lows(bars: DataFrame, n: int = 10) -> DataFrame:
    """Lowest low of the last n own rows at each bar."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-(n - 1), 0)
    return bars.select("symbol", "trade_date", F.min("low_qfq").over(w).alias("recent_low"))


def with_invalidation(triggered: DataFrame, lows: DataFrame) -> DataFrame:
    """Triggered rows with the price level that invalidates them."""
    t = triggered.filter("status = 'triggered' and entry_price > 0").join(lows, ["symbol", "trade_date"], "left")
    entry, low, ma = F.col("entry_price"), F.col("recent_low"), F.coalesce("sma_m", "sma_t")
    supports = F.greatest(F.when(low < entry, low), F.when(ma < entry, ma))
    level = F.when(F.col("setup") == "trend_pullback", low).otherwise(F.coalesce(supports, entry * 0.97))
    return t.withColumn("invalidation", F.when(level.isNull() | (level >= entry), entry * 0.97).otherwise(level))


def outcomes(armed: DataFrame, grid: DataFrame, index: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), cost_bps: float = 20.0, last_no: DataFrame | None = None) -> DataFrame:
    """One row per signal and horizon; rows whose exit lies beyond the data have a null exit_date. `grid` may be cut to the
    symbols that were armed; `last_no` is then the last session of all."""
    last = grid.agg(F.max("session_no").alias("last_no")) if last_no is None else last_no
    each = armed.select("symbol", "trade_date", "session_no", "sample", "grade", "place", "setup", "basis", "entry_price", "invalidation", F.col("e_trade_date").alias("entry_date"))
    each = each.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("entry_no", F.col("session_no") + 1)
    each = each.withColumn("target_no", F.col("entry_no") + F.col("horizon")).crossJoin(F.broadcast(last))
    key = ["symbol", "trade_date", "horizon"]
    open_ = each.filter("target_no <= last_no")
    # stops: the first of the sessions up to the longest horizon whose low reaches the level
    low = grid.filter("low_qfq is not null").select("symbol", F.col("session_no").alias("no"), "low_qfq")
    ahead = armed.select("symbol", "trade_date", "invalidation", F.explode(F.sequence(F.col("session_no") + 2, F.col("session_no") + 1 + max(horizons))).alias("no"))
    hit = ahead.join(low, ["symbol", "no"]).filter("low_qfq <= invalidation").groupBy("symbol", "trade_date").agg(F.min("no").alias("first_no"))
    stops = open_.join(hit, ["symbol", "trade_date"]).filter("first_no <= target_no").select(*key, F.col("first_no").alias("stop_no"))
    open_ = open_.join(stops, key, "left").withColumn("desired_no", F.coalesce("stop_no", "target_no"))
    # the first session from each one on at which the symbol can be sold
    sellable = F.col("close_qfq").isNotNull() & (F.coalesce("volume", F.lit(0.0)) > 0) & ~has_limit(F.col("limit_types"), "down")
    back = Window.partitionBy("symbol").orderBy(F.col("session_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    exits = grid.select("symbol", F.col("session_no").alias("desired_no"), F.min(F.when(sellable, F.col("session_no"))).over(back).alias("exit_no"), has_limit(F.col("limit_types"), "down").alias("down_day"))
    open_ = open_.join(exits, ["symbol", "desired_no"], "left")
    bar = grid.select("symbol", F.col("session_no").alias("exit_no"), F.col("trade_date").alias("exit_date"), F.col("open_qfq").alias("x_open"), F.col("close_qfq").alias("x_close"))
    open_ = open_.join(bar, ["symbol", "exit_no"], "left")
    stopped = F.col("stop_no").isNotNull() & (F.col("exit_no") == F.col("desired_no"))
    price = F.when(stopped, F.least(F.coalesce("x_open", "invalidation"), F.col("invalidation"))).otherwise(F.col("x_close"))
    open_ = open_.withColumn("exit_price", price).withColumn("delay", F.col("exit_no") - F.col("desired_no")).withColumn("exit_reason", F.when(F.col("stop_no").isNotNull(), "price_invalidation").otherwise("time_horizon"))
    seen = grid.filter("close_raw is not null").select("symbol", F.col("session_no").alias("no"), "low_qfq", "high_qfq")
    walked = open_.filter("exit_no is not null").select(*key, F.explode(F.sequence("entry_no", "exit_no")).alias("no"))
    path = walked.join(seen, ["symbol", "no"]).groupBy(*key).agg(F.min("low_qfq").alias("path_low"), F.max("high_qfq").alias("path_high"))
    open_ = open_.join(path, key, "left")
    enter = index.select(F.col("trade_date").alias("entry_date"), F.coalesce("open", "close").alias("b_in"))
    leave = index.select(F.col("trade_date").alias("exit_date"), F.col("close").alias("b_out"))
    open_ = open_.join(enter, "entry_date", "left").join(leave, "exit_date", "left")
    p = F.col("entry_price")
    net, bench = change(F.col("exit_price"), p) - cost_bps / 10_000, change(F.col("b_out"), F.col("b_in"))
    done = open_.select(*key, "session_no", "sample", "grade", "place", "setup", "basis", "entry_date", "exit_date", "exit_reason", "delay", (F.coalesce(F.col("delay") > 0, F.lit(False)) & F.coalesce("down_day", F.lit(False))).alias("limit_down_delay"), "entry_price", "invalidation", "exit_price", net.alias("net_return"), bench.alias("benchmark_return"), (net - bench).alias("excess_return"), change(F.col("path_low"), p).alias("mae"), change(F.col("path_high"), p).alias("mfe"))
    late = each.filter("target_no > last_no").select(*key, "session_no", "sample", "grade", "place", "setup", "basis", "entry_date", "entry_price", "invalidation")
    return done.unionByName(late, allowMissingColumns=True)


def _distribution(x: Column) -> list[Column]:
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    aw, al = F.avg(win), F.avg(loss)
    gp, gl = F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))
    half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
    return [
        aw.alias("average_win"),
        al.alias("average_loss"),
        ratio(aw, F.abs(al)).alias("payoff_ratio"),
        F.when(gl > 0, gp / gl).alias("profit_factor"),
        F.when(F.count(x) > 1, F.avg(x) - half).alias("ci_low"),
        F.when(F.count(x) > 1, F.avg(x) + half).alias("ci_high"),
    ]


def summarize(rows: DataFrame, by: list[str], x: str = "net_return", order: tuple[str, ...] = ("trade_date", "place", "horizon")) -> DataFrame:
    """Mean, median, hit rate, worst and distribution of closed outcomes per group; loss streaks follow `order`. Rows should
    be a written table: they are read several times. However few the groups are, none meets in one task."""
    v = F.col(x)
    closed = rows.filter(v.isNotNull())
    sums = closed.groupBy(*by).agg(F.count("*").alias("observations"), F.avg(v).alias("mean"), F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("excess_return").alias("mean_excess"), F.min(v).alias("worst"), *_distribution(v))
    spread = quantiles(closed, by, x, {"median": 0.5, "p05": 0.05, "p95": 0.95})
    streaks = longest_streak(closed, by, v < 0, list(order), order[0], "max_loss_streak")
    return sums.join(spread, by).join(streaks, by)


def baskets(rows: DataFrame) -> DataFrame:
    """Equal-weight basket of each signal date and horizon."""
    closed = rows.filter("net_return is not null")
    return closed.groupBy("sample", "trade_date", "horizon").agg(F.avg("net_return").alias("net_return"), F.avg("excess_return").alias("excess_return"), F.countDistinct("symbol").alias("positions"))


def accounting(entered: DataFrame, triggered: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts: selected, skipped, triggered, unresolved, delayed."""
    a = entered.agg(F.count("*").alias("selected"), F.count(F.when(F.col("skip") == "untradable", 1)).alias("skip_untradable"), F.count(F.when(F.col("skip") == "limit_up", 1)).alias("skip_limit_up"))
    b = triggered.agg(F.count(F.when(F.col("status") == "triggered", 1)).alias("triggered"), F.count(F.when(F.col("status") != "triggered", 1)).alias("not_triggered"))
    c = results.agg(F.count(F.when(F.col("exit_date").isNull(), 1)).alias("unresolved"), F.count(F.when(F.col("delay") > 0, 1)).alias("delayed"), F.count(F.when(F.col("limit_down_delay"), 1)).alias("delayed_by_limit_down"), F.coalesce(F.max("delay"), F.lit(0)).alias("max_delay"))
    return a.crossJoin(b).crossJoin(c)


def accounting_by_grade(entered: DataFrame, triggered: DataFrame) -> DataFrame:
    """Per grade: selected, skipped, triggered and not triggered."""
    a = entered.groupBy("grade").agg(F.count("*").alias("selected"), F.count("skip").alias("skipped"))
    b = triggered.groupBy("grade").agg(F.count(F.when(F.col("status") == "triggered", 1)).alias("triggered"), F.count(F.when(F.col("status") != "triggered", 1)).alias("not_triggered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "grade", "left").select("grade", "selected", "skipped", zero("triggered"), zero("not_triggered"))


def signal_coverage(signals: DataFrame, qualities: DataFrame, results: DataFrame) -> DataFrame:
    """Per sample: signal dates, those blocked by data quality, and the share of closed outcomes with a path low and high."""
    a = signals.join(qualities.select("trade_date", "status"), "trade_date", "left").groupBy("sample").agg(F.count("*").alias("signal_dates"), F.count(F.when(F.col("status") == "blocked_for_execution", 1)).alias("blocked_dates"))
    have = lambda c: F.avg(F.when(F.col("net_return").isNotNull(), F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)))
    b = results.groupBy("sample").agg(F.count("net_return").alias("closed"), have("mae").alias("mae_coverage"), have("mfe").alias("mfe_coverage"))
    return a.join(b, "sample", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))


def inference(results: DataFrame, signals: DataFrame, qualities: DataFrame) -> DataFrame:
    """Per required sample: signal baskets, warnings and the inference status of the whole run."""
    counts = results.filter("net_return is not null").groupBy("sample").agg(F.countDistinct("trade_date").alias("n"))
    need = signals.select("sample").distinct().join(counts, "sample", "left").select("sample", F.coalesce("n", F.lit(0)).alias("signal_baskets"))
    blocked = signals.join(qualities.select("trade_date", "status"), "trade_date", "left").agg(F.count(F.when(F.col("status") == "blocked_for_execution", 1)).alias("blocked"))
    open_ = results.agg(F.count(F.when(F.col("exit_date").isNull(), 1)).alias("unresolved"))
    j = need.crossJoin(F.broadcast(blocked)).crossJoin(F.broadcast(open_))
    whole = Window.partitionBy()
    none, few = F.min("signal_baskets").over(whole) == 0, F.min("signal_baskets").over(whole) < 20
    status = F.when(F.col("blocked") > 0, "blocked_by_data_quality").when(none, "insufficient_sample").when(few | (F.col("unresolved") > 0), "exploratory").otherwise("reviewable_not_validated")
    warning = F.when(F.col("signal_baskets") == 0, "sample_missing").when(F.col("signal_baskets") < 20, "sample_below_20_signal_dates")
    return j.select("sample", "signal_baskets", "blocked", "unresolved", warning.alias("warning"), status.alias("inference_status"))


#: Days of a block of bars whose first, last, lowest and highest are kept; a review reads blocks where it spans them whole.
BLOCK_DAYS = 32


def _summed(b: DataFrame, *keys: str) -> DataFrame:
    return b.groupBy(*keys).agg(F.min_by("f", "f.d").alias("f"), F.max_by("l", "l.d").alias("l"), F.min("low").alias("low"), F.max("high").alias("high"))


def review(recommendations: DataFrame, bars: DataFrame, index: DataFrame) -> DataFrame:
    """Path of each recommendation (rec_id, symbol, recommended_on, review_as_of): returns, excess, MAE, MFE.

    A long review does not read its symbol's every bar. Bars are summed up in blocks of `BLOCK_DAYS` days, and those in
    super-blocks of as many blocks. A review is split into the whole super-blocks, whole blocks and single days that it
    spans, some 130 pieces at most besides its super-blocks, and each piece is an equi-join on symbol and place."""
    day = F.datediff("trade_date", F.lit("1970-01-01"))
    at = lambda c: F.struct(F.col("trade_date").alias("d"), F.col(c).alias("x"))
    single = bars.select("symbol", day.alias("place"), at("close_qfq").alias("f"), at("close_qfq").alias("l"), F.col("low_qfq").alias("low"), F.col("high_qfq").alias("high"))
    levels = [_summed(single, "symbol", "place")]
    for _ in range(2):
        levels.append(_summed(levels[-1].withColumn("place", F.floor(F.col("place") / BLOCK_DAYS)), "symbol", "place"))
    sums = reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(k)).withColumn("place", F.col("place").cast("bigint")) for k, t in enumerate(levels)])
    number = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("bigint")
    spans = recommendations.filter("recommended_on <= review_as_of").select("rec_id", "symbol", number("recommended_on").alias("a"), (number("review_as_of") + 1).alias("b"))
    pieces = spans.select("rec_id", "symbol", F.explode(_pieces(F.col("a"), F.col("b"))).alias("p")).select("rec_id", "symbol", "p.level", "p.place")
    # pieces are many times what Spark expects of the rows they come from, so never broadcast
    path = _summed(pieces.hint("shuffle_merge").join(sums, ["symbol", "level", "place"]), "rec_id").select("rec_id", F.col("f.x").alias("first"), F.col("l.x").alias("final"), "low", "high")
    # for every calendar day the next and the last index row; then two equi-joins
    span = recommendations.agg(F.min("recommended_on").alias("a"), F.max("review_as_of").alias("b"))
    days = span.filter("a <= b").select(F.explode(F.sequence("a", "b")).alias("d")).join(index.select(F.col("trade_date").alias("d"), F.struct(F.col("trade_date").alias("on"), "close").alias("i")), "d", "left")
    up, down = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select("d", F.last("i", ignorenulls=True).over(down).alias("next"), F.last("i", ignorenulls=True).over(up).alias("before"))
    spans = recommendations.select("rec_id", "recommended_on", "review_as_of").join(F.broadcast(days.select(F.col("d").alias("recommended_on"), "next")), "recommended_on").join(F.broadcast(days.select(F.col("d").alias("review_as_of"), "before")), "review_as_of")  # a row a day
    market = spans.filter("next.on <= review_as_of").select("rec_id", F.col("next.close").alias("b_in"), F.col("before.close").alias("b_out"))
    j = recommendations.join(path, "rec_id", "left").join(market, "rec_id", "left")
    fwd, bench = change(F.col("final"), F.col("first")), change(F.col("b_out"), F.col("b_in"))
    return j.select("rec_id", "symbol", fwd.alias("forward_return"), bench.alias("benchmark_return"), (fwd - bench).alias("excess_return"), change(F.col("low"), F.col("first")).alias("mae"), change(F.col("high"), F.col("first")).alias("mfe"), F.when(fwd.isNotNull(), "completed").otherwise("insufficient_evidence").alias("review_status"))


def _pieces(a: Column, b: Column) -> Column:
    """Array of (level, place): days, blocks and super-blocks that make up the days from a to before b."""
    none = F.array().cast("array<struct<level:int,place:bigint>>")
    list_ = lambda lo, hi, level: F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda p: F.struct(F.lit(level).alias("level"), p.alias("place")))).otherwise(none)
    up = lambda c, n: F.ceil(c / n)
    down = lambda c, n: F.floor(c / n)
    n = BLOCK_DAYS
    # whole blocks from la to before lb, whole super-blocks of those from sa to before sb
    la, lb = up(a, n), down(b, n)
    sa, sb = up(la, n), down(lb, n)
    days = F.when(la < lb, F.concat(list_(a, la * n, 0), list_(lb * n, b, 0))).otherwise(list_(a, b, 0))
    blocks = F.when(la < lb, F.when(sa < sb, F.concat(list_(la, sa * n, 1), list_(sb * n, lb, 1), list_(sa, sb, 2))).otherwise(list_(la, lb, 1))).otherwise(none)
    return F.concat(days, blocks)
