"""Fixtures of known outcome for panels, indicators, screen, replay, ledger and positions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus, gates, indicators, ingest, panel, portfolio, replay, screen, sector
from tidemark.sources import asof


def days(n, start="2025-01-02"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trade_date date, open_raw double, high_raw double, low_raw double, close_raw double, adj_factor double, volume double, amount double")


@pytest.fixture(scope="module")
def seeded(spark):
    """Ten symbols over 240 sessions: one special-treatment name, one illiquid, one newly listed, one at its limit."""
    growth = [0.0040, 0.0032, 0.0025, 0.0006, 0.0002, -0.0001, 0.0050, 0.0060, 0.0045, 0.0042]
    d = days(240)
    rows = []
    for k, g in enumerate(growth, 1):
        for i, day in enumerate(d):
            p = 10 * (1 + g) ** i
            rows.append((f"{k:06d}.SZ", day, 0.999 * p, 1.01 * p, 0.99 * p, p, 1.0, 1e6, 1e4 if k == 8 else 1e5))
    b = panel.restate_qfq(bars_frame(spark, rows).withColumn("close_qfq", F.col("close_raw")))
    meta = spark.createDataFrame([(f"{k:06d}.SZ", "ST X" if k == 7 else f"N{k}", "A" if k <= 5 else "B", "main", dt.date(2026, 1, 1) if k == 9 else dt.date(2020, 1, 1), None, "L") for k in range(1, 11)], "symbol string, name string, industry string, market string, list_date date, delist_date date, list_status string")
    val = spark.createDataFrame([(f"{k:06d}.SZ", d[-1], 1e5 + 1e4 * k, 1.0) for k in range(1, 11)], "symbol string, trade_date date, circ_mv double, turnover_rate double")
    limits = spark.createDataFrame([("000010.SZ", d[-1], "U")], "symbol string, trade_date date, limit_type string")
    index = spark.createDataFrame([(day, 4000 * 1.0005**i, 4002 * 1.0005**i) for i, day in enumerate(d)], "trade_date date, open double, close double")
    grid = panel.amount_cny(panel.screening_panel(panel.session_grid(b), val, meta, limits)).persist()
    return d, b, index, grid


def graded(seeded, limit=5, until=None):
    d, b, index, grid = seeded
    profile = screen.Profile(limit=limit)
    bench = screen.benchmark_returns(panel.sessions(b), index, profile)
    cut = grid if until is None else grid.filter(F.col("trade_date") <= until)
    rows = screen.exclusions(screen.metrics(cut, profile), profile)
    scored = screen.scores(rows, bench, profile)
    states = screen.states(screen.candidates(scored, profile), screen.quality(cut, bench, profile), screen.regime(scored))
    return rows, scored, gates.grades(gates.screening(states))


def test_seeded_screen(seeded):
    last = seeded[0][-1]
    rows, _, grade = graded(seeded)
    counts = {r.reason: r.n for r in screen.exclusion_counts(rows.filter(F.col("trade_date") == last)).collect()}
    assert counts == {"special_treatment_or_delisting": 1, "insufficient_liquidity": 1, "insufficient_listing_age": 1, "entry_blocked_by_limit_up": 1}
    found = grade.filter(F.col("trade_date") == last).orderBy("place").collect()
    assert found[0].symbol == "000002.SZ" and found[0].pattern == "momentum_breakout"
    assert sorted(r.grade for r in found) == ["A", "B"] and all(r.quality_status == "ready" for r in found)


def test_screen_does_not_look_ahead(seeded):
    """Deleting the future changes nothing on an earlier date."""
    day = seeded[0][180]
    cols = ["symbol", "place", "buyability", "chase_risk", "grade"]
    full = graded(seeded)[2].filter(F.col("trade_date") == day).select(cols).toPandas().sort_values("place", ignore_index=True)
    cut = graded(seeded, until=day)[2].filter(F.col("trade_date") == day).select(cols).toPandas().sort_values("place", ignore_index=True)
    assert len(full) and full.equals(cut)


def test_seeded_replay(seeded):
    d, b, index, grid = seeded
    signals = replay.signal_days(panel.sessions(b), str(d[150]), str(d[175]), every=5, cap=2, split=str(d[165]))
    chosen = graded(seeded, limit=3)[2].filter("grade in ('A', 'B')").join(signals.select("trade_date", "sample"), "trade_date")
    entered = replay.entries(chosen, grid)
    done = replay.outcomes(replay.with_invalidation(replay.triggers(entered), replay.own_lows(b)), grid, index).persist()
    assert {(r.trade_date, r.sample) for r in signals.collect()} == {(d[150], "development"), (d[175], "out_of_sample")}
    mean = done.agg(F.avg("net_return").alias("r"), F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe"), F.count("*").alias("n")).first()
    assert mean.n > 0 and mean.r > 0 and mean.mae < 0 < mean.mfe
    s = replay.summarize(done, ["sample", "horizon"]).collect()
    assert {r["sample"] for r in s} == {"development", "out_of_sample"}


def test_price_restatement(spark):
    d = days(2)
    b = bars_frame(spark, [("X", d[0], None, None, None, 100.0, 1.0, 1.0, 1.0), ("X", d[1], None, None, None, 50.0, 2.0, 1.0, 1.0), ("Y", d[0], None, None, None, 7.0, None, 1.0, 1.0)]).withColumn("close_qfq", F.col("close_raw"))
    got = {(r.symbol, r.trade_date): (r.close_qfq, r.close_raw) for r in panel.restate_qfq(b).collect()}
    assert got == {("X", d[0]): (50.0, 100.0), ("X", d[1]): (50.0, 50.0), ("Y", d[0]): (7.0, 7.0)}
    f = spark.createDataFrame([("X", d[0], 1.0), ("X", d[1], 1.1)], "symbol string, trade_date date, adj_factor double")
    p = spark.createDataFrame([("X", d[0], 10.0), ("X", d[1], 11.0)], "symbol string, trade_date date, close_raw double")
    assert panel.forward_adjust(p, f).orderBy("trade_date").first().close_qfq == pytest.approx(10 / 1.1)


def test_exponential_indicators_match_pandas(spark):
    rng = np.random.default_rng(2)
    d, price = days(120), 50 + np.cumsum(rng.standard_normal(120))
    frame = spark.createDataFrame([("X", day, float(p)) for day, p in zip(d, price, strict=True)], "symbol string, trade_date date, close_qfq double")
    got = indicators.momentum(frame).toPandas().sort_values("trade_date", ignore_index=True)
    p = pd.Series(price)
    line = p.ewm(span=12, adjust=False, min_periods=12).mean() - p.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(got.macd, line, equal_nan=True)
    assert np.allclose(got.macd_signal, line.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)
    assert got.rsi.dropna().between(0, 100).all() and got.rsi.notna().sum() == 106
    flat = indicators.momentum(spark.createDataFrame([("F", day, 5.0) for day in d], frame.schema)).toPandas()
    assert set(flat.rsi.dropna()) == {50.0}


def test_cross_and_path(spark):
    d = days(12)
    h = [-0.2] * 8 + [-0.1, 0.1, 0.2, 0.3]
    rows = spark.createDataFrame([("X", day, v) for day, v in zip(d, h, strict=True)], "symbol string, trade_date date, macd_histogram double")
    c = indicators.last_cross(rows).first()
    assert (c.direction, c.sessions_ago, c.trade_date) == ("crossed_above_signal", 2, d[9])
    d = days(800, "2020-01-01")
    up = spark.createDataFrame([("U", day, 1.0008**i, 1.02 * 1.0008**i, 0.98 * 1.0008**i) for i, day in enumerate(d)] + [("S", day, 100.0 + (i % 20 - 10), None, None) for i, day in enumerate(d[:260])], "symbol string, trade_date date, close_qfq double, high_qfq double, low_qfq double")
    got = {(r.symbol, r.period): r for r in indicators.price_path(up).collect()}
    assert got["U", 0].path_label == "persistent_uptrend" and got["U", 0].high_date == d[-1] and ("U", 756) in got
    assert got["S", 0].path_label == "sideways_or_oscillating" and ("S", 756) not in got


def test_ledger_reactivation_and_cutoffs(spark):
    t = lambda k: dt.datetime(2024, 1, k, 12)
    rows = [("d", "k", "X", dt.date(2024, 1, 1), "A", t(2), 1), ("d", "k", "X", dt.date(2024, 1, 1), "B", t(3), 2), ("d", "k", "X", dt.date(2024, 1, 1), "A", t(5), 3)]
    led = ingest.ledger(spark.createDataFrame(rows, "dataset string, business_key string, symbol string, event_date date, state string, retrieved_at timestamp, batch_row long"), ["state"])
    got = {r.state: (r.revision, r.is_current) for r in led.collect()}
    assert got == {"A": (1, True), "B": (2, False)}
    assert [r.state for r in ingest.ledger_read(led).collect()] == ["A"]
    assert [r.state for r in ingest.ledger_read(led, observed_as_of="2024-01-06").collect()] == ["B"]
    assert [r.state for r in ingest.ledger_read(led, observed_as_of="2024-01-02 13:00:00").collect()] == ["A"]


def test_asof_filters(spark):
    rows = spark.createDataFrame([("a", "20240101"), ("b", "2024-09-01"), ("c", "soon"), ("d", None)], "symbol string, ann_date string")
    kept, audit = asof.available_as_of(rows, ["f_ann_date", "ann_date"], "2024-06-30")
    assert [r.symbol for r in kept.collect()] == ["a"]
    a = audit.first()
    assert (a.status, a.field, a.total, a.excluded, a.known_rows) == ("filtered", "ann_date", 4, 3, 2)
    kept, audit = asof.available_as_of(rows, ["x"], "2024-06-30")
    assert kept.count() == 4 and audit.first().status == "historically_unverified"
    # a first field without a usable day does not decide
    blank = rows.withColumn("f_ann_date", F.lit(" "))
    assert [r.symbol for r in asof.available_as_of(blank, ["f_ann_date", "ann_date"], "2024-06-30")[0].collect()] == ["a"]
    assert asof.available_as_of(blank.drop("ann_date"), ["f_ann_date"], "2024-06-30")[0].count() == 4
    assert asof.available_as_of(rows.limit(0), ["ann_date"], "2024-06-30")[1].first().status == "not_applicable"
    kept, audit = asof.sectors_as_of(rows.withColumnRenamed("ann_date", "trade_date"), "2024-06-30")
    assert [r.symbol for r in kept.collect()] == ["a"] and tuple(audit.first()) == ("partial", 3, 2)
    assert asof.sectors_as_of(rows, "2024-06-30")[1].first().status == "snapshot_without_effective_date"


def test_business_keys(spark):
    rows = spark.createDataFrame([("X", "20240102", None, "a"), ("X", "2024-01-02", "20240301", "b"), ("X", None, "20240301", "c"), ("X", " ", "2024-03-01", "d"), (None, None, None, "e"), (None, None, None, "f")], "ts_code string, trade_date string, ann_date string, h string")
    key = lambda d: [r[0] for r in rows.select(ingest.business_key(F.lit(d), rows.columns, F.col("h"))).collect()]
    a = key("one")
    assert a[0] == a[1] and a[2] == a[3] and a[0] != a[2] and a[4:] == ["row:e", "row:f"]
    assert key("two")[0] != a[0]


def test_upsert_orders_rows_of_one_batch(spark):
    old = spark.createDataFrame([("k", 1.0, 1)], "k string, v double, row int")
    new = spark.createDataFrame([("k", 3.0, 2), ("k", 2.0, 5), ("k", None, 9)], old.schema)
    assert ingest.merge_upsert(old, new, ["k"], row="row").collect()[0].v == 2.0
    assert ingest.merge_upsert(old, new, ["k"], overwrite=("v",), row="row").collect()[0].v is None


def test_trades_keep_rows_without_side_or_price(spark):
    rows = spark.createDataFrame([("p", k, s, q) for k, (s, q) in enumerate([("buy", "3"), ("hold", "x"), (" ", None), ("?", "2")])] + [("q", k, "sell", "1") for k in range(600)], "account string, no int, side string, quantity string")
    got = portfolio.clean_trades(rows, ["account"], "no")
    assert [(r.no, r.side, r.quantity) for r in got.filter("account = 'p'").orderBy("no").collect()] == [(0, "buy", 3.0), (3, "", 2.0)]
    assert got.filter("account = 'q'").count() == 500


def test_sector_returns_and_rotation(spark):
    d = days(21)
    rows = [(s, day, float(100 + k * i)) for s, k in ((1, 1), (2, -1)) for i, day in enumerate(d)]
    moved = sector.returns(spark.createDataFrame(rows, "sector_code int, trade_date date, close double"))
    best = sector.performance(moved, by="return_20", limit=1).first()
    assert best.sector_code == 1 and best.return_20 == pytest.approx(20.0)
    day = sector.breadth(moved).filter(F.col("trade_date") == d[-1]).first()
    assert (day.up, day.down) == (1, 1)
    d = days(7)
    closes = {1: [100] * 5 + [101, 106], 2: [100, 101, 102, 103, 104, 105, 104], 3: [100] * 5 + [99, 98]}
    rows = [(s, day, float(c)) for s, cs in closes.items() for day, c in zip(d, cs, strict=True)]
    turned = {r.sector_code: r.rank_change for r in sector.rotation(sector.returns(spark.createDataFrame(rows, "sector_code int, trade_date date, close double"))).collect()}
    assert turned == {1: 1, 2: -1, 3: 0}


def test_sizing_holdings_watchlist(spark):
    cols = "account double, entry double, stop double, risk_pct double, weight_pct double, gap_pct double, heat double, heat_limit double, open_positions int, max_positions int, daily_amount double, order_pct double, grade string"
    base = (1e6, 20.0, 18.0, 0.5, 20.0, 2.0)
    a, b = portfolio.position_plan(spark.createDataFrame([(*base, None, None, None, None, None, None, "A"), (*base, 2.0, 2.0, None, None, None, None, "A")], cols)).collect()
    assert a.shares > 0 and a.shares % 100 == 0 and a.planned_loss <= 5000 and a.binding == "risk_budget"
    assert b.shares == 0 and b.blockers == ["portfolio_heat_limit_reached"]
    h = portfolio.holding_metrics(spark.createDataFrame([("X", 10.0, 1500.0, 1550.0)], "symbol string, quantity double, average_cost double, latest_price double")).first()
    assert h.profit == 500 and h.profit_pct == pytest.approx(3.3333, abs=1e-3)
    old = spark.createDataFrame([("X", "active", "why", ["r1"])], "symbol string, status string, note string, reports array<string>")
    new = spark.createDataFrame([("X", None, None, ["r2"]), ("Y", "archived", None, [])], old.schema)
    merged = portfolio.merge_watchlist(old, new)
    assert {r.symbol: (r.status, r.note, r.reports) for r in merged.collect()}["X"] == ("active", "why", ["r1", "r2"])
    shown = portfolio.watchlist_view(merged, spark.createDataFrame([("r1",)], "report string")).collect()
    assert [(r.symbol, r.missing_reports) for r in shown] == [("X", 1)]


def test_signal_sampling_rounds_to_even(spark):
    d = spark.createDataFrame([(day, i + 1) for i, day in enumerate(days(60))], "trade_date date, session_no int")
    got = [r.session_no for r in replay.signal_days(d, "2025-01-01", "2026-01-01", every=5, cap=5).orderBy("session_no").collect()]
    assert got == [1 + 5 * round(i * 11 / 4) for i in range(5)]


def test_corpus_helpers(spark):
    page = "<html><script>x()</script><p>One  two</p><style>a{}</style><div>three</div></html>"
    assert corpus.visible_text(spark.createDataFrame([(page,), (None,)], "html string")).select("text").collect()[0][0] == "One two\n\nthree"
    odd = "<!-- <p>no</p> --><title>T &lt;x&gt;</title><SVG><text>no</text></SVG>caf&#233;&nbsp; &#26085;&#x; 5 < 6 &amp;lt;<br/><script>open"
    assert corpus.visible_text(spark.createDataFrame([(odd,)], "html string")).first().text == "T <x>\n\ncafé 日&#x; 5 < 6 &lt;"
    rows = spark.createDataFrame([("o", k % 3, k) for k in range(20)] + [(None, 1, 50)], "owner string, day int, id int")
    got = sorted((r.owner or "", r.place, r.id) for r in corpus.placed(rows, ["owner"], [("day", "desc")], [F.col("id")]).collect())
    assert got == [("", 1, 50)] + [("o", i, x) for i, x in enumerate(sorted(range(20), key=lambda k: (-(k % 3), k)), 1)]
    wiki = spark.createDataFrame([("a.md", "[[b]] and [c](c.md) `[[no]]`"), ("b.md", "fine")], "path string, text string")
    assert [(r.path, r.target) for r in corpus.broken_links(wiki).collect()] == [("a.md", "c.md")]


def test_settings_and_contracts(spark):
    with pytest.raises(ValueError):
        indicators.Settings(fast=30)
    assert indicators.Settings().warmup == 60
    assert gates.contract_table(spark).count() == 3
    s = spark.createDataFrame([([],), (["pass", "review"],), (["pass", "unknown", "review"],), (["not_required"],), (["pass", "not_required"],)], "s array<string>")
    assert [r[0] for r in s.select(gates.aggregate(F.col("s"))).collect()] == ["fail", "review", "unknown", "not_required", "pass"]
