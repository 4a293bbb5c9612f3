"""Queries on gates, confirmation, replay and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates, panel, replay
from tidemark.plans import query, shared
from tidemark.plans.base_sql import BARS, INDEX
from tidemark.plans.panel_queries import bars, rounded
from tidemark.plans.screen_queries import PICKED, days, full_grid, picked, quality
from tidemark.sources import adapters, asof, store
from tidemark.sources.adapters import table

START, END, SPLIT, EVERY, CAP = "1996-01-01", "2000-06-30", "1999-06-01", 1, 60


@shared
def graded(spark, sf_dir):
    return gates.grades(gates.screening(picked(spark, sf_dir)))


GRADED = f"""{PICKED},
gt AS (SELECT *, [CASE WHEN quality_status = 'ready' THEN 'pass' ELSE 'fail' END, CASE extension_state WHEN 'stretched' THEN 'review' ELSE 'pass' END,
  CASE WHEN chase_risk < 60 THEN 'pass' WHEN chase_risk < 80 THEN 'review' ELSE 'fail' END, CASE WHEN momentum_pct >= 0.7 THEN 'pass' ELSE 'review' END,
  CASE trend_state WHEN 'supportive' THEN 'pass' WHEN 'mixed' THEN 'review' ELSE 'fail' END, CASE participation_state WHEN 'adverse' THEN 'review' ELSE 'pass' END,
  CASE WHEN volatility_pct >= 0.9 THEN 'review' ELSE 'pass' END, CASE market_state WHEN 'hostile' THEN 'review' ELSE 'pass' END] AS g FROM picked),
gs AS (SELECT *, CASE WHEN list_contains(g, 'fail') THEN 'fail' WHEN list_contains(g, 'unknown') THEN 'unknown' WHEN list_contains(g, 'review') THEN 'review' ELSE 'pass' END AS screening_status FROM gt),
gg AS (SELECT *, CASE WHEN screening_status = 'pass' THEN 'A' WHEN list_contains(g, 'fail') OR chase_risk >= 80 THEN 'C' ELSE 'B' END AS grade,
  list_filter([CASE WHEN g[1] = 'fail' THEN 'data_not_fit_for_execution' END, CASE WHEN g[5] = 'fail' THEN 'trend_not_supportive' END, CASE WHEN g[2] = 'review' THEN 'price_extended_wait_for_pullback' END, CASE WHEN g[3] = 'review' THEN 'chase_risk_medium' END,
    CASE WHEN g[3] = 'fail' THEN 'chase_risk_high' END, CASE WHEN g[6] = 'review' THEN 'participation_unconfirmed' END, CASE WHEN g[7] = 'review' THEN 'volatility_high' END, CASE WHEN g[8] = 'review' THEN 'market_hostile' END], lambda x: x IS NOT NULL) AS rs FROM gs),
graded AS (SELECT *, CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') WHEN grade = 'A' THEN 'passes_mechanical_screen' WHEN grade = 'C' THEN 'hard_risk_not_offset_by_rank' ELSE 'kept_but_not_actionable_yet' END AS why,
  CASE WHEN chase_risk >= 80 THEN 'high' WHEN chase_risk >= 60 OR extension_state = 'stretched' THEN 'medium' ELSE 'low' END AS chase_label FROM gg)"""


@query(f"WITH {GRADED} SELECT symbol, trade_date, array_to_string(g, ',') AS gates, screening_status FROM graded")
def gate_screening(spark, sf_dir):
    g = gates.screening(picked(spark, sf_dir))
    ordered = F.array_join(F.array(*[F.col("gates")[k] for k in gates.GATES]), ",")
    return g.select("symbol", "trade_date", ordered.alias("gates"), "screening_status")


@query(f"WITH {GRADED} SELECT symbol, trade_date, grade, why AS grade_reasons, chase_label FROM graded")
def gate_grades(spark, sf_dir):
    return graded(spark, sf_dir).select("symbol", "trade_date", "grade", F.array_join("grade_reasons", ",").alias("grade_reasons"), "chase_label")


@query(
    f"""WITH {GRADED} SELECT trade_date, count(*) FILTER (screening_status = 'pass') AS n_pass, count(*) FILTER (screening_status = 'review') AS n_review, count(*) FILTER (screening_status = 'fail') AS n_fail,
  count(*) FILTER (grade = 'A') AS n_a, count(*) FILTER (grade = 'B') AS n_b, count(*) FILTER (grade = 'C') AS n_c,
  CASE WHEN count(*) FILTER (grade = 'A') > 0 THEN 'executable_candidates_available' WHEN count(*) FILTER (grade = 'B') > 0 THEN 'research_candidates_waiting_for_price' ELSE 'strong_watch_candidates_only' END AS screen_status FROM graded GROUP BY 1"""
)
def gate_readiness_counts(spark, sf_dir):
    return gates.readiness_counts(graded(spark, sf_dir)).select("trade_date", "n_pass", "n_review", "n_fail", "n_a", "n_b", "n_c", "screen_status")


@query(
    """WITH s AS (SELECT o_custkey AS evidence_id, CASE WHEN o_orderkey % 11 <> 4 THEN 'paper' END AS source, CASE WHEN o_orderkey % 13 = 5 THEN NULL WHEN o_orderkey % 17 = 6 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS avail FROM orders),
t AS (SELECT *, coalesce(try_cast(avail AS TIMESTAMP) < TIMESTAMP '2001-01-02', false) AS ok FROM s),
a AS (SELECT evidence_id, count(*) AS n, count(*) FILTER (ok) AS v, count(*) FILTER (source IS NULL) + count(*) FILTER (NOT ok) AS e FROM t GROUP BY 1)
SELECT c_custkey AS evidence_id, coalesce(n, 0) AS sources, coalesce(v, 0) AS valid, coalesce(e, 0) AS errors, CASE WHEN n IS NULL THEN CASE WHEN c_custkey % 3 = 0 THEN 'not_required' ELSE 'unknown' END WHEN v > 0 AND e = 0 THEN 'pass' ELSE 'fail' END AS status
FROM customer LEFT JOIN a ON a.evidence_id = c_custkey"""
)
def gate_source_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    at = F.when(k % 13 == 5, None).when(k % 17 == 6, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    sources = o.select(F.col("o_custkey").alias("evidence_id"), F.lit("2001-01-01").alias("as_of"), F.when(k % 11 != 4, "paper").alias("source"), at.alias("available_at"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id"), (F.col("c_custkey") % 3 != 0).alias("event_required"))
    return gates.source_audit(sources, asked)


# --- evidence assembled from the screen

_K = "symbol * 1000 + session_no"
_AS_OF = "2024-01-15"
_REQ = f"""{GRADED},
rq AS (SELECT {_K} AS evidence_id, {_K} AS k, CASE WHEN ({_K}) % 53 = 9 THEN symbol + 100000 ELSE symbol END AS symbol, trade_date, DATE '{_AS_OF}' AS as_of, ['momentum_trade', 'event_trade', 'catalyst_swing'][(({_K}) % 3 + 1)::INTEGER] AS strategy FROM graded),
kn AS (SELECT user_id AS symbol, count(*) AS events, min(ts::DATE + (event_id % 5)::INTEGER) AS first_event, max(ts::DATE + (event_id % 5)::INTEGER) AS last_event FROM events WHERE event_type IN ('purchase', 'error') AND ts::DATE <= DATE '{_AS_OF}' AND ts::DATE + (event_id % 5)::INTEGER BETWEEN DATE '2023-01-01' AND DATE '2025-01-01' GROUP BY 1),
evi AS (SELECT rq.*, coalesce(g.screening_status, 'fail') AS screening_status, g.name, g.g AS gt, close_qfq AS analysis_price, close_raw AS execution_price, close_raw IS NOT NULL AS execution_price_known, coalesce(events, 0) AS events, first_event, last_event, grade, chase_risk,
  strategy <> 'momentum_trade' AS req, CASE strategy WHEN 'momentum_trade' THEN 'momentum_breakout' WHEN 'event_trade' THEN 'event_continuation' ELSE 'trend_pullback' END AS dflt,
  CASE strategy WHEN 'momentum_trade' THEN ['momentum_breakout', 'trend_pullback'] WHEN 'event_trade' THEN ['event_continuation', 'momentum_breakout'] ELSE ['trend_pullback', 'event_continuation'] END AS setups,
  CASE WHEN strategy = 'event_trade' THEN 'event_continuation' WHEN pattern IN ('momentum_breakout', 'trend_pullback') THEN pattern WHEN strategy = 'momentum_trade' THEN 'momentum_breakout' ELSE 'trend_pullback' END AS hint
  FROM rq LEFT JOIN graded g ON g.symbol = rq.symbol AND g.trade_date = rq.trade_date LEFT JOIN kn ON kn.symbol = rq.symbol)"""


def _events(spark, sf_dir):
    return asof.known_events(adapters.corporate_events(spark, sf_dir), _AS_OF, "2023-01-01", "2025-01-01")


@shared
def _evidence(spark, sf_dir):
    known = graded(spark, sf_dir)
    k = F.col("symbol") * 1000 + F.col("session_no")
    name = F.element_at(F.array(*[F.lit(c) for c in gates.CONTRACTS]), (k % 3 + 1).cast("int"))
    requests = known.select(k.alias("evidence_id"), F.when(k % 53 == 9, F.col("symbol") + 100_000).otherwise(F.col("symbol")).alias("symbol"), "trade_date", F.lit(_AS_OF).cast("date").alias("as_of"), name.alias("strategy"))
    return gates.evidence(requests, known, gates.contract_table(spark), _events(spark, sf_dir))


@query(f"WITH {_REQ} SELECT evidence_id, symbol, trade_date, strategy, screening_status, hint AS setup_hint, name, round(analysis_price, 6) AS analysis_price, round(execution_price, 6) AS execution_price, execution_price_known, events, first_event, last_event, grade, chase_risk FROM evi")
def gate_evidence(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return rounded(e.select("evidence_id", "symbol", "trade_date", "strategy", "screening_status", "setup_hint", "name", "analysis_price", "execution_price", "execution_price_known", "events", "first_event", "last_event", "grade", "chase_risk"))


@query(f"WITH {_REQ} SELECT evidence_id, event_id, ts::DATE + (event_id % 5)::INTEGER AS event_date FROM evi JOIN events ON user_id = evi.symbol WHERE event_type IN ('purchase', 'error') AND ts::DATE <= DATE '{_AS_OF}' AND ts::DATE + (event_id % 5)::INTEGER BETWEEN DATE '2023-01-01' AND DATE '2025-01-01'")
def gate_event_leads(spark, sf_dir):
    return gates.event_leads(_evidence(spark, sf_dir), _events(spark, sf_dir)).select("evidence_id", "event_id", "event_date")


def _assessments(found):
    """What an assessor might say of each evidence: every field takes all of its values."""
    k = F.col("evidence_id")
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v).cast("string") for v in vs]), (F.pmod(F.floor(k / n), F.lit(len(vs))) + 1).cast("int"))
    said = lambda n, r: F.when(k % n != r, "said")
    none = F.lit(None).cast("string")
    return found.select(
        "evidence_id",
        F.when(k % 50 == 7, F.col("symbol") + 1).otherwise(F.col("symbol")).alias("assessed_symbol"),
        F.when(k % 41 == 3, "momentum_trade").otherwise(F.col("strategy")).alias("assessed_strategy"),
        F.when(k % 37 == 5, F.date_add("as_of", 1)).otherwise(F.col("as_of")).alias("assessed_as_of"),
        (k % 2 == 0).alias("setup_supplied"),
        pick(2, None, None, "momentum_breakout", "trend_pullback", "event_continuation", "other").alias("setup_type"),
        said(9, 1).alias("hypothesis"),
        said(4, 2).alias("trigger_rule"),
        none.alias("invalidation_rule"),
        none.alias("valid_until"),
        pick(4, "pass", "pass", "review", "odd").alias("relative_strength_status"),
        pick(2, "pass", "pass", "pass", "review").alias("trend_structure_status"),
        pick(6, "pass", "pass", "fail").alias("participation_status"),
        pick(8, "pass", "pass", "unknown").alias("extension_status"),
        pick(1, "verified", "unknown", "verified").alias("event_status"),
        (k % 3).alias("sources"),
        F.when(k % 11 == 4, F.greatest(k % 3 - 1, F.lit(0))).otherwise(k % 3).alias("valid_sources"),
        F.when((k % 11 == 4) & (k % 3 > 0), 1).otherwise(0).alias("source_errors"),
        pick(5, "positive", "positive", "neutral", "negative", None).alias("expectation"),
        said(7, 3).alias("expectation_thesis"),
        pick(3, "low", "moderate", "low", "high").alias("priced_in"),
        said(17, 2).alias("priced_thesis"),
        pick(7, "low", "moderate", "high", "odd").alias("crowding"),
        said(19, 2).alias("crowding_thesis"),
        said(23, 2).alias("counter_thesis"),
        said(29, 2).alias("counter_trigger"),
        pick(1, "priority_action", "wait_price", "wait_evidence", "cash", "wait_price", "odd").alias("action"),
        (k % 70).cast("double").alias("maximum_holding"),
        (3 + k % 4).cast("double").alias("expected_upside_pct"),
        F.when(k % 31 == 6, 0.0).otherwise(2.0).alias("effective_downside_pct"),
        *[said(n, r).alias(c) for c, n, r in zip(gates.PLAN_FIELDS, (13, 43, 47, 59, 61), (5, 5, 5, 5, 5), strict=True)],
        F.when(k % 67 == 8, "intraday").alias("decision_frequency"),
        *[F.when(k % n != 6, 1.0).alias(c) for c, n in zip(gates.LIMITS, (71, 73, 79, 83, 89, 97), strict=True)],
        pick(1, "high", "medium", "low", "high", "medium", "low", "low", None).alias("confidence"),
        said(101, 5).alias("thesis"),
    )


def _pick_sql(n: int, *vs) -> str:
    values = ", ".join("NULL" if v is None else f"'{v}'" for v in vs)
    return f"[{values}][((k // {n}) % {len(vs)} + 1)::INTEGER]"


def _worst_sql(x: str) -> str:
    return f"CASE WHEN list_contains({x}, 'fail') THEN 'fail' WHEN list_contains({x}, 'unknown') THEN 'unknown' WHEN list_contains({x}, 'review') THEN 'review' WHEN len(list_filter({x}, lambda y: y <> 'not_required')) = 0 THEN 'not_required' ELSE 'pass' END"


_SUPPLIED = lambda field, gate: f"CASE WHEN k % 2 = 0 THEN CASE WHEN {field} IN ('pass', 'review', 'fail', 'unknown') THEN {field} ELSE 'unknown' END ELSE coalesce(gt[{gate}], 'unknown') END"

_DECIDED = f"""{_REQ},
as0 AS (SELECT *, CASE WHEN k % 50 = 7 THEN symbol + 1 ELSE symbol END AS a_symbol, CASE WHEN k % 41 = 3 THEN 'momentum_trade' ELSE strategy END AS a_strategy, k % 37 = 5 AS a_late, {_pick_sql(2, None, None, 'momentum_breakout', 'trend_pullback', 'event_continuation', 'other')} AS st,
  {_pick_sql(4, 'pass', 'pass', 'review', 'odd')} AS s1, {_pick_sql(2, 'pass', 'pass', 'pass', 'review')} AS s2, {_pick_sql(6, 'pass', 'pass', 'fail')} AS s3, {_pick_sql(8, 'pass', 'pass', 'unknown')} AS s4, {_pick_sql(1, 'verified', 'unknown', 'verified')} AS es,
  CASE WHEN k % 11 = 4 THEN greatest(k % 3 - 1, 0) ELSE k % 3 END AS vs, CASE WHEN k % 11 = 4 AND k % 3 > 0 THEN 1 ELSE 0 END AS se, {_pick_sql(5, 'positive', 'positive', 'neutral', 'negative', None)} AS ex, {_pick_sql(3, 'low', 'moderate', 'low', 'high')} AS pi, {_pick_sql(7, 'low', 'moderate', 'high', 'odd')} AS cr,
  {_pick_sql(1, 'priority_action', 'wait_price', 'wait_evidence', 'cash', 'wait_price', 'odd')} AS action, {_pick_sql(1, 'high', 'medium', 'low', 'high', 'medium', 'low', 'low', None)} AS confidence, CASE WHEN k % 31 <> 6 THEN (3 + k % 4) / 2.0 END AS rr, k % 101 <> 5 AS th FROM evi),
as1 AS (SELECT *, coalesce(CASE WHEN k % 2 = 0 THEN st END, hint) AS setup FROM as0),
as2 AS (SELECT *, [CASE WHEN list_contains(setups, setup) THEN 'pass' ELSE 'fail' END, CASE WHEN (k % 2 = 0 AND k % 9 <> 1) OR th THEN 'pass' ELSE 'unknown' END, {_SUPPLIED('s1', 4)}, {_SUPPLIED('s2', 5)}, {_SUPPLIED('s3', 6)}, {_SUPPLIED('s4', 2)},
    CASE WHEN (k % 2 = 0 AND k % 4 <> 2) OR k % 13 <> 5 THEN 'pass' ELSE 'unknown' END, CASE WHEN k % 43 <> 5 THEN 'pass' ELSE 'unknown' END, CASE WHEN k % 59 <> 5 THEN 'pass' ELSE 'unknown' END, 'pass'] AS sg,
  [CASE WHEN es = 'verified' THEN 'pass' WHEN NOT req THEN 'not_required' ELSE 'unknown' END, CASE WHEN k % 3 = 0 THEN CASE WHEN req THEN 'unknown' ELSE 'not_required' END WHEN vs > 0 AND se = 0 THEN 'pass' ELSE 'fail' END,
    CASE WHEN ex = 'positive' AND k % 7 <> 3 THEN 'pass' WHEN ex = 'neutral' THEN 'review' WHEN ex = 'negative' THEN 'fail' ELSE 'unknown' END, CASE WHEN pi IN ('low', 'moderate') AND k % 17 <> 2 THEN 'pass' WHEN pi = 'high' THEN 'review' ELSE 'unknown' END,
    CASE WHEN cr IN ('low', 'moderate') AND k % 19 <> 2 THEN 'pass' WHEN cr = 'high' THEN 'review' ELSE 'unknown' END, CASE WHEN k % 23 <> 2 AND k % 29 <> 2 THEN 'pass' ELSE 'unknown' END] AS rg,
  [CASE WHEN k % 13 <> 5 AND k % 43 <> 5 AND k % 47 <> 5 AND k % 59 <> 5 AND k % 61 <> 5 THEN 'pass' ELSE 'unknown' END, CASE WHEN k % 70 > 0 AND k % 70 <= CASE strategy WHEN 'catalyst_swing' THEN 60 ELSE 20 END THEN 'pass' ELSE 'fail' END, CASE WHEN rr >= 1.5 THEN 'pass' WHEN rr IS NOT NULL THEN 'review' ELSE 'unknown' END] AS pg,
  CASE WHEN action = 'cash' THEN 'not_required' WHEN k % 67 = 8 THEN 'fail' WHEN k % 71 = 6 OR k % 73 = 6 OR k % 79 = 6 OR k % 83 = 6 OR k % 89 = 6 OR k % 97 = 6 THEN 'unknown' ELSE 'pass' END AS controls FROM as1),
as3 AS (SELECT *, {_worst_sql('sg')} AS technical, {_worst_sql('rg')} AS research, {_worst_sql('pg')} AS plan FROM as2),
as4 AS (SELECT *, screening_status = 'pass' AND technical = 'pass' AND research = 'pass' AND plan = 'pass' AND controls IN ('pass', 'not_required') AS ok FROM as3),
decided AS (SELECT *, concat_ws(',', CASE WHEN a_symbol <> symbol THEN 'symbol_differs' END, CASE WHEN a_strategy <> strategy THEN 'strategy_differs' END, CASE WHEN a_late THEN 'as_of_differs' END, CASE WHEN se > 0 THEN 'sources_invalid' END, CASE WHEN action = 'odd' THEN 'action_unknown' END,
  CASE WHEN action = 'priority_action' AND NOT ok THEN 'priority_not_ready' END, CASE WHEN confidence IS NULL THEN 'confidence_unknown' END, CASE WHEN NOT th THEN 'thesis_missing' END) AS errors FROM as4)"""


def _decided(spark, sf_dir):
    found = _evidence(spark, sf_dir)
    return gates.decide(found, _assessments(found))


@query(f"WITH {_DECIDED} SELECT evidence_id, setup, array_to_string(sg, ',') AS setup_gates, technical FROM decided")
def gate_setup(spark, sf_dir):
    d = _decided(spark, sf_dir)
    return d.select("evidence_id", "setup", F.array_join(F.array(*[F.col("setup_gates")[g] for g in gates.SETUP_GATES]), ",").alias("setup_gates"), "technical")


@query(f"WITH {_DECIDED} SELECT evidence_id, array_to_string(rg, ',') AS research_gates, array_to_string(pg, ',') AS plan_gates, screening_status, technical, research, plan, controls, round(rr, 6) AS reward_risk, errors, ok AND errors = '' AS decision_ready FROM decided")
def gate_decision(spark, sf_dir):
    d = _decided(spark, sf_dir)
    line = lambda c, names: F.array_join(F.array(*[F.col(c)[g] for g in names]), ",").alias(c)
    return rounded(d.select("evidence_id", line("research_gates", gates.RESEARCH_GATES), line("plan_gates", gates.PLAN_GATES), "screening_status", "technical", "research", "plan", "controls", "reward_risk", F.array_join("errors", ",").alias("errors"), "decision_ready"))


@query(f"WITH {_DECIDED} SELECT evidence_id, strategy, action, CASE WHEN action <> 'cash' THEN symbol END AS symbol, CASE WHEN action <> 'cash' THEN setup END AS setup, technical AS technical_pattern, ok AS decision_ready FROM decided WHERE errors = ''")
def gate_compact(spark, sf_dir):
    return gates.compact_decision(_decided(spark, sf_dir)).select("evidence_id", "strategy", "action", "symbol", "setup", "technical_pattern", "decision_ready")


# --- replay


@shared
def _signals(spark, sf_dir):
    return replay.signal_days(days(spark, sf_dir), START, END, EVERY, CAP, SPLIT)


@shared
def _entered(spark, sf_dir):
    good = graded(spark, sf_dir).filter(F.col("grade").isin("A", "B"))
    chosen = good.join(_signals(spark, sf_dir).select("trade_date", "sample"), "trade_date")
    return replay.entries(chosen, full_grid(spark, sf_dir))


@shared
def _armed(spark, sf_dir):
    entered = _entered(spark, sf_dir)
    # restated symbol by symbol
    own = replay.only_symbols(bars(spark, sf_dir), entered)
    return replay.with_invalidation(replay.triggers(entered), replay.own_lows(panel.restate_qfq(own)))


@shared
def _armed_grid(spark, sf_dir):
    """The cells of armed symbols, at most a screen's candidates on the signal dates, which every walk reads."""
    cells = full_grid(spark, sf_dir).select("symbol", "session_no", "trade_date", "open_qfq", "high_qfq", "low_qfq", "close_qfq", "close_raw", "volume", "limit_types")
    return replay.only_symbols(cells, _armed(spark, sf_dir))


@shared
def _index(spark, sf_dir):
    return adapters.index_daily(spark, sf_dir, bars(spark, sf_dir))


@shared
def _outcomes(spark, sf_dir):
    armed = _armed(spark, sf_dir)
    return replay.outcomes(armed, _armed_grid(spark, sf_dir), _index(spark, sf_dir), last_no=days(spark, sf_dir).agg(F.max("session_no").alias("last_no")))


SIGNALS = f"""
sd0 AS (SELECT trade_date, session_no, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM days WHERE trade_date BETWEEN DATE '{START}' AND DATE '{END}'),
sd1 AS (SELECT *, i // {EVERY} AS j, count(*) OVER () AS n FROM sd0 WHERE i % {EVERY} = 0),
signals AS (SELECT trade_date, session_no, CASE WHEN trade_date >= DATE '{SPLIT}' THEN 'out_of_sample' ELSE 'development' END AS sample FROM sd1
  WHERE n <= {CAP} OR j IN (SELECT round_even(k * (n - 1)::DOUBLE / {CAP - 1}, 0) FROM range({CAP}) t(k)))"""

OUTCOMES = f"""{GRADED}, {SIGNALS},
cand AS (SELECT g.*, s.sample FROM graded g JOIN signals s USING (trade_date) WHERE grade IN ('A', 'B')),
ent AS (SELECT c.*, n.trade_date AS e_date, n.open_qfq AS eo, n.high_qfq AS eh, n.low_qfq AS el, n.close_qfq AS ec,
  CASE WHEN coalesce(n.volume, 0) <= 0 THEN 'untradable' WHEN n.limit_types = 'U' THEN 'limit_up' END AS skip FROM cand c JOIN cells n ON n.symbol = c.symbol AND n.session_no = c.session_no + 1),
lev AS (SELECT *, CASE WHEN pattern = 'trend_pullback' THEN 'trend_pullback' ELSE 'momentum_breakout' END AS setup,
  CASE WHEN pattern = 'trend_pullback' THEN CASE WHEN coalesce(sma_m, sma_t) < close_qfq THEN coalesce(sma_m, sma_t) ELSE close_qfq * 0.995 END ELSE greatest(close_qfq * 1.002, coalesce(high_qfq, close_qfq)) END AS level FROM ent WHERE skip IS NULL),
trg AS (SELECT *, CASE WHEN close_qfq IS NULL OR ec IS NULL THEN 'unknown' WHEN setup = 'trend_pullback' AND coalesce(el <= level, false) AND ec >= level AND trend_state = 'supportive' THEN 'triggered'
  WHEN setup <> 'trend_pullback' AND (coalesce(eo >= level, false) OR coalesce(eh >= level, false) OR ec >= level) THEN 'triggered' ELSE 'not_triggered' END AS status FROM lev),
tp AS (SELECT *, CASE WHEN setup = 'trend_pullback' THEN level WHEN eo >= level THEN eo ELSE level END AS entry_price, CASE WHEN setup = 'trend_pullback' THEN 'low_touch_reclaim' WHEN eo >= level THEN 'open' ELSE 'intraday_high' END AS basis FROM trg WHERE status = 'triggered'),
lows AS (SELECT symbol, trade_date, min(low_qfq) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rl FROM qfq),
iv0 AS (SELECT tp.*, rl, CASE WHEN setup = 'trend_pullback' THEN rl ELSE coalesce(greatest(CASE WHEN rl < entry_price THEN rl END, CASE WHEN coalesce(sma_m, sma_t) < entry_price THEN coalesce(sma_m, sma_t) END), entry_price * 0.97) END AS raw FROM tp LEFT JOIN lows USING (symbol, trade_date)),
iv AS (SELECT *, CASE WHEN raw IS NULL OR raw >= entry_price THEN entry_price * 0.97 ELSE raw END AS invalidation FROM iv0),
hz AS (SELECT iv.*, h AS horizon, session_no + 1 AS entry_no, session_no + 1 + h AS target_no, (SELECT max(session_no) FROM days) AS last_no FROM iv CROSS JOIN (VALUES (5), (10), (20)) t(h)),
sp AS (SELECT hz.*, (SELECT min(c.session_no) FROM cells c WHERE c.symbol = hz.symbol AND c.session_no > entry_no AND c.session_no <= target_no AND c.low_qfq <= invalidation) AS stop_no FROM hz WHERE target_no <= last_no),
ds AS (SELECT *, coalesce(stop_no, target_no) AS desired_no FROM sp),
ex AS (SELECT *, (SELECT min(c.session_no) FROM cells c WHERE c.symbol = ds.symbol AND c.session_no >= desired_no AND c.close_qfq IS NOT NULL AND c.volume > 0 AND coalesce(c.limit_types, '') <> 'D') AS exit_no FROM ds),
xb AS (SELECT ex.*, c.trade_date AS exit_date, CASE WHEN stop_no IS NOT NULL AND exit_no = desired_no THEN least(coalesce(c.open_qfq, invalidation), invalidation) ELSE c.close_qfq END AS exit_price,
  (SELECT any_value(d.limit_types) FROM cells d WHERE d.symbol = ex.symbol AND d.session_no = desired_no) AS dl,
  (SELECT min(p.low_qfq) FROM cells p WHERE p.symbol = ex.symbol AND p.session_no BETWEEN entry_no AND exit_no) AS pl, (SELECT max(p.high_qfq) FROM cells p WHERE p.symbol = ex.symbol AND p.session_no BETWEEN entry_no AND exit_no) AS ph
  FROM ex LEFT JOIN cells c ON c.symbol = ex.symbol AND c.session_no = exit_no),
xr AS (SELECT xb.*, exit_price / nullif(entry_price, 0) - 1 - 0.002 AS net_return, bo.close / nullif(coalesce(bi.open, bi.close), 0) - 1 AS benchmark_return FROM xb LEFT JOIN idx bi ON bi.trade_date = e_date LEFT JOIN idx bo ON bo.trade_date = exit_date),
outc AS (SELECT symbol, trade_date, horizon, sample, grade, place, setup, basis, e_date AS entry_date, exit_date, CASE WHEN stop_no IS NOT NULL THEN 'price_invalidation' ELSE 'time_horizon' END AS exit_reason, exit_no - desired_no AS delay, coalesce(exit_no > desired_no AND dl = 'D', false) AS ldd,
    entry_price, invalidation, exit_price, net_return, benchmark_return, net_return - benchmark_return AS excess_return, pl / nullif(entry_price, 0) - 1 AS mae, ph / nullif(entry_price, 0) - 1 AS mfe FROM xr
  UNION ALL SELECT symbol, trade_date, horizon, sample, grade, place, setup, basis, e_date, NULL, NULL, NULL, NULL, entry_price, invalidation, NULL, NULL, NULL, NULL, NULL, NULL FROM hz WHERE target_no > last_no)"""


@query(f"WITH {GRADED}, {SIGNALS} SELECT trade_date, session_no, sample FROM signals")
def rpl_signals(spark, sf_dir):
    return _signals(spark, sf_dir)


@query(f"WITH {OUTCOMES} SELECT symbol, trade_date, e_date AS entry_date, skip FROM ent")
def rpl_entries(spark, sf_dir):
    return _entered(spark, sf_dir).select("symbol", "trade_date", F.col("e_trade_date").alias("entry_date"), "skip")


@query(f"WITH {OUTCOMES} SELECT t.symbol, t.trade_date, t.setup, t.status, round(t.level, 6) AS level, round(p.entry_price, 6) AS entry_price, p.basis FROM trg t LEFT JOIN tp p USING (symbol, trade_date)")
def rpl_triggers(spark, sf_dir):
    return rounded(replay.triggers(_entered(spark, sf_dir)).select("symbol", "trade_date", "setup", "status", "level", "entry_price", "basis"))


@query(
    f"""WITH {OUTCOMES} SELECT symbol, trade_date, horizon, sample, entry_date, exit_date, exit_reason, delay, round(entry_price, 6) AS entry_price, round(invalidation, 6) AS invalidation, round(exit_price, 6) AS exit_price, round(net_return, 6) AS net_return,
  round(benchmark_return, 6) AS benchmark_return, round(excess_return, 6) AS excess_return, round(mae, 6) AS mae, round(mfe, 6) AS mfe FROM outc"""
)
def rpl_outcomes(spark, sf_dir):
    return rounded(_outcomes(spark, sf_dir).select("symbol", "trade_date", "horizon", "sample", "entry_date", "exit_date", "exit_reason", "delay", "entry_price", "invalidation", "exit_price", "net_return", "benchmark_return", "excess_return", "mae", "mfe"))


@query(
    f"""WITH {OUTCOMES} SELECT (SELECT count(*) FROM ent) AS selected, (SELECT count(*) FROM ent WHERE skip = 'untradable') AS skip_untradable, (SELECT count(*) FROM ent WHERE skip = 'limit_up') AS skip_limit_up, (SELECT count(*) FROM trg WHERE status = 'triggered') AS triggered, (SELECT count(*) FROM trg WHERE status <> 'triggered') AS not_triggered,
  count(*) FILTER (exit_date IS NULL) AS unresolved, count(*) FILTER (delay > 0) AS delayed, count(*) FILTER (ldd) AS delayed_by_limit_down, coalesce(max(delay), 0) AS max_delay FROM outc"""
)
def rpl_accounting(spark, sf_dir):
    e = _entered(spark, sf_dir)
    return replay.accounting(e, replay.triggers(e), _outcomes(spark, sf_dir))


@query(f"WITH {OUTCOMES} SELECT grade, count(*) AS selected, count(skip) AS skipped, count(*) FILTER (t.status = 'triggered') AS triggered, count(*) FILTER (t.status <> 'triggered') AS not_triggered FROM ent LEFT JOIN (SELECT symbol, trade_date, status FROM trg) t USING (symbol, trade_date) GROUP BY 1")
def rpl_accounting_by_grade(spark, sf_dir):
    e = _entered(spark, sf_dir)
    return replay.accounting_by_grade(e, replay.triggers(e))


@query(
    f"""WITH {OUTCOMES}, s AS (SELECT sample, count(*) AS signal_dates, count(*) FILTER (status = 'blocked_for_execution') AS blocked_dates FROM signals LEFT JOIN quality USING (trade_date) GROUP BY 1),
o AS (SELECT sample, count(net_return) AS closed, avg((mae IS NOT NULL)::INTEGER) FILTER (net_return IS NOT NULL) AS a, avg((mfe IS NOT NULL)::INTEGER) FILTER (net_return IS NOT NULL) AS b FROM outc GROUP BY 1)
SELECT sample, signal_dates, blocked_dates, coalesce(closed, 0) AS closed, round(a, 6) AS mae_coverage, round(b, 6) AS mfe_coverage FROM s LEFT JOIN o USING (sample)"""
)
def rpl_signal_coverage(spark, sf_dir):
    return rounded(replay.signal_coverage(_signals(spark, sf_dir), quality(spark, sf_dir), _outcomes(spark, sf_dir)))


@query(
    f"""WITH {OUTCOMES}, r AS (SELECT trade_date, substr(sha256(strftime(trade_date, '%Y-%m-%d') || ' 00:00:00:{{"sample":"' || sample || '","session_no":' || session_no || '}}'), 1, 24) AS run_id FROM signals)
SELECT run_id, horizon, count(*) AS outcomes, count(net_return) AS closed FROM outc JOIN r USING (trade_date) GROUP BY 1, 2"""
)
def rpl_run_outcomes(spark, sf_dir):
    """Each signal date is logged as a run; its outcomes are rows of a child table under the run's id."""
    runs = store.run_log(_signals(spark, sf_dir).withColumn("operation", F.lit("replay")).withColumn("created_at", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss")), ["sample", "session_no"])
    child = store.run_outcomes(runs, _outcomes(spark, sf_dir), ["trade_date"])
    return child.groupBy("run_id", "horizon").agg(F.count("*").alias("outcomes"), F.count("net_return").alias("closed"))


def _dist_sql(source: str, by: str, order: str, x: str = "net_return") -> str:
    return f"""
dz AS (SELECT *, {x} AS x, sum(CASE WHEN {x} < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY {order}) AS run FROM {source} WHERE {x} IS NOT NULL),
dk AS (SELECT *, sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {by}, run) AS streak FROM dz)
SELECT {by}, count(*) AS observations, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg(CASE WHEN x > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(excess_return), 6) AS mean_excess, round(min(x), 6) AS worst,
  round(avg(x) FILTER (x > 0), 6) AS average_win, round(avg(x) FILTER (x < 0), 6) AS average_loss, round(avg(x) FILTER (x > 0) / nullif(abs(avg(x) FILTER (x < 0)), 0), 6) AS payoff_ratio,
  round(coalesce(sum(x) FILTER (x > 0), 0) / nullif(abs(coalesce(sum(x) FILTER (x < 0), 0)), 0), 6) AS profit_factor, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.95), 6) AS p95, coalesce(max(streak), 0)::BIGINT AS max_loss_streak,
  round(CASE WHEN count(*) > 1 THEN avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)) END, 6) AS ci_low, round(CASE WHEN count(*) > 1 THEN avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)) END, 6) AS ci_high FROM dk GROUP BY {by}"""


@query(f"WITH {OUTCOMES}, {_dist_sql('outc', 'sample, horizon', 'trade_date, place, horizon')}")
def rpl_summary(spark, sf_dir):
    return rounded(replay.summarize(_outcomes(spark, sf_dir), ["sample", "horizon"]))


@query(f"WITH {OUTCOMES}, {_dist_sql('outc', 'sample, grade, horizon', 'trade_date, place, horizon')}")
def rpl_summary_by_grade(spark, sf_dir):
    return rounded(replay.summarize(_outcomes(spark, sf_dir), ["sample", "grade", "horizon"]))


@query(
    f"""WITH {OUTCOMES}, bk AS (SELECT sample, trade_date, horizon, avg(net_return) AS net_return, avg(excess_return) AS excess_return, count(DISTINCT symbol) AS positions FROM outc WHERE net_return IS NOT NULL GROUP BY 1, 2, 3), {_dist_sql('bk', 'sample, horizon', 'trade_date')}"""
)
def rpl_baskets(spark, sf_dir):
    return rounded(replay.summarize(replay.baskets(_outcomes(spark, sf_dir)), ["sample", "horizon"], order=("trade_date",)))


@query(
    f"""WITH {OUTCOMES}, ct AS (SELECT sample, count(DISTINCT trade_date) AS n FROM outc WHERE net_return IS NOT NULL GROUP BY 1),
nd AS (SELECT s.sample, coalesce(n, 0) AS signal_baskets FROM (SELECT DISTINCT sample FROM signals) s LEFT JOIN ct USING (sample)),
bl AS (SELECT count(*) FILTER (q.status = 'blocked_for_execution') AS blocked FROM signals LEFT JOIN quality q USING (trade_date)), un AS (SELECT count(*) FILTER (exit_date IS NULL) AS unresolved FROM outc)
SELECT sample, signal_baskets, blocked, unresolved, CASE WHEN signal_baskets = 0 THEN 'sample_missing' WHEN signal_baskets < 20 THEN 'sample_below_20_signal_dates' END AS warning,
  CASE WHEN blocked > 0 THEN 'blocked_by_data_quality' WHEN min(signal_baskets) OVER () = 0 THEN 'insufficient_sample' WHEN min(signal_baskets) OVER () < 20 OR unresolved > 0 THEN 'exploratory' ELSE 'reviewable_not_validated' END AS inference_status FROM nd, bl, un"""
)
def rpl_inference(spark, sf_dir):
    return replay.inference(_outcomes(spark, sf_dir), _signals(spark, sf_dir), quality(spark, sf_dir))


@query(
    f"""WITH {BARS}, {INDEX}, rec AS (SELECT c_custkey AS rec_id, c_custkey % 120 + 1 AS symbol, DATE '1996-01-01' + (c_custkey % 900)::INTEGER AS a, DATE '1996-01-01' + (c_custkey % 900)::INTEGER + 40 + (c_custkey % 7)::INTEGER * 60 AS b FROM customer),
p AS (SELECT rec_id, arg_min(close_qfq, trade_date) AS f, arg_max(close_qfq, trade_date) AS l, min(low_qfq) AS lo, max(high_qfq) AS hi FROM rec JOIN qfq q ON q.symbol = rec.symbol AND q.trade_date BETWEEN a AND b GROUP BY 1),
m AS (SELECT rec_id, arg_min(close, trade_date) AS f2, arg_max(close, trade_date) AS l2 FROM rec JOIN idx ON trade_date BETWEEN a AND b GROUP BY 1)
SELECT rec_id, symbol, round(l / nullif(f, 0) - 1, 6) AS forward_return, round(l2 / nullif(f2, 0) - 1, 6) AS benchmark_return, round(l / nullif(f, 0) - 1 - (l2 / nullif(f2, 0) - 1), 6) AS excess_return, round(lo / nullif(f, 0) - 1, 6) AS mae, round(hi / nullif(f, 0) - 1, 6) AS mfe,
  CASE WHEN l / nullif(f, 0) IS NOT NULL THEN 'completed' ELSE 'insufficient_evidence' END AS review_status FROM rec LEFT JOIN p USING (rec_id) LEFT JOIN m USING (rec_id)"""
)
def rpl_review(spark, sf_dir):
    k = F.col("c_custkey")
    a = F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int"))
    rec = table(spark, sf_dir, "customer").select(k.alias("rec_id"), (k % 120 + 1).alias("symbol"), a.alias("recommended_on"), F.date_add(a, (40 + (k % 7) * 60).cast("int")).alias("review_as_of"))
    return rounded(replay.review(rec, panel.restate_qfq(bars(spark, sf_dir)), adapters.index_daily(spark, sf_dir, bars(spark, sf_dir))))
