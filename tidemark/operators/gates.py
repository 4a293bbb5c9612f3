"""Readiness gates and grades of screen candidates, and confirmation of assessed evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import reasons


@dataclass(frozen=True)
class Contract:
    """What a strategy allows and demands."""

    name: str
    event_required: bool
    default_setup: str
    setups: tuple[str, ...]
    max_holding: int
    min_reward_risk: float = 1.5


# The three strategies.
CONTRACTS = {
    c.name: c
    for c in (
        Contract("momentum_trade", False, "momentum_breakout", ("momentum_breakout", "trend_pullback"), 20),
        Contract("event_trade", True, "event_continuation", ("event_continuation", "momentum_breakout"), 20),
        Contract("catalyst_swing", True, "trend_pullback", ("trend_pullback", "event_continuation"), 60),
    )
}
# The gates of the screen, and of assessed setups, research, plans; actions, confidences, how often a
# decision is due, and the limits that an investor records.
GATES = ("data_quality", "price_extension", "chase_risk", "relative_strength", "trend_structure", "participation", "volatility", "market_regime")

SETUP_GATES = ("setup_identified", "behavioral_hypothesis", "relative_strength", "trend_structure", "participation", "extension", "trigger_defined", "invalidation_defined", "validity_window", "execution_price_basis")
RESEARCH_GATES = ("event_verification", "source_timestamps", "expectation_gap", "priced_in", "crowding", "counter_scenario")
PLAN_GATES = ("plan_fields", "holding_period", "reward_risk")
STATUSES = ("pass", "review", "fail", "unknown")
ACTIONS = ("priority_action", "wait_price", "wait_evidence", "cash")
CONFIDENCES = ("high", "medium", "low")
FREQUENCY = "close_review_next_session_execution"
LIMITS = ("maximum_open_positions", "single_trade_risk_budget_pct", "portfolio_heat_limit_pct", "maximum_new_trades_per_session", "overnight_gap_buffer_pct", "minimum_liquidity_multiple")
PLAN_FIELDS = ("entry_trigger", "price_invalidation", "event_invalidation", "time_invalidation", "cash_comparison")


def contract_table(spark: SparkSession) -> DataFrame:
    rows = [(c.name, c.event_required, c.default_setup, list(c.setups), c.max_holding, c.min_reward_risk) for c in CONTRACTS.values()]
    return spark.createDataFrame(rows, "strategy string, event_required boolean, default_setup string, setups array<string>, max_holding int, min_reward_risk double")


def aggregate(statuses: Column) -> Column:
    """Worst status of an array: fail (also when empty), unknown, review, not_required if all are, pass."""
    has = lambda s: F.array_contains(statuses, s)
    return (
        F.when((F.size(statuses) == 0) | has("fail"), "fail")
        .when(has("unknown"), "unknown")
        .when(has("review"), "review")
        .when(F.forall(statuses, lambda s: s == "not_required"), "not_required")
        .otherwise("pass")
    )


def screening(candidates: DataFrame) -> DataFrame:
    """Candidates with `gates` (name to status) and `screening_status`."""
    chase, mom, vol = F.col("chase_risk"), F.col("momentum_pct"), F.col("volatility_pct")
    by_state = lambda c, table, other: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in table.items()], F.lit(other))
    status = {
        "data_quality": F.when(F.col("quality_status") == "ready", "pass").otherwise("fail"),
        "price_extension": by_state("extension_state", {"stretched": "review", "not_stretched": "pass"}, "unknown"),
        "chase_risk": F.when(chase < 60, "pass").when(chase < 80, "review").when(chase.isNotNull(), "fail").otherwise("unknown"),
        "relative_strength": F.when(mom >= 0.7, "pass").when(mom.isNotNull(), "review").otherwise("unknown"),
        "trend_structure": by_state("trend_state", {"supportive": "pass", "mixed": "review", "adverse": "fail"}, "unknown"),
        "participation": by_state("participation_state", {"adverse": "review", "supportive": "pass", "mixed": "pass"}, "unknown"),
        "volatility": F.when(vol >= 0.9, "review").otherwise("pass"),
        "market_regime": by_state("market_state", {"hostile": "review", "supportive": "pass", "mixed": "pass"}, "unknown"),
    }
    gates = F.create_map(*[x for k in GATES for x in (F.lit(k), status[k])])
    return candidates.withColumn("gates", gates).withColumn("screening_status", aggregate(F.map_values("gates")))


def grades(gated: DataFrame) -> DataFrame:
    """Grade A, B or C with ordered reasons, and the chase-risk label."""
    g = lambda k: F.col("gates")[k]
    chase = F.col("chase_risk")
    grade = F.when(F.col("screening_status") == "pass", "A").when(F.array_contains(F.map_values("gates"), "fail") | F.coalesce(chase >= 80, F.lit(False)), "C").otherwise("B")
    found = reasons(
        (g("data_quality") == "fail", "data_not_fit_for_execution"),
        (g("trend_structure") == "fail", "trend_not_supportive"),
        (g("price_extension") == "review", "price_extended_wait_for_pullback"),
        (g("chase_risk") == "review", "chase_risk_medium"),
        (g("chase_risk") == "fail", "chase_risk_high"),
        (g("participation") == "review", "participation_unconfirmed"),
        (g("volatility") == "review", "volatility_high"),
        (g("market_regime") == "review", "market_hostile"),
    )
    other = F.when(F.col("grade") == "A", "passes_mechanical_screen").when(F.col("grade") == "C", "hard_risk_not_offset_by_rank").otherwise("kept_but_not_actionable_yet")
    label = F.when(chase >= 80, "high").when((chase >= 60) | (chase.isNotNull() & (F.col("extension_state") == "stretched")), "medium").when(chase.isNotNull(), "low").otherwise("unconfirmed")
    out = gated.withColumn("grade", grade).withColumn("_r", found)
    return out.withColumn("grade_reasons", F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.array(other))).withColumn("chase_label", label).drop("_r")


def readiness_counts(graded: DataFrame) -> DataFrame:
    """Per date: counts by screening status and grade, and the status of the whole screen."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1)).alias(f"n_{v.lower()}")
    day = graded.groupBy("trade_date").agg(*[n("screening_status", s) for s in ("pass", "review", "unknown", "fail")], *[n("grade", s) for s in ("A", "B", "C")])
    status = F.when(F.col("n_a") > 0, "executable_candidates_available").when(F.col("n_b") > 0, "research_candidates_waiting_for_price").when(F.col("n_c") > 0, "strong_watch_candidates_only").otherwise("no_edge_found")
    return day.withColumn("screen_status", status)


def source_audit(sources: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Per evidence_id: named sources known before the day after `as_of`. `sources` has evidence_id, as_of,
    source, available_at (text)."""
    at = F.try_to_timestamp("available_at")
    named = F.trim(F.coalesce("source", F.lit(""))) != ""
    given = F.trim(F.coalesce("available_at", F.lit(""))) != ""
    early = at < F.date_add(F.to_date("as_of"), 1).cast("timestamp")
    ok = given & at.isNotNull() & F.coalesce(early, F.lit(False))
    errors = F.count(F.when(~named, 1)) + F.count(F.when(~ok, 1))
    out = sources.groupBy("evidence_id").agg(F.count("*").alias("sources"), F.count(F.when(ok, 1)).alias("valid"), errors.alias("errors"))
    out = out.withColumn("status", F.when((F.col("valid") > 0) & (F.col("errors") == 0), "pass").otherwise("fail"))
    if required is None:
        return out
    none = F.when(F.col("event_required"), "unknown").otherwise("not_required")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return required.join(out, "evidence_id", "left").select("evidence_id", zero("sources"), zero("valid"), zero("errors"), F.coalesce("status", none).alias("status"))


def _given(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def _known(*columns: str) -> Column:
    """pass if one of the texts is given, else unknown."""
    found = F.lit(False)
    for c in columns:
        found = found | _given(c)
    return F.when(found, "pass").otherwise("unknown")


def _gate_map(names: tuple[str, ...], statuses: list[Column]) -> Column:
    return F.create_map(*[x for n, s in zip(names, statuses, strict=True) for x in (F.lit(n), s)])


def evidence(requests: DataFrame, candidates: DataFrame, contracts: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence of each request (evidence_id, symbol, trade_date, as_of, strategy): the screened candidate of that symbol
    and date, if there is one, with what its chart says under the strategy, and how many events of the symbol were
    known; `event_leads` lists those. A request without a candidate fails the screen."""
    have = candidates.select("symbol", "trade_date", "name", "gates", F.col("screening_status").alias("screened"), "pattern", "trend_state", "participation_state", "extension_state", "momentum_pct", "chase_risk", "buyability", "grade", "close_raw", "close_qfq")
    leads = events.groupBy("symbol").agg(F.count("*").alias("events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"))
    j = requests.join(have, ["symbol", "trade_date"], "left").join(leads, "symbol", "left").join(contracts, "strategy", "left")
    shown = F.when(F.col("pattern").isin("momentum_breakout", "trend_pullback", "event_continuation"), F.col("pattern"))
    hint = F.when(F.col("default_setup") == "event_continuation", F.col("default_setup")).otherwise(F.coalesce(shown, "default_setup"))
    return j.select(*requests.columns, F.coalesce("screened", F.lit("fail")).alias("screening_status"), hint.alias("setup_hint"), "name", "gates", "trend_state", "participation_state", "extension_state", "momentum_pct", "chase_risk", "buyability", "grade", F.col("close_qfq").alias("analysis_price"), F.col("close_raw").alias("execution_price"), F.col("close_raw").isNotNull().alias("execution_price_known"), F.coalesce("events", F.lit(0)).alias("events"), "first_event", "last_event", "event_required", "default_setup", "setups", "max_holding", "min_reward_risk")


def event_leads(found: DataFrame, events: DataFrame) -> DataFrame:
    """(evidence_id, event_id, event_date, available_at): the known events of each evidence's symbol, a row each."""
    return found.select("evidence_id", "symbol").join(events, "symbol").select("evidence_id", "event_id", "event_date", F.col("retrieved_at").alias("available_at"))


def setup_gates(assessed: DataFrame) -> DataFrame:
    """`setup` and `setup_gates` of evidence joined with its assessment: a supplied status counts where a setup was
    supplied at all, else the screen's own gate is inherited."""

    def inherited(field: str, gate: str) -> Column:
        own = F.when(F.col(field).isin(*STATUSES), F.col(field)).otherwise("unknown")
        return F.when(F.col("setup_supplied"), own).otherwise(F.coalesce(F.col("gates")[gate], F.lit("unknown")))

    text = lambda c: F.when(_given(c), F.trim(F.col(c)))
    setup = F.coalesce(F.when(F.col("setup_supplied"), text("setup_type")), text("setup_hint"), F.col("default_setup"))
    rule = lambda own, other: F.when(F.coalesce(F.when(F.col("setup_supplied"), text(own)), text(other)).isNotNull(), "pass").otherwise("unknown")
    statuses = [
        F.when(F.array_contains("setups", setup), "pass").otherwise("fail"),
        rule("hypothesis", "thesis"),
        inherited("relative_strength_status", "relative_strength"),
        inherited("trend_structure_status", "trend_structure"),
        inherited("participation_status", "participation"),
        inherited("extension_status", "price_extension"),
        rule("trigger_rule", "entry_trigger"),
        rule("invalidation_rule", "price_invalidation"),
        rule("valid_until", "time_invalidation"),
        F.lit("pass"),
    ]
    return assessed.withColumn("setup", setup).withColumn("setup_gates", _gate_map(SETUP_GATES, statuses))


def decide(found: DataFrame, assessments: DataFrame) -> DataFrame:
    """Evidence with its assessment: the gates of setup, research and plan as maps, the investor's controls, `errors` in
    order (rows with errors are kept and never ready), and whether the decision is ready.

    Assessments have evidence_id, assessed_symbol, assessed_strategy, assessed_as_of; setup_supplied, setup_type,
    hypothesis, trigger_rule, invalidation_rule, valid_until and the four setup statuses; event_status, sources,
    valid_sources, source_errors; expectation, expectation_thesis; priced_in, priced_thesis; crowding, crowding_thesis;
    counter_thesis, counter_trigger; the plan's action, maximum_holding, expected_upside_pct, effective_downside_pct and
    `PLAN_FIELDS`; decision_frequency and `LIMITS`; confidence and thesis."""
    j = setup_gates(found.join(assessments, "evidence_id"))
    burden = lambda c, thesis: F.when(F.col(c).isin("low", "moderate") & _given(thesis), "pass").when(F.col(c) == "high", "review").otherwise("unknown")
    research = [
        F.when(F.col("event_status") == "verified", "pass").when(~F.col("event_required"), "not_required").otherwise("unknown"),
        F.when(F.col("sources") == 0, F.when(F.col("event_required"), "unknown").otherwise("not_required")).when((F.col("valid_sources") > 0) & (F.col("source_errors") == 0), "pass").otherwise("fail"),
        F.when((F.col("expectation") == "positive") & _given("expectation_thesis"), "pass").when(F.col("expectation") == "neutral", "review").when(F.col("expectation") == "negative", "fail").otherwise("unknown"),
        burden("priced_in", "priced_thesis"),
        burden("crowding", "crowding_thesis"),
        F.when(_given("counter_thesis") & _given("counter_trigger"), "pass").otherwise("unknown"),
    ]
    complete = F.lit(True)
    for c in PLAN_FIELDS:
        complete = complete & _given(c)
    up, down = F.col("expected_upside_pct"), F.col("effective_downside_pct")
    odds = F.when(down > 0, up / down)
    plan = [
        F.when(complete, "pass").otherwise("unknown"),
        F.when((F.col("maximum_holding") > 0) & (F.col("maximum_holding") <= F.col("max_holding")), "pass").otherwise("fail"),
        F.when(odds >= F.col("min_reward_risk"), "pass").when(odds.isNotNull(), "review").otherwise("unknown"),
    ]
    lacking = F.lit(False)
    for c in LIMITS:
        lacking = lacking | (F.coalesce(F.col(c), F.lit(0.0)) <= 0)
    frequency = F.when(_given("decision_frequency"), F.trim("decision_frequency")).otherwise(FREQUENCY)
    controls = F.when(F.col("action") == "cash", "not_required").when(frequency != FREQUENCY, "fail").when(lacking, "unknown").otherwise("pass")
    out = j.withColumn("research_gates", _gate_map(RESEARCH_GATES, research)).withColumn("plan_gates", _gate_map(PLAN_GATES, plan)).withColumn("controls", controls).withColumn("reward_risk", odds)
    worst = lambda c: aggregate(F.map_values(c))
    out = out.withColumn("technical", worst("setup_gates")).withColumn("research", worst("research_gates")).withColumn("plan", worst("plan_gates"))
    ready = F.forall(F.array("screening_status", "technical", "research", "plan"), lambda s: s == "pass") & F.col("controls").isin("pass", "not_required")
    differs = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    errors = reasons(
        (differs("assessed_symbol", "symbol"), "symbol_differs"),
        (differs("assessed_strategy", "strategy"), "strategy_differs"),
        (differs("assessed_as_of", "as_of"), "as_of_differs"),
        (F.col("source_errors") > 0, "sources_invalid"),
        (outside("action", ACTIONS), "action_unknown"),
        ((F.col("action") == "priority_action") & ~ready, "priority_not_ready"),
        (outside("confidence", CONFIDENCES), "confidence_unknown"),
        (~_given("thesis"), "thesis_missing"),
    )
    return out.withColumn("errors", errors).withColumn("decision_ready", ready & (F.size("errors") == 0))


def compact_decision(decided: DataFrame) -> DataFrame:
    """The index of recommendations: no assessment, evidence or gates; of cash only that it was chosen."""
    held = F.col("action") != "cash"
    return decided.filter(F.size("errors") == 0).select("evidence_id", "as_of", "strategy", "action", *[F.when(held, F.col(c)).alias(c) for c in ("symbol", "setup", "confidence", "reward_risk")], "screening_status", F.col("technical").alias("technical_pattern"), "research", "plan", "controls", "decision_ready")
