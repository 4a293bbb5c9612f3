"""Typed tables, payload tables, exports and the run log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.ingest import RULES, ledger_backfill, merge_upsert, route, routed
from tidemark.sources.asof import parsed_date
from tidemark.sources.scratch import written


@dataclass(frozen=True)
class Spec:
    """Key and typed columns of a table; the newer non-null value wins, `overwrite` columns even when null."""

    keys: tuple[str, ...]
    columns: dict[str, str]
    overwrite: tuple[str, ...] = field(default=())
    payload: bool = False


# The stored tables and their keys.
SPECS = {
    "bars": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "open_raw": "double", "high_raw": "double", "low_raw": "double", "close_raw": "double", "close_qfq": "double", "adj_factor": "double", "volume": "double", "amount": "double"}, ("close_qfq", "volume")),
    "valuation": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "circ_mv": "double", "turnover_rate": "double"}),
    "financials": Spec(("symbol", "end_date"), {"symbol": "string", "end_date": "date", "ann_date": "date", "revenue": "double"}),
    "metadata": Spec(("symbol",), {"symbol": "string", "name": "string", "industry": "string", "market": "string", "list_date": "date", "list_status": "string", "delist_date": "date"}, ("name", "industry", "market", "list_date")),
    "calendar": Spec(("exchange", "cal_date"), {"exchange": "string", "cal_date": "date", "is_open": "int", "pretrade_date": "date"}),
    "index_daily": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "open": "double", "close": "double"}),
    "index_daily_basic": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "total_mv": "double", "pe": "double", "pb": "double"}),
    "classification": Spec(("src", "index_code"), {"src": "string", "index_code": "string", "level": "string", "parent_code": "string", "industry_name": "string"}),
    "index_member": Spec(("index_code", "con_code", "in_date"), {"index_code": "string", "con_code": "string", "in_date": "date", "out_date": "date"}),
    "index_weight": Spec(("index_code", "con_code", "trade_date"), {"index_code": "string", "con_code": "string", "trade_date": "date", "weight": "double"}),
    "market_info": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "com_count": "double", "total_mv": "double", "amount": "double"}),
    "market_flow": Spec(("trade_date",), {"trade_date": "date", "net_amount": "double"}),
    "margin": Spec(("exchange", "trade_date"), {"exchange": "string", "trade_date": "date", "rzye": "double", "rqye": "double"}),
    "stock_flow": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date", "net_mf_amount": "double"}, payload=True),
    "limit_events": Spec(("symbol", "trade_date", "limit_type"), {"symbol": "string", "trade_date": "date", "limit_type": "string", "pct_chg": "double"}, payload=True),
    "chips": Spec(("symbol", "trade_date", "price"), {"symbol": "string", "trade_date": "date", "price": "double", "percent": "double"}, payload=True),
    "factor_daily": Spec(("symbol", "trade_date"), {"symbol": "string", "trade_date": "date"}, payload=True),
    "visits": Spec(("symbol", "surv_date", "org_name"), {"symbol": "string", "surv_date": "date", "org_name": "string", "ann_date": "date"}, payload=True),
    "corporate_events": Spec(("dataset", "symbol", "event_date", "event_key"), {"dataset": "string", "symbol": "string", "event_date": "date", "event_key": "string"}, payload=True),
    "sector_master": Spec(("provider", "sector_code"), {"provider": "string", "sector_code": "string", "sector_name": "string", "sector_type": "string"}),
    "sector_daily": Spec(("provider", "sector_code", "trade_date"), {"provider": "string", "sector_code": "string", "trade_date": "date", "close": "double", "pct_chg": "double", "vol": "double", "amount": "double"}),
    "sector_flow": Spec(("provider", "sector_code", "trade_date"), {"provider": "string", "sector_code": "string", "trade_date": "date", "net_amount": "double"}),
    "sector_member": Spec(("dataset", "index_code", "con_code", "trade_date"), {"dataset": "string", "index_code": "string", "con_code": "string", "trade_date": "date", "out_date": "date"}),
}


def conform(rows: DataFrame, spec: Spec) -> DataFrame:
    """Rows cast to the table's columns, absent ones null, text trimmed with blank as null, blank keys dropped."""
    out = []
    for name, kind in spec.columns.items():
        if name not in rows.columns:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "date" and dict(rows.dtypes)[name] == "string":
            out.append(parsed_date(F.col(name)).alias(name))
        elif kind == "string":
            text = F.trim(F.col(name).cast("string"))
            out.append(F.when(text != "", text).alias(name))
        else:
            out.append(F.col(name).try_cast(kind).alias(name))
    if spec.payload:
        out.append(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("payload_json"))
    return rows.select(*out).dropna(subset=list(spec.keys))


# The names under which endpoints give a table's columns, if not by their own.
FIELD_ALIASES = {"symbol": ("ts_code",), "exchange": ("exchange_id",), "limit_type": ("limit",), "event_date": ("ann_date", "trade_date", "end_date", "float_date")}


def typed_rows(rows: DataFrame, spec: Spec) -> DataFrame:
    """The table's columns and `batch_row` from landed rows (payload as a map of texts): days and numbers read, text
    trimmed with blank as null, rows without a key left out."""
    filled = lambda name: F.when(F.trim(F.col("payload")[name]) != "", F.trim(F.col("payload")[name]))
    cols = []
    for name, kind in spec.columns.items():
        text = F.coalesce(*[filled(n) for n in (name, *FIELD_ALIASES.get(name, ()))])
        if name == "dataset":
            text = F.col("endpoint")
        elif name == "event_key":
            text = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))), 256)
        elif name == "limit_type":
            text = F.coalesce(text, F.col("endpoint"))
        cols.append((parsed_date(text) if kind == "date" else text if kind == "string" else text.try_cast(kind)).alias(name))
    if spec.payload:
        cols.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("payload_json"))
    return rows.select(*cols, "batch_row").dropna(subset=list(spec.keys))


def route_all(landing: DataFrame, rules: list[tuple[str, set[str], set[str], str]] = RULES, existing: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts): landed rows (endpoint, batch_row, payload) of all endpoints, read once and split by rule into the
    typed tables, each merged with what there was of it; and of each endpoint and target how many rows there were.

    The split is written, a folder a target, so that every table reads its own rows only."""
    split = written(routed(landing, rules).select("endpoint", "batch_row", "payload", "target"), "routed", "target")
    tables = {}
    for name in dict.fromkeys(target for *_, target in rules):
        spec = SPECS[name]
        new = typed_rows(split.filter(F.col("target") == name), spec)
        one = merge_upsert(new.limit(0), new, list(spec.keys), spec.overwrite, "batch_row")
        old = (existing or {}).get(name)
        tables[name] = one if old is None else merge_upsert(old, one, list(spec.keys), spec.overwrite)
    return tables, split.groupBy("endpoint", "target").agg(F.count("*").alias("rows"))


def upsert(existing: DataFrame | None, rows: DataFrame, spec: Spec) -> DataFrame:
    """The table after new rows, one row a key."""
    new = conform(rows, spec)
    return merge_upsert(new.limit(0) if existing is None else existing, new, list(spec.keys), spec.overwrite)


def persist(rows: DataFrame, endpoint: str, rules: list[tuple[str, set[str], set[str], str]], existing: DataFrame | None = None) -> tuple[str | None, DataFrame | None]:
    """Target table of an endpoint's rows by the first rule that fits, and that table after the rows."""
    target = route(rules, endpoint, rows.columns)
    return (None, None) if target is None else (target, upsert(existing, rows, SPECS[target]))


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Whole-frame write as csv with a header, or as JSON records with ISO dates."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def exported(spark: SparkSession, path: str, schema: StructType, kind: str = "csv") -> DataFrame:
    """What `export` wrote, read back under the schema of the frame that was written. In csv an empty text is a null."""
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.schema(schema).json(path)


# What a logged run has besides its payload, the operation of a saved recommendation, the length of an id.
RUN_FIELDS = ("operation", "profile", "benchmark", "requested_as_of", "start_date", "end_date", "schema_version", "strategy_contract", "symbol", "parent_run_id")
RECOMMENDATION, ID_LENGTH = "short_confirmation", 24


def run_log(runs: DataFrame, payload: list[str]) -> DataFrame:
    """Runs (created_at and any of `RUN_FIELDS`) with an id hashed from their time and payload; absent fields are null,
    the schema version 1."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]))
    field = lambda c: F.col(c) if c in runs.columns else F.lit(1 if c == "schema_version" else None).cast("int" if c == "schema_version" else "string").alias(c)
    kept = [c for c in runs.columns if c not in RUN_FIELDS]
    logged = runs.select(*kept, *[field(c) for c in RUN_FIELDS], body.alias("payload_json"))
    return logged.withColumn("run_id", F.substring(F.sha2(F.concat_ws(":", F.col("created_at").cast("string"), "payload_json"), 256), 1, ID_LENGTH))


def append_runs(logged: DataFrame, path: str, outcomes: DataFrame | None = None) -> None:
    """Add runs, and outcome rows with their run_id, to the log at `path`; what is there stays as it is."""
    logged.write.mode("append").partitionBy("operation").parquet(f"{path}/runs")
    if outcomes is not None:
        outcomes.write.mode("append").parquet(f"{path}/outcomes")


def load_run(runs: DataFrame, run_id: str, expected: tuple[str, ...] = ()) -> DataFrame:
    """The run of an id; an error if there is none, or if its operation is not one of those expected."""
    one = runs.filter(F.col("run_id") == run_id)
    found = [r[0] for r in one.select("operation").limit(2).collect()]
    if not found:
        raise ValueError(f"no run {run_id}")
    if expected and found[0] not in expected:
        raise ValueError(f"run {run_id} is {found[0]}, not one of {', '.join(expected)}")
    return one


def list_runs(runs: DataFrame, operation: str, limit: int) -> DataFrame:
    """Newest runs of an operation, ties by id."""
    return runs.filter(F.col("operation") == operation).orderBy(F.col("created_at").desc(), "run_id").limit(limit)


def list_recommendations(runs: DataFrame, symbol: str | None = None, limit: int = 50) -> DataFrame:
    """Newest saved recommendations, of one symbol if asked, with what their payloads say; a payload that is no JSON says
    nothing."""
    asked = runs if symbol is None else runs.filter(F.col("symbol") == symbol)
    said = lambda path, name: F.get_json_object("payload_json", path).alias(name)
    return list_runs(asked, RECOMMENDATION, max(1, limit)).select(
        F.col("run_id").alias("recommendation_run_id"),
        "symbol",
        "strategy_contract",
        F.col("requested_as_of").alias("as_of"),
        said("$.recommendation.action_label", "action_label"),
        said("$.decision_ready", "decision_ready"),
        said("$.decision_snapshot_saved", "decision_snapshot_saved"),
        "created_at",
    )


def run_chains(runs: DataFrame) -> DataFrame:
    """(run_id, root_run_id, depth): the first run that each run goes back to over its parents, and how many steps. A
    parent that is not in the log ends the chain before it; runs whose parents go round in a circle have no root. Steps
    double each round, so a chain of a thousand runs takes ten joins."""
    log = runs.select("run_id", "parent_run_id").dropDuplicates(["run_id"])
    known = log.select(F.col("run_id").alias("parent_run_id"), F.lit(True).alias("here"))
    links = log.join(known, "parent_run_id", "left").select("run_id", F.when(F.col("here"), F.col("parent_run_id")).alias("up"))
    chains = written(links.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")).withColumn("root", F.coalesce("up", "run_id")), "chains")
    for _ in range(int(max(2, chains.count())).bit_length() + 1):
        if chains.filter("up is not null").isEmpty():
            break
        next_ = chains.select(F.col("run_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("far"))
        open_ = chains.filter("up is not null").join(next_, "up").select("run_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("far").alias("root"))
        chains = written(open_.unionByName(chains.filter("up is null")), "chains")
    done = F.col("up").isNull()
    return chains.select("run_id", F.when(done, F.col("root")).alias("root_run_id"), F.when(done, F.col("depth")).alias("depth"))


def run_outcomes(runs: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Outcome rows as a child table of the runs they come from: `run_id` of the parent first."""
    return runs.select("run_id", *by).join(outcomes, by).select("run_id", *outcomes.columns)


def persist_with_ledger(rows: DataFrame, dataset: str, endpoint: str, rules: list[tuple[str, set[str], set[str], str]], existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(ledger, typed table or null, counts) of an endpoint's rows, which have symbol, event_date, retrieved_at and
    batch_row besides their payload: the ledger always, the typed table if a rule fits; and how many rows each took."""
    payload = [c for c in rows.columns if c not in ("symbol", "event_date", "retrieved_at", "batch_row")]
    told = ledger_backfill(rows.withColumn("dataset", F.lit(dataset)), payload)
    target, typed = persist(rows.drop("retrieved_at", "batch_row"), endpoint, rules, existing)
    n = F.count("*")
    counts = told.agg(n.alias("ledger_rows")).crossJoin(typed.agg(n.alias("typed_rows")) if typed is not None else rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("typed_rows")))  # a row each
    return told, typed, counts.select(F.lit(target).cast("string").alias("target"), "ledger_rows", "typed_rows")
