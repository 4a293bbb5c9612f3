"""Merging of new rows, the revision ledger, coverage and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.asof import parsed_date


def canonicalize(rows: DataFrame, aliases: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Each target column from the first alias present; rows with a blank key drop out."""
    cols = []
    for target, names in aliases.items():
        found = [F.col(n) for n in names if n in rows.columns]
        cols.append((F.coalesce(*found) if found else F.lit(None)).alias(target))
    out = rows.select(*cols)
    for k in keys:
        out = out.filter(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    return out


def melt(wide: DataFrame, date: str, field: str) -> DataFrame:
    """Wide (date by symbol) into long (date, symbol, field), nulls left out."""
    cols = [c for c in wide.columns if c != date]
    return wide.unpivot([date], cols, "symbol", field).filter(F.col(field).isNotNull())


def merge_fields(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Long frames of one field each as one frame: a full outer join on the keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full_outer")
    return out


def merge_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """Newer non-null values win field by field; `overwrite` fields take the newer value even when null. Several rows
    of a key in one batch follow `row`, a column of both that tells the later one; without it, their values."""
    fields = [c for c in existing.columns if c not in keys and c != row]
    place = F.col(row) if row else F.lit(0)
    both = existing.select(*keys, *fields, F.struct(F.lit(0), place).alias("_o")).unionByName(incoming.select(*keys, *fields, F.struct(F.lit(1), place).alias("_o")))
    # the value itself settles what the order leaves open
    at = lambda c: F.struct("_o", c)
    pick = lambda c: F.max(at(c))[c] if c in overwrite else F.max(F.when(F.col(c).isNotNull(), at(c)))[c]
    return both.groupBy(*keys).agg(*[pick(c).alias(c) for c in fields])


# Fields that identify a record, those of them that date it, and announcement days that stand in for a date.
IDENTITY = ("ts_code", "trade_date", "end_date", "report_date", "surv_date", "float_date", "cal_date", "month", "date", "index_code", "con_code", "exchange", "org_name", "holder_name", "holder_type", "report_type", "comp_type", "end_type")
DATING = ("trade_date", "end_date", "report_date", "surv_date", "float_date", "cal_date", "month", "date")
ANNOUNCED = ("ann_date", "f_ann_date")


def business_key(dataset: Column, fields: list[str], row_hash: Column) -> Column:
    """Hash of the dataset and the identity fields that are not blank, dates in one form; an announcement day joins only
    where no other date is given; without any of them the row's own hash, marked `row:`."""
    text = lambda f: F.when(F.trim(F.col(f).cast("string")) != "", F.trim(F.col(f).cast("string")))
    day = lambda f: F.coalesce(F.date_format(parsed_date(text(f)), "yyyy-MM-dd"), text(f))
    have = [f for f in IDENTITY if f in fields]
    values = {f: day(f) if f in DATING else text(f) for f in have}
    dated = [values[f] for f in have if f in DATING]
    stand_in = [day(f) for f in ANNOUNCED if f in fields]
    if stand_in:
        undated = F.coalesce(*dated).isNull() if dated else F.lit(True)
        values["ann_date"] = F.when(undated, F.coalesce(*stand_in))
    if not values:
        return F.concat(F.lit("row:"), row_hash)
    # to_json leaves nulls out; names are in order
    identity = F.to_json(F.struct(dataset.alias("dataset"), F.struct(*[v.alias(f) for f, v in sorted(values.items())]).alias("identity")))
    return F.when(F.coalesce(*values.values()).isNull(), F.concat(F.lit("row:"), row_hash)).otherwise(F.sha2(identity, 256))


def row_hash(fields: list[str]):
    """Hash of the canonical JSON of all fields, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


# Fields that say when a record became available, the first one filled deciding, and flags of a revision.
AVAILABLE = ("f_ann_date", "ann_date", "report_date", "surv_date", "float_date", "trade_date", "cal_date")
REVISED = ("1", "true", "yes", "updated", "revised")
KEY = ("dataset", "business_key")


def availability(payload: list[str], retrieved_at: Column) -> Column:
    """When a record became available: the first dated field that is filled, else its retrieval. A field that is filled
    with something that is no day leaves it unknown (null), so that no cutoff ever admits the record."""
    text = lambda f: F.trim(F.col(f).cast("string"))
    out = retrieved_at
    for f in reversed([f for f in AVAILABLE if f in payload]):
        out = F.when(F.coalesce(text(f), F.lit("")) != "", parsed_date(text(f)).cast("timestamp")).otherwise(out)
    return out


def looks_revised(payload: list[str]) -> Column:
    flag = F.lower(F.trim(F.col("update_flag").cast("string"))) if "update_flag" in payload else F.lit("")
    return F.coalesce(flag, F.lit("")).isin(*REVISED)


def _arrivals(observations: DataFrame, payload: list[str]) -> DataFrame:
    """Distinct payloads of each key with their first and last arrival (`_first`, `_last`)."""
    seen = observations.withColumn("row_hash", row_hash(payload)).withColumn("_at", F.struct("retrieved_at", "batch_row"))
    return seen.groupBy(*KEY, "row_hash").agg(
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
        F.min_by("symbol", "_at").alias("symbol"),
        F.min_by("event_date", "_at").alias("event_date"),
        *[F.min_by(p, "_at").alias(p) for p in payload],
    )


def _in_order(each: DataFrame) -> DataFrame:
    """`_place`, from 1, of each payload by first arrival within its key, and `_latest`, the key's last arrival. Places are
    counted within days and added up over them, so a key with very many payloads is spread over tasks."""
    each = each.withColumn("_day", F.to_date("_first.retrieved_at"))
    inside = Window.partitionBy(*KEY, "_day").orderBy("_first")
    days = each.groupBy(*KEY, "_day").agg(F.count("*").alias("_n"), F.max("_last").alias("_end"))
    whole = Window.partitionBy(*KEY)
    before = F.sum("_n").over(whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*KEY, "_day", F.coalesce(before, F.lit(0)).alias("_before"), F.max("_end").over(whole).alias("_latest"))
    placed = each.withColumn("_within", F.row_number().over(inside)).join(days, [*KEY, "_day"])
    return placed.withColumn("_place", (F.col("_within") + F.col("_before")).cast("int")).drop("_day", "_within", "_before")


def _available_at(payload: list[str]) -> Column:
    return F.when((F.col("revision") > 1) | looks_revised(payload), F.col("first_seen_at")).otherwise(availability(payload, F.col("first_seen_at")))


def ledger(observations: DataFrame, payload: list[str]) -> DataFrame:
    """Revisions of each (dataset, business_key): one row per distinct payload in order of first arrival, first and last
    seen, and whether it is the payload of the last arrival. A payload seen again becomes current without a new revision.
    A first revision is available from the day its fields say (`availability`), later ones and those flagged as revised
    from when they were first seen."""
    each = _in_order(_arrivals(observations, payload))
    out = each.select(
        *KEY,
        "row_hash",
        F.col("_first.retrieved_at").alias("first_seen_at"),
        F.col("_last.retrieved_at").alias("last_seen_at"),
        "symbol",
        "event_date",
        *payload,
        F.col("_place").alias("revision"),
        (F.col("_last") == F.col("_latest")).alias("is_current"),
    )
    return out.withColumn("available_at", _available_at(payload))


def ledger_append(existing: DataFrame, batch: DataFrame, payload: list[str]) -> DataFrame:
    """The ledger rows of the keys that a batch of observations names, after the batch; rows of other keys are neither read
    nor returned. New payloads get the revisions after the highest of their key, known ones are seen again, and the batch's
    last arrival of a key is its current row. Batches count in the order they are appended, whatever their retrieval
    times; appending one again changes nothing."""
    new = _in_order(_arrivals(batch, payload)).withColumn("_now", F.col("_last") == F.col("_latest"))
    keys = new.select(*KEY).distinct()
    old = existing.join(keys, [*KEY], "left_semi")
    top = old.groupBy(*KEY).agg(F.max("revision").alias("_top"))
    known = old.select(*KEY, "row_hash", F.lit(True).alias("_known"))
    marked = new.join(known, [*KEY, "row_hash"], "left")
    # places of the new payloads only
    fresh = _in_order(marked.filter("_known is null").drop("_known", "_place", "_latest", "_now"))
    fresh = fresh.drop("_latest").join(marked.select(*KEY, "row_hash", "_now"), [*KEY, "row_hash"]).join(top, [*KEY], "left")
    inserted = fresh.select(
        *KEY,
        "row_hash",
        F.col("_first.retrieved_at").alias("first_seen_at"),
        F.col("_last.retrieved_at").alias("last_seen_at"),
        "symbol",
        "event_date",
        *payload,
        (F.col("_place") + F.coalesce("_top", F.lit(0))).cast("int").alias("revision"),
        F.col("_now").alias("is_current"),
    ).withColumn("available_at", _available_at(payload))
    again = marked.filter("_known").select(*KEY, "row_hash", F.col("_last.retrieved_at").alias("_seen"), "_now")
    kept = old.join(again, [*KEY, "row_hash"], "left").withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).withColumn("is_current", F.coalesce("_now", F.lit(False)))
    return kept.select(inserted.columns).unionByName(inserted)


def ledger_backfill(legacy: DataFrame, payload: list[str]) -> DataFrame:
    """The ledger of stored rows (dataset, symbol, event_date, retrieved_at, batch_row and payload) whose keys, revisions
    and availability are computed anew, in order of arrival."""
    keyed = legacy.withColumn("business_key", business_key(F.col("dataset"), payload, row_hash(payload)))
    return ledger(keyed, payload)


def ledger_query(rows: DataFrame, datasets: list[str] | None = None, symbols: list | None = None, start: str | None = None, end: str | None = None, limit: int = 200, **cutoffs) -> DataFrame:
    """`ledger_read` of some datasets, symbols and event days, newest event first, then dataset and symbol, as many rows
    as `limit`."""
    for column, values in (("dataset", datasets), ("symbol", symbols)):
        rows = rows if values is None else rows.filter(F.col(column).isin(values))
    rows = rows if start is None else rows.filter(F.col("event_date") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.filter(F.col("event_date") <= F.lit(end).cast("date"))
    return ledger_read(rows, **cutoffs).orderBy(F.col("event_date").desc(), "dataset", "symbol", "business_key", F.col("revision").desc()).limit(limit)


def ledger_read(rows: DataFrame, available_as_of: str | None = None, observed_as_of: str | None = None, revisions: bool = False) -> DataFrame:
    """Current rows; or, given a cutoff, the highest revision known then of each key, or all of them."""
    if available_as_of is None and observed_as_of is None:
        return rows if revisions else rows.filter("is_current")
    known = rows
    if available_as_of is not None:
        known = known.filter(F.to_date("available_at") <= F.lit(available_as_of).cast("date"))
    if observed_as_of is not None:
        known = known.filter(F.col("first_seen_at") <= F.lit(observed_as_of).cast("timestamp"))
    if revisions:
        return known
    w = Window.partitionBy("dataset", "business_key").orderBy(F.col("revision").desc(), F.col("first_seen_at").desc())
    return known.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def date_coverage(calendar: DataFrame, raw: DataFrame, normalized: DataFrame, start: str, end: str, completed: str | None = None) -> DataFrame:
    """One row: status, open days expected up to the last completed session, stored ones, and missing ones with their
    first and last day. Where the calendar lacks a day of the range, the status is `unknown` and the rest null."""
    last = min(end, completed) if completed else end
    inside = calendar.filter(F.col("cal_date").between(start, end))
    whole = inside.agg((F.countDistinct("cal_date") == F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1).alias("whole"))
    want = inside.filter((F.col("is_open") == 1) & (F.col("cal_date") <= F.lit(last).cast("date"))).select("cal_date").distinct()
    have = raw.select(F.col("trade_date").alias("cal_date")).union(normalized.select("trade_date")).distinct().withColumn("here", F.lit(1))
    lacks = F.when(F.col("here").isNull(), F.col("cal_date"))
    found = want.join(have, "cal_date", "left").agg(F.count("*").alias("expected"), F.count("here").alias("stored"), F.count(lacks).alias("missing"), F.min(lacks).alias("first_missing"), F.max(lacks).alias("last_missing"))
    both = whole.crossJoin(found)  # a row each
    status = F.when(~F.col("whole"), "unknown").when(F.col("missing") == 0, "complete").otherwise("incomplete")
    return both.select(status.alias("status"), *[F.when(F.col("whole"), F.col(c)).alias(c) for c in ("expected", "stored", "missing", "first_missing", "last_missing")])


def business_days(days: DataFrame, date: str = "cal_date") -> DataFrame:
    return days.filter(~F.dayofweek(date).isin(1, 7))


def symbols_alive(metadata: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols listed by the end of the range and not delisted before its start."""
    listed = F.col("list_date").isNull() | (F.col("list_date") <= F.lit(end).cast("date"))
    return metadata.filter(listed & (F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(start).cast("date")))).select("symbol").distinct()


def incremental_window(tables: list[DataFrame], today: str, date: str = "trade_date") -> DataFrame:
    """Day after the oldest of the tables' last days, to today; no row if that lies in the future."""
    lasts = None
    for t in tables:
        one = t.agg(F.max(date).alias("last"))
        lasts = one if lasts is None else lasts.unionByName(one)
    return lasts.agg(F.date_add(F.min("last"), 1).alias("start_date")).select("start_date", F.lit(today).cast("date").alias("end_date")).filter("start_date <= end_date")


def route(rules: list[tuple[str, set[str], set[str], str]], endpoint: str, columns: list[str]) -> str | None:
    """Target of the first rule (name, endpoints, required columns, target) that fits."""
    return next((target for _, ends, need, target in rules if endpoint in ends and need <= set(columns)), None)


# Which endpoints' rows, with which fields, go to which table; the first rule that fits decides.
RULES = [
    ("valuation", {"daily_basic"}, {"ts_code", "trade_date"}, "valuation"),
    ("financials", {"fina_indicator"}, {"ts_code", "end_date"}, "financials"),
    ("metadata", {"stock_basic"}, {"ts_code", "name", "industry", "market", "list_date"}, "metadata"),
    ("calendar", {"trade_cal"}, {"exchange", "cal_date"}, "calendar"),
    ("index daily", {"index_daily"}, {"ts_code", "trade_date"}, "index_daily"),
    ("index basic", {"index_dailybasic"}, {"ts_code", "trade_date"}, "index_daily_basic"),
    ("classification", {"index_classify"}, {"src", "index_code"}, "classification"),
    ("index members", {"index_member"}, {"index_code", "con_code", "in_date"}, "index_member"),
    ("index weights", {"index_weight"}, {"index_code", "con_code", "trade_date"}, "index_weight"),
    ("market info", {"daily_info"}, {"trade_date", "ts_code"}, "market_info"),
    ("market flow", {"moneyflow_mkt_dc"}, {"trade_date", "net_amount"}, "market_flow"),
    ("margin", {"margin"}, {"trade_date", "exchange_id"}, "margin"),
    ("stock flow", {"moneyflow", "moneyflow_ths", "moneyflow_dc"}, {"ts_code", "trade_date"}, "stock_flow"),
    ("limit events", {"limit_list_d", "limit_step", "kpl_list", "kpl_stock_rank"}, {"ts_code", "trade_date"}, "limit_events"),
    ("chips", {"cyq_chips", "cyq_perf"}, {"ts_code", "trade_date", "price"}, "chips"),
    ("factors", {"stk_factor", "stk_factor_pro"}, {"ts_code", "trade_date"}, "factor_daily"),
    ("visits", {"stk_surv"}, {"ts_code", "surv_date"}, "visits"),
    ("corporate events", {"repurchase", "pledge_detail", "stk_holdertrade", "block_trade", "namechange", "share_float"}, {"ts_code"}, "corporate_events"),
]


def routed(landing: DataFrame, rules: list[tuple[str, set[str], set[str], str]] = RULES) -> DataFrame:
    """Landed rows (endpoint, payload as a map of texts, and others) of all endpoints with `target`, the table of the first
    rule that fits each, or null: one expression over one scan."""
    target = F.lit(None).cast("string")
    for _, ends, need, name in reversed(rules):
        fits = F.col("endpoint").isin(*sorted(ends))
        for field in sorted(need):
            fits = fits & F.coalesce(F.map_contains_key("payload", F.lit(field)), F.lit(False))
        target = F.when(fits, name).otherwise(target)
    return landing.withColumn("target", target)


# Where sector columns come from if they are not there by name, and what each kind of table keeps.
SECTOR_ALIASES = {"sector_code": ("ts_code", "index_code", "code"), "sector_name": ("name", "ts_name", "industry_name", "industry"), "sector_type": ("type", "category", "level"), "exchange": ("market",)}
SECTOR_TABLES = {
    "master": (("provider", "sector_code"), {}, ("sector_name", "sector_type", "exchange"), ()),
    "daily": (("provider", "sector_code", "trade_date"), {"trade_date": ("date",), "pct_chg": ("pct_change", "change_pct"), "vol": ("volume",)}, ("sector_name",), ("open", "high", "low", "close", "pct_chg", "vol", "amount", "turnover_rate")),
    "flow": (("provider", "sector_code", "trade_date"), {"trade_date": ("date",), "pct_chg": ("pct_change",), "lead_stock_pct_chg": ("pct_change_stock",)}, ("sector_name", "lead_stock"), ("pct_chg", "lead_stock_pct_chg", "company_num", "net_buy_amount", "net_sell_amount", "net_amount")),
}


def sector_rows(kind: str, provider: str, rows: DataFrame) -> DataFrame:
    """Rows of a sector master, daily or flow table: columns by name or alias, days and numbers read, rows without a key
    left out."""
    keys, more, texts, numbers = SECTOR_TABLES[kind]
    aliases = {**SECTOR_ALIASES, **more}

    def found(name: str) -> Column:
        source = next((c for c in (name, *aliases.get(name, ())) if c in rows.columns), None)
        return F.col(source).cast("string") if source else F.lit(None).cast("string")

    day = lambda c: parsed_date(c) if kind != "master" else c
    cols = [F.lit(provider).alias("provider"), F.trim(found("sector_code")).alias("sector_code")]
    cols += [day(found("trade_date")).alias("trade_date")] if "trade_date" in keys else []
    out = rows.select(*cols, *[found(c).alias(c) for c in texts], *[found(c).try_cast("double").alias(c) for c in numbers])
    for k in keys:
        out = out.filter(F.col(k).isNotNull())
    return out.filter("sector_code <> ''")


def membership_rows(dataset: str, rows: DataFrame, retrieved_at: Column) -> DataFrame:
    """Rows of a sector membership table: (dataset, index_code, con_code, trade_date, in_date, out_date, name). A table
    without trade_date is a snapshot of the day it was retrieved."""
    have = lambda *names: next((F.col(c).cast("string") for c in names if c in rows.columns), F.lit(None).cast("string"))
    day = parsed_date(have("trade_date")) if "trade_date" in rows.columns else retrieved_at.cast("date")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(F.lit(dataset).alias("dataset"), blank(have("index_code", "ts_code")).alias("index_code"), blank(have("con_code", "ts_code")).alias("con_code"), day.alias("trade_date"), parsed_date(have("in_date")).alias("in_date"), parsed_date(have("out_date")).alias("out_date"), have("name", "con_name").alias("name"))
