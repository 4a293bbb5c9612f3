"""Point-in-time reads and availability audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_range(rows: DataFrame, start: str, end: str, symbols: list | None = None, date: str = "trade_date") -> DataFrame:
    """Inclusive date range and optional symbols; both reach the scan."""
    out = rows.filter(F.col(date).between(start, end))
    return out if symbols is None else out.filter(F.col("symbol").isin(symbols))


def read_matrix(rows: DataFrame, start: str, end: str, symbols: list | None = None, date: str = "trade_date") -> DataFrame:
    """Closes and volumes only of a range, one row a symbol and date; the other columns are never scanned."""
    return read_range(rows.select("symbol", date, "close_qfq", "volume"), start, end, symbols, date)


def valuation_history(rows: DataFrame, as_of: str, symbols: list | None = None) -> DataFrame:
    out = rows.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    return out if symbols is None else out.filter(F.col("symbol").isin(symbols))


def known_financials(rows: DataFrame, as_of: str) -> DataFrame:
    """Announced by as_of, or never dated, for periods that had ended."""
    d = F.lit(as_of).cast("date")
    return rows.filter((F.col("ann_date").isNull() | (F.col("ann_date") <= d)) & (F.col("end_date") <= d))


def latest_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row of each key under the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def factor_inputs(valuation: DataFrame, financials: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    """Latest valuation with the latest known financials and metadata; an undated announcement wins as latest."""
    val = latest_by(valuation_history(valuation, as_of), ["symbol"], F.col("trade_date").desc())
    fin = latest_by(known_financials(financials, as_of), ["symbol"], F.col("ann_date").desc_nulls_first(), F.col("end_date").desc())
    return val.join(fin, "symbol", "left").join(metadata, "symbol", "left")


def known_events(rows: DataFrame, as_of: str, start: str, end: str) -> DataFrame:
    """Events of the range that were recorded by as_of."""
    return rows.filter(F.col("event_date").between(start, end) & (F.to_date("retrieved_at") <= F.lit(as_of).cast("date")))


def sector_history(daily: DataFrame, master: DataFrame, flow: DataFrame) -> DataFrame:
    key = ["provider", "sector_code"]
    names = master.select(*key, "sector_name", "sector_type")
    out = daily.join(names, key, "left").join(flow, [*key, "trade_date"], "left")
    return out.withColumn("sector_name", F.coalesce("sector_name", F.col("sector_code").cast("string")))


def memberships(members: DataFrame, master: DataFrame, as_of: str, stock=None, sector=None) -> DataFrame:
    """Members of each sector's latest snapshot among the rows left by the stock, sector and as-of filters."""
    rows = members.filter(F.col("trade_date") <= F.lit(as_of).cast("date"))
    rows = rows if stock is None else rows.filter(F.col("con_code").isin(stock))
    rows = rows if sector is None else rows.filter(F.col("sector_code").isin(sector))
    last = rows.groupBy("sector_code").agg(F.max("trade_date").alias("trade_date"))
    return rows.join(last, ["sector_code", "trade_date"]).join(master.select("sector_code", "sector_name", "sector_type"), "sector_code", "left")


def stored_dates(rows: DataFrame, date: str, *by: str) -> DataFrame:
    return rows.select(*by, date).distinct()


#: Date columns by which a table's last day is told, in order of preference.
PROFILE_DATES = ("trade_date", "event_date", "end_date", "cal_date", "checked_at", "available_at")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, last_retrieved (of `retrieved_at`), date_field and last_date (of the first of `PROFILE_DATES` that a
    table has) of each table that is not empty."""
    none = F.lit(None)
    parts = []
    for name, df in tables.items():
        field = next((c for c in PROFILE_DATES if c in df.columns), None)
        got = F.max("retrieved_at") if "retrieved_at" in df.columns else none
        row = df.agg(F.count("*").alias("n_rows"), got.cast("timestamp").alias("last_retrieved"), (F.max(field) if field else none).cast("date").alias("last_date"))
        parts.append(row.select(F.lit(name).alias("name"), "n_rows", "last_retrieved", F.lit(field).cast("string").alias("date_field"), "last_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n_rows > 0")


#: Forms of dates that are read, after digits alone.
DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd MMM yyyy", "MMM dd, yyyy")


def parsed_date(c) -> F.col:
    """Text as a date: yyyyMMdd, a day of `DATE_FORMS`, or a timestamp that begins with yyyy-MM-dd; else null."""
    t = F.trim(c)
    plain = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    stamp = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(plain, stamp, *[F.try_to_date(t, form) for form in DATE_FORMS])


def available_as_of(rows: DataFrame, fields: list[str], as_of: str) -> tuple[DataFrame, DataFrame]:
    """Rows known by as_of, and an audit row. The first field that holds a usable value (eight digits once all else is
    taken out) for any row decides, and rows without one there are excluded too; if none is usable, all rows stay."""
    present = [f for f in fields if f in rows.columns]
    digits = {f: F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), "[^0-9]", "") for f in present}
    usable = {f: digits[f].rlike(r"^\d{8}$") for f in present}
    limit = as_of.replace("-", "")
    counts = rows.agg(F.count("*").alias("total"), *[F.count(F.when(usable[f], 1)).alias(f"_u{k}") for k, f in enumerate(present)], *[F.count(F.when(usable[f] & (digits[f] <= limit), 1)).alias(f"_k{k}") for k, f in enumerate(present)])
    chosen = F.coalesce(*[F.when(F.col(f"_u{k}") > 0, k) for k in range(len(present))], F.lit(-1)) if present else F.lit(-1)
    one = counts.withColumn("_c", chosen)
    by = lambda values, other: F.coalesce(*[F.when(F.col("_c") == k, v) for k, v in enumerate(values)], other) if values else other
    known, valid = by([F.col(f"_k{k}") for k in range(len(present))], F.col("total")), by([F.col(f"_u{k}") for k in range(len(present))], F.lit(0))
    status = F.when(F.col("total") == 0, "not_applicable").when(F.col("_c") < 0, "historically_unverified").otherwise("filtered")
    audit = one.select(status.alias("status"), by([F.lit(f) for f in present], F.lit(None).cast("string")).alias("field"), "total", (F.col("total") - known).alias("excluded"), valid.cast("bigint").alias("known_rows"))
    passes = by([usable[f] & (digits[f] <= limit) for f in present], F.lit(True))
    kept = rows.crossJoin(F.broadcast(one.select("_c"))).filter(passes).select(*rows.columns)  # one row
    return kept, audit


def sectors_as_of(rows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Sector rows dated by as_of, and an audit row; without a trade_date column all rows stay, as a snapshot that has no
    effective date."""
    if "trade_date" not in rows.columns:
        return rows, rows.agg(F.count("*").alias("total")).select(F.when(F.col("total") == 0, "empty").otherwise("snapshot_without_effective_date").alias("status"), F.lit(0).cast("bigint").alias("excluded"), F.lit(0).cast("bigint").alias("invalid"))
    d = parsed_date(F.col("trade_date").cast("string"))
    fits = F.coalesce(d <= F.lit(as_of).cast("date"), F.lit(False))
    audit = rows.agg(F.count("*").alias("total"), F.count(F.when(~fits, 1)).alias("excluded"), F.count(F.when(d.isNull(), 1)).alias("invalid"))
    status = F.when(F.col("total") == 0, "empty").when(F.col("invalid") == 0, "verified").otherwise("partial")
    return rows.filter(fits), audit.select(status.alias("status"), "excluded", "invalid")


def expand_payload(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """Fields of a JSON column as columns; a name already taken gets the prefix payload_."""
    parsed = rows.withColumn("_p", F.from_json(payload, schema))
    names = [f.name for f in parsed.schema["_p"].dataType.fields]
    return parsed.select("*", *[F.col("_p")[n].alias(f"payload_{n}" if n in rows.columns else n) for n in names]).drop("_p")


#: Keys that a payload may be expanded to.
MAX_KEYS = 2_000


def _column_type(kind: str) -> str:
    """Column type of a key from the variant schema of all its values: whole numbers, numbers, booleans; else text, nested
    values as JSON."""
    if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
        return "double"
    return {"BIGINT": "bigint", "BOOLEAN": "boolean"}.get(kind, "string")


def expand_any(rows: DataFrame, payload: str) -> DataFrame:
    """Every key that a JSON column has in any row as a column, in order of name, with the type that fits all of its values;
    nothing is declared. A name already taken gets the prefix payload_. Rows without a JSON object get nulls. The keys
    and their types are one aggregate over the data; more than `MAX_KEYS` of them are an error, as a table has no more columns."""
    parsed = rows.withColumn("_p", F.from_json(payload, "map<string,variant>"))
    found = parsed.select(F.explode("_p").alias("key", "value")).groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind"))
    keys = sorted((r["key"], _column_type(r["kind"])) for r in found.limit(MAX_KEYS + 1).collect())
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys in {payload}")
    taken = {c.lower() for c in rows.columns}
    value = lambda k, t: F.try_variant_get(F.col("_p")[k], "$", t).alias(f"payload_{k}" if k.lower() in taken else k)
    return parsed.select(*[F.col(f"`{c}`") for c in rows.columns], *[value(k, t) for k, t in keys])
