"""The ledger fed by a file stream."""

import datetime as dt

from tidemark.sources.store import SPECS, export, upsert
from tidemark.streaming.ledger_feed import append_observations, read_ledger

SCHEMA = "dataset string, business_key string, symbol string, event_date date, state string, retrieved_at timestamp, batch_row long"


def test_stream_then_late_row(spark, tmp_path):
    row = lambda state, hour, k: ("d", "k", "X", dt.date(2024, 1, 1), state, dt.datetime(2024, 1, 2, hour), k)
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for batch in ([row("A", 1, 1), row("B", 3, 2)], [row("A", 5, 3), row("C", 2, 4)]):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(src)
        append_observations(spark.readStream.schema(SCHEMA).parquet(src), out, mark).awaitTermination()
    got = {r.state: (r.revision, r.is_current) for r in read_ledger(spark, out, ["state"]).collect()}
    assert got == {"A": (1, True), "C": (2, False), "B": (3, False)}


def test_typed_upsert_and_export(spark, tmp_path):
    first = spark.createDataFrame([("X", "2024-01-02", "1.5", None), (" ", "2024-01-02", "9", None)], "symbol string, trade_date string, circ_mv string, turnover_rate double")
    one = upsert(None, first, SPECS["valuation"])
    two = upsert(one, spark.createDataFrame([("X", "20240102", None, 0.5)], first.schema), SPECS["valuation"])
    assert [tuple(r) for r in two.collect()] == [("X", dt.date(2024, 1, 2), 1.5, 0.5)]
    for kind in ("csv", "json"):
        export(two, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().trade_date == "2024-01-02"
