"""Availability, append and the kept ledger, against a plain version that takes one observation at a time."""

import datetime as dt
import glob
import random

import pytest

from tidemark.operators import ingest
from tidemark.streaming import ledger_feed

PAYLOAD = ["state", "ann_date", "f_ann_date", "trade_date", "update_flag"]
SCHEMA = "dataset string, business_key string, symbol string, event_date date, state string, ann_date string, f_ann_date string, trade_date string, update_flag string, retrieved_at timestamp, batch_row long"
START = dt.datetime(2024, 5, 1)


def observation(rng, n):
    """The n-th arrival."""
    day = lambda: rng.choice([None, "", " ", "soon", "20240301", "2024-03-05", "2024/03/09"])
    return ("d", f"k{rng.randrange(6)}", "X", dt.date(2024, 3, 31), rng.choice("ABC"), day(), rng.choice([None, "", "20240410"]), rng.choice([None, "2024-03-31"]), rng.choice([None, None, "0", "Yes", "updated "]), START + dt.timedelta(hours=7 * n), n)


def available(row):
    ann, f_ann, trade = row[5], row[6], row[7]
    for text in (f_ann, ann, trade):
        if text and text.strip():
            digits = text.replace("-", "").replace("/", "")
            return dt.datetime.strptime(digits, "%Y%m%d") if digits.isdigit() else None
    return row[9]


def plain(rows):
    """{(key, payload): (revision, current, available, first, last)}, one arrival after another."""
    out = {}
    for row in rows:
        key, body, at = row[1], row[4:9], row[9]
        mine = [k for k in out if k[0] == key]
        for k in mine:
            out[k] = (out[k][0], False, *out[k][2:])
        if (key, body) in out:
            r, _, when, first, _ = out[(key, body)]
            out[(key, body)] = (r, True, when, first, at)
            continue
        revision = len(mine) + 1
        revised = (row[8] or "").strip().lower() in ("yes", "updated")
        out[(key, body)] = (revision, True, at if revision > 1 or revised else available(row), at, at)
    return out


def of(df):
    return {(r.business_key, (r.state, r.ann_date, r.f_ann_date, r.trade_date, r.update_flag)): (r.revision, r.is_current, r.available_at, r.first_seen_at, r.last_seen_at) for r in df.collect()}


@pytest.fixture
def rows():
    rng = random.Random(8)
    return [observation(rng, n) for n in range(160)]


def test_ledger_matches_arrivals(spark, rows):
    assert of(ingest.ledger(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA), PAYLOAD)) == plain(rows)


def test_a_march_record_is_not_known_before_its_announcement(spark):
    row = ("d", "k", "X", dt.date(2024, 3, 31), "A", "2024-05-20", None, None, None, START + dt.timedelta(days=60), 1)
    known = ingest.ledger(spark.createDataFrame([row], SCHEMA), PAYLOAD)
    assert ingest.ledger_read(known, available_as_of="2024-05-19").count() == 0
    assert ingest.ledger_read(known, available_as_of="2024-05-20").count() == 1


def test_appended_batches_are_the_rebuilt_ledger(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    built = ingest.ledger(df.filter("batch_row < 40"), PAYLOAD)
    for a, b in ((40, 90), (90, 91), (91, 160)):
        batch = df.filter(f"batch_row >= {a} and batch_row < {b}")
        merged = ingest.ledger_append(built, batch, PAYLOAD)
        built = spark.createDataFrame(built.join(batch.select(*ingest.KEY).distinct(), [*ingest.KEY], "left_anti").unionByName(merged).collect(), built.schema)
    assert of(built) == plain(rows)
    again = ingest.ledger_append(built, batch, PAYLOAD)
    touched = {r[1] for r in rows[91:]}
    assert of(again) == {k: v for k, v in plain(rows).items() if k[0] in touched}


def test_append_touches_only_its_keys(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    merged = ingest.ledger_append(ingest.ledger(df, PAYLOAD), df.filter("business_key = 'k2'").limit(1), PAYLOAD)
    assert {r.business_key for r in merged.collect()} == {"k2"}
    assert ingest.ledger_append(ingest.ledger(df, PAYLOAD), df.limit(0), PAYLOAD).count() == 0


def test_kept_ledger_merges_a_stream_bucket_by_bucket(spark, rows, tmp_path):
    src, path, mark = (str(tmp_path / x) for x in ("in", "ledger", "mark"))
    df = spark.createDataFrame(rows, SCHEMA)
    ledger_feed.create_kept_ledger(spark, path, df.schema, PAYLOAD)
    for a, b in ((0, 70), (70, 160)):
        df.filter(f"batch_row >= {a} and batch_row < {b}").coalesce(1).write.mode("append").parquet(src)
        ledger_feed.merge_observations(spark.readStream.schema(SCHEMA).parquet(src), path, PAYLOAD, mark, buckets=4).awaitTermination()
    assert of(ledger_feed.kept_ledger(spark, path)) == plain(rows)
    before = {f: f.split("/")[-2] for f in glob.glob(f"{path}/*/*.parquet")}
    one = ("d", "k3", "X", None, "new", None, None, None, None, START + dt.timedelta(days=90), 1000)
    for _ in range(2):  # a batch that is merged again changes nothing
        ledger_feed.merge_batch(spark, spark.createDataFrame([one], SCHEMA), path, PAYLOAD, buckets=4)
        assert of(ledger_feed.kept_ledger(spark, path)) == plain([*rows, one])
    kept = set(before) & set(glob.glob(f"{path}/*/*.parquet"))
    assert len({before[f] for f in set(before) - kept}) == 1
