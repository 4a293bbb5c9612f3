"""Routing of endpoints, the run log, exports, payloads with undeclared keys, links, windows to load."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus, ingest, panel, screen
from tidemark.sources import asof, store
from tidemark.sources.scratch import written

LANDED = "endpoint string, batch_row long, payload map<string,string>"


def landed(spark, *rows):
    return spark.createDataFrame([(e, k, p) for k, (e, p) in enumerate(rows)], LANDED)


def test_every_rule_has_a_table_and_the_first_that_fits_decides(spark):
    assert {t for *_, t in ingest.RULES} <= set(store.SPECS) and len({t for *_, t in ingest.RULES}) == 18
    rows = []
    for _, ends, need, target in ingest.RULES:
        for e in sorted(ends):
            rows.append((e, {f: "1" for f in need}, target))
            rows.append((e, {f: "1" for f in sorted(need)[1:]}, None))
    rows += [("unheard", {"ts_code": "1"}, None), ("daily_basic", None, None)]
    got = [r.target for r in ingest.routed(landed(spark, *[r[:2] for r in rows])).orderBy("batch_row").collect()]
    assert got == [r[2] for r in rows]
    for e, p, target in rows:
        assert p is None or ingest.route(ingest.RULES, e, list(p)) == target


def test_split_types_and_merges(spark):
    rows = [
        ("daily_basic", {"ts_code": " a ", "trade_date": "20240102", "circ_mv": "1.5", "turnover_rate": "n/a"}),
        ("daily_basic", {"ts_code": "a", "trade_date": "2024-01-02", "circ_mv": " ", "turnover_rate": "7"}),
        ("daily_basic", {"ts_code": "", "trade_date": "20240102"}),
        ("daily_basic", {"ts_code": "b", "trade_date": "soon"}),
        ("stock_basic", {"ts_code": "a", "name": "new", "industry": "", "market": "m", "list_date": "20200101"}),
        ("limit_step", {"ts_code": "a", "trade_date": "20240102", "more": "x"}),
        ("other", {"ts_code": "a"}),
    ]
    old = spark.createDataFrame([("a", "old", "steel", "m", dt.date(2020, 1, 1), "L", None)], "symbol string, name string, industry string, market string, list_date date, list_status string, delist_date date")
    tables, counts = store.route_all(landed(spark, *rows), existing={"metadata": old})
    assert [tuple(r) for r in tables["valuation"].collect()] == [("a", dt.date(2024, 1, 2), 1.5, 7.0)]
    # name and industry follow the newer row even where it is blank; the lifecycle stays
    assert [tuple(r) for r in tables["metadata"].collect()] == [("a", "new", None, "m", dt.date(2020, 1, 1), "L", None)]
    assert [tuple(r)[:3] for r in tables["limit_events"].collect()] == [("a", dt.date(2024, 1, 2), "limit_step")]
    assert tables["limit_events"].first().payload_json == '{"more":"x","trade_date":"20240102","ts_code":"a"}'
    assert {(r.endpoint, r.target): r["rows"] for r in counts.collect()} == {("daily_basic", "valuation"): 4, ("stock_basic", "metadata"): 1, ("limit_step", "limit_events"): 1, ("other", None): 1}
    assert tables["margin"].count() == 0


def test_run_log_grows_and_finds(spark, tmp_path):
    def runs(*rows):
        return store.run_log(spark.createDataFrame(rows, "created_at string, operation string, symbol string, requested_as_of string, parent_run_id string, note string"), ["note"])

    one = runs(("2024-01-01 00:00:00", "screen", None, "2024-01-01", None, "first"))
    first = one.first().run_id
    assert len(first) == 24 and one.first().schema_version == 1
    store.append_runs(one, str(tmp_path / "log"), one.select("run_id", F.lit(5).alias("horizon")))
    two = runs(("2024-01-02 00:00:00", store.RECOMMENDATION, "x", "2024-01-02", first, "second"), ("2024-01-03 00:00:00", store.RECOMMENDATION, "y", "2024-01-03", "gone", "third"))
    store.append_runs(two, str(tmp_path / "log"), two.select("run_id", F.lit(9).alias("horizon")))
    log = spark.read.parquet(str(tmp_path / "log" / "runs"))
    assert log.count() == 3 and spark.read.parquet(str(tmp_path / "log" / "outcomes")).filter(F.col("run_id") == first).count() == 1
    assert store.load_run(log, first, ("screen",)).first().parent_run_id is None
    with pytest.raises(ValueError, match="is screen"):
        store.load_run(log, first, (store.RECOMMENDATION,))
    with pytest.raises(ValueError, match="no run"):
        store.load_run(log, "gone")
    assert [r.symbol for r in store.list_recommendations(log).collect()] == ["y", "x"]
    assert [r.as_of for r in store.list_recommendations(log, "x", 0).collect()] == ["2024-01-02"]
    odd = log.withColumn("payload_json", F.lit("no json"))
    assert {r.action_label for r in store.list_recommendations(odd).collect()} == {None}


def test_run_chains_of_any_length(spark):
    links = [(f"a{k}", f"a{k - 1}" if k else None) for k in range(40)] + [("b", "missing"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s")]
    random.Random(1).shuffle(links)
    got = {r.run_id: (r.root_run_id, r.depth) for r in store.run_chains(spark.createDataFrame(links, "run_id string, parent_run_id string")).collect()}
    assert all(got[f"a{k}"] == ("a0", k) for k in range(40))
    assert got["b"] == ("b", 0) and got["c"] == ("b", 1)
    assert all(got[k] == (None, None) for k in "xyzs")


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_exports_read_back(spark, tmp_path, kind):
    rows = [(1, "plain", 1.5, dt.date(2024, 1, 2), True), (2, 'quote " comma, line\nbreak \\ back', None, None, False), (3, "", -0.1, dt.date(1999, 12, 31), None), (4, None, 1e300, None, None)]
    df = spark.createDataFrame(rows, "id int, note string, x double, day date, flag boolean")
    store.export(df, str(tmp_path / kind), kind)
    want = [(3, None, *r[2:]) if r[0] == 3 and kind == "csv" else r for r in rows]
    assert sorted(map(tuple, store.exported(spark, str(tmp_path / kind), df.schema, kind).collect())) == want
    text = "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
    assert "2024-01-02" in text and (kind == "json" or text.startswith("id,note,x,day,flag"))


def test_undeclared_keys_become_columns(spark):
    rows = [(1, '{"k":1,"a b":"x","n":null,"id":7}'), (2, '{"k":2.5,"list":[1,{"z":2}],"ok":true,"mixed":1}'), (3, '{"mixed":"two","ID2":"z"}'), (4, "no json"), (5, None), (6, "[1]"), (7, "{}")]
    out = asof.expand_any(spark.createDataFrame(rows, "id int, payload string"), "payload")
    assert dict(out.dtypes) == {"id": "int", "payload": "string", "ID2": "string", "a b": "string", "payload_id": "bigint", "k": "double", "list": "string", "mixed": "string", "n": "string", "ok": "boolean"}
    got = {r.id: r for r in out.collect()}
    assert (got[1].k, got[1]["a b"], got[1].payload_id, got[1].n) == (1.0, "x", 7, None)
    assert (got[2].k, got[2]["list"], got[2].ok, got[2].mixed) == (2.5, '[1,{"z":2}]', True, "1") and got[3].mixed == "two"
    assert all(got[k].k is None and got[k].ok is None for k in (3, 4, 5, 6, 7))
    assert asof.expand_any(spark.createDataFrame([], "id int, payload string"), "payload").columns == ["id", "payload"]


def test_links_have_candidates(spark):
    text = "[[b]] [[wiki/entity/b]] [[entity/b.md#part|B]] [[nowhere]] [[ /]] [x](../concept/c.md?v=1) [y](/wiki/entity/b.md) [z](../../../../up.md) [m](mailto:a@b.md) [h](https://e.org/c.md) ![i](gone.md) [t](gone.txt) [q](<gone.md> 'title') `[[code]]` ```\n[[fence]]\n```"
    pages = spark.createDataFrame([("wiki/entity/a.md", text), ("wiki/entity/b.md", None), ("wiki/concept/c.md", "[self](c.md) [[c]]")], "path string, text string")
    assert sorted(map(tuple, corpus.broken_links(pages).collect())) == [("wiki/entity/a.md", t) for t in ("/", "gone.md", "nowhere")]
    given = {r.target: r.candidates for r in corpus.page_links(pages).filter("path like '%a.md'").collect()}
    assert given["b"] == ["b.md", "wiki/entity/b.md", "wiki/concept/b.md", "wiki/analysis/b.md"] and given["entity/b.md"] == ["entity/b.md", "wiki/entity/b.md"]
    paths = ["a/./b//c", "../a", "a/../../b", "a/../b", "..", "", "a/..", "/x/y"]
    got = [r[0] for r in spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").orderBy("k").select(corpus.folded(F.col("p"))).collect()]
    assert got == ["a/b/c", None, None, "b", None, None, None, "x/y"]


def test_windows_open_only_their_years(spark):
    bars = spark.createDataFrame([("x", dt.date(y, m, 15), y) for y in range(2000, 2012) for m in range(1, 13)], "symbol string, trade_date date, year int")
    stored = written(bars, "bars", "year")
    asked = spark.createDataFrame([("r", "trade", dt.date(2005, 3, 1), dt.date(2005, 4, 1)), ("s", "swing", dt.date(2009, 1, 1), dt.date(2009, 1, 2))], "request_id string, profile string, start_date date, end_date date")
    got = panel.load_windows(stored, asked, {"trade": screen.TRADE, "swing": screen.SWING})
    spans = {r.request_id: (r.a, r.b) for r in got.groupBy("request_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).collect()}
    assert spans == {"r": (dt.date(2004, 8, 15), dt.date(2005, 4, 15)), "s": (dt.date(2008, 1, 15), dt.date(2009, 4, 15))}
    assert {int(f.split("year=")[1].split("/")[0]) for f in got.inputFiles()} >= {2004, 2005, 2008, 2009}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan
