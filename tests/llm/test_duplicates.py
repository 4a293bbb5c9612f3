"""Near duplicates and repeated passages against plain versions, on the smallest table and on built cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import common, jaccard, passages, queries

SF = "/root/testdata/sf0.001"


def rows(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def family():
    """A hot family of edited copies, exact copies, a shared passage, short and odd texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(90)]
    passage = [word() for _ in range(60)]
    docs = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        docs.append((1000 + k, " ".join(copy)))
    docs += [(2000 + k, " ".join(base).upper()) for k in range(30)]
    docs += [(3000 + k, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for k in range(40)]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "one two three four five six"), (8, "x " * 4000), (9, "x " * 4000), (10, "long" * 9000)]
    rng.shuffle(docs)
    return docs


def test_components_match_brute(spark, family):
    for docs, df in ((rows(spark), spark.read.parquet(f"{SF}/documents.parquet")), (family, spark.createDataFrame(family, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("n", F.lit(1)))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
        assert got == brute.jaccard_components(docs)
    assert sum(v[1] != k for k, v in got.items()) > 60


def test_components_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(some).collect())
    assert got == [(-1, -1), (4, 4), (4, 4), (9, 4)]
    assert sorted(r.doc_id or -1 for r in jaccard.keep_one(some).collect()) == [-1, 4, 4]


def test_other_thresholds(spark, family):
    docs = [d for d in family if d[0] < 1060]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, percent=60).collect()}
    assert got == {k: v[1] for k, v in brute.jaccard_components(docs, 60).items()}


def test_every_link_is_counted(spark, family):
    sets = {d: brute.shingles(t) for d, t in family}
    alike = lambda s, t: bool(s & t) and 100 * len(s & t) >= 75 * len(s | t)
    want = {d: sum(e != d and alike(s, t) for e, t in sets.items()) for d, s in sets.items()}
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(df).collect()}
    assert got == want and max(want.values()) > 40
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (10, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_links) for r in jaccard.near_duplicates(odd).collect()) == [(-1, 0), (4, 1), (9, 1), (10, 0)]


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    base = [f"w{k}" for k in range(40)]
    near = lambda k: " ".join([*base[:38], f"x{k}"])
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(3, " ".join(base)), (5, near(1)), (5, other), (9, other), (None, other), (7, other + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("x")).withColumn("n", F.lit(0))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 26, -1, 0), (3, 36, 3, 1), (5, 26, 5, 2), (5, 35, 3, 1), (7, 27, 5, 2), (9, 26, 5, 2)]
    kept = sorted((r.doc_id or -1, r.text) for r in jaccard.keep_one(df).collect())
    assert kept == sorted([(-1, other), (3, rows[0][1]), (5, other)])


def test_tiles_and_forests_match_all_pairs(spark, family, monkeypatch):
    """Small tiles, few cells: the same links."""
    for name, value in (("TILE", 7), ("TILE_SHINGLES", 900), ("CELLS", 500), ("FEW", 3)):
        monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute.jaccard_components(family)


def test_links_query_matches_sql(spark):
    c = duckdb.connect()
    c.register("documents", spark.read.parquet(f"{SF}/documents.parquet").toPandas())
    want = {r[0]: r[1:] for r in c.execute(queries.oracle_sql()["op4_jaccard"]).fetchall()}
    got = queries.op4_jaccard(spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200, 202: 200}
    assert got == want


def test_passages_match_brute(spark, family):
    for docs, df in ((rows(spark), spark.read.parquet(f"{SF}/documents.parquet")), (family, spark.createDataFrame(family, "doc_id long, text string").withColumn("pos", F.lit(1)))):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_passages(df).collect()}
        assert got == brute.repeated(docs)
    assert sum(v[1] > 0 for v in got.values()) > 100


def test_passages_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(70))
    some = spark.createDataFrame([(None, text), (4, text), (4, text), (9, "pre " + text + " post"), (11, "é " * 120), (12, "é " * 60)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in passages.repeated_passages(some).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (9, 70), (11, 0), (12, 60)]
    out = {r.doc_id: r.text for r in passages.remove_passages(some.filter("doc_id > 4"), passages.repeated_passages(some.filter("doc_id is not null"))).collect()}
    assert out[9] == "pre post" and out[12] == ""
    assert passages.repeated_passages(some.limit(0)).count() == 0


def test_passages_of_one_id_with_several_texts(spark):
    """Rows are judged by their own words; rows of one id take none from each other."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, one), (5, one), (5, two), (5, two + "\n"), (9, "pre " + two), (9, one + " " + two), (None, two), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dg", F.lit(1)).withColumn("text_hash", F.lit(None).cast("string"))
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in passages.repeated_passages(df).collect())
    assert got == [(-1, 60, 0), (3, 60, 0), (5, 60, 0), (5, 60, 0), (5, 60, 60), (9, 61, 60), (9, 120, 120), (10, 0, 0)]
    out = sorted((r.doc_id or -1, r.text or "") for r in passages.remove_passages(df, passages.repeated_passages(df)).collect())
    assert out == [(-1, two), (3, one), (5, ""), (5, two), (5, two + "\n"), (9, ""), (9, "pre"), (10, "")]


def test_pieces_of_a_shared_head_stay_linear(spark, monkeypatch):
    """Pairs of documents with one head of 49 words: pieces travel by confirmed windows, so there are
    about as many as passages, and long passages are cut."""
    head = [f"h{i}" for i in range(49)]
    rows = []
    for k in range(30):
        tail = [f"t{k}x{i}" for i in range(70)]
        rows += [(2 * k, " ".join(head + tail)), (2 * k + 1, " ".join(head + tail + ["end", str(k)]))]
    long = [f"l{i}" for i in range(1500)]
    rows += [(100, " ".join(long)), (101, " ".join(["a", *long[300:], "b"])), (102, " ".join(long[700:749] + long[100:160]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeated(rows)
    sent = []
    stream = passages._stream
    monkeypatch.setattr(passages, "_stream", lambda rows, span: (sent.append(rows), stream(rows, span))[1])
    monkeypatch.setattr(passages, "BUCKET_WORDS", 200)
    monkeypatch.setattr(passages, "MACHINE_WORDS", 300)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.repeated_passages(df).collect()}
    assert got == want and sum(v[1] > 0 for v in got.values()) == 32
    assert sent[0].filter("kind = 0 and doc < 100").count() <= 40


def test_window_hashes_tell_windows_apart():
    import numpy as np

    h = np.array([3, 5, 7, 3, 5, 7, 9], dtype=np.uint64)
    w = common.window_hashes(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    assert len(common.window_hashes(h, 8)) == 0


def test_prune_keeps_needed_rows(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc")
    needed = df.filter("doc % 700 = 3")
    kept = {r.doc for r in common.prune(df, needed, "doc").collect()}
    assert {r.doc for r in needed.collect()} <= kept and len(kept) < 50


def test_registered_digest_columns(spark):
    assert queries.op4_jaccard(spark, SF).columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert queries.op10_passages(spark, SF).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_a_shared_head_costs_the_same_for_any_number_of_pieces():
    """A document that only carries a head of 49 words, which thousands of pieces begin with, tries none of them."""
    import time

    head, took = [f"h{k}".encode() for k in range(49)], []
    for n in (500, 4000):
        pieces = [(k, [*head, *[f"p{k}w{i}".encode() for i in range(5)]]) for k in range(n)]
        machine = passages.PhraseAutomaton(pieces, 50)
        began = time.perf_counter()
        for _ in range(20):
            assert not machine.covered(10**9, [*head, *[b"own"] * 60]).any()
        took.append(time.perf_counter() - began)
        assert machine.covered(10**9, [b"x", *pieces[7][1], b"x"]).sum() == 54 and not machine.covered(7, pieces[7][1]).any()
    assert took[1] < 3 * took[0] + 0.02


def test_two_matches_on_one_diagonal():
    """A copy with a change in its middle keeps both sides."""
    words = [f"w{k}".encode() for k in range(170)]
    copy = [*words[:70], b"changed", *words[71:130], b"again", *words[131:]]
    gone = passages.PhraseAutomaton([(1, words)], 50).covered(2, copy)
    assert gone.tolist() == [True] * 70 + [False] + [True] * 59 + [False] * 40
