"""Repeated byte strings and the fill-in-middle transformation against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import factors, infill, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passages():
    """Exact and near copies, a passage and a line that many documents carry, periodic, short, long and odd texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghäß😀") for _ in range(rng.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    base, passage, line = some(60), some(30), some(11)
    docs = []
    for k in range(60):
        w = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000 + k, base) for k in range(20)]
    docs += [(3000 + k, f"{some(12)} {passage[k % 5:]} {some(12)}") for k in range(30)]
    docs += [(4000 + k, some(9) + line + some(9)) for k in range(150)]
    docs += [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "x " * 3000), (7, " x" * 2000), (8, some(30) + "\x00" + some(30)), (9, "long" * 9000), (10, "퟿" * 60)]
    rng.shuffle(docs)
    return docs


def of(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in rows}


@pytest.mark.parametrize("crowd", [factors.CROWD, 20])
def test_repeated_strings_match_brute(spark, passages, crowd):
    df = spark.createDataFrame(passages, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("th", F.lit(1))
    got = of(factors.repeated_strings(df, crowd=crowd).collect())
    assert got == brute.repeated_bytes(passages)
    assert sum(v[1] > 0 for v in got.values()) > 150 and max(v[2] for v in got.values()) > 2


def test_query_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_factors(spark, SF).collect()}
    assert got == brute.repeated_bytes(docs)


def test_other_lengths(spark, passages):
    docs = [d for d in passages if d[0] < 1020 or d[0] > 4100]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert of(factors.repeated_strings(df, span=31, gram=9).collect()) == brute.repeated_bytes(docs, 31)
    with pytest.raises(ValueError):
        factors.repeated_strings(df, span=20, gram=20)


def test_strings_of_odd_rows(spark):
    kind = "doc_id long, text string"
    assert factors.repeated_strings(spark.createDataFrame([], kind)).count() == 0
    a, b = "a" * 30 + "b" * 40, "c" * 20 + "b" * 40 + "a" * 60
    df = spark.createDataFrame([(None, a), (None, b), (4, a), (4, a), (4, a + b), (9, a), (7, b)], kind)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in factors.repeated_strings(df).collect())
    assert got == [(-1, 70, 0), (-1, 120, 0), (4, 70, 0), (4, 70, 0), (4, 190, 0), (7, 120, 120), (9, 70, 70)]
    assert factors.kept_bytes(df, factors.repeated_strings(df)).filter("doc_id = 9").first().kept == b""


def test_kept_bytes_have_the_digest(spark, passages):
    df = spark.createDataFrame(passages, "doc_id long, text string").withColumn("extra", F.lit(1))
    found = factors.repeated_strings(df)
    kept = factors.kept_bytes(df, found)
    assert kept.columns == ["doc_id", "text", "extra", "kept"] and kept.count() == len(passages)
    assert kept.select("doc_id", F.sha2("kept", 256).alias("k")).join(found, "doc_id").filter("k <> kept_sha256").count() == 0


def test_previous_factor_walks_long_runs():
    """A run of equal suffixes is walked by leaps, whatever the order of its documents."""
    for doc in (np.arange(3000)[::-1], np.arange(3000), np.ones(3000, np.int64)):
        lcp = np.full(3000, 50)
        lcp[0] = 0
        got = factors.previous_factor(lcp, doc, 50) > 0
        want = np.append(False, np.minimum.accumulate(doc)[:-1] < doc[1:])
        assert (got == want).all()


def test_cuts_of_block_trees():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["a", "Bc", "é", "😀", " ", "\n", "zzz" * rng.randint(0, 900), "<"]) for _ in range(rng.randint(0, 60)))
        units = brute.re.findall("[A-Za-z]+|[^A-Za-z]", text)
        cut = infill.CutText(np.frombuffer(text.encode(), dtype=np.uint8))
        assert cut.n_units == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cut.cut(k) == (len(head.encode()), len(head))


def test_infill_matches_brute(spark, passages):
    docs = [*passages, (50, "a<P>b"), (51, "<M>"), (52, "< P>"), (53, "<"), (54, "<S" * 700), (55, "M>" * 700), (-7, "negative id"), *((100 + k, f"word {k}, <other> ümlaut") for k in range(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("form", F.lit(1))
    made = infill.transform(df)
    rows = made.select("*", infill.restored(F.col("form"), F.col("output")).alias("back")).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows} == {d: brute.infill(d, t) for d, t in docs}
    text = dict(docs)
    assert all(r.back == (text[r.doc_id] or "") for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_infill_of_odd_rows(spark):
    kind = "doc_id long, text string"
    assert infill.transform(spark.createDataFrame([], kind)).count() == 0
    rows = infill.transform(spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b"), (5, "a b")], kind)).collect()
    assert len(rows) == 4 and len({r.output for r in rows if r.doc_id == 5}) == 1
