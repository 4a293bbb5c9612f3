"""The conversation prefix trie against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import queries, trie

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def of(df):
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def log():
    """Families, copies, shared first turns, ties, repeated rows, nulls, negative ids, an endless conversation and its
    copy, conversations that end up without turns."""
    rng = random.Random(4)
    say = lambda: rng.choice(["", "hi", "hello there", "ünï 😀", "long " * 40])
    turns = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 220), -3, -100, -150]:
        turns += [(c, k, ("user", "assistant")[k % 2], say()) for k in range(rng.randint(1, 9))]
    turns += [(300 + c, k, "user", f"copy {k}") for c in range(60) for k in range(4 + (c % 3 == 0))]
    turns += [(c, k, "user", f"endless {k}") for c in (500, 501, 617) for k in range(70)]
    turns += [(700, None, None, None), (700, None, "user", None), (700, 3, "user", "tie"), (700, 3, "user", "tie"), (700, 3, "a", "tie"), (701, None, "user", "x"), (701, 0, "user", "y")]
    turns += [(c, 0, "user", "short") for c in range(800, 815)]
    turns += [(None, 0, "user", "nobody")]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("chunk, block, bits", [(trie.CHUNK, trie.BLOCK, trie.MOST_BITS), (4, 8, 12), (16, 64, 12)])
def test_nodes_match_brute(spark, log, monkeypatch, chunk, block, bits):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "BLOCK", block)
    df = spark.createDataFrame(log, KIND).withColumn("d", F.lit("clash")).withColumn("conv", F.lit(1)).repartition(5)
    got = of(trie.nodes(df, bits))
    assert got == brute.trie(log)
    assert any(r[3] == 1 and r[1] > 60 for r in got) and any(r[3] > 15 and r[1] > 2 for r in got)


def test_a_full_sketch_changes_nothing(spark, log, monkeypatch):
    """With every cell at two nothing is proved alone and all prefixes are grouped."""
    real = trie.sketch
    monkeypatch.setattr(trie, "sketch", lambda p, b: (s := real(p, b), setattr(s, "packed", np.full_like(s.packed, 0xAA)))[0])
    assert of(trie.nodes(spark.createDataFrame(log, KIND))) == brute.trie(log)


def test_sketch_never_counts_too_low(spark, log):
    df = spark.createDataFrame([(k // 3 if k < 3000 else k,) for k in range(6000)], "k long").select(F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b"))
    found = trie.sketch(df)
    a, b = (df.toPandas()[c].to_numpy() for c in ("a", "b"))
    alone = found.alone(a, b)
    assert not alone[:3000].any() and alone[3000:].mean() > 0.9


def test_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(queries.op11_trie(spark, SF)) == brute.trie(rows)


def test_odd_logs(spark):
    assert trie.nodes(spark.createDataFrame([], KIND)).count() == 0
    alone = [(-1, 5, "user", "x" * 100_000)]
    assert of(trie.nodes(spark.createDataFrame(alone, KIND))) == brute.trie(alone)
    nobody = [(None, 1, "user", "x")]
    assert trie.nodes(spark.createDataFrame(nobody, KIND)).count() == 0
