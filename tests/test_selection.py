"""Quantiles, streaks and reviews against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.selection import longest_streak, quantiles
from tidemark.operators import replay

PROBS = {"low": 0.0, "p05": 0.05, "half": 0.5, "p95": 0.95, "high": 1.0}


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(2)
    out = {"normal": [rng.gauss(0, 1) for _ in range(1500)], "hot": [0.25] * 900 + [rng.random() for _ in range(300)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 200) for _ in range(400)], "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 600, "near": [1.0 + k * 2**-52 for k in range(500)], None: [float(k) for k in range(50)]}
    return out


@pytest.mark.parametrize("bins, few", [(4096, 20_000), (8, 5)])
def test_quantiles_match_numpy(spark, groups, bins, few):
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None), ("none", float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles(df, ["g"], "v", PROBS, bins, few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, p in PROBS.items():
            assert getattr(got[g], name) == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-300), (g, name)


def test_quantiles_of_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"x": 0.5}).count() == 0


def test_streaks_match_a_walk(spark):
    rng = random.Random(3)
    rows = [(g, d, k, rng.random() < share) for g, share in (("a", 0.5), ("b", 0.97), ("c", 1.0), ("d", 0.0)) for d in range(30) for k in range(rng.randint(1, 6))]
    rows += [("e", 0, 0, None)]
    want = {}
    for g in "abcde":
        run = best = 0
        for r in sorted(r for r in rows if r[0] == g):
            run = run + 1 if r[3] else 0
            best = max(best, run)
        want[g] = best
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, d int, k int, bad boolean")
    got = {r.g: r.n for r in longest_streak(df, ["g"], F.col("bad"), ["d", "k"], "d", "n").collect()}
    assert got == want and want["c"] > 60


def test_reviews_match_brute(spark):
    rng = random.Random(6)
    first = dt.date(1969, 11, 20)
    bars = [(s, first + dt.timedelta(days=d), rng.choice([None, rng.uniform(5, 9)]) if rng.random() < 0.1 else rng.uniform(5, 9), rng.uniform(1, 5), rng.uniform(9, 12)) for s in ("x", "y") for d in range(2600) if rng.random() < 0.6]
    recs = []
    for k in range(60):
        a = rng.randint(0, 2600)
        recs.append((k, rng.choice(["x", "y", "z"]), first + dt.timedelta(days=a), first + dt.timedelta(days=a + rng.choice([-1, 0, 5, 40, 70, 900, 2300]))))
    index = spark.createDataFrame([(first + dt.timedelta(days=d), 100.0 + d) for d in range(0, 3000, 3)], "trade_date date, close double")
    got = {r.rec_id: r for r in replay.review(spark.createDataFrame(recs, "rec_id int, symbol string, recommended_on date, review_as_of date"), spark.createDataFrame(bars, "symbol string, trade_date date, close_qfq double, low_qfq double, high_qfq double"), index).collect()}
    assert len(got) == 60
    done = 0
    for k, s, a, b in recs:
        path = sorted(r[1:] for r in bars if r[0] == s and a <= r[1] <= b)
        entry, last = (path[0][1], path[-1][1]) if path else (None, None)
        forward = last / entry - 1 if entry and last else None
        assert got[k].forward_return == (None if forward is None else pytest.approx(forward))
        assert got[k].review_status == ("insufficient_evidence" if forward is None else "completed")
        if entry:
            assert got[k].mae == pytest.approx(min(r[2] for r in path) / entry - 1) and got[k].mfe == pytest.approx(max(r[3] for r in path) / entry - 1)
            done += 1
    assert done > 25
