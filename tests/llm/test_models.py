"""Classifiers, neighbours, conversations and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import ann, chat, langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "a" * 20000), (5, "normal words of a text")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, i) for i, t in ODD], "doc_id long, text string, lang string, score long")


def labelled(spark, name, column):
    return spark.read.parquet(f"{SF}/labels.parquet").join(queries.queries()[name](spark, SF), "doc_id").select("held_out", "predicted", "score", F.col(column).alias("y")).toPandas()


def test_quality_held_out(spark):
    d = labelled(spark, "op2_quality", "quality")
    held = d[d.held_out]
    assert (held.predicted == held.y).mean() > 0.95 and d.score.between(0, 1).all()


def test_quality_without_labels_and_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(quality.labelled(odd(spark), labels, "quality"))
    assert {round(r.score, 6) for r in quality.score(odd(spark), model).collect()} == {0.5}
    kept = quality.score(odd(spark).drop("score"), model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(ODD)
    assert quality.score(odd(spark).limit(0), model).count() == 0


def test_quality_weights_match_plain_updates(spark):
    """Weights and scores of one and of several groups against the published per-coordinate rule, term by term; groups
    count by their rows."""
    from math import exp, sqrt

    import pandas as pd

    rows = [(k, f"{'good plain words' if k % 3 else 'bad bad junk !!'} n{k % 5} tail", int(k % 3 > 0)) for k in range(40)]
    rows += [(40, None, 1), (41, "", 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    marks = {r.id: r.m for r in df.select("id", F.xxhash64(F.lit("ftrl"), F.col("id").cast("string")).alias("m")).collect()}

    def plain(part):
        z, n, w = {}, {}, lambda k, z, n: 0.0 if abs(z.get(k, 0)) <= (quality.L1 if k else 0) else -(z[k] - (1 if z[k] > 0 else -1) * (quality.L1 if k else 0)) / ((quality.BETA + sqrt(n[k])) / quality.ALPHA + quality.L2)
        xs = []
        for _, t, y in sorted(part, key=lambda r: marks[r[0]]):
            x = {}
            for k, v in zip(*(a.tolist() for a in quality.features([t or ""])[1:]), strict=True):
                x[k] = x.get(k, 0) + v
            xs.append((x, y))
        for _ in range(quality.EPOCHS):
            for x, y in xs:
                ws = {k: w(k, z, n) for k in x}
                p = 1 / (1 + exp(-max(-35, min(35, sum(ws[k] * v for k, v in x.items())))))
                for k, v in x.items():
                    g = (p - y) * v
                    z[k] = z.get(k, 0) + g - (sqrt(n.get(k, 0) + g * g) - sqrt(n.get(k, 0))) / quality.ALPHA * ws[k]
                    n[k] = n.get(k, 0) + g * g
        return {k: w(k, z, n) for k in z}

    for per in (1000, 14):
        shards = -(-len(rows) // per)
        want = {}
        for s in range(shards):
            part = [r for r in rows if marks[r[0]] % shards == s]
            for k, v in plain(part).items() if part else ():
                want[k] = want.get(k, 0) + v * len(part) / len(rows)
        got = {r.feature: r.weight for r in quality.train(df, per).collect()}
        assert got.keys() == {k for k, v in want.items() if v} and all(np.isclose(got[k], want[k]) for k in got)
    few = quality.train(df.filter("id < 6"))
    again = pd.DataFrame([tuple(r) for r in quality.score(df.select(F.col("id").alias("doc_id"), "text"), few).collect()])
    assert again[1].max() - again[1].min() > 0.1


def test_quality_of_repeated_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "b good"), (1, "a good"), (1, "a good"), (2, "junk"), (None, "x"), (3, None)], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("label", F.lit(9))
    found = sorted((r.id, r.text, r.label) for r in quality.labelled(docs, labels, "quality").collect())
    assert found == [(1, "a good", 1), (2, "junk", 0)]
    assert quality.score(docs, quality.train(quality.labelled(docs, labels, "quality")), keep=True).count() == 6


def test_toxicity_held_out(spark):
    d = labelled(spark, "op1_toxicity", "toxic")
    held = d[d.held_out]
    assert (held.predicted == held.y).mean() > 0.9 and d.score.between(0, 1).all()
    assert d[d.y == 0].predicted.mean() < 0.05
    toxic, clean = held[held.y == 1].score.to_numpy(), held[held.y == 0].score.to_numpy()
    above = (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2
    assert above > 0.9 and (toxic >= 0.5).mean() > 0.6


@pytest.mark.parametrize("words", [60, 4000])
def test_toxicity_index_is_exact(words):
    """Block bounds never lose a neighbour, whether words are summed in the matrix or by postings."""
    rng = np.random.default_rng(3)
    ix = toxicity.Index({f"t{k}": k for k in range(words)}, rng.uniform(0.5, 3, words), np.arange(500), rng.integers(0, 2, 500))
    draw = lambda n: ix.unit(*np.unique((words * rng.random(n) ** 3).astype(int), return_counts=True))
    vectors = [draw(rng.integers(1, 40)) for _ in range(500)]
    ix.build(vectors)
    assert (words > 1000) == bool(len(ix.example) and len(ix.dense))
    dense = np.zeros((500, words))
    for k, (at, w) in enumerate(vectors):
        dense[k, at] = w
    asked = [draw(20) for _ in range(100)]
    for (at, w), (near, sim) in zip(asked, ix.nearest(asked), strict=True):
        full = dense[:, at] @ w
        assert np.allclose(sim, np.sort(full)[::-1][: len(sim)], atol=1e-12) and len(sim) == min(toxicity.NEIGHBOURS, (full > 0).sum())
        assert np.allclose(full[near], sim, atol=1e-12)
    for k, (near, _) in enumerate(ix.nearest(vectors[:70], list(range(70)))):
        assert k not in near


def test_toxicity_query_matches_plain_cosine(spark):
    """Scores of the whole query against dense vectors over the same weights, and ties, repeated rows, odd rows."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.001')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    ix = model.plain
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n, df = len(texts), {}
    for t in texts.values():
        for w in set(toxicity.terms(t)):
            df[w] = df.get(w, 0) + 1
    known = {r.doc_id: r.toxic for r in labels.collect()}
    of = {y: {d for d, v in known.items() if v == y and d in texts} for y in (0, 1)}
    assert set(ix.ids) == of[0] | of[1] and set(ix.vocab) == {w for d in of[0] | of[1] for w in toxicity.terms(texts[d])}
    count = {y: {} for y in of}
    for y, ds in of.items():
        for d in ds:
            for w in set(toxicity.terms(texts[d])):
                count[y][w] = count[y].get(w, 0) + 1
    for w, k in ix.vocab.items():
        a, b, n1, n0 = count[1].get(w, 0), count[0].get(w, 0), len(of[1]), len(of[0])
        odds = lambda x, m: np.log((x + 0.5) / (m - x + 0.5))
        error = np.sqrt(sum(1 / (x + 0.5) for x in (a, n1 - a, b, n0 - b)))
        assert np.isclose(ix.idf[k], np.log(n / df[w]))
        assert np.isclose(model.relevant.idf[k], ix.idf[k] * max(0, abs(odds(a, n1) - odds(b, n0)) - toxicity.ERRORS * error))

    def dense(text, ix=ix):
        v = np.zeros(len(ix.vocab))
        for w in toxicity.terms(text):
            if w in ix.vocab:
                v[ix.vocab[w]] += 1
        v[v > 0] = (1 + np.log(v[v > 0])) * ix.idf[v > 0]
        return v / (np.linalg.norm(v) or 1)

    examples = np.array([dense(texts[i]) for i in ix.ids])
    assert all(examples.any(axis=1) == [bool(toxicity.terms(texts[i])) for i in ix.ids])
    others = np.array([dense(texts[i], model.relevant) for i in model.relevant.ids])
    for d, t in texts.items():
        sim = examples @ dense(t)
        best = np.sort(sim[sim > 1e-12])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([e.similarity for e in got[d].evidence], best), d
        near = np.array([{int(i): k for k, i in enumerate(ix.ids)}[e.example] for e in got[d].evidence], dtype=int)
        second = others @ dense(t, model.relevant)
        order = np.lexsort((np.arange(len(second)), -second.round(12)))[: toxicity.NEIGHBOURS]
        order = order[second[order] > 1e-12]
        votes = np.array([[ix.vote(near, sim[near]), model.relevant.vote(order, second[order])]])
        assert np.isclose(got[d].score, model.calibrated(votes)[0], atol=2e-3)


def test_toxicity_of_repeated_and_empty_tables(spark):
    bad, good = "you stupid clown", "a kind and gentle word"
    rows = [(k, f"{bad if k % 3 == 0 else good} {k}") for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(61, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    twice = spark.createDataFrame(rows + rows[:9] + [(3, "zzz later text"), (None, bad), (70, None), (71, "")], "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("score", F.lit(1))
    ix, jx = toxicity.train(once, labels), toxicity.train(twice, labels)
    assert len(jx.plain.ids) == len(ix.plain.ids) == 60
    got = [(r.doc_id, r.score) for r in toxicity.score(twice, jx).collect()]
    assert len(got) == 73 and all(0 <= s <= 1 for _, s in got)
    assert all((s >= 0.5) == (d is None or d % 3 == 0) for d, s in got if d is None or d < 60) or dict(got)[3] < 0.5
    assert len({s for d, s in got if d in (70, 71)}) == 1
    assert toxicity.score(twice.limit(0), jx).count() == 0
    assert {r.score for r in toxicity.score(once, toxicity.train(once.limit(0), labels)).collect()} == {0.5}


def test_toxicity_without_labels_and_odd_rows(spark):
    ix = toxicity.train(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd(spark), ix).collect()} == {0.5}


def test_language_held_out_and_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs.select("doc_id", "lang").join(queries.op3_language(spark, SF), "doc_id").toPandas()
    held = d[d.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    langs, likelihoods = langid.train(docs)
    en, fr = (docs.filter(F.col("lang") == x).filter("n_chars between 500 and 3000").first()["text"] for x in ("en", "fr"))
    both = spark.createDataFrame([(1, en + "\n" + fr)], "doc_id long, text string")
    shares = langid.identify(both, langs, likelihoods).first()["shares"]
    assert set(shares) >= {"en", "fr"} and min(shares["en"], shares["fr"]) > 0.1
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd(spark), langs, likelihoods).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] in langs
    none, table = langid.train(odd(spark))
    assert none == [] and {r.lang_pred for r in langid.identify(odd(spark), none, table).collect()} == {"und"}


def test_language_mixtures_match_plain_expectation_maximisation():
    """The fitted shares against one document and word at a time; and as many languages enter as a text has."""
    rng = np.random.default_rng(8)
    names = "abcdefghijklmnopqrst"
    table = np.full((1 << 12, 9), -9.0, dtype=np.float32)
    words = [["".join(rng.choice(list(names[2 * k : 2 * k + 4]), 5)) for _ in range(40)] for k in range(9)]
    for k, ws in enumerate(words):
        np.add.at(table[:, k], langid.trigrams([" ".join(ws)], 12)[0], 1.5)
    table = np.minimum(table, -1.0)
    docs = [" ".join(words[0]), " ".join(words[2][:20] + words[5][:20]), " ".join(w for k in range(1, 8) for w in words[k][:30]), "", "1 2", None or ""]
    shares, n = langid.infer(docs, table)
    assert n.tolist() == [40, 40, 210, 0, 0, 0] and (shares[3:] == 0).all()
    assert (shares[2] > 0).sum() >= 7 and np.allclose(shares[:3].sum(axis=1), 1, atol=1e-4)

    def plain(text):
        lik = []
        for w in text.split():
            lik.append(table[langid.trigrams([w], 12)[0]].sum(axis=0).astype(float))
        lik = np.array(lik)
        top = lik.max(axis=1, keepdims=True)
        like = np.exp(lik - top)

        def fit(pi, rounds):
            for _ in range(rounds):
                each = [x * pi / max((x * pi).sum(), 1e-30) for x in like]
                pi = sum(each) / len(each)
            return pi, float(top.sum() + sum(np.log(max((x * pi).sum(), 1e-30)) for x in like))

        full, _ = fit(np.full(9, 1 / 9), langid.ROUNDS)
        order, best = np.argsort(-full, kind="stable"), None
        for size in range(1, 10):
            pi = np.zeros(9)
            pi[order[:size]] = np.maximum(full[order[:size]], 1e-3)
            pi, value = fit(pi / pi.sum(), 0 if size == 1 else langid.SET_ROUNDS)
            value -= langid.PENALTY * (size - 1) * (0.5 * np.log(len(like) + 1.0) + 1)
            if best is not None and value <= best[0]:
                break
            best = (value, pi)
        return best[1]

    for text, row in zip(docs[:3], shares, strict=False):
        assert np.allclose(plain(text), row, atol=2e-3)


def test_language_of_repeated_rows_and_empty_tables(spark):
    rows = [(k % 20, f"{'alpha beta gamma' if k % 2 else 'uno dos tres'} word{k}", "en" if k % 2 else "es") for k in range(40)] + [(None, "alpha", "zz"), (5, None, "en"), (6, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("x")).withColumn("score", F.lit(2))
    langs, table = langid.train(docs)
    assert langs == ["en", "es"]
    got = langid.identify(docs, langs, table)
    assert got.columns == ["doc_id", "lang_pred", "score", "shares"] and got.count() == len(rows)
    assert langid.identify(docs.limit(0), langs, table).count() == 0 and langid.train(docs.limit(0))[0] == []


def oracle(name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        c.register(t, df)
    return c.execute(queries.oracle_sql()[name]).df()


def test_neighbours_match_sql_and_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = queries.op7_neighbours(spark, SF).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    want = oracle("op7_neighbours", embeddings=e).sort_values(["query_id", "rank"]).reset_index(drop=True)
    hit = set(zip(got.query_id, got.vec_id)) & set(zip(want.query_id, want.vec_id))
    assert len(hit) >= 0.99 * len(want)
    joined = got.merge(want, on=["query_id", "vec_id"])
    assert (joined.score_x == joined.score_y).all()


def test_neighbours_bound_is_not_narrowed():
    """A true neighbour falls outside the bound by chance in less than 0.01 % of cases."""
    from statistics import NormalDist

    assert 1 - NormalDist().cdf(ann.WIDTH) < 1e-4


def test_neighbours_small_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24)).astype(np.float32)
    v[50:120] = v[40]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (401, [0.0] * 24), (402, [float("nan")] + [1.0] * 23), (403, [None] + [1.0] * 23), (404, []), (420, [1.0, 2.0]), (421, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(ann.build_index(df), F.col("vec_id") % 20 == 0, query_cells=7 * 24, candidate_cells=40 * 24).toPandas()
    full = v.astype(np.float64)
    for q in range(0, 300, 20):
        mine = got[got.query_id == q].sort_values("rank")
        score = ann.exact(np.broadcast_to(full[q], full.shape), full)
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert mine.vec_id.tolist() == order
    assert got[got.query_id == 420].vec_id.tolist() == [421] and not set(got.query_id) & {400, 401, 402, 403, 404}
    assert ann.search(ann.build_index(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """A query's own row is left out, other rows of its id are not; each row of a repeated query id has its own k."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(1, 60)]
    rows += [(40, [1.0] * 8), (40, [2.0] * 8), (7, rows[6][1]), (None, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).withColumn("dim", F.lit(None).cast("int"))
    got = ann.search(ann.build_index(df), F.col("vec_id") % 20 == 0, candidate_cells=8 * 9).toPandas()
    v = np.array([e for i, e in rows[:-1]], dtype=np.float32).astype(float)
    ids = np.array([i for i, _ in rows[:-1]])
    want = []
    for k in np.flatnonzero(ids % 20 == 0):
        score = ann.exact(np.broadcast_to(v[k], v.shape), v)
        order = [i for i in np.lexsort((ids, -score)) if i != k][:20]
        want += [(int(ids[k]), r, int(ids[i]), score[i]) for r, i in enumerate(order, 1)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)
    assert (got.query_id == 40).sum() == 60 and (got[got.query_id == 40].vec_id == 40).sum() >= 2


def test_conversations(spark):
    got = queries.op8_chat(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = oracle("op8_chat", conversations=spark.read.parquet(f"{SF}/conversations.parquet").toPandas()).sort_values("conv_id").reset_index(drop=True)
    assert got.equals(want[got.columns].astype(got.dtypes))
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, None, None, None), (5, 0, "user", "a"), (5, 1, "bot", "c"), (5, 1, "bot", "c"), (None, 0, "user", "z"), (6, 0, "bot", "b"), (6, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("no", F.lit(7))
    out = {r.conv_id: (r.n_turns, r.copies) for r in chat.render(df).collect()}
    assert out == {2: (2, 2), 4: (1, 1), 5: (2, 1), 6: (2, 1)}
    assert chat.render(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_pipeline_stages(spark, staged):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    good, single, clean, redacted = (texts(x) for x in staged[:4])
    assert all(x.columns == first.columns for x in staged[:4])
    assert 0 < len(first.toPandas()) - len(good) < 0.3 * first.count()
    comp = brute.jaccard_components(list(good.items()))
    assert set(single) == {d for d in good if comp[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = brute.contamination(list(single.items()), items)
    assert set(clean) == {d for d in single if not dirty[d][4]}
    assert set(redacted) == set(clean) and not any(brute.personal(t) for t in redacted.values())
    assert staged[4].count() == len(redacted)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD] + [(5, "normal words of a text", None, None, 0), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = spark.read.parquet(f"{SF}/benchmark.parquet")
    sf.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 1), (None, 0), (4, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
