"""Decontamination, personal data and subwords against plain versions, on the smallest table and on odd rows."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import decontam, pieces, pii, queries

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "a@b.c_d@e.f x@y.z.w, 1.2.3.4.5 300.1.1.1 001.02.3.255"),
    (6, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890"), (7, "+1 (132) 555-1352 +12 3 +49 (0)30.123.456.78-"),
    (8, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (9, "my ssn is 123-45-6789; nr 987-65-4321 is far away from any such word here"),
    (10, "\U0001F600é a.b@c.d \U0001F600"), (11, "9" * 30000), (12, "a" * 30000), (13, "1.2.3." * 5000), (14, "x@" * 9000), (15, "▁ ▁a  b▁"), (16, "4111 1111 1111 1111 " * 300),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in ODD], "doc_id long, text string, kind string, id long")


def test_contamination_matches_brute(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op5_decontamination(spark, SF).collect()}
    assert got == brute.contamination(docs, items)
    assert any(x[4] for x in got.values())


def test_contamination_short_items_blocks_and_odd_rows(spark, odd):
    items = [(1, "two"), (2, "A B"), (3, None), (4, ""), (1, "two"), (5, "one two three"), (6, " ".join("abcdefghijklmnopq")), (None, "zzz")]
    docs = ODD[:10] + [(20, "a b, A-B one TWO three two"), (21, "x " + " ".join("abcdefghijklmnopq") + " y"), (21 + 1, "two " * 50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, [x for x in items if x[0] is not None])
    for block in (1_000_000, 20, 3):
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in decontam.contamination(table, bench, block_words=block).collect()}
        assert got == {k: v[:3] for k, v in want.items()}
    none = decontam.contamination(table, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert none[0] == 0 and none[1] == len(docs)
    assert decontam.contamination(table.limit(0), bench).count() == 0
    longest = {r.doc_id: r.longest_match for r in decontam.contamination(table, bench).collect()}
    assert longest[21].n_words == 17 and longest[21].item == "6" and (longest[21].doc_word, longest[21].item_word) == (1, 0)


def test_contamination_is_one_for_any_number_of_blocks(spark):
    """Null and repeated ids, rows repeated in full, and matches that run through two items."""
    a, b, c = ([f"{x}{k}" for k in range(30)] for x in "abc")
    bench = [(1, " ".join(a[:13])), (2, " ".join(a[1:14])), (3, " ".join(b)), (3, " ".join(c)), (4, " ".join(b[5:20])), (None, " ".join(c)), (5, "q")]
    docs = [(None, " ".join(a[:14])), (None, "clean"), (7, " ".join(a[:14])), (7, " ".join(["x", *b[3:27], "y"])), (7, " ".join(["x", *b[3:27], "y"])), (8, " ".join(c) + " q " + " ".join(b[:13]))]
    table, items = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("x")).withColumn("th", F.lit(0)), spark.createDataFrame(bench, "item_id long, text string")
    want = [brute.contamination([(0, t)], [x for x in bench if x[0] is not None])[0][:3] for _, t in docs]
    runs = []
    for block in (10_000, 60, 1):
        got = decontam.contamination(table, items, block_words=block).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, len(r["items"])) for r in got) == sorted((d or -1, *w) for (d, _), w in zip(docs, want, strict=True))
        runs.append(sorted((r.doc_id or -1, r.n_hit, r.longest_match.n_words if r.longest_match else 0) for r in got))
        kept = decontam.remove_contaminated(table, items, block_words=block).collect()
        assert [(r.doc_id, r.text) for r in kept] == [(None, "clean")]
    assert runs[0] == runs[1] == runs[2]
    # 14 words of a lie in two items of 13, so no match is longer than 13
    assert {r[2] for r in runs[0]} == {0, 13, 24, 30}


def test_windows_and_longest_matches_of_a_long_item(spark):
    item = [f"w{k}" for k in range(75)]
    docs = [(k, " ".join(item[k : k + 13])) for k in range(63)] + [(99, " ".join(item)), (98, " ".join(["x", *item[3:60], "y", *item[30:]]))]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")).collect()}
    assert all(r.n_hit == r.n_words and r["items"] == ["a"] for d, r in got.items() if d != 98)
    assert got[99].longest_match.n_words == 75 and all(tuple(got[k].longest_match) == ("a", 13, 0, k) for k in range(63))
    assert tuple(got[98].longest_match) == ("a", 57, 1, 3) and got[98].n_hit == 102


def shard_of(docs):
    import numpy as np

    sizes = np.array([len(d) for d in docs])
    return np.array([w for d in docs for w in d], dtype=np.uint64), np.repeat(np.cumsum(sizes), sizes)


def test_suffix_arrays_are_sorted():
    rng = random.Random(7)
    for letters in (2, 3, 50):
        docs = [[rng.randrange(letters) for _ in range(rng.randint(0, 60))] for _ in range(30)]
        docs += [docs[3], docs[4], [1] * 200, [1] * 200]
        h, ends = shard_of(docs)
        array = decontam.SuffixArray(h, ends)
        suffix = lambda k: tuple(h[k : ends[k]].tolist())
        got = [suffix(k) for k in array.order.tolist()]
        assert sorted(array.order.tolist()) == list(range(len(h))) and got == sorted(got)


def test_every_window_is_found_with_its_length():
    """Binary search in the array against a plain walk, on few different words, with suffixes cut off by documents."""
    rng = random.Random(9)
    for window in (1, 3, 5):
        docs = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(20)] + [[7, 7], []]
        items = [[rng.randrange(4) for _ in range(rng.randint(1, 30))] for _ in range(8)] + [[9], [7]]
        import numpy as np

        tests = decontam.TestSuffixes([(str(k), np.array(t, dtype=np.uint64).tobytes()) for k, t in enumerate(items)], window)
        h, ends = shard_of(docs)
        want = set()
        flat = h.tolist()
        for k, t in enumerate(items):
            size = min(window, len(t))
            for i in range(len(t) - size + 1):
                for p in range(len(flat)):
                    if p + size <= ends[p] and flat[p : p + size] == t[i : i + size]:
                        n = 0
                        while i + n < len(t) and p + n < ends[p] and t[i + n] == flat[p + n]:
                            n += 1
                        want.add((p, k, i, n))
        pos, suffix, n = decontam.SuffixArray(h, ends).matches(tests)
        got = [(p, int(tests.names[tests.item[s]]), int(tests.place[s]), m) for p, s, m in zip(pos.tolist(), suffix.tolist(), n.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_results_come_from_the_array(spark, monkeypatch):
    """With the array's order undone nothing is found."""
    real = decontam.SuffixArray.__init__

    def undone(self, h, ends):
        real(self, h, ends)
        self.order = self.order[::-1].copy()

    monkeypatch.setattr(decontam.SuffixArray, "__init__", undone)
    import numpy as np

    words = np.arange(40, dtype=np.uint64)
    tests = decontam.TestSuffixes([("a", words.tobytes())], 13)
    assert len(decontam.SuffixArray(words, np.full(40, 40)).matches(tests)[0]) < 28


def test_work_hardly_follows_the_benchmark():
    """A benchmark 100 times larger costs a shard little more: sorting the shard is most of it."""
    import time

    import numpy as np

    rng = np.random.default_rng(2)
    shard = rng.integers(0, 1 << 62, 300_000).astype(np.uint64)
    took = []
    for n in (40, 4000):
        items = [(str(k), rng.integers(0, 1 << 62, 100).astype(np.uint64).tobytes()) for k in range(n)] + [("hit", shard[500:540].tobytes())]
        tests = decontam.TestSuffixes(items, 13)
        began = time.perf_counter()
        for _ in range(3):
            pos, _, n_words = decontam.SuffixArray(shard, np.full(len(shard), len(shard))).matches(tests)
        took.append(time.perf_counter() - began)
        assert sorted(pos.tolist()) == list(range(500, 528)) and n_words.max() == 40
    assert took[1] < 4 * took[0] + 0.05


def test_personal_data_matches_brute(spark, odd):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op6_pii(spark, SF).collect()}
    for d, t in docs:
        want = brute.personal(t)
        assert got[d].base_sha256 == brute.sha(",".join(want))
        assert set(want) <= set(got[d].spans.split(","))
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_spans(odd).collect()}
    for d, t in ODD:
        base = [f"{k}:{a}:{b}" for k, a, b in spans[d] if k in brute.BASE]
        assert base == brute.personal(t), d
    assert [k for k, _, _ in spans[8]] == ["iban"] and [k for k, _, _ in spans[9]] == ["id_number"]
    clean = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert clean[1] is None and clean[10] == "\U0001F600é <EMAIL> \U0001F600"
    assert clean[6].startswith("card <CARD> and 4111")


def test_personal_data_with_many_matches_and_repeated_rows(spark):
    """Positions and redaction across chunks of running sums, in time that does not grow with the square."""
    import time

    mail, ip = [f"m{k}@é.x{k % 7}@host{k % 5}.org" for k in range(700)], [f"10.{k % 256}.3.{k % 300}" for k in range(700)]
    many = " ".join(f"{a} é😀 {b}," for a, b in zip(mail, ip, strict=True))
    rows = [(1, many), (1, many), (2, None), (None, "x a@b.cd y"), (3, "DE89370400440532013000 " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("_email", F.lit(1))
    for r in pii.find_spans(df).collect():
        text = dict(rows)[r.doc_id]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in brute.BASE] == brute.personal(text)
    clean = [(r.doc_id, r.text) for r in pii.redact(df).collect()]
    assert clean[0] == clean[1] and clean[2] == (2, None) and clean[3] == (None, "x <EMAIL> y") and clean[4][1] == "<IBAN> " * 200
    out, at = [], 0
    for x in sorted(((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in brute.personal(many)), key=lambda s: (s[0], list(pii.KINDS).index(s[2]))):
        if x[0] >= at:
            out += [many[at : x[0]], f"<{x[2].upper()}>"]
        at = max(at, x[1])
    assert clean[0][1] == "".join(out) + many[at:]
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    took = []
    for n in (4_000, 32_000):
        one = spark.createDataFrame([(1, "a@b.cd 1.2.3.4, " * (n // 2))], "doc_id long, text string")
        began = time.time()
        assert pii.find_spans(one).select(F.size("spans")).first()[0] == n
        assert pii.redact(one).select(F.length("text")).first()[0] == (n // 2) * 14
        took.append(time.time() - began)
    assert took[1] < 12 * took[0]


def test_pieces_match_library(spark, odd):
    path = pieces.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_decode(odd).collect():
        text = dict(ODD)[r.doc_id] or ""
        want = lib.encode(text, add_eos=True)
        assert r.ids == want and r.decoded == lib.decode(want)
    codec = pieces.codec(path)
    rng = random.Random(5)
    letters = "aab  bcdeé_-.,$\\{}²0123\n\t▁ètion☃漢字inǵ\U0001F600ABCthe"
    for k in range(3000):
        text = " " * rng.randint(0, 40 * (k % 3 == 0)) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert codec.encode(text).tolist() == lib.encode(text), text
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_pieces_query_matches_library_on_the_whole_table(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(lib.decode(ids)))
    got = queries.op9_sentencepiece(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_pieces_of_clashing_columns_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("id", F.lit(7)).withColumn("decoded", F.lit(0))
    got = pieces.encode_decode(df)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id or -1, r.decoded) for r in got.collect()) == [(-1, "c"), (1, "a b"), (1, "a b"), (2, "")]
    assert pieces.encode_decode(df.limit(0)).count() == 0


def test_account_numbers_before_other_words(spark):
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"é IBAN {de} BIC COBADEFFXXX", [de]),
        ("pay DE89 3704 0044 0532 0130 00 2024 now", ["DE89 3704 0044 0532 0130 00"]),
        (f"{de} {gb} {de}", [de, gb, de]),
        (f"AB12 {gb} X", [gb]),
        (f"X{de} {de}X DE89370400440532013001", []),
        (None, []),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [cases[r.doc_id][0][s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_spans(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    clean = {r.doc_id: r.text for r in pii.redact(df.filter("doc_id < 2")).collect()}
    assert clean[0] == "é IBAN <IBAN> BIC COBADEFFXXX" and "3704" not in clean[1]
