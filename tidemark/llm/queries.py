"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, decontam, factors, infill, jaccard, langid, passages, pieces, pii, quality, toxicity, trie
from tidemark.llm.common import crc_fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.train(docs, labels.filter(crc_fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, index)
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(quality.labelled(docs, labels.filter(crc_fold("doc_id", 3) != 1), "quality"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, likelihoods = langid.train(docs.filter(crc_fold("doc_id", 4) != 2))
    return langid.identify(docs, langs, likelihoods).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.build_index(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("removed", "text_hash")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op12_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factors.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    restored = infill.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_ALL = (op1_toxicity, op2_quality, op3_language, op4_jaccard, op5_decontamination, op6_pii, op7_neighbours, op8_chat, op9_sentencepiece, op10_passages, op11_trie, op12_factors, op13_infill)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no FROM t),
lines AS (SELECT conv_id, no, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' AS line FROM n),
pre AS (SELECT conv_id, no, string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY no) AS rendered,
  max(no) OVER (PARTITION BY conv_id) AS last FROM lines),
whole AS (
  SELECT min(conv_id) AS conv_id, no AS n_turns, count(*) AS copies, rendered
  FROM pre WHERE no = last GROUP BY no, rendered)
SELECT conv_id, n_turns, copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM pre p WHERE p.no < p.last AND p.no = w.n_turns AND p.rendered = w.rendered)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"
_ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""

OP4_SQL = _OP4_SQL.replace("\nSELECT doc_id, coalesce(n.n", ",\nk AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)\nSELECT doc_id, coalesce(n.n").replace("AS component_id FROM w", "AS component_id, coalesce(k.n_links, 0) AS n_links FROM w").rstrip() + " LEFT JOIN k ON k.a = doc_id\n"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ITEM}) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM p),
q AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM q JOIN p USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) AS w FROM documents),
q AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS o FROM q),
g AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM f WHERE o < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.k = x.k GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _crc32_sql(digits: str) -> str:
    """crc32 of a text of ASCII characters as an expression, bit by bit."""
    byte = "c"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    codes = f"list_transform(string_split({digits}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, ch: list_transform([xor(acc, ch)], lambda c: {byte})[1]), 4294967295::BIGINT)"


OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT DISTINCT c, {_crc32_sql('c::VARCHAR')} % 6 AS h FROM t),
u AS (SELECT v.c, 0 AS part, t.pos, r, x FROM v JOIN t ON t.c = v.c - v.c % 100 AND t.pos <= h UNION ALL SELECT v.c, 1, t.pos, r, x FROM v JOIN t ON t.c = v.c AND t.pos > h),
b AS (SELECT c, row_number() OVER w AS d, r, x, string_agg(md5(r || chr(31) || x), '') OVER w AS k FROM u WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
m AS (SELECT c, d, md5(k) AS k, x FROM b UNION ALL SELECT c, 0, '', '' FROM v),
l AS (SELECT c, max(d) AS len FROM m GROUP BY 1),
n AS (SELECT d, k, min(c) AS rep, count(*) AS n_convs, any_value(length(x)) AS size FROM m GROUP BY 1, 2),
e AS (SELECT d, k, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ends FROM m JOIN l ON l.c = m.c AND l.len = m.d GROUP BY 1, 2),
p AS (SELECT DISTINCT y.d, y.k, z.k AS up FROM m y JOIN m z ON z.c = y.c AND z.d = y.d - 1),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM p GROUP BY 1, 2),
below AS (SELECT DISTINCT y.d, y.k, z.d AS zd, z.k AS zk FROM m y JOIN m z ON z.c = y.c AND z.d >= y.d),
s AS (SELECT below.d, below.k, sum((n_convs - 1) * size) AS saved, count(*) FILTER (ch.d IS NULL) AS leaves FROM below JOIN n ON n.d = zd AND n.k = zk LEFT JOIN ch ON ch.d = zd AND ch.k = zk GROUP BY 1, 2)
SELECT n.rep AS conv_id, n.d::BIGINT AS depth, up.rep AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN ch USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN p USING (d, k) LEFT JOIN n up ON up.d = n.d - 1 AND up.k = p.up
"""

# hex digits of the bytes, two a byte
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS o FROM q) WHERE o < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS opens FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY 1, 2),
k AS (SELECT r.doc_id, run, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY run), 0) + 1, 2 * (a - coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY run), 0))) AS before FROM r JOIN d USING (doc_id)),
t AS (SELECT doc_id, string_agg(before, '' ORDER BY run) AS kept, max(e) AS last FROM k GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n FROM r GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
n AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE x END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_neighbours": OP7_SQL, "op8_chat": OP8_SQL, "op10_passages": OP10_SQL, "op11_trie": OP11_SQL, "op12_factors": OP12_SQL, "op13_infill": OP13_SQL}
