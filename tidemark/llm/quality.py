"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader.

Training takes a bounded sample of labelled rows (`MAX_ROWS`, and `MAX_BYTES` of their texts), dealt by a hash of the
id over one group for each `SHARD_ROWS` rows. Each group runs the per-coordinate updates on its rows, and the groups'
weights are averaged by their rows; a model has at most 2**BITS weights whatever the input. Scoring is one sparse dot
product a document and needs no shuffle.

Null and empty texts score as the model's intercept. Rows with a null label or id are not learned from; repeated
labels of one document are averaged and rounded; of several texts of one id the smallest is learned, once. Every row is
scored by its own text. Without any labelled row every score is 0.5. Columns may have any names; with `keep`, an input
column `score` is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, labelled_sample, materialize, text_slices, texts

BITS = 18
#: Labelled rows that training looks at, about, and bytes of their texts; above them a sample by id hash is taken.
MAX_ROWS, MAX_BYTES = 24_000, 128 << 20
#: Rows of one group, about.
SHARD_ROWS = 3_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 1.0
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MEMORY = 200_000


class TokenHashes(dict):
    """64-bit hashes of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


_HASHES = TokenHashes()


def features(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of each text: its words, its word bigrams, the equality patterns of its word trigrams
    (which of the words before a word equals, whatever the words are), and its intercept."""
    doc, feat, val = [], [], []
    shift = np.uint64(64 - BITS)
    for k, text in enumerate(batch_texts):
        tokens = _TOKEN.findall(text)
        h = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        pattern = 1 + (h[2:] == h[1:-1]) + 2 * (h[2:] == h[:-2]).astype(np.uint64)
        both = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9)), pattern.astype(np.uint64) * np.uint64(0x27220A95FE1D0F11)])
        one = both >> shift
        one[one == 0] = 1
        feat.append(np.concatenate([[np.uint64(0)], one]).astype(np.int64))
        value = 1 / np.sqrt(len(one)) if len(one) else 0.0
        val.append(np.concatenate([[1.0], np.full(len(one), value)]))
        doc.append(np.full(len(one) + 1, k))
    if not doc:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(doc), np.concatenate(feat), np.concatenate(val)


class Leader:
    """Per-coordinate follow-the-regularised-leader state."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
    claim("tokens", [_HASHES])
    rows = rows.sort_values("mark")
    model, examples = Leader(1 << BITS), []
    for text, y in zip(rows["text"], rows["label"], strict=True):
        _, feat, val = features([text or ""])
        at, back = np.unique(feat, return_inverse=True)
        examples.append((at, np.bincount(back, weights=val), float(y)))
    for _ in range(EPOCHS):
        for at, x, y in examples:
            model.learn(at, x, y)
    used = np.flatnonzero(model.n)
    w = model.weights(used)
    # feature -1 tells the group's rows
    n = len(examples)
    return pd.DataFrame({"feature": np.append(used[w != 0], -1), "weight": np.append(w[w != 0] * n, n)})


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(id, text, label) of a bounded sample of the labelled documents."""
    return labelled_sample(docs, labels, label, max_rows, MAX_BYTES, id_col)[0]


def train(examples: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Model (feature, weight) from rows (id, text, label), label 0 or 1."""
    shards = -(-examples.count() // shard_rows) or 1
    mark = F.xxhash64(F.lit("ftrl"), F.col("id").cast("string"))
    dealt = examples.select("text", "label", mark.alias("mark"), F.pmod(mark, F.lit(shards)).alias("shard"))
    each = materialize(dealt.groupBy("shard").applyInPandas(_fit_shard, "feature long, weight double"), "weights")
    rows = each.filter("feature = -1").agg(F.sum("weight")).first()[0] or 1.0
    return each.filter("feature >= 0").groupBy("feature").agg((F.sum("weight") / rows).alias("weight"))


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """`score` of every document: its id and score, or all its columns and score if `keep`."""
    known = model.toPandas()
    dense = np.zeros(1 << BITS, dtype=np.float64)
    dense[known["feature"].to_numpy(dtype=np.int64)] = known["weight"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(dense)
    slim = docs if keep else docs.select(id_col, "text")
    slim = slim.drop("score") if keep else slim
    out_schema = slim.schema if keep else slim.select(id_col).schema
    names = [f.name for f in out_schema.fields]

    def run(batches):
        claim("tokens", [_HASHES])
        w = held.value
        for batch in batches:
            for part in text_slices(batch, budget=1 << 20):
                doc, feat, val = features(texts(part))
                dot = np.bincount(doc, weights=w[feat] * val, minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(p)], names=[*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema.fields)
    return slim.mapInArrow(run, f"{fields}, score double")
