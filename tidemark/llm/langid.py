"""Language identification as mixture inference.

Character trigrams of a bounded sample of labelled rows give each language's likelihoods (a table of
hashed trigrams with a fixed number of cells; with more than 256 languages the trigrams share more cells). A document's
words are drawn from a mixture of languages: expectation-maximisation over all languages estimates first proportions,
for all documents of a slice at once. The languages then enter by their proportions, one after another, and each set is
fitted again, as long as the likelihood penalised by half a log word count and a weight for each further language
rises: any number of languages can enter. The prediction is the language with the largest share in the best set.

A null text or one without letters is `und` with score 0. Rows with null language or id are not learned from. Every row
is judged by its own text, so repeated rows repeat their result. Without anything learned, every row is `und`. Ties go
to the language that sorts first. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, text_slices, texts

#: Labelled rows that training looks at, about.
MAX_ROWS = 12_000
#: Cells of the likelihood table over all languages; trigram buckets shrink when there are many languages.
MAX_CELLS = 1 << 24
MAX_BITS = 16
ROUNDS, SET_ROUNDS = 8, 6
PENALTY = 2.0
SMOOTHING = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(batch_texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram of every word (with a space on both ends), the first trigram of each word,
    and each word's document."""
    low = [t.lower() for t in batch_texts]
    codes = np.frombuffer((" " + "\n".join(low) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    mid = np.flatnonzero(letter)
    h = (c[mid - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[mid] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[mid + 1] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(~letter[mid - 1])
    ends = np.cumsum(np.array([len(t) + 1 for t in low], dtype=np.int64)) + 1
    return bucket, first, np.searchsorted(ends, mid[first], side="right")


def train(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and the (bucket x language) table of log likelihoods from rows (id, text, lang)."""
    rows = bounded_sample(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(id_col).isNotNull()), id_col, max_rows).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch):
                got, langs = texts(part), part.column("lang").to_pylist()
                for lang in set(langs):
                    bucket, _, _ = trigrams([t for t, x in zip(got, langs, strict=True) if x == lang], MAX_BITS)
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket, minlength=1 << MAX_BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    known = counts.toPandas()
    langs = sorted(known["lang"].unique())
    if not langs:
        return [], np.zeros((1, 0), dtype=np.float32)
    bits = MAX_BITS
    while (len(langs) << bits) > MAX_CELLS and bits > 8:
        bits -= 1
    sums = np.zeros((1 << bits, len(langs)))
    np.add.at(sums, (known["bucket"].to_numpy() >> (MAX_BITS - bits), known["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()), known["n"].to_numpy(dtype=float))
    return langs, np.log((sums + SMOOTHING) / (sums.sum(axis=0) + SMOOTHING * len(sums))).astype(np.float32)


def infer(batch_texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each language in the chosen set, number of words) for each text."""
    n_docs, n_langs = len(batch_texts), table.shape[1]
    shares, n_words = np.zeros((n_docs, n_langs)), np.zeros(n_docs, dtype=np.int64)
    bucket, first, doc = trigrams(batch_texts, int(np.log2(len(table))))
    if not len(first) or not n_langs:
        return shares, n_words
    loglik = np.add.reduceat(table[bucket], first, axis=0)
    top = loglik.max(axis=1)
    lik = np.exp(loglik - top[:, None])
    has, start, back = np.unique(doc, return_index=True, return_inverse=True)
    words = np.diff(np.append(start, len(doc)))
    base = np.add.reduceat(top.astype(np.float64), start)

    def fit(pi: np.ndarray, rounds: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares after so many rounds, and log likelihoods, of some of the documents."""
        if len(docs) == len(has):
            mine, begin, place = lik, start, back
        else:
            use = np.isin(back, docs)
            mine, place = lik[use], np.searchsorted(docs, back[use])
            begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = words[docs]
        for _ in range(rounds):
            joint = mine * pi[place]
            total = np.maximum(joint.sum(axis=1), 1e-30)
            pi = np.add.reduceat(joint / total[:, None], begin, axis=0) / n[:, None]
        total = np.maximum((mine * pi[place]).sum(axis=1), 1e-30)
        return pi, base[docs] + np.add.reduceat(np.log(total).astype(np.float64), begin)

    everyone = np.arange(len(has))
    full, _ = fit(np.full((len(has), n_langs), 1 / n_langs, dtype=np.float32), ROUNDS, everyone)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, best_score = np.zeros_like(full), np.full(len(has), -np.inf)
    rising, size = everyone, 0
    while len(rising) and size < n_langs:
        size += 1
        pi = np.maximum(full[rising], 1e-3) * (rank[rising] < size)
        pi, value = fit((pi / pi.sum(axis=1, keepdims=True)).astype(np.float32), 0 if size == 1 else SET_ROUNDS, rising)
        value = value - PENALTY * (size - 1) * (0.5 * np.log(words[rising] + 1.0) + 1)
        better = value > best_score[rising]
        best[rising[better]], best_score[rising[better]] = pi[better], value[better]
        rising = rising[better]
    shares[has], n_words[has] = best, words
    return shares, n_words


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, `lang_pred`, `score` (its share) and `shares` (language to share, of the chosen set)."""
    held = docs.sparkSession.sparkContext.broadcast((langs, table))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names, likelihoods = held.value
        for batch in batches:
            for part in text_slices(batch, budget=1 << 20):
                shares, n_words = infer(texts(part), likelihoods)
                pick = shares.argmax(axis=1) if names else np.zeros(part.num_rows, dtype=int)
                pred = [names[k] if n else UNKNOWN for k, n in zip(pick.tolist(), n_words.tolist(), strict=True)]
                score = shares.max(axis=1) if names else np.zeros(part.num_rows)
                each = [[(names[k], float(row[k])) for k in np.flatnonzero(row > 0)] for row in shares]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(each, pa.map_(pa.string(), pa.float64()))], names=["id", "lang_pred", "score", "shares"])

    slim = docs.select(F.col(id_col).alias("id"), "text")
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double, shares map<string,double>").withColumnRenamed("id", id_col)
