"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows (`MAX_EXAMPLES` a class, `MAX_BYTES` of text) becomes an inverted index over all
their words. A word weighs (1 + ln tf) ln(N / df), where df and N count all documents; no word and no row is left out.
Examples lie in blocks, ordered by their weightiest word; for each word and block the largest weight is kept, and
blocks are scored by falling bound until none reaches the k-th best similarity so far, so the k nearest are exact.
Words that many examples have are summed for a batch of documents at once, as one matrix product; the bound of a
block then has their exact sum, and the similarities of what is found are summed anew in full precision.

Neighbours vote with their squared similarity. A second vote, by the same search, is taken under weights in which a word
counts as much as its odds of standing in a toxic example differ from those in another (beyond `ERRORS` standard
errors; `relevance`). A logistic curve over both votes, fitted on the examples themselves (each scored without itself,
classes weighted back to their true shares), turns them into scores; `evidence` are the neighbours of the first vote.

Null and empty texts, and texts without a word of the examples, get the score of a document without neighbours.
Rows with a null label or id are not learned from; repeated labels of one document are averaged and rounded, and of
several texts of one id the smallest is learned, once. Every row is scored by its own text. Ties between neighbours go
to the smaller example number. Without labelled rows of both classes every score is 0.5. Other columns, whatever their
names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_sample, materialize, text_slices, texts

#: Labelled rows of each class that become examples, about, and bytes of their texts, about.
MAX_EXAMPLES = 1_000
MAX_BYTES = 64 << 20
#: Standard errors by which log odds must differ for the second vote.
ERRORS = 2.0
BLOCK = 32
#: A word that one of so many examples has is summed as part of a matrix; and documents of one product.
DENSE = 20
BATCH = 64
#: Slack of sums in single precision.
SLACK = 1e-5
NEIGHBOURS = 25
#: Blocks scored before any bound is used.
FIRST_BLOCKS = 16
VOTE_FLOOR = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Index:
    """Block-max inverted index over examples. Cells are the pairs of a word and a block with postings, by word, then
    block; a cell has its largest weight and the range of its postings. Words of many examples are rows of a matrix."""

    vocab: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    example: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    bound: np.ndarray = field(default_factory=lambda: np.empty(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    blocks: int = 1
    row: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    vectors: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0)))
    scratch: np.ndarray | None = None

    def unit(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of word numbers and their counts."""
        w = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(w @ w)
        return (at[w > 0], w[w > 0] / norm) if norm > 0 else (at[:0], w[:0])

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of the examples; example k of the index is `vectors[k]`."""
        n, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        size = np.array([len(v[0]) for v in vectors], dtype=np.int64)
        term = np.concatenate([v[0] for v in vectors]) if n else np.empty(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if n else np.empty(0)
        self.vectors = (np.concatenate([[0], np.cumsum(size)]), term, weight)
        example = np.repeat(np.arange(n), size)
        often = np.flatnonzero(np.bincount(term, minlength=len(self.vocab)) * DENSE >= max(n, DENSE))
        self.row = np.full(len(self.vocab), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), dtype=np.float32)
        mine = self.row[term] >= 0
        self.dense[self.row[term[mine]], example[mine]] = weight[mine]
        term, weight, example = term[~mine], weight[~mine], example[~mine]
        order = np.lexsort((example, term))
        term, self.weight, self.example = term[order], weight[order], example[order].astype(np.int32)
        cell = term * self.blocks + self.example // BLOCK
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        self.start = np.append(at, len(cell))
        self.block = (cell[at] % self.blocks).astype(np.int32)
        self.bound = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.first = np.searchsorted(term[at], np.arange(len(self.vocab) + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None):
        """For each query vector the exact nearest examples with positive similarity, nearest first. Queries are worked
        off in batches: the blocks of highest bound first, then those whose bound reaches the k-th best similarity of these."""
        n = len(self.ids)
        for a in range(0, len(queries), BATCH):
            part = queries[a : a + BATCH]
            m = len(part)
            if not n:
                yield from [(np.empty(0, np.int64), np.empty(0))] * m
                continue
            of = np.repeat(np.arange(m), [len(v[0]) for v in part])
            at, w = (np.concatenate([v[i] for v in part]) for i in (0, 1))
            row = self.row[at]
            often, rare = row >= 0, row < 0
            q = np.zeros((m, len(self.dense)), dtype=np.float32)
            q[of[often], row[often]] = w[often]
            sim = (q @ self.dense).astype(float)
            cells, term = _ranges(self.first[at[rare]], self.first[at[rare] + 1], np.arange(np.count_nonzero(rare)))
            asks, share, block = of[rare][term], w[rare][term], self.block[cells]
            bound = np.maximum.reduceat(sim, np.arange(0, n, BLOCK), axis=1)
            bound += np.bincount(asks * self.blocks + block, weights=share * self.bound[cells], minlength=m * self.blocks).reshape(m, -1)
            place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
            done = np.zeros((m, self.blocks), dtype=bool)
            floor = np.zeros(m)
            for step in (place < FIRST_BLOCKS, None):
                step = ((bound >= floor[:, None] - SLACK) if step is None else step) & (bound > 0) & ~done
                take = step[asks, block]
                post, cell = _ranges(self.start[cells[take]], self.start[cells[take] + 1], np.arange(np.count_nonzero(take)))
                sim += np.bincount(asks[take][cell] * n + self.example[post], weights=share[take][cell] * self.weight[post], minlength=m * n).reshape(m, n)
                done |= step
                known = np.where(np.repeat(done, BLOCK, axis=1)[:, :n], sim, 0)
                if skip is not None:
                    known[np.arange(m), skip[a : a + m]] = 0
                if n > NEIGHBOURS:
                    floor = np.partition(known, n - NEIGHBOURS, axis=1)[:, n - NEIGHBOURS]
            found = (known > 0) & (known >= floor[:, None] - SLACK)
            for k, v in enumerate(part):
                near = np.flatnonzero(found[k])
                exact = self._similarity(near, *v)
                keep = np.lexsort((near, -exact))[:NEIGHBOURS]
                keep = keep[exact[keep] > 0]
                yield near[keep], exact[keep]

    def _similarity(self, examples: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums in full precision."""
        if self.scratch is None:
            self.scratch = np.zeros(len(self.vocab))
        self.scratch[at] = w
        edge, term, weight = self.vectors
        out = np.array([self.scratch[term[a:b]] @ weight[a:b] for a, b in zip(edge[examples].tolist(), edge[examples + 1].tolist(), strict=True)], dtype=float)
        self.scratch[at] = 0
        return out

    def vote(self, near: np.ndarray, sim: np.ndarray) -> float:
        """Log ratio of the squared similarities of toxic and other neighbours."""
        w = sim * sim
        toxic = w[self.labels[near] == 1].sum()
        return float(np.log((toxic + VOTE_FLOOR) / (w.sum() - toxic + VOTE_FLOOR)))

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> np.ndarray:
        return np.array([self.vote(*found) for found in self.nearest(queries, skip)])


@dataclass
class Model:
    """Both indexes, over the same examples and words, and the curve over their votes."""

    plain: Index
    relevant: Index
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def vectors(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        at = np.fromiter(map(self.plain.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at, tf = np.unique(at[at >= 0], return_counts=True)
        return self.plain.unit(at, tf), self.relevant.unit(at, tf)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        """Scores from rows of two votes."""
        return 1 / (1 + np.exp(-np.clip(votes @ self.curve[:2] + self.curve[2], -35, 35)))


def _ranges(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, each with its range's value."""
    size = end - start
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - np.cumsum(size) + size, size), np.repeat(value, size)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slopes and intercept by Newton steps with a slight ridge."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta, ridge = np.zeros(design.shape[1]), np.array([1e-2] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        grad = design.T @ (w * (y - p)) - ridge * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _term_counts(rows: DataFrame) -> DataFrame:
    """(id, label, term, tf) of the examples."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                for i, y, text in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), texts(part), strict=True):
                    words, tf = np.unique(np.array(terms(text) or [""], dtype=object), return_counts=True)
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n), pa.array([y] * n, pa.int32()), pa.array(words.tolist(), pa.string()), pa.array(tf.astype(np.int64))], names=["id", "label", "term", "tf"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, term string, tf long")


def weighed_terms(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(term, no, relevance) of all words of the n1 toxic and the n0 other examples: by how much their log odds differ
    beyond `ERRORS` standard errors, or 0; numbered in order. A row a word of the bounded sample."""
    each = counts.filter("term != ''").groupBy("term").agg(F.count(F.when(F.col("label") == 1, 1)).alias("a"), F.count(F.when(F.col("label") == 0, 1)).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    a_not, b_not = F.lit(n1 + 1.0) - a, F.lit(n0 + 1.0) - b
    beyond = F.abs(F.log(a / a_not) - F.log(b / b_not)) - ERRORS * F.sqrt(1 / a + 1 / a_not + 1 / b + 1 / b_not)
    return each.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("no"), F.greatest(beyond, F.lit(0.0)).alias("relevance"))


def document_frequencies(docs: DataFrame, vocab: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        known = held.value
        df, n = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in text_slices(batch):
                for text in texts(part):
                    found = set(map(known.get, terms(text), repeat(-1)))
                    found.discard(-1)
                    df[list(found)] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(got["term"].tolist(), got["n"].tolist(), strict=True))
    return np.array([counts.get(k, 0) for k in range(len(vocab))], dtype=np.int64), int(counts.get(-1, 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id") -> Model:
    """Indexes over a bounded sample of the labelled rows, word statistics over all of `docs`."""
    rows, sizes = labelled_sample(docs, labels, label, MAX_EXAMPLES, MAX_BYTES, id_col, per_class=True)
    counts = materialize(_term_counts(rows), "examples")
    # what reaches the driver is bounded by the sample's bytes
    each = counts.select("id", "label").distinct().toPandas()
    n1, n0 = int((each["label"] == 1).sum()), int((each["label"] == 0).sum())
    none = lambda: Index({}, np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))
    if not n1 or not n0:
        return Model(none(), none())
    terms_of = materialize(weighed_terms(counts, n1, n0), "terms")
    known = terms_of.orderBy("no").toArrow()
    vocab = {t: k for k, t in enumerate(known["term"].to_pylist())}
    df, n_docs = document_frequencies(docs, vocab)
    idf = np.log(np.maximum(n_docs, 1) / np.maximum(df, 1))
    # postings as numbers; both sides are bounded by the sample
    kept = counts.join(terms_of, "term").select("id", "no", "tf").toArrow()
    ids, at, tf = kept["id"].to_numpy(), kept["no"].to_numpy().astype(np.int64), kept["tf"].to_numpy().astype(float)
    order = np.lexsort((at, ids))
    ids, at, tf = ids[order], at[order], tf[order]
    start, end = np.searchsorted(ids, each["id"], side="left"), np.searchsorted(ids, each["id"], side="right")
    found = []
    for weights in (idf, idf * known["relevance"].to_numpy()):
        index = Index(vocab, weights, np.empty(0, np.int64), np.empty(0, np.int32))
        vectors = [index.unit(at[x:y], tf[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
        lead = np.array([int(v[0][v[1].argmax()]) if len(v[0]) else -1 for v in vectors])
        placed = np.lexsort((each["id"], lead))
        index.ids, index.labels = each["id"].to_numpy()[placed], each["label"].to_numpy()[placed]
        vectors = [vectors[k] for k in placed]
        index.build(vectors)
        votes = np.empty(len(placed))
        votes[placed] = index.votes(vectors, list(range(len(vectors))))
        found.append((index, votes))
    y = each["label"].to_numpy().astype(float)
    share = np.where(y == 1, sizes[1] / n1, sizes[0] / n0) * len(y) / (sizes[1] + sizes[0])
    return Model(found[0][0], found[1][0], _logistic(np.stack([found[0][1], found[1][1]], axis=1), y, share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, `score`, and `evidence`, its nearest examples (id, similarity, label)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        known = held.value
        ix = known.plain
        for batch in batches:
            for part in text_slices(batch):
                vectors = [known.vectors(terms(text)) for text in texts(part)]
                found = list(ix.nearest([v[0] for v in vectors]))
                near, sim = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                rows = pa.StructArray.from_arrays([pa.array(ix.ids[near].astype(np.int64)), pa.array(sim), pa.array(ix.labels[near].astype(np.int32))], fields=list(near_type.value_type))
                evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32()), rows)
                votes = np.zeros((len(vectors), 2))
                votes[:, 0] = [ix.vote(*f) for f in found]
                votes[:, 1] = known.relevant.votes([v[1] for v in vectors])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(known.calibrated(votes)), evidence], names=["id", "score", "evidence"])

    slim = docs.select(F.col(id_col).alias("id"), "text")
    return slim.mapInArrow(run, f"id {kind}, score double, evidence array<struct<example:bigint,similarity:double,label:int>>").withColumnRenamed("id", id_col)
