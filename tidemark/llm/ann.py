"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Each unit vector is turned by a fixed random rotation and kept as the signs of its coordinates (packed
bits) with two scalars: its length and the inner product of the code with what it stands for. From these a
query's inner product is estimated without bias, with an error bound that shrinks with the dimension. In
each block the best estimates are computed exactly first; then every vector whose estimate plus bound
reaches the exact k-th best is reranked on the original vectors, in single and then in double precision.

Queries and candidates meet in blocks of bounded size: (query block, candidate block) is the grouping key,
blocks are dealt by a hash of the row's number, so groups are even, none grows with the data, and a repeated id is
no hot key. Each block pair returns k rows a query at most. A candidate travels to every query block as it is
stored (single precision stays single) with its code; sums are made in double precision.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. Vectors
meet only those of their own dimension. Ties go to the smaller id. Rows are told apart by a number of their own: a
query's candidates are all rows but itself, so another row with its id is one, and each row of a repeated query id
gets its own k neighbours, under the same `query_id`. A query with fewer candidates than k gets them all. Other
columns, whatever their names, are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Components of a block of queries, and of one of candidates, about.
QUERY_CELLS = 1 << 17
CANDIDATE_CELLS = 1 << 20
#: Width of the error bound in standard deviations.
WIDTH = 4.0
SEED = 20_240_501


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of codes with the unit vectors."""
    length = np.linalg.norm(vectors.astype(np.float64), axis=1)
    unit = (vectors / length[:, None]).astype(np.float32) @ turn.T
    return np.packbits(unit > 0, axis=1), length.astype(np.float32), np.abs(unit).sum(axis=1) / np.float32(np.sqrt(unit.shape[1]))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Index rows (vec_id, dim, vector, code, length, fit) of every usable vector."""
    fine = usable(vectors, id_col, vec_col)
    if fine.schema["vector"].dataType.simpleString() not in ("array<float>", "array<double>"):
        fine = fine.withColumn("vector", F.col("vector").cast("array<double>"))
    kind = fine.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                codes, length, fit = encode(flat, rotation(int(dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length, pa.float32()), pa.array(fit, pa.float32())], names=["vec_id", "vector", "dim", "code", "length", "fit"])

    return fine.mapInArrow(run, f"vec_id bigint, vector {kind}, dim int, code binary, length float, fit float")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _none() -> pd.DataFrame:
    return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})


def search_block(queries: pd.DataFrame, cands: pd.DataFrame, k: int, width: float = WIDTH) -> pd.DataFrame:
    """The k best candidates of each query within one pair of blocks."""
    q, x = (np.stack(rows["vector"].to_numpy()).astype(np.float64) for rows in (queries, cands))
    q_id, x_id = queries["vec_id"].to_numpy(), cands["vec_id"].to_numpy()
    q_row, x_row = queries["row"].to_numpy(), cands["row"].to_numpy()
    dim = x.shape[1]
    bits = np.unpackbits(np.frombuffer(b"".join(cands["code"]), dtype=np.uint8).reshape(len(x), -1), axis=1)[:, :dim]
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    fit, length = cands["fit"].to_numpy(), cands["length"].to_numpy()
    scale = length / fit
    spread = length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * np.float32(width / np.sqrt(max(dim - 1, 1)))
    turned = q.astype(np.float32) @ rotation(dim).T
    q_len = np.linalg.norm(turned, axis=1)
    single, q32 = x.astype(np.float32), q.astype(np.float32)
    # more than single precision can be off by, in these sums
    slack = 1e-6 * dim * np.linalg.norm(q, axis=1) * float(length.max())
    out = []
    for s in range(0, len(q), 128):
        near = turned[s : s + 128] @ signs.T * scale
        bound = near + q_len[s : s + 128, None] * spread
        for i in range(len(near)):
            own = x_row == q_row[s + i]
            near[i, own] = bound[i, own] = -np.inf
            room = len(x) - int(own.sum())
            if not room:
                continue
            take = np.argpartition(-near[i], min(2 * k, room) - 1)[: min(2 * k, room)]
            score = exact(np.broadcast_to(q[s + i], (len(take), dim)), x[take])
            if room > len(take):
                floor = np.partition(score, len(score) - k)[len(score) - k]
                bound[i, take] = -np.inf
                more = np.flatnonzero(bound[i] >= floor - slack[s + i])
                # single precision first: only what can still reach the floor is summed in double precision
                more = more[np.take(single, more, axis=0) @ q32[s + i] >= floor - slack[s + i]]
                take = np.concatenate([take, more])
                score = np.concatenate([score, exact(np.broadcast_to(q[s + i], (len(more), dim)), x[more])])
            best = np.lexsort((x_row[take], x_id[take], -score))[:k]
            out.append(pd.DataFrame({"row": q_row[s + i], "query_id": q_id[s + i], "vec_id": x_id[take[best]], "score": score[best]}))
    return pd.concat(out) if out else _none()


def search(index: DataFrame, is_query, k: int = 20, query_cells: int = QUERY_CELLS, candidate_cells: int = CANDIDATE_CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for the index rows that `is_query` selects."""
    # numbered before it is written, so a row keeps its number however often it is read
    index = materialize(index.withColumn("row", F.monotonically_increasing_id()), "codes")
    # one row a dimension
    sizes = index.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") / candidate_cells).cast("int").alias("cbs"), F.greatest(F.lit(1), F.ceil(F.count(F.when(is_query, 1)) * F.col("dim") / query_cells)).cast("int").alias("qbs"))
    sized = index.join(F.broadcast(sizes), "dim")
    block = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = sized.filter(is_query).select("row", "vec_id", "vector", "dim", block("q", "qbs").alias("qb"), every("cbs").alias("cb"))
    right = sized.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "vector", "dim", "code", "length", "fit")], block("c", "cbs").alias("cb"), every("qbs").alias("qb"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _none() if a.empty or b.empty else search_block(a, b, k)

    keys = ["dim", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
