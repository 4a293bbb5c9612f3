"""Helpers that the text operators share: tables, scratch tables, Arrow slices, samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step inside a task looks at.
SLICE_BYTES = 2 << 20
#: Resolution of `bounded_sample`.
SAMPLE_STEPS = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the session (`spark.checkpoint.dir`). Where it is unset, a local session (one machine, as
    in tests) gets a temporary folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[context.applicationId]


#: Whether shuffle files go once the write that made them is over; until then a lost executor's are made again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends in files every executor sees, and the shuffles
    behind it are needed no more."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from `materialize` once what was made of them is written, too."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, rows: int, salt: str = "sample") -> DataFrame:
    """All of `df` if it has at most `rows` rows, else the rows whose salted key hash is under a
    threshold at which `rows` are expected. The choice depends on the key alone."""
    n = df.select(key).count()
    if n <= rows:
        return df
    mark = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(SAMPLE_STEPS))
    return df.filter(mark < int(SAMPLE_STEPS * rows / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, id_col: str = "doc_id", per_class: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label) of about `rows` labelled rows (of each class, if `per_class`) and `max_bytes` of text, or all of
    them if there are fewer, and the number of labelled rows of each class.

    Rows with a null label or id are left out; repeated labels of one id are averaged and rounded; of several texts
    of one id the smallest is taken, once."""
    each = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.round(F.avg(label)).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in each.groupBy("label").count().collect()}
    if per_class:
        picked = [bounded_sample(each.filter(F.col("label") == y), id_col, rows) for y in (1, 0)]
        picked = picked[0].unionByName(picked[1])
    else:
        picked = bounded_sample(each, id_col, rows)
    found = docs.select(id_col, "text").join(F.broadcast(picked), id_col)
    found = materialize(found.groupBy(F.col(id_col).alias("id")).agg(F.min("text").alias("text"), F.first("label").alias("label")), "labelled")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        found = found.filter(F.pmod(F.xxhash64(F.lit("bytes"), F.col("id").cast("string")), F.lit(SAMPLE_STEPS)) < int(SAMPLE_STEPS * max_bytes / size))
    return found, sizes


def crc_fold(key: str, parts: int):
    """crc32 of the key as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def text_slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `budget` bytes of text, at least a row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes + 64) // budget
    cuts = np.flatnonzero(np.diff(block)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key over the session's shuffle partitions."""
    return df.repartition(*[F.col(k) for k in keys])


#: Groups with at least this share of the rows are joined by broadcast; there are at most as many as its inverse.
HOT_SHARE = 0.001


def join_copies(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str = "copies") -> DataFrame:
    """`rows` left-joined with one row a group, where `copies` counts the group's rows: a group with a large
    share of all rows stays out of the shuffle. Both sides are read twice, so they should be written tables."""
    least = rows.count() * HOT_SHARE
    hot, rest = groups.filter(F.col(copies) >= least), groups.filter(F.col(copies) < least)
    found = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys, "left")
    return found.unionByName(others)


#: log2 of the bits of the filter that `prune` broadcasts: 2 MB.
FILTER_BITS = 24


def prune(df: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key may be in `needed` (a column of the same name): a bitmap of fixed size is
    broadcast, so rows that are surely not needed stay out of the shuffle of the exact join that follows."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << FILTER_BITS))
    bits = needed.select(place.alias("_p")).groupBy(F.expr("_p div 32768").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_p") % 32768).alias("_bits"))
    # at most 512 rows of 4 KB
    marked = df.withColumn("_p", place).join(F.broadcast(bits), F.expr("_p div 32768 = _bucket"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_p % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0).select(df.columns)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over links, for every node that has a link.

    Large-star and small-star rounds over the edge table until it is a forest of stars; each round is written
    to the shared folder, and hubs are aggregated before they are joined."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        # a star forest: every u has one v, and no v is a u
        roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        loose = roles.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).filter("as_u > 1 or (as_u > 0 and as_v > 0)")
        if loose.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


_HELD: list = [None]


def claim(owner: str, tables: list[dict]) -> None:
    """Called as a task starts: one operator at a time keeps its remembered values in a Python worker, those
    of the operator before are dropped."""
    if _HELD[0] is not None and _HELD[0][0] != owner:
        for t in _HELD[0][1]:
            t.clear()
    _HELD[0] = (owner, tables)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD_HASHES = WordHashes()
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive values: a polynomial modulo 2**64, then mixed."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    if len(_POWERS[0]) < n:
        m = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _POWERS[0][:n], dtype=np.uint64)])
    g = (sums[size:] - sums[:-size]) * _POWERS[1][: n - size + 1]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))
