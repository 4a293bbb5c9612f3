"""Suffix-array deduplication of byte strings by longest-previous-factor arrays.

A byte goes if some string of `SPAN` bytes that covers it starts in a document with a smaller id, too.

1. Of the byte n-grams of every `SPAN`-byte string the one with the smallest hash is its anchor, so equal strings have
   equal anchors. Anchors that different texts share are counted out; documents keep theirs. Of equal texts one, of
   the smallest id, speaks for all; the others lose every byte and go no further.
2. The strings with one shared anchor form short segments (anchor, bytes, document, place). Equal segments are
   aggregated before they travel, to their smallest document.
3. The segments of an anchor meet in one task. Their suffixes are sorted; the longest common prefixes of neighbours,
   and the previous and next entries with a smaller document, give every suffix its longest previous factor: where
   it reaches `SPAN` bytes, the string has occurred before. A document that has a segment of a smaller one
   loses all of it.
4. What is lost goes back to the documents as (place, bits), a bit a string.

An anchor with more than `CROWD` different segments (a line that very many documents carry, each between words of its
own) does not meet in one task: its strings are aggregated one by one to their smallest document.

A null text is empty. Texts shorter than `SPAN` lose nothing. Rows are judged one by one: rows with a null id lose
nothing and take nothing; rows that repeat an id, with one text or several, never take from each other but lose to
smaller ids. Other columns, whatever their names, are ignored. An empty table gives no rows. Very long texts are
read in stretches. Bytes are compared as they are sorted; segments, and strings of a crowd, are told apart by 128 bits
of hash (anchor and contents).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_SHARE, discard, join_copies, materialize, text_slices, window_hashes
from tidemark.llm.passages import sliding_min

#: Bytes of a string, and of an anchor.
SPAN = 50
GRAM = 20
#: Different segments of one anchor that may meet in one task.
CROWD = 4096
#: Suffixes that are sorted at once, about.
SORTED = 250_000
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
#: Texts that one task remembers having fingerprinted.
MEMORY = 200_000
#: Log2 of the bits that say which anchors may be shared: 8 MB.
FILTER_BITS = 26

_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def anchors(raw: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The anchor of every string of `span` bytes."""
    out = []
    for a in range(0, max(0, len(raw) - span + 1), STRETCH):
        part = raw[a : a + STRETCH + span - 1]
        out.append(sliding_min(window_hashes(_BYTE[part], gram), span - gram + 1).view(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def runs(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of equal values, in pieces of at most `most`."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    size = np.diff(np.append(first, len(values)))
    pieces = -(-size // most)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(first, pieces) + k * most, np.minimum(np.repeat(size, pieces) - k * most, most)


def _raw(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Bytes of each row of a binary column `text`, without copies."""
    column = batch.column("text")
    data = column.buffers()[2]
    edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return [whole[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _fingerprints(texts: DataFrame, span: int, gram: int, filtered=None) -> DataFrame:
    """(doc, th, anchor, sure): the anchors of every text, each once. Given (bits, hot anchors), those that may be shared
    and those that surely are. A task tells the anchors of equal texts once, and again for a smaller id."""

    def run(batches):
        told: dict[int, int] = {}
        bits, hot = (None, None) if filtered is None else filtered.value
        for batch in batches:
            for part in text_slices(batch):
                doc, key, found = [], [], []
                for d, th, raw in zip(part.column("doc").to_pylist(), part.column("th").to_pylist(), _raw(part), strict=True):
                    if told.get(th, d + 1) <= d:
                        continue
                    if len(told) >= MEMORY:
                        told.clear()
                    told[th] = d
                    values = anchors(raw, span, gram)
                    values = np.unique(values[runs(values, len(values) + 1)[0]])
                    if bits is not None:
                        place = values & ((1 << FILTER_BITS) - 1)
                        values = values[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                    doc.append(np.full(len(values), d))
                    key.append(np.full(len(values), th))
                    found.append(values)
                if not found:
                    continue
                values = np.concatenate(found)
                sure = np.zeros(len(values), bool) if hot is None else np.isin(values, hot)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(key), pa.int64()), pa.array(values), pa.array(sure)], names=["doc", "th", "anchor", "sure"])

    return texts.mapInArrow(run, "doc bigint, th bigint, anchor bigint, sure boolean")


def _bits(shared: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the low bits of every shared anchor; at most 2,048 rows of 4 KB reach the driver."""
    place = F.col("anchor").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = shared.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in rows:
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _segments(suspects: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, seg, doc, th, pos, n): stretches of at most span - gram + 1 strings with one shared anchor."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                cols = {c: [] for c in ("anchor", "doc", "th", "pos", "n")}
                segs = []
                for d, th, raw, marks in zip(part.column("doc").to_pylist(), part.column("th").to_pylist(), _raw(part), part.column("marks"), strict=True):
                    values = anchors(raw, span, gram)
                    first, size = runs(values, span - gram + 1)
                    mine = np.isin(values[first], marks.values.to_numpy())
                    first, size = first[mine], size[mine]
                    data = raw.tobytes()
                    segs += [data[a : a + k + span - 1] for a, k in zip(first.tolist(), size.tolist(), strict=True)]
                    for c, v in (("anchor", values[first]), ("doc", np.full(len(first), d)), ("th", np.full(len(first), th)), ("pos", first), ("n", size)):
                        cols[c].append(v)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(v).astype(np.int64)) for v in cols.values()], pa.array(segs, pa.binary())], names=[*cols, "seg"])

    return suspects.mapInArrow(run, "anchor bigint, doc bigint, th bigint, pos bigint, n bigint, seg binary")


def suffix_order(buf: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at`, in the order of their first `span` bytes, and the longest common prefix of each
    with the one before it, up to `span`. Every suffix has `span` bytes. They are sorted by eight bytes at a time, and
    after the first eight only those that are still equal to others."""
    wide = buf.astype(np.uint64)
    for k in (1, 2, 4):
        wide = (wide[:-k] << np.uint64(8 * k)) | wide[k:]  # 2, 4, 8 bytes from each place, first byte highest
    offsets = [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]
    key = wide[at]
    order = np.argsort(key)
    lcp = np.full(len(at), span, dtype=np.int64)
    lcp[:1] = 0
    key = key[order]
    differ = key[1:] ^ key[:-1]
    new = np.flatnonzero(differ)
    lcp[new + 1] = _equal_bytes(differ[new])
    opens = np.append(True, differ != 0)  # where a group of equal suffixes begins
    for o in offsets[1:]:
        tied = np.flatnonzero(~opens | ~np.append(opens[1:], True))
        if not len(tied):
            break
        group = np.cumsum(opens[tied]) - 1
        key = wide[at[order[tied]] + o]
        by_key = np.argsort(key)
        place = np.empty(len(key), dtype=np.int64)
        place[by_key] = np.arange(len(key))
        to = np.argsort(group * len(key) + place)
        order[tied] = order[tied][to]
        key = key[to]
        differ = np.append(np.uint64(0), key[1:] ^ key[:-1])
        new = np.flatnonzero((differ != 0) & ~opens[tied])
        lcp[tied[new]] = o + _equal_bytes(differ[new])
        opens[tied[new]] = True
    return order, lcp


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the first bytes of eight are equal, from their exclusive or."""
    return sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))


def previous_factor(lcp: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For every entry of a suffix order its longest common prefix with the nearest earlier entry of a smaller document,
    where that reaches `span`, else 0. Pointers leap from entry to entry, all of them at once: what lies between an
    entry and its pointer has no smaller document."""
    low, prev = lcp.copy(), np.arange(-1, len(doc) - 1)
    todo = np.flatnonzero(low >= span)
    while len(todo):
        todo = todo[(low[todo] >= span) & (prev[todo] >= 0)]
        todo = todo[doc[prev[todo]] >= doc[todo]]
        via = prev[todo]
        low[todo], prev[todo] = np.minimum(low[todo], low[via]), prev[via]
    found = (low >= span) & (prev >= 0)
    found[found] = doc[prev[found]] < doc[found]
    return np.where(found, low, 0)


def longest_previous_factors(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each suffix the longest prefix, of at most `span` bytes, that a suffix of a smaller document shares; 0 if it is
    shorter than `span`."""
    order, lcp = suffix_order(buf, at, span)
    owner = doc[order]
    before = previous_factor(lcp, owner, span)
    after = previous_factor(np.append(0, lcp[:0:-1]), owner[::-1], span)[::-1]
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def seen_before(segs: list[bytes], owner: np.ndarray, span: int) -> np.ndarray:
    """For each segment the bits of its strings that a smaller document has in one of the others."""
    size = np.array([len(s) for s in segs], dtype=np.int64)
    n = size - span + 1
    start = np.cumsum(size) - size
    which = np.repeat(np.arange(len(segs)), n)
    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    buf = np.frombuffer(b"".join(segs), dtype=np.uint8)
    hit = longest_previous_factors(buf, start[which] + local, owner[which], span) >= span
    bits = np.where(hit, np.int64(1) << local, 0)
    return np.add.reduceat(bits, np.cumsum(n) - n)


def _factored(distinct: DataFrame, span: int) -> DataFrame:
    """(anchor, sid, mask): bits of the strings of each segment that a smaller document has; whole anchors at a time."""
    names = ["anchor", "sid", "mask"]

    def solve(rows: pa.Table):
        mask = seen_before(rows["seg"].to_pylist(), rows["owner"].to_numpy(), span)
        keep = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(rows["anchor"].to_numpy()[keep]), pa.array(rows["sid"].to_numpy()[keep]), pa.array(mask[keep])], names=names)

    def run(batches):
        held, size = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            size += batch.num_rows
            if size * (span - GRAM) // 2 < SORTED:
                continue
            anchor = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
                size = held.num_rows
        if held is not None and held.num_rows:
            yield solve(held)

    return distinct.select("anchor", "sid", "seg", "owner").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor bigint, sid bigint, mask bigint")


def _crowded(distinct: DataFrame, span: int) -> DataFrame:
    """What `_factored` gives, for crowded anchors: every string is aggregated to its smallest document."""
    each = distinct.select("anchor", "sid", "owner", F.expr(f"posexplode(transform(sequence(0, octet_length(seg) - {span}), i -> xxhash64(substring(seg, i + 1, {span}))))").alias("i", "w"))
    each = materialize(each, "strings")
    least = materialize(each.groupBy("anchor", "w").agg(F.min("owner").alias("least"), F.count("*").alias("copies")).filter("copies > 1"), "least")
    lost = join_copies(each, least, ["anchor", "w"]).filter("owner > least")
    return lost.groupBy("anchor", "sid").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def _taken(rows: DataFrame, span: int) -> DataFrame:
    """From (doc, th, text, lost): (doc, th, n_removed, removed, kept_digest)."""
    names = ["doc", "th", "n_removed", "removed", "kept_digest"]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                count, ranges, digest = [], [], []
                for raw, lost in zip(_raw(part), part.column("lost"), strict=True):
                    pos, mask = (lost.values.field(c).to_numpy() for c in (0, 1))
                    k, bit = np.nonzero((mask[:, None] >> np.arange(span)) & 1)
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(edge, pos[k] + bit, 1)
                    np.add.at(edge, pos[k] + bit + span, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                    count.append(int(gone.sum()))
                    ranges.append([{"start": a, "end": e} for a, e in ends.tolist()])
                    digest.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(count, pa.int64()), pa.array(ranges, _RANGES), pa.array(digest, pa.string())], names=names)

    return rows.mapInArrow(run, "doc bigint, th bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_digest string")


def repeated_strings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_bytes`, `n_removed`, `removed` (byte ranges, end exclusive, maximal), `kept_sha256`,
    the hash of the bytes that stay, and `text_hash`, which tells texts of one id apart."""
    if not 8 <= gram < span <= gram + 62:
        raise ValueError("8 <= gram < span <= gram + 62")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text"), F.xxhash64(text).alias("th"))
    heads = materialize(slim.select("doc", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "heads")
    long = slim.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= span))

    # of equal texts the smallest id speaks
    sets = materialize(heads.filter(f"doc is not null and n_bytes >= {span}").groupBy("digest", "th").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "sets")
    tells = sets.select(F.col("rep").alias("doc"), "th")
    shared = _fingerprints(long, span, gram).groupBy("anchor").agg(F.min("th").alias("x"), F.max("th").alias("y"), F.count("*").alias("copies")).filter("x < y")
    shared = materialize(shared.select("anchor", "copies"), "shared")
    least = heads.count() * HOT_SHARE
    # anchors of a thousandth of all rows: as many as a text has of them, and a thousand times that at most
    hot = np.array([r[0] for r in shared.filter(F.col("copies") >= least).orderBy(F.desc("copies")).limit(10_000).select("anchor").collect()], dtype=np.int64)
    filtered = docs.sparkSession.sparkContext.broadcast((_bits(shared), np.sort(hot)))
    told = materialize(_fingerprints(long, span, gram, filtered), "points")
    filtered.unpersist()
    points = told.filter("sure").unionByName(told.filter("not sure").join(shared.select("anchor").hint("merge"), "anchor", "left_semi"))
    marks = points.groupBy("doc", "th").agg(F.collect_list("anchor").alias("marks")).join(tells, ["doc", "th"])
    suspects = materialize(long.join(marks.hint("merge"), ["doc", "th"]).dropDuplicates(["doc", "th"]), "suspects")
    discard(told, shared)

    segs = materialize(_segments(suspects, span, gram).withColumn("sid", F.xxhash64("seg")), "segments")
    distinct = materialize(segs.groupBy("anchor", "sid", "seg").agg(F.min("doc").alias("owner"), F.count("*").alias("copies")), "distinct")
    crowds = materialize(distinct.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"), "crowds")
    few = distinct.join(crowds, "anchor", "left_anti")
    lost = materialize(_factored(few, span).unionByName(_crowded(distinct.join(crowds, "anchor"), span)), "factors")
    found = distinct.select("anchor", "sid", "owner", "copies").join(lost.hint("merge"), ["anchor", "sid"], "left").filter("copies > 1 or mask is not null")
    found = materialize(found, "found")
    discard(distinct, crowds, lost)
    every = F.expr("shiftleft(1L, cast(n as int)) - 1")
    mine = F.when(F.col("doc") > F.col("owner"), every).otherwise(F.coalesce("mask", F.lit(0)))
    hits = join_copies(segs.drop("seg"), found, ["anchor", "sid"]).filter("owner is not null").select("doc", "th", "pos", mine.alias("mask")).filter("mask <> 0")
    hits = materialize(hits.groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "mask")).alias("lost")), "hits")
    discard(segs, found)
    taken = _taken(suspects.drop("marks").join(hits.hint("merge"), ["doc", "th"]), span)

    goes = sets.join(taken.withColumnRenamed("doc", "rep"), ["rep", "th"], "left").filter("copies > 1 or n_removed is not null")
    out = join_copies(heads, materialize(goes.drop("th"), "goes"), ["digest"])
    copy = F.col("doc").isNotNull() & (F.col("doc") > F.col("rep"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    mine = lambda all_gone, lost, none: F.when(copy, all_gone).otherwise(F.coalesce(F.when(F.col("doc").isNotNull(), lost), none))
    return out.select(
        F.col("doc").alias(id_col),
        "n_bytes",
        mine(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        mine(whole, F.col("removed"), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"),
        mine(F.sha2(F.lit(""), 256), F.col("kept_digest"), F.col("digest")).alias("kept_sha256"),
        F.col("th").alias("text_hash"),
    )


def kept_bytes(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a column `kept` (binary): the bytes of the text that `found` (from `repeated_strings`) leaves. Rows
    are matched by id and text; a cut may fall inside a code point, so these are bytes and not a text."""
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    gone = found.filter("n_removed > 0").select(F.col(id_col).cast("bigint").alias("_tm_id"), F.col("text_hash").alias("_tm_th"), F.col("removed").alias("_tm_gone")).dropDuplicates(["_tm_id", "_tm_th"])
    joined = docs.join(gone, (docs[id_col].cast("bigint") == F.col("_tm_id")) & (F.xxhash64(raw) == F.col("_tm_th")), "left")
    ends = F.concat(F.transform("_tm_gone", lambda r: r["start"]), F.array(F.octet_length(raw).cast("bigint")))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_tm_gone", lambda r: r["end"]))
    parts = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.hex(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    return joined.select(*[docs[c] for c in docs.columns], F.when(F.col("_tm_gone").isNull(), raw).otherwise(F.unhex(F.array_join(parts, ""))).alias("kept"))
