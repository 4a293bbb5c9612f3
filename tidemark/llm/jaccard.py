"""Jaccard self-join on word shingles by a grouped prefix join.

Each document becomes the set of its distinct shingles. Under one global order, rare shingles first, two
sets at or above the threshold share a shingle among the first ones of each, their prefixes. Documents
with the same prefix and size form one group, and only groups are joined: by prefix shingle and size class,
with a filter on the number of prefix shingles that sets of such sizes must share. Groups that meet are
expanded to members and verified on the whole sets.

Every link is found:
1. equal sets are one node, with its number of documents;
2. a group looks under its rarest prefix shingles only, by as many as it has more than the number it must
   share with a partner of the size class; groups that have fewer drop out;
3. groups that few others meet under a shingle are paired one by one, with a filter on what may follow the shared
   shingle; nodes lie in tiles of bounded size, near their smallest possible partner, and under a hot shingle tiles
   rather than groups are paired: k nodes give (k / tile)^2 rows. The nodes that a pair of tiles has to compare are
   verified at once, as the product of two membership matrices, and each gets its number of links and its place in
   the forest of links there: rows in proportion to nodes, whatever the number of links. A link has one pair of tiles,
   so it counts once.
Links of documents are those of their nodes, counted with copies; components follow from the forests.

The order of shingles is only a matter of speed: a bounded table ranks the most frequent ones last.

Words are runs without space or \\x09-\\x0D after A-Z is lowered. With fewer words than a shingle the whole
sequence is one shingle. A null, empty or wordless text has an empty set and links with nothing: its
component is its own id. Equal texts always link. Rows are the vertices, so rows that repeat an id keep one
row each and are judged by their own text (with one id their links to each other count too); rows with a
null id have no links. Other columns, whatever their names, are ignored. Shingles are compared as 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_HASHES, claim, components, join_copies, materialize, prune, text_slices, texts, window_hashes

SHINGLE = 5
PERCENT = 75
#: Shingles that the frequency table ranks at most (12 bytes each in every worker).
RANKED = 1 << 18
#: A shingle that occurs this often within one slice of documents counts as frequent.
LOCAL_REPEATS = 3
#: Sets and groups that one task remembers having told.
MEMORY = 200_000
#: Ratio of neighbouring size classes.
SIZE_STEP = 1.02
#: Nodes, and shingles, of a tile, about.
TILE, TILE_SHINGLES = 256, 250_000
#: Groups that meet under a shingle and are paired one by one; beyond, tiles are.
FEW = 32
#: Cells of a membership matrix at a time.
CELLS = 1 << 21
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = WORD_HASHES.of(words)
    if len(words) < size:
        return window_hashes(h, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(h, size))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc, th, n, digest) of every document, and rows (token, seen) of shingles frequent in a slice."""
    names = ["doc", "th", "n", "digest", "token", "seen"]

    def run(batches):
        claim("words", [WORD_HASHES])
        for batch in batches:
            for part in text_slices(batch):
                sets = [shingle_set(t, size) for t in texts(part)]
                n = [len(s) for s in sets]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), none, none], names=names)
                if sum(n):
                    token, seen = np.unique(np.concatenate(sets), return_counts=True)
                    token, seen = token[seen >= LOCAL_REPEATS], seen[seen >= LOCAL_REPEATS]
                    k = len(token)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(token.view(np.int64)), pa.array(seen)], names=names)

    return docs.mapInArrow(run, "doc bigint, th bigint, n int, digest binary, token bigint, seen bigint")


def _prefixes(docs: DataFrame, ranked: np.ndarray, size: int, percent: int) -> DataFrame:
    """Rows (token, grp, n): the prefix shingles of each group; and, with a negative token and the digest set, one row a
    set. A task tells equal sets and groups once; null ids are left out. `grp` is the hash of size and prefix."""
    held = docs.sparkSession.sparkContext.broadcast(ranked)

    def run(batches):
        claim("words", [WORD_HASHES])
        order = held.value
        keys = np.sort(order)
        rank = np.argsort(order, kind="stable") + 1
        told: set[bytes | int] = set()
        for batch in batches:
            for part in text_slices(batch):
                token, grp, count, digest = [], [], [], []
                for d, text in zip(part.column("doc").to_pylist(), texts(part), strict=True):
                    if d is None or not len(s := shingle_set(text, size)):
                        continue
                    g128 = xxhash.xxh3_128_digest(s.tobytes())
                    if g128 in told:
                        continue
                    n, k = len(s), prefix_length(len(s), percent)
                    first = s[:k]
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        common = keys[at] == s
                        if common[:k].any():
                            late = np.flatnonzero(common)
                            late = late[np.argsort(rank[at[late]], kind="stable")]
                            first = np.concatenate([s[~common], s[late]])[:k]
                    g = xxhash.xxh64_intdigest(np.append(first, np.uint64(n)).tobytes()) >> 1
                    new = g not in told
                    if len(told) >= MEMORY:
                        told.clear()
                    told |= {g, g128}
                    if new:
                        token.append((first >> np.uint64(8)).astype(np.int64))
                    token.append(np.array([-1 - (xxhash.xxh64_intdigest(g128) >> 1)], dtype=np.int64))
                    rows = k + 1 if new else 1
                    grp.append(np.full(rows, g, dtype=np.int64))
                    count.append(np.full(rows, n, dtype=np.int32))
                    digest += [None] * (rows - 1) + [g128]
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(grp)), pa.array(np.concatenate(count)), pa.array(digest, pa.binary())], names=["token", "grp", "n", "digest"])

    return docs.mapInArrow(run, "token bigint, grp bigint, n int, digest binary")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """From rows sorted by token, then group: one row a set as it is, and (token, grp, n) of tokens
    that more than one group has. Streams; a token's groups are never held together."""

    names = ["token", "grp", "n", "digest"]

    def run(batches):
        held = None  # of the token that is open: token, first group and its size, last group, whether the first is told
        for batch in batches:
            token, grp, n = (batch.column(c).to_numpy() for c in ("token", "grp", "n"))
            single = token < 0
            if single.any():
                yield batch.filter(pa.array(single))
            token, grp, n = token[~single], grp[~single], n[~single]
            if not len(token):
                continue
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])
            fresh[0] = held is None or (token[0], grp[0]) != (held[0], held[3])
            token, grp, n = token[fresh], grp[fresh], n[fresh]
            if not len(token):
                continue
            goes_on = held is not None and token[0] == held[0]
            if goes_on:
                token, grp, n = np.append(held[0], token), np.append(held[1], grp), np.append(held[2], n)
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(at, len(token)))
            keep = np.repeat(size > 1, size)
            if goes_on and held[4]:
                keep[0] = False
            held = (int(token[-1]), int(grp[at[-1]]), int(n[at[-1]]), int(grp[-1]), bool(size[-1] > 1))
            if keep.any():
                k = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(grp[keep]), pa.array(n[keep], pa.int32()), pa.nulls(k, pa.binary())], names=names)

    dealt = rows.repartition("token").sortWithinPartitions("token", "grp")
    return dealt.mapInArrow(run, "token bigint, grp bigint, n int, digest binary")


def _probes(tokens: DataFrame, percent: int) -> DataFrame:
    """Of rows (token, grp, n): those that have to be joined, as (token, grp, n, own, other, rest).

    `own` is the size class of the group, `other` one in which the token has another group. A partner
    from that class must share at least `need` of the group's tokens there; of `have` tokens, the rarest
    `have - need + 1` include the first shared one under one common order. `rest` counts the token and those
    after it: no pair whose first shared token this is can share more."""
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rows = materialize(tokens.join(spread, "token").withColumn("own", F.floor(F.log("n") / F.log(F.lit(SIZE_STEP))).cast("int")), "sized")
    classes = rows.groupBy("token", F.col("own").alias("other")).agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    reach = int(np.log(100 / percent) / np.log(SIZE_STEP)) + 2
    near = rows.join(classes, "token").filter(f"other between own - {reach} and own + {reach} and (lo <> grp or hi <> grp)")
    low, high = F.pow(F.lit(SIZE_STEP), "other") - 1, F.pow(F.lit(SIZE_STEP), F.col("other") + 1) + 1

    def need(m):
        m = F.least(F.greatest(m, F.col("n") * percent / 100), F.col("n") * 100 / percent)
        return F.ceil((F.col("n") + m) * percent / (100 + percent) - F.greatest(F.col("n"), m) * percent / 100 - 1e-6)

    group = Window.partitionBy("grp", "other")
    ranked = near.withColumn("have", F.count("*").over(group)).withColumn("need", F.greatest(F.lit(1), F.least(need(low), need(high)))).filter("have >= need")
    ranked = ranked.withColumn("k", F.row_number().over(group.orderBy("df", "token")))
    return ranked.filter("k <= have - need + 1").select("token", "grp", "n", "own", "other", (F.col("have") - F.col("k") + 1).cast("int").alias("rest"))


def _both_fit(percent: int):
    """Whether sizes na and nb are near enough, and the shared prefix shingles that ra and rb allow, with all that may
    follow, reach the needed overlap."""
    near = f"100L * least(na, nb) >= {percent}L * greatest(na, nb)"
    rest = f"(greatest(na, nb) * {percent}L + 99) div 100 - 1"
    return F.expr(f"{near} and {100 + percent}L * (least(ra, rb) + {rest}) >= {percent}L * (na + nb)")


def _tiles(probes: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, places): the tile of each node that may have a link, and (ta, tb, digest), the nodes that each pair of
    tiles ta <= tb has to compare.

    Rows that meet share (token, lower class, upper class) and come from both classes. A group lies with the
    smallest group that it meets; a tile is a part of the nodes that lie together."""
    key = ["token", "lo", "hi"]
    sides = probes.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "grp", "n", "rest", (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high"))
    meets = sides.groupBy(*key).agg(F.min("grp").alias("first"), F.max("grp").alias("last"), F.max("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("k")).filter("first < last and l and h")
    met = materialize(sides.join(meets.select(*key, "first", "k"), key), "met")
    few, hot = met.filter(F.col("k") <= FEW), met.filter(F.col("k") > FEW)
    a = few.filter("low").select(*key, F.col("grp").alias("ga"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = few.filter("high").select(*key, F.col("grp").alias("gb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    pairs = a.join(b.hint("merge"), key).filter((F.col("ga") != F.col("gb")) & _both_fit(percent)).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"))
    several = nodes.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    pairs = materialize(pairs.distinct().unionByName(several), "pairs")

    heads = pairs.select(F.col("gb").alias("grp"), F.col("ga").alias("head")).unionByName(pairs.select(F.col("ga").alias("grp"), F.col("ga").alias("head"))).unionByName(hot.select("grp", F.col("first").alias("head")))
    placed = materialize(nodes.join(heads.groupBy("grp").agg(F.min("head").alias("head")).hint("merge"), "grp"), "placed")
    parts = placed.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("parts"))
    members = placed.join(parts.hint("merge"), "head").select("grp", "digest", "doc", "th", "copies", F.xxhash64("head", F.pmod(F.xxhash64("digest"), "parts")).alias("tile"))
    members = materialize(members, "members")

    # pairs of groups, as the tiles of both; each sends its own nodes
    of = members.select("grp", "tile").distinct()
    paired = pairs.join(of.select(F.col("grp").alias("ga"), F.col("tile").alias("x")).hint("merge"), "ga").join(of.select(F.col("grp").alias("gb"), F.col("tile").alias("y")).hint("merge"), "gb")
    both = [F.least("x", "y").alias("ta"), F.greatest("x", "y").alias("tb")]
    sent = paired.select(*both, F.col("ga").alias("grp"), F.col("x").alias("tile")).unionByName(paired.select(*both, F.col("gb").alias("grp"), F.col("y").alias("tile"))).distinct()
    own = sent.join(members.select("grp", "tile", "digest").hint("merge"), ["grp", "tile"]).select("ta", "tb", "digest")
    # under hot shingles, pairs of tiles with all of their nodes
    found = materialize(hot.join(of.hint("merge"), "grp").groupBy(*key, "tile").agg(F.max("low").alias("low"), F.max("high").alias("high")), "found")
    x, y = (found.filter(side).select(*key, F.col("tile").alias(t)) for side, t in (("low", "x"), ("high", "y")))
    wide = x.join(y.hint("merge"), key).select(*both).distinct()
    every = wide.select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile")).join(members.select("tile", "digest").hint("merge"), "tile").select("ta", "tb", "digest")
    return members, materialize(own.unionByName(every).distinct(), "places")


def alike(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the sets of `left` and `right` at or above the threshold; of `left` alone, i < j, without `right`."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    token, number = np.unique(np.concatenate(sets), return_inverse=True)
    node = np.repeat(np.arange(len(sets)), sizes)
    cut = len(left)
    if right is None:
        keep = np.bincount(number, minlength=len(token)) > 1
    else:
        here = np.bincount(number[node < cut], minlength=len(token)) > 0
        keep = here & (np.bincount(number[node >= cut], minlength=len(token)) > 0)
    column = np.cumsum(keep) - 1
    use = keep[number]
    node, number = node[use], column[number[use]]
    rows, cols = cut, len(sets) - cut if right is not None else cut
    common = np.zeros((rows, cols), dtype=np.float32)
    step = max(1, CELLS // len(sets))
    order = np.argsort(number, kind="stable")
    node, number = node[order], number[order]
    for start in range(0, int(keep.sum()), step):
        x, y = np.searchsorted(number, [start, start + step])
        cells = np.zeros((len(sets), step), dtype=np.float32)
        cells[node[x:y], number[x:y] - start] = 1
        common += cells[:cut] @ (cells[cut:] if right is not None else cells).T
    n = sizes[:cut, None] + (sizes[cut:] if right is not None else sizes)[None, :]
    linked = (common > 0) & ((100 + percent) * common.astype(np.int64) >= percent * n)
    return np.nonzero(np.triu(linked, 1) if right is None else linked)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one reachable over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verify(members: DataFrame, places: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, others, root) for each node with links in a pair of tiles: the documents it links with there, and a
    node of the pair of tiles that its links lead to. A node's text is fetched once, its shingles once for each of its
    places."""
    found = prune(docs, members.select("doc"), "doc").join(members.select("doc", "th", "digest", "tile", "copies").hint("merge"), ["doc", "th"])

    def shingled(batches):
        claim("words", [WORD_HASHES])
        told: set[bytes] = set()  # rows repeated in full name a node again
        for batch in batches:
            for part in text_slices(batch):
                fresh = [g not in told and not told.add(g) for g in part.column("digest").to_pylist()]
                part = part.filter(pa.array(fresh, pa.bool_()))
                raw = [shingle_set(t, size).tobytes() for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("tile"), part.column("copies"), pa.array(raw, pa.binary())], names=["digest", "tile", "copies", "shingles"])
                if len(told) >= MEMORY:
                    told.clear()

    held = found.select("text", "digest", "tile", "copies").mapInArrow(shingled, "digest binary, tile bigint, copies bigint, shingles binary")
    # both sides grow with the input, so this is a merge join at every size
    rows = places.join(held.hint("merge"), "digest").select("ta", "tb", (F.col("tile") != F.col("ta")).cast("int").alias("side"), "digest", "copies", "shingles")
    names = ["node", "others", "root"]

    def solve(pair, left, right):
        """Links of the nodes (digest to copies and shingles) of one tile or of two."""
        if not left or not (right or pair[0] == pair[1]):
            return
        nodes = [*left.items(), *right.items()]
        sets = [np.frombuffer(s, dtype=np.uint64) for _, (_, s) in nodes]
        ids, copies = [g for g, _ in nodes], np.array([c for _, (c, _) in nodes], dtype=np.int64)
        i, j = alike(sets[: len(left)], sets[len(left) :] if right else None, percent)
        if not len(i):
            return
        j = j + len(left) if right else j
        others = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        root = _forest(len(ids), i, j)
        at = np.unique(np.concatenate([i, j])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.binary()), pa.array(others[at].astype(np.int64)), pa.array([ids[root[k]] for k in at], pa.binary())], names=names)

    def run(batches):
        pair, left, right = None, {}, {}
        for batch in batches:
            for part in text_slices(batch, "shingles"):
                for ta, tb, side, g, c, s in zip(*(part.column(x).to_pylist() for x in ("ta", "tb", "side", "digest", "copies", "shingles")), strict=True):
                    if (ta, tb) != pair:
                        yield from solve(pair, left, right)
                        pair, left, right = (ta, tb), {}, {}
                    (right if side else left)[g] = (c, s)
        yield from solve(pair, left, right)

    dealt = rows.repartition("ta", "tb").sortWithinPartitions("ta", "tb")
    return materialize(dealt.mapInArrow(run, "node binary, others bigint, root binary"), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_shingles`, `component_id`, the smallest id reachable by links, `n_links`, the
    number of other documents it links with, and `text_hash`, which tells texts of one id apart."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    first = materialize(_sets(slim, size), "sets")
    heads = first.filter("n is not null").select("doc", "th", "n", "digest")
    common = first.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.col("seen").desc(), "token").limit(RANKED)
    ranked = common.orderBy("seen", "token").select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64)

    shared = materialize(_shared_tokens(_prefixes(slim.select("doc", "text"), ranked, size, percent)), "tokens")
    # equal sets are one node
    counts = heads.filter("doc is not null and n > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.min_by("th", "doc").alias("th"), F.count("*").alias("copies"))
    nodes = materialize(shared.filter("digest is not null").select("grp", "n", "digest").distinct().join(counts.hint("merge"), "digest"), "nodes")

    probes = materialize(_probes(shared.filter("digest is null").select("token", "grp", "n"), percent), "probes")
    members, places = _tiles(probes, nodes, percent)
    found = verify(members, places, slim, size, percent)
    degree = found.groupBy("node").agg(F.sum("others").alias("others"))
    of = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = materialize(degree.join(of.hint("merge"), "node").join(nodes.select(F.col("digest").alias("node"), "doc").hint("merge"), "node"), "linked")
    smallest = linked.groupBy("component").agg(F.min("doc").alias("lowest"))
    final = linked.join(smallest.hint("merge"), "component").select(F.col("node").alias("digest"), "lowest", "others")

    # back to documents: the digest names the node
    by_set = nodes.join(final.hint("merge"), "digest", "left").filter("copies > 1 or lowest is not null")
    by_set = by_set.select("digest", "copies", F.coalesce("lowest", "doc").alias("lowest"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = join_copies(heads, materialize(by_set, "classes"), ["digest"])
    known = F.col("doc").isNotNull()
    return out.select(
        F.col("doc").alias(id_col),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(known, F.coalesce("lowest", "doc")).alias("component_id"),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        F.col("th").alias("text_hash"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold the smallest id of their component, with all columns; rows without an id stay, and
    so do all rows that repeat the smallest id within one component. Rows are matched by id and text."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("component_id") < F.col(id_col))
    gone = gone.select(F.col(id_col).alias("_tm_id"), F.coalesce("text_hash", F.lit(0)).alias("_tm_th")).distinct()
    same = (docs[id_col].cast("bigint") == F.col("_tm_id")) & (F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)) == F.col("_tm_th"))
    return docs.join(gone, same, "left_anti").select(docs.columns)
