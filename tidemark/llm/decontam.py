"""Benchmark decontamination over suffix arrays of the training text.

Each task cuts its documents into shards of a few MB and sorts all suffixes of a shard's words, document by document,
into a suffix array: by as many words as fit one number, then by doubling among those still equal. Every test suffix
is looked up by binary search: a range of the array shares the first words with it, the longest common prefix of the
range's ends says how many words all of it shares, and the search goes on at the word after them. A suffix whose
first `window` words occur ends in the range of all their locations; there the longest common prefix of each location
and the test suffix is the length of the verbatim match. Nothing but the array tells where a test suffix occurs.

Test items travel to the tasks as numeric arrays in blocks of about `block_words` words (some 50 bytes a word in every
worker), one pass over the documents for each block; an item travels whole. A pass is written and its block
released before the next is sent. Passes are joined by id and text, so the number of blocks never changes a result.

Words are runs of letters a-z, digits and non-ASCII characters after A-Z is lowered. A null or empty text
has no words: such a document is clean and such an item has no window. An item shorter than the window
is one window of its whole length. Repeated items with one id count once each different text, under the one id;
items whose id is null are ignored. Each row of documents is judged by its own text, whatever its id: null and
repeated ids are nothing special. Other columns, whatever their names, are ignored. A document longer than a shard is a shard
of its own. Words are compared as 64-bit hashes, and runs of words as hashes of those.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import WORD_HASHES, claim, materialize, text_slices, texts

WINDOW = 13
#: Words of test items that one pass broadcasts, about.
BLOCK_WORDS = 1_000_000
#: Bytes of text of one shard.
SHARD_BYTES = 4 << 20

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_RANGE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Runs:
    """Words as hashes, and the hash of any run of them."""

    def __init__(self, h: np.ndarray):
        common.window_hashes(h, 1)  # has powers for so many words
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * common._POWERS[0][: len(h)], dtype=np.uint64)])

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * common._POWERS[1][at]


def common_prefix(a: Runs, i: np.ndarray, b: Runs, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from i in `a` and from j in `b` are equal, `limit` at most: by leaps, then by halving."""
    low, step = np.zeros(len(i), dtype=np.int64), 1
    going = np.flatnonzero(limit > 0)
    high = limit.copy()  # no more than these are equal
    while len(going):
        n = np.minimum(step, limit[going])
        same = a.of(i[going], n) == b.of(j[going], n)
        low[going[same]], high[going[~same]] = n[same], n[~same] - 1
        going = going[same & (n < limit[going])]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        n = (low[going] + high[going] + 1) // 2
        same = a.of(i[going], n) == b.of(j[going], n)
        low[going[same]], high[going[~same]] = n[same], n[~same] - 1
        going = going[low[going] < high[going]]
    return low


class TestSuffixes:
    """One block of test items: their words, and the suffixes with a window each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        """From (item, word hashes) of each different text."""
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        parts = [np.frombuffer(raw, dtype=np.uint64) for _, raw in items]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        each = np.maximum(sizes - window, 0) + 1
        which = np.repeat(np.arange(len(parts)), each)
        self.place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)  # in the item
        self.at = start[which] + self.place
        self.item = np.array([number[items[k][0]] for k in which.tolist()], dtype=np.int64)
        self.window = np.minimum(sizes, window)[which]
        self.left = sizes[which] - self.place


class SuffixArray:
    """All suffixes of a shard's words in order; a suffix ends where its document ends, and the end comes before any word."""

    def __init__(self, h: np.ndarray, ends: np.ndarray):
        self.runs, self.ends = Runs(h), ends
        self.known, self.rank = np.unique(h, return_inverse=True)
        self.rank = self.rank.astype(np.int64)
        n = len(h)
        bits = max(1, int(len(self.known)).bit_length())
        at, key, depth = np.arange(n), np.zeros(n, dtype=np.int64), max(1, 62 // bits)
        for k in range(depth):
            key = (key << bits) | self._next(self.rank, at, k)
        self.order = np.argsort(key)
        key = key[self.order]
        opens = np.append(True, key[1:] != key[:-1]) if n else np.empty(0, bool)
        place = np.empty(n, dtype=np.int64)  # of the first suffix that is equal so far
        longest = int((ends - at).max()) if n else 0
        place[self.order] = np.maximum.accumulate(np.where(opens, at, 0))
        while depth < longest:
            tied = np.flatnonzero(~opens | ~np.append(opens[1:], True))
            if not len(tied):
                break
            mine = self.order[tied]
            further = self._next(place, mine, depth)
            to = np.argsort(place[mine] * (n + 1) + further)
            mine, further = mine[to], further[to]
            self.order[tied] = mine
            new = np.append(True, (further[1:] != further[:-1]) | (place[mine[1:]] != place[mine[:-1]]))
            opens[tied] |= new
            place[mine] = np.maximum.accumulate(np.where(opens[tied], tied, 0))
            depth *= 2

    def _next(self, values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Of each suffix the value k words on, plus 1; 0 where its document has ended."""
        to = at + k
        inside = to < self.ends[at]
        return np.where(inside, values[np.where(inside, to, 0)] + 1, 0)

    def _word(self, entry: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The word number `depth` words into an entry of the array, -1 at the end of its document."""
        at = self.order[entry]
        return np.where(at + depth < self.ends[at], self.rank[np.minimum(at + depth, len(self.rank) - 1)], -1)

    def _narrow(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range whose word at `depth` is `word`, by binary search."""
        ends = []
        for after in (0, 1):
            a, b = low.copy(), high.copy()
            while len(open_ := np.flatnonzero(a < b)):
                mid = (a[open_] + b[open_]) // 2
                less = self._word(mid, depth[open_]) < word[open_] + after
                a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            ends.append(a)
        return ends[0], ends[1]

    def find(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, first, end): the test suffixes whose window occurs, with the range of its locations in the array."""
        number = np.minimum(np.searchsorted(self.known, tests.words), max(len(self.known) - 1, 0))
        word = np.where(self.known[number] == tests.words, number, -2) if len(self.known) else np.full(len(tests.words), -2)
        theirs = Runs(tests.words)
        todo = np.flatnonzero(word[tests.at] >= 0)
        low, high = self._narrow(np.zeros(len(todo), np.int64), np.full(len(todo), len(self.order)), np.zeros(len(todo), np.int64), word[tests.at[todo]])
        here = low < high
        todo, low, high = todo[here], low[here], high[here]
        found = []
        while len(todo):
            first, last = self.order[low], self.order[high - 1]
            size = tests.window[todo]
            # words that all of the range shares, and that it shares with the test suffix
            own = common_prefix(self.runs, first, self.runs, last, np.minimum(size, np.minimum(self.ends[first] - first, self.ends[last] - last)))
            both = common_prefix(theirs, tests.at[todo], self.runs, first, np.minimum(size, self.ends[first] - first))
            whole = np.minimum(own, both) == size
            found.append((todo[whole], low[whole], high[whole]))
            go = ~whole & (both >= own)
            todo, low, high, depth = todo[go], low[go], high[go], own[go]
            low, high = self._narrow(low, high, depth, word[tests.at[todo] + depth])
            here = low < high
            todo, low, high = todo[here], low[here], high[here]
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, suffix, words) of every occurrence of a window: where it is in the shard, the test suffix that it begins,
        and how many words match there."""
        which, first, end = self.find(tests)
        n = end - first
        suffix = np.repeat(which, n)
        pos = self.order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return pos, suffix, common_prefix(Runs(tests.words), tests.at[suffix], self.runs, pos, np.minimum(tests.left[suffix], self.ends[pos] - pos))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, n, words): word hashes of each different text of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).filter("item is not null").distinct()

    def run(batches):
        claim("words", [WORD_HASHES])
        for batch in batches:
            hashes = [WORD_HASHES.of(words(text)) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([len(h) for h in hashes], pa.int64()), pa.array([h.tobytes() for h in hashes], pa.binary())], names=["item", "n", "words"])

    return items.mapInArrow(run, "item string, n bigint, words binary").filter("n > 0").distinct()


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """Test suffixes in blocks of bounded size, gathered one at a time; one without items if there are none."""
    rows = materialize(_items(benchmark), "benchmark")
    n = int((rows.agg(F.sum("n")).first()[0] or 0) // block_words) + 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).orderBy("item", "words").toArrow()
        yield TestSuffixes(list(zip(part["item"].to_pylist(), part["words"].to_pylist(), strict=True)), window)


_MATCH = "struct<item:string,n_words:int,doc_word:int,item_word:int>"
_MATCH_TYPE = pa.struct([("item", pa.string()), ("n_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())])


def _finder(held):
    """Task function: (id, th, n_words, hits, items, longest) of every document of a pass."""

    def run(batches):
        claim("words", [WORD_HASHES])
        tests: TestSuffixes = held.value
        for batch in batches:
            for part in text_slices(batch, budget=SHARD_BYTES):
                shard = [WORD_HASHES.of(words(t)) for t in texts(part)]
                counts = np.array([len(w) for w in shard], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                hits: list[list[dict]] = [[] for _ in shard]
                items: list[list[str]] = [[] for _ in shard]
                match: list[dict | None] = [None] * len(shard)
                pos, suffix, equal = SuffixArray(np.concatenate(shard), np.repeat(bounds[1:], counts)).matches(tests)
                doc = np.searchsorted(bounds, pos, side="right") - 1
                order = np.lexsort((pos, doc))
                pos, suffix, equal, doc = pos[order], suffix[order], equal[order], doc[order]
                cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else doc
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    d = int(doc[a])
                    s, p = suffix[a:b], pos[a:b] - bounds[d]
                    ends = np.maximum.accumulate(p + tests.window[s])
                    fresh = np.append(True, p[1:] > ends[:-1])
                    start, end = p[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(p) - 1)]
                    hits[d] = [{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    items[d] = [tests.names[k] for k in np.unique(tests.item[s]).tolist()]
                    best = np.lexsort((tests.place[s], p, tests.item[s], -equal[a:b]))[0]
                    match[d] = {"item": tests.names[tests.item[s[best]]], "n_words": int(equal[a + best]), "doc_word": int(p[best]), "item_word": int(tests.place[s[best]])}
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(counts), pa.array(hits, _RANGE), pa.array(items, pa.list_(pa.string())), pa.array(match, _MATCH_TYPE)], names=["id", "th", "n_words", "hits", "items", "longest"])

    return run


def _covered(ranges):
    """Places that (start, end) ranges in order of start cover."""
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["upto"], r["end"]).alias("upto"), (acc["n"] + F.greatest(r["end"] - F.greatest(acc["upto"], r["start"]), F.lit(0))).alias("n"))
    return F.aggregate(ranges, none, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_words`, `n_hit` (words inside an occurring window), `hits` (their ranges, end
    exclusive), `items` (ids of the items with occurring windows, sorted as strings), `longest_match` (item, words, and first
    word in document and item, of the longest verbatim match with one item; ties to the smallest item, then place; null
    without a hit) and `text_hash`, which tells texts of one id apart."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    passes = []
    for block in _blocks(benchmark, window, block_words):
        held = spark.sparkContext.broadcast(block)
        found = slim.mapInArrow(_finder(held), f"id {kind}, th bigint, n_words bigint, hits array<struct<start:int,end:int>>, items array<string>, longest {_MATCH}")
        passes.append(materialize(found.filter("longest is not null") if passes else found, "contamination"))
        held.unpersist()
    out = passes[0]
    if len(passes) > 1:
        each = reduce(DataFrame.unionByName, [out.filter("longest is not null"), *passes[1:]]).withColumn("rank", F.struct(-F.col("longest.n_words"), "longest.item", "longest.doc_word", "longest.item_word"))
        hit = each.groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.min_by("longest", "rank").alias("longest"))
        both = out.select("id", "th", "n_words").join(hit, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
        none = lambda c: F.coalesce(c, F.array().cast(hit.schema[c].dataType))
        out = both.select("id", "th", "n_words", F.array_sort(none("hits")).alias("hits"), none("items").alias("items"), "longest")
    return out.select(F.col("id").alias(id_col), "n_words", _covered(F.col("hits")).alias("n_hit"), "hits", F.array_sort("items").alias("items"), F.col("longest").alias("longest_match"), F.col("th").alias("text_hash"))


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text is not contaminated, with all columns; rows are matched by id and text."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter(is_contaminated(F.col("n_words"), F.col("n_hit")))
    bad = bad.select(F.col(id_col).alias("_tm_id"), F.col("text_hash").alias("_tm_th")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_tm_id")) & (F.xxhash64(docs[text_col]) == F.col("_tm_th")), "left_anti").select(docs.columns)
