"""Removal of repeated passages with automata over confirmed phrases.

1. Every document is fingerprinted: of any `SPAN` - `GRAM` + 1 consecutive word n-grams the smallest hash is
   an anchor, so two documents that share `SPAN` words share an anchor. Of documents with equal words one,
   the smallest, speaks for all; the others lose every word and go no further.
2. Anchors that texts with different words share make suspects. Their suspect windows (those whose anchor
   recurs) are hashed and aggregated to their smallest document; a window that a second document has is
   confirmed.
3. Confirmed windows of their smallest document join to passages, cut to pieces of bounded length that
   overlap by a window. Blocks of each piece, laid so that every window holds one, become the phrases of an
   Aho-Corasick automaton over words; a table of the pieces' windows tells which of them a hit may belong to. Suspects are dealt over buckets; a bucket's automaton holds the pieces
   that its documents share a confirmed window with, and the documents stream through it. Each hit is extended word by word against the piece; matches of at least `SPAN` words
   from a smaller document are removed.

Hashes only nominate: what is removed has matched word by word. Frequent anchors and windows are
aggregated before they are joined, and no set of all occurrences is gathered anywhere.

Words are runs without space or \\x09-\\x0D, unchanged. Null, empty and short texts have no window and lose
nothing. Rows are judged one by one: rows with a null id lose nothing and take nothing; rows that repeat an
id, with one text or several, never take words from each other but lose them to smaller ids. Other columns,
whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_HASHES, claim, join_copies, materialize, prune, text_slices, texts, window_hashes

#: Words of a window, and of an anchor n-gram.
SPAN = 50
GRAM = 12
#: Words of an automaton's phrase; pieces are cut every SPAN - BLOCK + 1 words.
BLOCK = 25
#: A piece's windows start within one stretch of so many words of its document.
PIECE = 400
#: Words of suspect documents that one bucket has, about.
BUCKET_WORDS = 300_000
#: Texts that one task remembers having fingerprinted.
MEMORY = 200_000
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def split_words(text: str) -> list[bytes]:
    return text.encode().split()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` consecutive values."""
    step, low = 1, values
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """The anchor of every window, from the words' hashes."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    return sliding_min(window_hashes(hashes, GRAM), span - GRAM + 1).view(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values of an array with long runs."""
    return np.unique(values[np.append(True, values[1:] != values[:-1])]) if len(values) else values


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _key(digest: str) -> int:
    """64 bits of a digest; with the id, it names a text."""
    return int(digest[:16], 16) - (1 << 63)


def fingerprints(docs: DataFrame, span: int) -> DataFrame:
    """Rows (doc, dg, anchor), each anchor of a text once, and one row a document (doc, dg, th, n_words, digest).

    A task tells the anchors of equal texts once, and again when a smaller id turns up."""

    def run(batches):
        claim("words", [WORD_HASHES])
        told: dict[int, int] = {}
        for batch in batches:
            for part in text_slices(batch):
                doc, key, anchor, size = [], [], [], []
                n_words, digest = [], []
                for d, text in zip(part.column("doc").to_pylist(), texts(part), strict=True):
                    words = split_words(text)
                    n_words.append(len(words))
                    digest.append(_digest(words))
                    if len(words) < span or d is None:
                        continue
                    k = _key(digest[-1])
                    if told.get(k, d + 1) <= d:
                        continue
                    if len(told) >= MEMORY:
                        told.clear()
                    told[k] = d
                    mine = _distinct(anchors(WORD_HASHES.of(words), span))
                    anchor.append(mine)
                    doc.append(d)
                    key.append(k)
                    size.append(len(mine))
                n = part.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([_key(g) for g in digest], pa.int64()), none, part.column("th"), pa.array(n_words, pa.int64()), pa.array(digest, pa.string())], names=_PRINT)
                if doc:
                    k = sum(size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(doc, np.int64), size)), pa.array(np.repeat(np.array(key, np.int64), size)), pa.array(np.concatenate(anchor)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names=_PRINT)

    return docs.mapInArrow(run, "doc bigint, dg bigint, anchor bigint, th bigint, n_words bigint, digest string")


_PRINT = ["doc", "dg", "anchor", "th", "n_words", "digest"]


def _windows(suspects: DataFrame, span: int) -> DataFrame:
    """(win, doc, dg, pos) of the suspect windows."""

    def run(batches):
        claim("words", [WORD_HASHES])
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for d, g, text, marks in zip(part.column("doc").to_pylist(), part.column("dg").to_pylist(), texts(part), part.column("marks"), strict=True):
                    h = WORD_HASHES.of(split_words(text))
                    pos = np.flatnonzero(np.isin(anchors(h, span), marks.values.to_numpy()))
                    if len(pos):
                        out.append((window_hashes(h, span)[pos].view(np.int64), np.full(len(pos), d), np.full(len(pos), g), pos))
                if out:
                    w, d, g, p = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(d, pa.int64()), pa.array(g, pa.int64()), pa.array(p, pa.int32())], names=["win", "doc", "dg", "pos"])

    return suspects.mapInArrow(run, "win bigint, doc bigint, dg bigint, pos int")


def _pieces(owners: DataFrame, span: int) -> DataFrame:
    """From rows (doc, dg, text, starts): (doc, dg, cell, words) of each piece; `cell` numbers the stretch of `PIECE`
    words that its windows start in."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                doc, key, cell, out = [], [], [], []
                for d, g, text, starts in zip(part.column("doc").to_pylist(), part.column("dg").to_pylist(), texts(part), part.column("starts"), strict=True):
                    words = split_words(text)
                    at = np.unique(starts.values.to_numpy())
                    cut = np.flatnonzero((np.diff(at) > span) | (np.diff(at // PIECE) > 0))
                    for b, e in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
                        doc.append(d)
                        key.append(g)
                        cell.append(b // PIECE)
                        out.append(b" ".join(words[b : e + span]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(cell, pa.int32()), pa.array(out, pa.string())], names=["doc", "dg", "cell", "words"])

    return owners.mapInArrow(run, "doc bigint, dg bigint, cell int, words string")


#: Code points from here on stand for words; none is a surrogate. One automaton takes pieces of as many words,
#: about, so that they always suffice.
_FIRST = 0xE000
MACHINE_WORDS = 500_000


class PhraseAutomaton:
    """Automaton over the blocks of some pieces; a word is one letter."""

    def __init__(self, pieces: list[tuple[int, list[bytes]]], span: int):
        self.span, self.letter = span, {}
        self.owner = [d for d, _ in pieces]
        blocks: set[str] = set()
        letter = self.letter
        self.pieces = []
        for _, words in pieces:
            for w in words:
                if w not in letter:
                    letter[w] = chr(_FIRST + len(letter) + 1)
            line = "".join(map(letter.__getitem__, words))
            self.pieces.append(self._numbers(line))
            blocks.update(line[at : at + BLOCK] for at in range(0, len(words) - BLOCK + 1, span - BLOCK + 1))
        self.automaton = ahocorasick.Automaton()
        for block in blocks:
            self.automaton.add_word(block, len(block))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks
        # every window of every piece by its hash
        each = [self._windows(p) for p in self.pieces]
        size = np.array([len(w) for w in each], dtype=np.int64)
        window = np.concatenate(each) if each else np.empty(0, np.uint64)
        order = np.argsort(window, kind="stable")
        self.window, self.piece = window[order], np.repeat(np.arange(len(each)), size)[order]
        self.place = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))[order]

    def _windows(self, ids: np.ndarray) -> np.ndarray:
        return window_hashes(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), self.span)

    @staticmethod
    def _numbers(line: str) -> np.ndarray:
        return np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)

    def covered(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window that a smaller document's piece has."""
        out = np.zeros(len(words), dtype=bool)
        if self.empty or len(words) < self.span:
            return out
        line = "".join(map(self.letter.get, words, repeat(chr(_FIRST))))
        ids = known = None
        reached: dict[tuple[int, int], int] = {}
        reach = self.span - BLOCK
        for end, _ in self.automaton.iter(line):
            at = end - BLOCK + 1
            first = max(0, at - reach)
            if out[first : end + 1 + reach].all():
                continue
            if ids is None:
                ids = self._numbers(line)
                mine = self._windows(ids)
                left, right = np.searchsorted(self.window, mine, side="left"), np.searchsorted(self.window, mine, side="right")
                known = left < right
            # only windows that a piece has word for word, by its hash, are extended: a block that many pieces begin
            # with costs nothing where what follows is another
            for start in (first + np.flatnonzero(known[first : at + 1])).tolist():
                if out[start : start + self.span].all():
                    continue
                for e in range(left[start], right[start]):
                    k, off = int(self.piece[e]), int(self.place[e])
                    if self.owner[k] >= doc or reached.get((k, start - off), -1) > start:
                        continue
                    a, b = _extent(ids, start, self.pieces[k], off)
                    reached[(k, start - off)] = b
                    if b - a >= self.span:
                        out[a:b] = True
        return out


def _machines(pieces: list[tuple[int, list[bytes]]], span: int) -> list[PhraseAutomaton]:
    """Automata over the pieces, each of about `MACHINE_WORDS` words."""
    if not pieces:
        return []
    part = np.cumsum([len(w) for _, w in pieces]) // MACHINE_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pieces)]
    return [PhraseAutomaton(pieces[a:b], span) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _extent(x: np.ndarray, i: int, y: np.ndarray, j: int) -> tuple[int, int]:
    """How far x around i and y around j are equal: the range in x."""
    n = min(len(x) - i, len(y) - j)
    differ = np.flatnonzero(x[i : i + n] != y[j : j + n])
    right = i + (int(differ[0]) if len(differ) else n)
    m = min(i, j)
    differ = np.flatnonzero(x[i - m : i] != y[j - m : j])
    return i - m + (int(differ[-1]) + 1 if len(differ) else 0), right


def _stream(rows: DataFrame, span: int) -> DataFrame:
    """Rows sorted by bucket, pieces before documents: each bucket's pieces are compiled, then its
    documents pass by. Gives (doc, dg, n_removed, removed, kept_digest) of documents that lose words."""
    names = ["doc", "dg", "n_removed", "removed", "kept_digest"]

    def run(batches):
        bucket, pieces, machines = None, [], None
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for b, kind, d, g, text in zip(part.column("bucket").to_pylist(), part.column("kind").to_pylist(), part.column("doc").to_pylist(), part.column("dg").to_pylist(), texts(part), strict=True):
                    if b != bucket:
                        bucket, pieces, machines = b, [], None
                    if kind == 0:
                        pieces.append((d, split_words(text)))
                        continue
                    if machines is None:
                        machines, pieces = _machines(pieces, span), []
                    if not machines:
                        continue
                    words = split_words(text)
                    gone = np.logical_or.reduce([m.covered(d, words) for m in machines])
                    if gone.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                        out.append((d, g, int(gone.sum()), [{"start": a, "end": e} for a, e in edge.tolist()], _digest([w for w, x in zip(words, gone.tolist(), strict=True) if not x])))
                if out:
                    d, g, n, r, k = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(r, _RANGES), pa.array(k, pa.string())], names=names)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "doc")
    return dealt.mapInArrow(run, "doc bigint, dg bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_digest string")


def repeated_passages(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_words`, `n_removed`, `removed` (word ranges, end exclusive), `kept_sha256`,
    the hash of the kept words joined by one space, and `text_hash`, which tells texts of one id apart."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    prints = materialize(fingerprints(slim, span), "fingerprints")
    heads, points = prints.filter("digest is not null").drop("anchor"), prints.filter("digest is null").select("doc", "dg", "anchor")

    # of equal words the smallest id speaks; its th leads to one of its texts
    sets = heads.filter(f"doc is not null and n_words >= {span}").groupBy("digest").agg(F.min("doc").alias("rep"), F.min_by("th", "doc").alias("th"), F.min("dg").alias("dg"), F.count("*").alias("copies"))
    sets = materialize(sets, "sets")
    tells = sets.select(F.col("rep").alias("doc"), "dg", "th")
    recurring = points.groupBy("anchor").agg(F.min("dg").alias("x"), F.max("dg").alias("y")).filter("x < y").select("anchor")
    points = materialize(points.join(recurring, "anchor").join(tells.select("doc", "dg"), ["doc", "dg"]).distinct(), "points")
    marks = points.groupBy("doc", "dg").agg(F.collect_list("anchor").alias("marks")).join(tells, ["doc", "dg"])
    marks = materialize(marks, "marks")
    suspects = materialize(prune(slim.filter("doc is not null"), marks.select("doc"), "doc").join(marks, ["doc", "th"]), "suspects")

    windows = materialize(_windows(suspects, span), "windows")
    confirmed = windows.groupBy("win").agg(F.min("doc").alias("owner"), F.max("doc").alias("other"), F.min_by("dg", "doc").alias("owner_dg"), F.min_by("pos", "doc").alias("pos")).filter("owner < other")
    confirmed = materialize(confirmed.drop("other"), "confirmed")
    starts = confirmed.groupBy(F.col("owner").alias("doc"), F.col("owner_dg").alias("dg")).agg(F.collect_list("pos").alias("starts"))
    pieces = materialize(_pieces(suspects.select("doc", "dg", "text").join(starts, ["doc", "dg"]), span), "pieces")

    total = suspects.agg(F.sum(F.size("marks"))).first()[0] or 0
    buckets = int(total * (span - GRAM + 2) // (2 * BUCKET_WORDS)) + 1
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "doc", "dg"), F.lit(buckets))
    # of a window that many documents have, a bucket keeps one row
    last = windows.groupBy("win", bucket.alias("bucket")).agg(F.max("doc").alias("last"))
    routes = last.join(confirmed.hint("merge"), "win").filter("owner < last").select("bucket", "owner", "owner_dg", F.floor(F.col("pos") / PIECE).cast("int").alias("cell")).distinct()
    held = pieces.select(F.col("doc").alias("owner"), F.col("dg").alias("owner_dg"), "cell", "words").distinct()
    phrases = routes.join(held.hint("merge"), ["owner", "owner_dg", "cell"]).select("bucket", F.lit(0).alias("kind"), F.col("owner").alias("doc"), F.col("owner_dg").alias("dg"), F.col("words").alias("text"))
    stream = phrases.unionByName(suspects.select(bucket.alias("bucket"), F.lit(1).alias("kind"), "doc", "dg", "text"))
    lost = _stream(stream, span).dropDuplicates(["doc", "dg"]).withColumnRenamed("doc", "rep")

    found = sets.join(lost, ["rep", "dg"], "left").filter("copies > 1 or n_removed is not null").select("digest", "rep", "copies", "n_removed", "removed", "kept_digest")
    out = join_copies(heads, materialize(found, "lost"), ["digest"])
    copy = F.col("doc").isNotNull() & (F.col("doc") > F.col("rep"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    mine = lambda all_gone, lost, none: F.when(copy, all_gone).otherwise(F.coalesce(F.when(F.col("doc").isNotNull(), lost), none))
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        mine(F.col("n_words"), F.col("n_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        mine(whole, F.col("removed"), F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
        mine(F.sha2(F.lit(""), 256), F.col("kept_digest"), F.col("digest")).alias("kept_sha256"),
        F.col("th").alias("text_hash"),
    )


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed words of `found` (from `repeated_passages`) taken out of the text; a text that
    loses words is its kept words joined by one space. Rows are matched by id and text."""
    gone = found.filter("n_removed > 0").select(F.col(id_col).cast("bigint").alias("_tm_id"), F.col("text_hash").alias("_tm_th"), F.col("removed").alias("_tm_gone")).dropDuplicates(["_tm_id", "_tm_th"])
    joined = docs.join(gone, (docs[id_col].cast("bigint") == F.col("_tm_id")) & (F.xxhash64(docs[text_col]) == F.col("_tm_th")), "left")
    words = F.filter(F.split(docs[text_col], "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists("_tm_gone", lambda r: (i >= r["start"]) & (i < r["end"])))
    return joined.select(*[(F.when(F.col("_tm_gone").isNotNull(), F.array_join(kept, " ")).otherwise(docs[c]).alias(c) if c == text_col else docs[c]) for c in docs.columns])
