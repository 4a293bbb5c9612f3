"""Fill-in-middle transformation: texts are cut at two unit boundaries and their parts are rearranged.

A text is cut into units: a run of letters A-Z, a-z is one, and so is every other code point. A text is laid out in
blocks of `BLOCK` bytes; a Fenwick tree over its blocks holds how many units and code points start in them. The cut
after k units is found by binary lifting: a descent over the tree goes to the last block before which at most k
units start and brings the units and code points before that block; inside the block the unit's first byte is
looked up. So a cut costs the logarithm of the number of blocks and one block, however long the text is.

The draws come from the id alone (`sha256("1:" + id)`), so a row always gets the same form and cuts, wherever it is.
Every row is a row of the result, whatever its id: repeated ids share their draws, a null id draws as an empty one. A
null text is an empty one; an empty text, and one that holds a marker, stays plain. Other columns, whatever their
names, are kept out. An empty table gives no rows. Rows never meet: one pass over the documents without a shuffle, and
a task holds `SLICE_BYTES` of text, or one text, at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

#: What goes before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block; a power of two.
BLOCK = 1024
#: Of a hundred draws, so many rearrange the text, and so many of those put the suffix first.
RATE, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class BlockTree:
    """Fenwick trees over the blocks of one text: units and code points that start in them."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.n = len(units)
        self.units, self.points = (self._sums(x) for x in (units, points))

    @staticmethod
    def _sums(counts: np.ndarray) -> np.ndarray:
        tree = np.concatenate([np.zeros(1, np.int64), counts.astype(np.int64)])
        step = 1
        while 2 * step < len(tree):
            # every node of this level adds to the next node that covers it
            upper = tree[2 * step :: 2 * step]
            upper += tree[step :: 2 * step][: len(upper)]
            step *= 2
        return tree

    def find(self, k: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) of the block where unit k starts, counted from 0; the number
        of blocks if there is no such unit."""
        at, units, points = 0, 0, 0
        step = 1 << self.n.bit_length()
        while step:
            to = at + step
            if to <= self.n and units + self.units[to] <= k:
                at, units, points = to, units + int(self.units[to]), points + int(self.points[to])
            step >>= 1
        return at, units, points


def starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of a text in UTF-8 begin a unit, and which a code point."""
    letter = _LETTER[raw]
    point = (raw & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, point


class CutText:
    """One text with the trees of its blocks."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.unit, self.point = starts(raw)
        edges = np.arange(0, len(raw), BLOCK)
        counts = [np.add.reduceat(x, edges, dtype=np.int64) if len(raw) else np.empty(0, np.int64) for x in (self.unit, self.point)]
        self.tree = BlockTree(*counts)
        self.n_units = int(counts[0].sum())

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        block, units, points = self.tree.find(k)
        if block == self.tree.n:
            return len(self.raw), points
        begin = block * BLOCK
        here = int(np.flatnonzero(self.unit[begin : begin + BLOCK])[k - units])
        return begin + here, points + int(np.count_nonzero(self.point[begin : begin + here]))


def _draws(key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


_SHAPE = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _rearrange(batches):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    before, after, between = marks
    for batch in batches:
        for part in text_slices(batch):
            n, form, prefix, middle, out = [], [], [], [], []
            for raw, h1, h2, h3, h4 in zip(part.column("text"), *[part.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)], strict=True):
                data = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                text = CutText(np.frombuffer(data, dtype=np.uint8))
                n.append(text.n_units)
                if not data or h3 % 100 >= RATE or any(m in data for m in marks):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    out.append(data)
                    continue
                low, high = sorted((h1 % (text.n_units + 1), h2 % (text.n_units + 1)))
                (a, x), (b, y) = text.cut(low), text.cut(high)
                prefix.append(x)
                middle.append(y - x)
                if h4 % 100 < SUFFIX_FIRST:
                    form.append("spm")
                    out.append(b"".join((after, data[b:], before, data[:a], between, data[a:b])))
                else:
                    form.append("psm")
                    out.append(b"".join((before, data[:a], after, data[b:], between, data[a:b])))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pc.cast(pa.array(out, pa.binary()), pa.string())],
                names=_SHAPE,
            )


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n` units, `form` (plain, psm or spm), `prefix_chars` and `middle_chars` in code
    points (null if plain), and `output`, the text as rearranged."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_draws(F.col(id_col)))
    made = slim.mapInArrow(_rearrange, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A marker cannot arise where a part meets a marker, so the three of them
    split the output."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
