"""Exact merge-type subword encoding and decoding.

A text is cut where no vocabulary piece can cross; each cut part is encoded by backtracking over
Aho-Corasick matches: take the longest piece that starts here, keep it if it survives re-merging
next to its left neighbour, else try a shorter one; a position from which nothing fits is marked in a
bitfield and never tried again. Parts recur, so their ids are remembered in a bounded table.

Null and empty texts give only the end id and decode to the empty string. Rows are never merged:
repeated rows give repeated results, null ids are nothing special. Columns other than the id and the text, whatever
their names, are left out of the result. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import claim, text_slices, texts

#: Remembered parts and pairs of one Python worker; both tables start afresh when full.
PART_MEMORY = 600_000
PAIR_MEMORY = 600_000

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder for one merge-type model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != pb.TrainerSpec.BPE or norm.name != "identity" or norm.precompiled_charsmap:
            raise ValueError("a merge-type model with identity normalisation is needed")
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("the model's white space rules are not supported")
        kinds = pb.ModelProto.SentencePiece
        self.prefix = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.control: set[int] = set()
        self.unknown, self.end = train.unk_id, train.eos_id
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.raw.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                self.ids[p.piece.replace(SPACE, " ")] = i
                self.score[p.piece.replace(SPACE, " ")] = p.score
                self.raw.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.UNKNOWN:
                self.raw.append(train.unk_surface.encode())
            elif p.type == kinds.CONTROL:
                self.control.add(i)
                self.raw.append(b"")
            else:
                raise ValueError("user-defined or unused pieces are not supported")
        self.plain_start = {*self.byte_id.values(), self.unknown}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.cut = self._cutter()
        self._parts: dict[str, bytes] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def _cutter(self) -> re.Pattern:
        """Pattern whose consecutive matches no piece crosses, the finest of two that holds."""
        odd = set()
        for p in self.ids:
            body = p.lstrip(" ")
            if not re.fullmatch(r"[^\W\d_]*", body):
                odd |= set(re.findall(r"[^\W\d_]", body))
        more = "".join(map(re.escape, sorted(odd)))
        fine = re.compile(rf" *[^\W\d_{more}]+| *(?:[^\w ]|[_{more}])+| *\w| +")
        if all(len(fine.findall(p)) == 1 for p in self.ids):
            return fine
        if any(" " in p.lstrip(" ") for p in self.ids):
            return re.compile(r"(?s).+")
        return re.compile(r" *[^ ]+| +")

    def merged(self, text: str) -> list[str]:
        """Plain merging: always the best-scored pair, the leftmost of equals."""
        parts = list(text)
        score = self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces come out again when their joined characters are merged."""
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= PAIR_MEMORY:
                self._fits.clear()
            found = self._fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def backtrack(self, part: str) -> list[str]:
        """Pieces of one part; a character outside the vocabulary stands alone."""
        n = len(part)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(part):
            starts[end - size + 1].append(size)
        for i in range(n):
            if not starts[i] or starts[i][0] != 1:
                starts[i].insert(0, 1)
        fits = self._fits.get
        failed = bytearray(n // 8 + 1)
        pieces: list[str] = []
        tried: list[int] = []
        at, k = 0, len(starts[0]) - 1 if n else -1
        while at < n:
            taken = False
            while k >= 0:
                size = starts[at][k]
                stop = at + size
                k -= 1
                if failed[stop >> 3] >> (stop & 7) & 1:
                    continue
                piece = part[at:stop]
                if size > 1:
                    ok = fits(("", piece))
                    if ok is False or ok is None and not self.fits("", piece):
                        continue
                if pieces:
                    ok = fits((pieces[-1], piece))
                    if ok is False or ok is None and not self.fits(pieces[-1], piece):
                        continue
                taken = True
                break
            if taken:
                pieces.append(piece)
                tried.append(k)
                at = stop
                k = len(starts[at]) - 1 if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not pieces:
                    raise ValueError("no encoding found")
                at -= len(pieces.pop())
                k = tried.pop()
        return pieces

    def part_ids(self, part: str) -> bytes:
        out: list[int] = []
        for piece in self.backtrack(part):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without an end id."""
        if not text:
            return np.empty(0, dtype=np.int32)
        text = text.replace(SPACE, " ")
        known, out = self._parts, []
        for part in self.cut.findall(" " + text if self.prefix else text):
            ids = known.get(part)
            if ids is None:
                if len(known) >= PART_MEMORY:
                    known.clear()
                ids = self.part_ids(part)
                if len(part) <= 64:
                    known[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        """Text of ids; control ids vanish, the added leading space goes, broken bytes become U+FFFD."""
        runs: list[list[int]] = [[]]
        if self.control.isdisjoint(ids):
            runs = [list(ids)]
        else:
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
        runs = [r for r in runs if r]
        if len(runs) > 1:
            return "".join(self._decode_run(r, k == 0) for k, r in enumerate(runs))
        return self._decode_run(runs[0], True) if runs else ""

    def _decode_run(self, ids: list[int], first: bool) -> str:
        text = b"".join(map(self.raw.__getitem__, ids))
        if first and self.prefix and ids[0] not in self.plain_start and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", errors="each_byte")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True) -> DataFrame:
    """One row per document: its id, `ids` (array<int>) and `decoded`, the text decoded from them."""
    path = model_path or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        claim("pieces", [c._parts, c._fits])
        tail = [c.end] if end_id else []
        for batch in batches:
            for part in text_slices(batch, "text"):
                values, sizes, decoded = [], [], []
                for text in texts(part, "text"):
                    ids = np.concatenate([c.encode(text), np.array(tail, dtype=np.int32)])
                    values.append(ids)
                    sizes.append(len(ids))
                    decoded.append(c.decode(ids.tolist()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays = [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "ids", "decoded"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
