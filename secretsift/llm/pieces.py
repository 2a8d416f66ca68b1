"""SentencePiece encoding and decoding of a merge-type model, exact, by backtracking.

A text is cut where no piece of the model reaches across: before a run of spaces, around
line feeds, and between Latin letters and other
characters. Each part is encoded from left to right: an Aho-Corasick automaton finds
all pieces at all places, the longest is tried first, and a piece may follow
another only if merging the two together again by the rules of the model gives the
same two pieces. Where no piece fits, the place is marked as failed in a bit field
and the piece before it is shortened. A sequence whose neighbours are all compatible
is the one that merging would give.

Most parts need no step back: if the longest pieces, one after the other, are
compatible, they are the answer. Results for parts and for pairs of pieces are
remembered up to fixed numbers of entries; parts that were used since the last time
the store was full stay. Characters that no piece holds become byte pieces.

Defined results: null is the empty text, which has no pieces; texts of any length
are handled whole; an empty table gives an empty result. The model's path is a
parameter; its pieces, not the file, are sent to the executors.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

SPACE = "▁"
_LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"  # letters, as a character class
# Entries remembered per worker, and the longest part that is.
PARTS, PART_CHARS, PAIRS = 100_000, 40, 200_000
# Output rows are sent in batches of about this many pieces.
BATCH_PIECES = 1 << 18


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]  # id of each byte's piece
    plain: frozenset[int]  # ids that merging can give
    control: frozenset[int]
    unknown: int
    key: str = field(default="")

    @staticmethod
    def load(path: str) -> Pieces:
        import hashlib

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = tuple(model.id_to_piece(i) for i in range(size))
        at = {t: i for i, t in enumerate(texts)}
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        byte_ids = tuple(at.get(f"<0x{b:02X}>", -1) for b in range(256))
        if -1 in byte_ids or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model must have a piece for every byte and no unused ones")
        with open(path, "rb") as f:
            key = hashlib.sha256(f.read()).hexdigest()
        return Pieces(texts, tuple(model.get_score(i) for i in range(size)), byte_ids,
                      frozenset(range(size)) - frozenset(special),
                      frozenset(i for i in special if model.is_control(i)), model.unk_id(), key)


class Codec:
    """Encoder and decoder over the pieces of one model."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.ids = {pieces.texts[i]: i for i in pieces.plain}
        self.rank = {t: -pieces.scores[i] for t, i in self.ids.items()}
        self.characters = {t for t in self.ids if len(t) == 1}
        self.lengths = [len(t) for t in pieces.texts]
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            if all(c in self.characters for c in text) and self.merged(text) == [text]:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(self._cuts())
        self.surface = [t.replace(SPACE, " ").encode() for t in pieces.texts]
        for b, i in enumerate(pieces.byte_ids):
            self.surface[i] = bytes([b])
        for i in pieces.control:
            self.surface[i] = b""
        self.surface[pieces.unknown] = " ⁇ ".encode()

    def _cuts(self) -> str:
        """A pattern of the parts of a text: cuts are only taken where no piece crosses them."""
        letter, crossed = re.compile(f"[{_LATIN}]"), {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        if any("\n" in two or (two[1] == SPACE and two[0] != SPACE) for two in crossed):
            return r"(?s).+"
        if any(two[0] != SPACE and bool(letter.match(two[0])) != bool(letter.match(two[1])) for two in crossed):
            return rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
        return rf"{SPACE}*(?:[{_LATIN}]+|[^{SPACE}\n{_LATIN}]+)|{SPACE}+|\n+"

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the model's rule: best pair first, the left one of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left, right = self.pieces.texts[a], self.pieces.texts[b]
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def _run(self, text: str) -> list[int]:
        """Pieces of a text whose characters are all known."""
        size, lengths = len(text), self.lengths
        out = [i for _, i in self.automaton.iter_long(text)]
        if sum(map(lengths.__getitem__, out)) == size and all(map(self.compatible, out, out[1:])):
            return out
        found: list[list[int]] = [[] for _ in range(size)]
        for end, i in self.automaton.iter(text):
            found[end + 1 - lengths[i]].append(i)  # by growing length
        failed = bytearray((size >> 3) + 1)
        out = []
        tried: list[int] = []  # index of each piece of ``out`` among those at its place
        at, index = 0, len(found[0]) - 1
        while at < size:
            here = found[at]
            while index >= 0:
                piece = here[index]
                end = at + lengths[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                index -= 1
            if index >= 0:
                out.append(piece)
                tried.append(index)
                at = end
                index = len(found[at]) - 1 if at < size else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= lengths[out.pop()]
                index = tried.pop() - 1
        return out

    def _part(self, part: str) -> tuple[int, ...]:
        if self.characters.issuperset(part):
            return tuple(self._run(part))
        ids: list[int] = []
        run: list[str] = []
        for c in part:
            if c in self.characters:
                run.append(c)
                continue
            if run:
                ids += self._run("".join(run))
                run = []
            ids += [self.pieces.byte_ids[b] for b in c.encode()]
        if run:
            ids += self._run("".join(run))
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin or end ids."""
        if not text:
            return []
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE))
        out = list(map(self.parts.get, parts))
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._remembered(parts[i])
        return list(chain.from_iterable(out))

    def _remembered(self, part: str) -> tuple[int, ...]:
        """Pieces of a part that is not in the newer store."""
        if len(part) > PART_CHARS:
            return self._part(part)
        ids = self.parts.get(part) or self.older.get(part) or self._part(part)
        if len(self.parts) >= PARTS:
            self.older, self.parts = self.parts, {}
        self.parts[part] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces restored, the one added in front removed."""
        first = next((i for i in ids if i not in self.pieces.control), None)
        data = b"".join(map(self.surface.__getitem__, ids))
        if first is not None and self.pieces.texts[first].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors=_EACH_BYTE)


_EACH_BYTE = "piece-bytes"
codecs.register_error(_EACH_BYTE, lambda e: ("�" * (e.end - e.start), e.end))

_codecs: dict[str, Codec] = {}


def codec_of(pieces: Pieces) -> Codec:
    """The codec of a model, made once per process."""
    if pieces.key not in _codecs:
        _codecs.clear()
        _codecs[pieces.key] = Codec(pieces)
    return _codecs[pieces.key]


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df`` but the text), ``ids`` and the text ``decoded`` from them."""
    pieces = df.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(pieces.value)
        for batch in batches:
            texts, start, ids, size = batch.column("body"), 0, [], 0
            for i in range(batch.num_rows):
                ids.append(codec.encode(texts[i].as_py() or ""))
                size += len(ids[-1])
                if size >= BATCH_PIECES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("row").slice(start, i + 1 - start), pa.array(ids, pa.list_(pa.int32())),
                        pa.array([codec.decode(x) for x in ids], pa.string())], names=["row", "ids", "decoded"])
                    start, ids, size = i + 1, [], 0

    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(rest.alias("row"), F.col(text).alias("body"))
    schema = StructType([rows.schema["row"]]).add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return rows.mapInArrow(run, schema)
