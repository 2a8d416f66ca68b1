"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Tokenizer A is byte-level (``tokenizers``), B has pieces with byte fallback
(``sentencepiece``). Both read a text that begins with a space. Their spans are coarse
cuts: A's character offsets and B's byte spans tell where tokens end, except where
several tokens share one character or have an empty span. Those ends are refined
with the bytes that the tokens decode to. Where an A and a B token end together, a
group ends, and the two tokens are linked.

Before a space that follows a non-space no token of either kind reaches across, so
texts are cut there, and each different part is encoded once per chunk of texts.
A chunk holds its links as places in its own list of id pairs; only these lists are
counted and looked up over all texts, each row of which is a pair of one chunk. A
second pass brings a chunk's texts and its pairs' counts together.

Defined results: null and empty texts have no tokens, nor have those whose joined
bytes of A or B differ from a space and the text (B can't tell U+2581 from a space):
their numbers are 0 and ``groups`` is empty, and their links count nowhere. Texts of any
length are read whole, one longer than a chunk is a chunk of its own. Repeated rows
are texts of their own. Pairs with equal counts are best alike. An empty table gives
an empty result. The input's row travels in one struct, so its names cannot clash.
Files of the tokenizers are read by the driver and sent to the executors.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from secretsift.llm.common import stored, whole

# Characters of a chunk; its arrays are some times as large.
CHUNK_CHARS = 1 << 22
# Parts remembered per worker, and the longest part that is.
PARTS, PART_CHARS = 400_000, 24
# Parts aligned at once, pairs per stored row.
BATCH_PARTS, ROW_PAIRS = 8_000, 1 << 15
# Parts that the libraries read in one text, as each text has a cost of its own.
LINE_PARTS = 200

_MISSING = object()
_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")

_STORED = [
    StructField("chunk", LongType()), StructField("n_a", LongType()), StructField("n_b", LongType()),
    StructField("n_groups", LongType()), StructField("groups", StringType()),
    StructField("links", ArrayType(IntegerType())), StructField("slice", IntegerType()),
    StructField("pairs", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))]


@dataclass(frozen=True)
class Files:
    """The contents of the tokenizers' files."""

    a: str
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Files:
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            return Files(f.read(), g.read())


class Tools:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, files: Files):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.known: dict[str, tuple] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and its byte.

    Printable bytes of Latin-1 stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _tools(files: Files) -> Tools:
    return Tools(files)


def parts_of(text: str) -> list[str]:
    """A space and ``text``, cut before each space that follows a non-space; each part without its first space.

    There is no cut before the last space of a text, as B has no token for an empty part.
    """
    parts = [p[1:] for p in _CUT.split(" " + text)] if _LOOSE.search(" " + text) else text.split(" ")
    if parts[-1] == "" and len(parts) > 1:
        parts[-2:] = [parts[-2] + " "]
    return parts


def _refined(starts: np.ndarray, ends: np.ndarray, decoded: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: those of their spans, or else of the bytes they decode to.

    A span gives an end if it isn't empty and the next token of its part (there is
    none after ``last``) doesn't begin inside it.
    """
    following = np.append(starts[1:], 0)
    clear = (ends > starts) & (last | (following >= ends))
    return np.where(clear, ends, decoded)


def _lines(parts: list[str]) -> list[str]:
    """Parts joined to longer texts, each with its space; one that ends with white space ends a text."""
    out, line = [], []
    for p in parts:
        line.append(p)
        if len(line) == LINE_PARTS or p[-1:].isspace():
            out.append(" " + " ".join(line))
            line = []
    if line:
        out.append(" " + " ".join(line))
    return out


def align(parts: list[str], tools: Tools) -> list[tuple | None]:
    """Per part: numbers of A and B tokens, groups as text, linked id pairs as bytes of int64; None where bytes differ."""
    lines = _lines(parts)
    a = tools.a.encode_batch(lines, add_special_tokens=False)
    b = [[(t.id, t.begin, t.end) for t in x.pieces]
         for x in tools.b.encode([x[1:] for x in lines], return_type="proto", num_threads=1)]
    a_ids = list(chain.from_iterable(x.ids for x in a))
    a_line, b_line = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    b_tokens = np.fromiter(chain.from_iterable(chain.from_iterable(b)), np.int64, 3 * int(b_line.sum())).reshape(-1, 3)
    b_ids = b_tokens[:, 0].tolist()
    text = "".join(lines)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    byte_at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
    byte_base = byte_at[np.append(0, np.cumsum([len(p) + 1 for p in parts]))]
    line_base = np.append(0, np.cumsum([len(x) for x in lines]))[:-1]

    a_decoded, b_decoded = np.cumsum(tools.a_sizes[a_ids]), np.cumsum(tools.b_sizes[b_ids])
    # Numbers of tokens up to the end of each part.
    a_after, b_after = (np.searchsorted(d, byte_base[1:], "right") for d in (a_decoded, b_decoded))
    data = text.encode()
    same = (
        len(a_ids) > 0 and len(b_ids) > 0 and a_after[0] > 0 and b_after[0] > 0
        and np.array_equal(a_decoded[a_after - 1], byte_base[1:]) and np.array_equal(b_decoded[b_after - 1], byte_base[1:])
        and b"".join(map(tools.a_bytes.__getitem__, a_ids)) == data
        and b"".join(map(tools.b_bytes.__getitem__, b_ids)) == data)
    if not same:
        if len(parts) == 1:
            return [None]
        # Halves find the parts whose bytes differ.
        half = len(parts) // 2
        return align(parts[:half], tools) + align(parts[half:], tools)

    def last_of(after: np.ndarray, count: int) -> np.ndarray:
        marks = np.zeros(count, dtype=bool)
        marks[after - 1] = True
        return marks

    offsets = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in a)), np.int64, 2 * len(a_ids))
    offsets = offsets.reshape(-1, 2) + np.repeat(line_base, a_line)[:, None]
    spans = b_tokens[:, 1:] + np.repeat(byte_at[line_base], b_line)[:, None] + 1
    a_ends = _refined(byte_at[offsets[:, 0]], byte_at[offsets[:, 1]], a_decoded, last_of(a_after, len(a_ids)))
    b_ends = _refined(spans[:, 0], spans[:, 1], b_decoded, last_of(b_after, len(b_ids)))
    cuts, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    pairs = ((np.array(a_ids)[a_at] << 32) | np.array(b_ids)[b_at]).astype(np.int64).tobytes()
    group_after = np.searchsorted(cuts, byte_base[1:], "right").tolist()
    a_to, b_to = (a_at + 1).tolist(), (b_at + 1).tolist()
    a_names, b_names = [tools.names[i] for i in a_ids], [tools.names[i] for i in b_ids]
    a_count, b_count = np.diff(np.append(0, a_after)).tolist(), np.diff(np.append(0, b_after)).tolist()
    out, g, ai, bi = [], 0, 0, 0
    for n_a, n_b, end in zip(a_count, b_count, group_after):
        texts = []
        for a_end, b_end in zip(a_to[g:end], b_to[g:end]):
            if a_end - ai == 1 == b_end - bi:
                texts.append(a_names[ai] + "|" + b_names[bi])
            else:
                texts.append(",".join(a_names[ai:a_end]) + "|" + ",".join(b_names[bi:b_end]))
            ai, bi = a_end, b_end
        out.append((n_a, n_b, ";".join(texts), pairs[8 * g : 8 * end]))
        g = end
    return out


def _entries(parts: list[str], tools: Tools) -> list[tuple | None]:
    """``align`` of different parts, some of them remembered."""
    known = tools.known
    out = list(map(known.get, parts, repeat(_MISSING)))
    at = [i for i, e in enumerate(out) if e is _MISSING]
    for i in range(0, len(at), BATCH_PARTS):
        batch = at[i : i + BATCH_PARTS]
        for k, entry in zip(batch, align([parts[k] for k in batch], tools)):
            out[k] = entry
    if len(known) + len(at) > PARTS:
        # Parts of this chunk stay, in the order they came, as common ones come early.
        known.clear()
        at = range(len(parts))
    for k in at[: PARTS - len(known)]:
        if len(parts[k]) <= PART_CHARS:
            known[parts[k]] = out[k]
    return out


class Chunk:
    """Texts that share one list of parts and one of id pairs."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.rows: list[dict | None] = []
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, row, text: str) -> None:
        codes = self.codes
        self.rows.append(row)
        self.texts.append(np.array(
            [codes.setdefault(p, len(codes)) for p in parts_of(text)] if text else [], dtype=np.int64))
        self.chars += len(text)

    def finish(self, number: int, tools: Tools, keep_groups: bool) -> Iterator[dict]:
        """The stored rows of the chunk: its texts, then its pairs with their counts."""
        entries = _entries(list(self.codes), tools)
        bad = np.array([e is None for e in entries], dtype=bool)
        entries = [e or (0, 0, "", b"") for e in entries]
        n_a = np.array([e[0] for e in entries], dtype=np.int64)
        n_b = np.array([e[1] for e in entries], dtype=np.int64)
        sizes = np.array([len(e[3]) for e in entries], dtype=np.int64) // 8
        strings = [e[2] for e in entries]
        pairs, places = np.unique(np.frombuffer(b"".join(e[3] for e in entries), dtype=np.int64), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        uses = np.zeros(len(entries), dtype=np.int64)
        for row, codes in zip(self.rows, self.texts):
            out = {"row": row, "chunk": number, "n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "links": []}
            if len(codes) and not bad[codes].any():
                np.add.at(uses, codes, 1)
                count = sizes[codes]
                after = np.cumsum(count)
                at = np.repeat(begins[codes] - (after - count), count) + np.arange(int(after[-1]))
                groups = ";".join(map(strings.__getitem__, codes.tolist()))
                out |= {"n_a": int(n_a[codes].sum()), "n_b": int(n_b[codes].sum()), "n_groups": int(after[-1]),
                        "groups": groups if keep_groups else hashlib.sha256(groups.encode()).hexdigest(),
                        "links": places[at].astype(np.int32)}
            yield out
        counts = np.bincount(places, weights=np.repeat(uses, sizes).astype(float), minlength=len(pairs)).astype(np.int64)
        for i in range(0, len(pairs), ROW_PAIRS):
            yield {"chunk": number, "slice": i // ROW_PAIRS, "pairs": pairs[i : i + ROW_PAIRS],
                   "counts": counts[i : i + ROW_PAIRS]}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(f.name) for r in rows], type=f.type) for f in schema], schema=schema)


def _encoder(sent, row_type: pa.DataType, keep_groups: bool):
    lists = {"links": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
             "groups": pa.string(), "slice": pa.int32()}
    schema = pa.schema([("row", row_type), *[(f.name, lists.get(f.name, pa.int64())) for f in _STORED]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(sent.value)
        task = TaskContext.get().partitionId()
        chunk, number = Chunk(), 0

        def done() -> Iterator[pa.RecordBatch]:
            ready, held = [], 0
            for r in chunk.finish((task << 32) | number, tools, keep_groups):
                ready.append(r)
                held += 100 + len(r.get("links", ())) + 3 * len(r.get("pairs", ())) + len(r.get("groups", ""))
                if held > 1 << 20:
                    yield _batch(ready, schema)
                    ready, held = [], 0
            if ready:
                yield _batch(ready, schema)

        # Millions of small tuples and no cycles: looking for cycles takes a quarter of the time.
        gc.disable()
        try:
            for batch in batches:
                rows, texts = batch.column(0), batch.column(1)
                for i in range(len(batch)):
                    text = texts[i].as_py()
                    if chunk.rows and chunk.chars + len(text) > CHUNK_CHARS:
                        yield from done()
                        chunk, number = Chunk(), number + 1
                    chunk.add(rows[i].as_py(), text)
            if chunk.rows:
                yield from done()
        finally:
            gc.enable()

    return encode


_TOTALS = StructType([StructField("n_best", LongType()), StructField("count_sum", LongType())])


def _totals(schema: pa.Schema):
    """Sums over each text's links of what its chunk's pairs were found to be."""

    def total(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        values = np.zeros((2, size), dtype=np.int64)
        values[0, place] = pairs.column("best").to_numpy()
        values[1, place] = pairs.column("count").to_numpy()
        after = np.cumsum(texts.column("n_groups").to_numpy())
        links = texts.column("links").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        arrays = []
        for f in schema:
            if f.name in ("n_best", "count_sum"):
                sums = np.append(0, np.cumsum(values[int(f.name == "count_sum")][links]))
                arrays.append(pa.array(np.diff(np.append(0, sums[after])), type=pa.int64()))
            else:
                arrays.append(texts.column(f.name))
        return pa.Table.from_arrays(arrays, schema=schema)

    return total


def align_texts(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep_groups: bool = True,
                keep_text: bool = True) -> DataFrame:
    """``row``, the numbers of tokens, groups and links, ``groups``, ``n_best`` and ``count_sum`` of each row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256 without ``keep_groups``.
    """
    spark = df.sparkSession
    row = F.struct("*") if keep_text else F.struct("*").dropFields(text)
    given = df.select(row.alias("row"), whole(F.col(text)).alias("text"))
    sent = spark.sparkContext.broadcast(Files.read(a_path, b_path))
    fields = [given.schema["row"], *_STORED]
    row_type = to_arrow_schema(StructType(fields[:1])).field(0).type
    encoded = stored(given.mapInArrow(
        _encoder(sent, row_type, keep_groups), StructType([StructField(f.name, f.dataType) for f in fields])))

    listed = encoded.where("slice IS NOT NULL").select("chunk", "slice", F.posexplode(F.arrays_zip("pairs", "counts")))
    listed = listed.select("chunk", (F.col("slice") * ROW_PAIRS + F.col("pos")).alias("place"),
                           F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    counted = stored(listed.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", b_id))
    # As many rows as B has ids.
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    judged = counted.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    found = listed.select("chunk", "place", "pair").join(judged.hint("merge"), "pair").select(
        F.col("chunk").alias("of"), "place", "count", "best")

    texts = encoded.where("slice IS NULL").select("row", "chunk", "n_a", "n_b", "n_groups", "groups", "links")
    out = StructType([StructField(f.name, f.dataType) for f in (
        texts.schema["row"], texts.schema["n_a"], texts.schema["n_b"], texts.schema["n_groups"],
        texts.schema["groups"], *_TOTALS)])
    totals = _totals(to_arrow_schema(out))
    summed = texts.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(totals, out)
    return summed.withColumn("n_links", F.col("n_groups"))
