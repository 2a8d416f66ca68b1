"""Fingerprints against brute force, and their likeness over edits of all lengths."""

import collections
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from secretsift.llm import syncmers
from secretsift.llm.queries import QUERIES


@pytest.fixture(scope="module")
def near(docs):
    """Likeness of each text to its edit and to the next one."""

    def run(texts):
        out = syncmers.edited_neighbours(docs([(i, t, "a") for i, t in enumerate(texts)]))
        rows = out.select("doc_id", syncmers.likeness(F.col("bag"), F.col("edited_bag")).alias("edited"),
                          syncmers.likeness(F.col("bag"), F.col("next_bag")).alias("next")).collect()
        return [(r.edited, r.next) for r in sorted(rows)]

    return run


def _words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_near_copies_of_like_length(near):
    base = _words(1, 80)
    texts = [base[:n] for n in range(188, 214)]
    assert all(likeness > 0.7 for _, likeness in near(texts)[:-1])
    # Nothing in common stays nothing.
    assert all(likeness < 0.1 for _, likeness in near([_words(s, 30) for s in (2, 3, 4)]))


def test_edit_that_shortens(near):
    # Of 240 characters 180 stay and 10 are added.
    assert near([_words(5, 90)[:240], _words(6, 10)[:10]])[0][0] > 0.5


def test_runs_without_space(near):
    rng = random.Random(7)
    for text in ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(900)),
                 "".join(rng.choice("ABCDEFghijklmnop0123456789+/") for _ in range(900))):
        assert near([text, text[:50] + text[51:]])[0][1] > 0.9


def _murmur(words, seed, length):
    """The 32-bit hash of Spark's ``hash`` over whole words."""
    mask, h = 0xFFFFFFFF, seed
    for k in words:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    h ^= length
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def _signed(value):
    return value - (1 << 32) if value >> 31 else value


def _pairs(text):
    """Hashes of the closed syncmers of a text, each with the distance to the next one."""
    if not text:
        return []
    k, s = syncmers.K, syncmers.S
    marked = [b"\xff" * 4] * (k - 1) + [c.encode("utf-32-be") for c in text] + [b"\xff" * 4] * (k - 1)

    def run(at, length):
        data = b"".join(marked[at : at + length])
        return _signed(_murmur(struct.unpack(f"<{length}I", data), 42, len(data)))

    inner = [run(i, s) for i in range(len(marked) - s + 1)]
    found = [(i, run(i, k)) for i in range(len(marked) - k + 1)
             if min(inner[i : i + k - s + 1]) == min(inner[i], inner[i + k - s])]
    out = []
    for j, (at, value) in enumerate(found):
        gap = found[j + 1][0] - at if j + 1 < len(found) else 0
        out.append(_signed(_murmur([gap], _murmur([value & 0xFFFFFFFF, 0], 42, 8), 4)))
    return out


def test_query_against_brute_force(spark, docs, odd_rows, tmp_path):
    rng = random.Random(11)
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 20_000] + [(None, "no id", "a"), (4, "ab " * 700, "b")]
    rows += [(100 + n, "".join(rng.choice("abcé 漢🙂") for _ in range(n)), "a") for n in range(60)]
    rows += [(200 + n, _words(n % 3, 5 + n), "a") for n in range(40)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op8_fingerprints"](spark, str(tmp_path)).collect()
    # Rows of one id follow each other in an order of their own; these are equal or the only ones.
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t, _ in ordered]

    def alike(a, b):
        a, b = collections.Counter(a), collections.Counter(b)
        return (a & b).total() / (a | b).total() if a or b else 1.0

    want = []
    for i, (key, _, _) in enumerate(ordered):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, changed = _pairs(text), _pairs(edited)
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, own)),
                     ",".join(map(str, changed)), alike(own, changed), alike(own, _pairs(after))))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
