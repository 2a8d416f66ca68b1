"""Token alignment against encoding whole texts and counting in dictionaries."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from secretsift.llm import alignment
from secretsift.llm.queries import BYTE_TOKENIZER, QUERIES, tokenizer_path

PATHS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path()
SOME = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "🙂", "👩‍👧", " ", "▁", "<0x41>", "<|endoftext|>",
        "</s>", "'s", "23", ".", "\x00", "\x1c", "Ж", "\r\n", "​", "́", "　"]
DOCS = [
    (1, None, "a"), (2, "", None), (3, " \n\t\n", "a"), (4, "the cat  sat on the mat " * 500, "b"), (5, "one two three", "b"),
    (5, "one two three", "a"), (None, "one two", "a"), (7, "has ▁ in it the cat", None), (8, "é漢🙂 x\r\ny\x00z 👩‍👧 ", "b"),
    (9, "x" * 5000, "c"), (10, "漢字" * 700, "c"), (11, "the<|endoftext|>cat</s> it's", "c")]


@pytest.fixture(scope="module")
def tools():
    return alignment.Tools(alignment.Files.read(*PATHS))


def brute(text, tools):
    """Tokens of the whole text by both libraries, cut at the ends they have in common."""
    if not text:
        return 0, 0, "", []
    want = (" " + text).encode()
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    a_ends = np.cumsum([len(tools.a_bytes[i]) for i in a]).tolist()
    b_ends = np.cumsum([len(tools.b_bytes[i]) for i in b]).tolist()
    if b"".join(tools.a_bytes[i] for i in a) != want or b"".join(tools.b_bytes[i] for i in b) != want:
        return 0, 0, "", []
    groups, pairs, i, j = [], [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        pairs.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return len(a), len(b), ";".join(groups), pairs


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SOME), max_size=14).map("".join))
def test_parts_align_as_the_whole(tools, text):
    found = alignment.align(alignment.parts_of(text), tools) if text else []
    if any(e is None for e in found):
        found = []
    assert brute(text, tools) == (
        sum(e[0] for e in found), sum(e[1] for e in found), ";".join(e[2] for e in found),
        [(p >> 32, p & 0xFFFFFFFF) for e in found for p in np.frombuffer(e[3], dtype=np.int64).tolist()])


def expected(rows, tools):
    found = [(i, brute(t, tools)) for i, t, _ in rows]
    count = collections.Counter(p for _, f in found for p in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, n_a, n_b, len(pairs), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), groups)
            for i, (n_a, n_b, groups, pairs) in found]


@pytest.mark.parametrize("chars", [300, alignment.CHUNK_CHARS])
def test_counts_over_all_texts(docs, tools, monkeypatch, chars):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chars)
    out = alignment.align_texts(docs(DOCS), *PATHS)
    rows = out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected(DOCS, tools)))


def test_query(spark, docs, tools, tmp_path):
    docs(DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in expected(DOCS, tools)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_empty_table(docs):
    assert alignment.align_texts(docs([]), *PATHS).count() == 0
