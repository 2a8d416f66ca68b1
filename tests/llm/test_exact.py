"""Operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from secretsift.llm import lines, mixing, near, pieces, quality, queries, spans, syncmers, warc
from secretsift.llm.common import components, numbered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(odd_rows):
    """Awkward rows and random texts that share lines and passages."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("al", "en", "ir", "os", "ut", "ax", "el")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(45))
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    rows = list(odd_rows)
    for i in range(20, 70):
        own = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))]
        text = " ".join(own)
        if i % 3 == 0:
            text += "\n" + line.upper() + " \n" + text[:40]
        if i % 4 == 0:
            text = passage + " " + text + " " + passage
        rows.append((i, text, rng.choice(["a", "b", None])))
        if i % 7 == 0:
            own[len(own) // 2] = "changed"
            rows.append((100 + i, " ".join(own), "a"))
    return rows


def test_quality(docs, corpus, words):
    found = quality.host_quality(docs(corpus)).select(
        "row.doc_id", "row.text", *quality.METRICS, "base_failed", "host", "host_docs", "kept").collect()
    assert len(found) == len(corpus)
    for r in found:
        text, w = r.text or "", words(r.text)
        with_word = [x for x in text.split("\n") if words(x)]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(with_word) - len(set(with_word)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert {r.host: r.host_docs for r in found} == collections.Counter(s for _, _, s in corpus)


def test_bad_host_goes_as_a_whole(docs):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(40)] + [(100 + i, good, "good") for i in range(40)]
    kept = quality.reject_low_quality(docs(rows))
    assert kept.columns == docs(rows).columns
    assert {r.source for r in kept.collect()} == {"good"} and kept.count() == 40


def test_lines(docs, corpus):
    rows = {(i, t) for i, t, _ in corpus}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    assert keeper
    out = lines.dedup_lines(docs(corpus), batches=3).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept")
    got = out.collect()
    assert len(got) == len(corpus)
    for r in got:
        every = (r.text or "").split("\n")
        stay = [x for x in every if keeper.get(key(x), r.doc_id) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept) == (len(every), len(every) - len(stay), "\n".join(stay))
    assert lines.drop_frequent_lines(docs(corpus)).columns == docs(corpus).columns


def test_spans(docs, corpus, words):
    order = sorted(corpus, key=lambda r: r[0])
    seen, want = set(), collections.Counter()
    for i, t, _ in order:
        w = words(t)
        gone = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = collections.Counter(tuple(r) for r in spans.dedup_substrings(docs(corpus)).select(
        "id", "n_words", "n_removed", "kept").collect())
    assert got == want


@pytest.mark.parametrize("shingle", [2, 5])
def test_near(docs, corpus, words, shingle):
    rows = sorted(corpus, key=lambda r: r[0])
    sets = []
    for _, t, _ in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a, b in itertools.combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    want = collections.Counter((r[0], len(s), rows[k][0]) for r, s, k in zip(rows, sets, root))
    got = near.near_duplicates(docs(corpus), shingle=shingle).select("id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == want
    kept = near.keep_one_of_each(docs(corpus), shingle=shingle)
    assert kept.columns == docs(corpus).columns and kept.count() == len(set(root))


def test_near_in_a_group_of_almost_near_copies(docs, words, monkeypatch):
    monkeypatch.setattr(near, "RARE", 4)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 9)):
            text[at] = f"m{rng.randrange(12)}"
        rows.append((i, " ".join(text), "a"))
    sets = [set(zip(w, w[1:])) for w in (words(t) for _, t, _ in rows)]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near.near_duplicates(docs(rows), shingle=2).select("id", "component_id").collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(root)) and len(set(root)) > 5


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 140), (140, 120), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 120: 100, 140: 100}


def test_numbered_keeps_order(docs, odd_rows):
    got = numbered(docs(odd_rows), "doc_id", F.col("doc_id")).orderBy("row_id").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _, _ in odd_rows)
    assert len({r.row_id for r in got}) == len(odd_rows)


def test_fingerprints(docs, corpus):
    rows = sorted({(i, t or "") for i, t, _ in corpus})
    out = syncmers.edited_neighbours(docs([(i, t, "a") for i, t in rows])).select(
        "doc_id", "n_chars", "edited", syncmers.fingerprint(F.col("pairs")).alias("f"),
        syncmers.likeness(F.col("bag"), F.col("edited_bag")).alias("near")).collect()
    after = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    texts = dict(rows)
    for r in out:
        t, n = texts[r.doc_id], len(texts[r.doc_id]) // 4
        assert (r.n_chars, r.edited) == (len(t), t[: len(t) - n] + after[r.doc_id][:n])
        assert 0 <= r.near <= 1 and (len(t) < 40 or r.near > 0.3)
    of = collections.defaultdict(set)
    for r in out:
        of[texts[r.doc_id]].add(r.f)
    assert len(out) == len(rows) and all(len(x) == 1 for x in of.values())


def test_mix(docs, corpus, words):
    made = docs(corpus)
    mix = mixing.mix(made, block=8)
    sizes = collections.Counter()
    for _, t, s in corpus:
        sizes[s] += len(words(t))
    held = {r.source: r for r in mix.sources.collect()}
    assert {s: r.source_size for s, r in held.items()} == dict(sizes)
    assert sum(r.target for r in held.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken = collections.Counter()
    per = mix.taken.join(mix.docs, "row_id").selectExpr("row_id", "source", "size", "last - first AS n").collect()
    by_row = collections.Counter()
    for r in per:
        taken[r.source] += r.n
        by_row[r.row_id, r["size"]] += r.n
    assert all(n <= 2 * size for (_, size), n in by_row.items())
    for s, r in held.items():
        assert abs(taken[s] - r.target) <= max(16, 0.05 * r.target)
    again = mixing.mix(made, block=8).taken.select("epoch", "shard", "slot", "first", "last")
    assert sorted(again.collect()) == sorted(mix.taken.select("epoch", "shard", "slot", "first", "last").collect())
    out = mixing.mixed_documents(made, block=8)
    assert out.columns == made.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())


def test_targets_and_permutation():
    import numpy as np

    assert mixing.targets([10, 0, 1000]) == [20.0, 0.0, pytest.approx(1495.0)]
    assert mixing.targets([]) == []
    for n in (1, 2, 5, 1000):
        at = np.arange(n)
        got = mixing.permuted(at, np.full(n, n), np.full(n, 77))
        assert sorted(got) == list(range(n))


def test_pieces(docs, corpus):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    extra = ["  a  b\n\nc ", "▁▁a▁", "<s></s><unk><0x0A>", "\x00\x7f​", "ąćę ΑΒΓ кит 日本語 🙂🙂", "it's \");\r\n  }", " " * 70 + "z",
             "a" * 3000, "".join(chr(c) for c in range(1, 0x500))]
    rows = corpus + [(1000 + i, t, "a") for i, t in enumerate(extra)]
    for r in pieces.encode_texts(docs(rows).select("doc_id", "text", F.col("text").alias("keep")), queries.tokenizer_path()).select(
            "row.keep", "ids", "decoded").collect():
        want = model.encode(r.keep or "")
        assert list(r.ids) == want and r.decoded == model.decode(want)


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(5, "http://a/\n1", body), (2, None, body), (9, "http://b", body), (3, "u", "small"), (4, "u", "small"),
            (6, "é", None), (7, "u", ""), (8, "u", "漢" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    got = {r.record_id: r for r in warc.archive_pages(pages, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data, r = (html or "").encode(), got[f"<urn:page:{i}>"]
        again = i in (5, 9)
        assert r.record_type == ("revisit" if again else "response")
        assert r.refers_to == ("<urn:page:2>" if again else None)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert again or (r.payload or b"") == data
    few = warc.read_warc(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://b%'")
    assert [r.record_id for r in few.collect()] == ["<urn:page:9>"]
    assert all(r.payload is None for r in warc.read_warc(spark, path, payload=False).collect())


def test_warc_of_other_writers(tmp_path):
    import gzip
    import io

    rows = [{c: None for c in warc.HEADERS} | {"record_type": "response", "record_id": f"<{i}>", "payload": b"p" * i} for i in (3, 400)]
    plain = b"".join(map(warc.record_bytes, rows))
    for data in (plain, b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)):
        got = list(warc.read_records(io.BytesIO(data), lambda r: r["record_id"] != "<3>"))
        assert [(r["record_id"], r["payload"]) for r in got] == [("<400>", b"p" * 400)]


def test_empty_tables(docs, spark):
    none = docs([])
    assert quality.host_quality(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert spans.dedup_substrings(none).count() == 0
    assert near.near_duplicates(none).count() == 0
    assert syncmers.edited_neighbours(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert pieces.encode_texts(none, queries.tokenizer_path()).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_words_that_differ_are_told_apart(docs):
    """A Thue-Morse word and its mirror sum to the same polynomial for every base modulo 2 ** 64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    mirror = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join([word, *rest[:12]]), "a"), (2, " ".join([mirror, *rest[:12]]), "a"),
            (3, " ".join([*rest[:9], word, *rest[9:]]), "a"), (4, " ".join([*rest[:9], mirror, *rest[9:]]), "a")]
    out = spans.dedup_substrings(docs(rows)).select("id", "n_removed").collect()
    assert {(r.id, r.n_removed) for r in out} == {(i, 0) for i in range(1, 5)}
    linked = near.near_duplicates(docs([(1, word, "a"), (2, mirror, "a")]), shingle=2).collect()
    assert {(r.id, r.component_id) for r in linked} == {(1, 1), (2, 2)}
