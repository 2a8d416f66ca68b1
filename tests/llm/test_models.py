"""Trained operators: gradients, held-out accuracy, awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from secretsift.llm import language, queries, toxicity


def test_gradients_match_differences():
    rows = language.windows("Hello wörld, this is a test. ".encode() * 8)[:3]
    labels = np.array([0, 1, 0])
    network = language.Network.new(["a", "b"])
    network.values = {k: v.astype(np.float64) for k, v in network.values.items()}
    _, by = network.gradients(rows, labels)
    rng = np.random.default_rng(1)
    for name, value in network.values.items():
        at = tuple(rng.integers(n) for n in value.shape)
        if name == "embedding":
            at = (int(rows[0, 3]), at[1])
        old, step = value[at], 1e-3
        value[at] = old + step
        up = network.gradients(rows, labels)[0]
        value[at] = old - step
        down = network.gradients(rows, labels)[0]
        value[at] = old
        assert abs((up - down) / (2 * step) - by[name][at]) < 2e-4, name


def test_languages(spark):
    rows = queries.QUERIES["op7_language"](spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and len(lang[r.doc_id][1]) > 100]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_rows(docs, odd_rows):
    network = language.train(["the cat sat on the mat"] * 5, ["en"] * 5, rounds=3)
    got = {r.row.doc_id: r for r in language.label_texts(docs(odd_rows), network).collect()}
    assert [got[i].language for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[7].language == "en" and got[4].score <= 1
    assert language.predict(None, ["some text"]) == [("und", 0.0)]
    assert language.train([], []) is None


def _sentences(rng, count, toxic):
    stems = ["bal", "ten", "mir", "dos", "kut", "fax"]
    out = []
    for _ in range(count):
        text = ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        if toxic:
            text[rng.randrange(len(text))] = "zorgl" + rng.choice(["ed", "ing", "er", "s", "ish", "y"])
        out.append(" ".join(text))
    return out


def test_toxicity_of_unseen_misspellings():
    rng = random.Random(3)
    good, bad = _sentences(rng, 150, False), _sentences(rng, 150, True)
    model = toxicity.train(good + bad, [0] * 150 + [1] * 150)
    unseen = [t.replace("zorgl", "zorglx") for t in _sentences(rng, 50, True)]
    assert np.mean([model.score(t) >= 0.5 for t in unseen]) > 0.9
    assert np.mean([model.score(t) < 0.5 for t in _sentences(rng, 50, False)]) > 0.9
    long = " ".join(_sentences(rng, 100, False) + unseen[:1])
    assert model.score(long) >= 0.5


def test_toxicity_of_awkward_rows(docs, odd_rows, spark):
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 0), (None, 1), (999, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs(odd_rows), labels, F.lit(True)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.toxicity(docs(odd_rows), labels.limit(0), F.lit(True)).collect()
    assert len(none) == len(odd_rows) and all(r.score < 0.5 for r in none)
    assert toxicity.toxicity(docs([]), labels, F.lit(True)).count() == 0


def test_every_language_is_learned(spark):
    """Two hundred and fifty languages, one of them with a third of the rows, and rows without one."""
    rows = [(i, f"text of number {i}", f"l{i % 250:03}") for i in range(750)]
    rows += [(1000 + i, "common text", "l007") for i in range(500)] + [(2000, "none", None), (2001, None, "l260")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    excerpts, labels = language.training_sample(frame, F.lit(True), 3)
    assert set(labels) == {f"l{i:03}" for i in range(250)} and len(excerpts) == len(labels)
    assert max(labels.count(x) for x in set(labels)) <= 3
