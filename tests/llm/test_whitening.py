"""Whitening against numpy on the distinct integer vectors."""

import math

import numpy as np
import pytest

from secretsift.llm import whitening
from secretsift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, index long, x string, n int"


def rows_of(vectors):
    return [(i, v, 0, 5, "x", 1) for i, v in vectors]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.2).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(500 + i, base[7]) for i in range(150)]  # a vector that a third of the rows share
    odd = [None, [], [1.0] * 19 + [None], [math.nan] + [1.0] * 19, [math.inf] + [0.0] * 19, [1e30] + [0.0] * 19, [1.0, 2.0]]
    return rows + [(900 + i, v) for i, v in enumerate(odd)] + [(None, base[3]), (3, base[3])]


def expected(vectors):
    used = [(i, v) for i, v in vectors if v and len(v) == 20 and all(c is not None and abs(c) < 2**50 for c in v)]
    x = np.floor(64 * np.array([v for _, v in used], dtype=np.float64)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    values, axes = np.linalg.eigh((once - s / n).T @ (once - s / n) / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    whitened = (x - s / n) @ axes / np.sqrt(values)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return [i for i, _ in used], n, deviation, whitened, values / np.trace((once - s / n).T @ (once - s / n) / n)


def test_query_against_numpy(spark, vectors, tmp_path):
    spark.createDataFrame(rows_of(vectors), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["op13_whitening"](spark, str(tmp_path)).collect()
    ids, n, deviation, whitened, explained = expected(vectors)
    assert len(rows) == 16 * len(ids) and {r.n for r in rows} == {n}
    assert {r.component for r in rows} == set(range(1, 17))
    assert max(r.identity_error for r in rows) < 1e-9 and len({r.identity_error for r in rows}) == 1
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.component), []).append(r)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    # Every component has one sign over all rows.
    sign = {}
    for i, d, w in zip(ids, deviation, whitened):
        for c in range(16):
            for r in found[i, c + 1]:
                assert r.deviation == d and abs(abs(r.whitened) - abs(w[c])) < 1e-8
                if abs(w[c]) > 1e-3:
                    assert sign.setdefault(c, r.whitened / w[c] > 0) == (r.whitened / w[c] > 0)


def test_wide_sums_agree(spark, vectors):
    """Sums beyond 64 bits take the decimal form of the same expressions."""
    rows = whitening.integers(spark.createDataFrame(rows_of(vectors), SCHEMA))
    found = whitening.fit(rows)
    both = rows.select(*[whitening.deviation(found.sums, found.n, wide).alias(name) for wide, name in (
        ("long", "a"), ("decimal(38,0)", "b"))]).collect()
    assert found.wide == "long" and all(r.a == r.b for r in both)


def test_blocks_are_split(spark, vectors, monkeypatch):
    """Many blocks and splits give what one block gives."""
    frame = spark.createDataFrame(rows_of(vectors), SCHEMA)
    one = whitening.fit(whitening.integers(frame))
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    many = whitening.fit(whitening.integers(frame))
    assert np.allclose(one.eigenvalues, many.eigenvalues) and np.allclose(np.abs(one.components), np.abs(many.components))


@pytest.mark.parametrize("few", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_varies(spark, few):
    out = whitening.by_component(whitening.whiten(spark.createDataFrame(rows_of(few), SCHEMA)))
    assert out.collect() == [] and "whitened" in out.columns


def test_fewer_components_than_asked(spark):
    """Two dimensions that vary together have one component."""
    out = whitening.by_component(whitening.whiten(spark.createDataFrame(rows_of(
        [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0, 8.0])]), SCHEMA))).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-9
