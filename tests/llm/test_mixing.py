"""Mixing: draws, plans without a bound on sources, and the registered query."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from secretsift.llm import mixing
from secretsift.llm.queries import QUERIES


def test_many_sources(spark):
    n = 100_003
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("text"),
                                 F.format_string("s%06d", "id").alias("source"))
    mix = mixing.mix(made, block=2)
    rows = sorted(mix.sources.select("source", "target", "slots", "place").collect())
    wanted = mixing.targets([i % 5 for i in range(n)])
    assert [r.place for r in rows] == list(range(n))
    assert [r.target for r in rows] == pytest.approx(wanted)
    shards = mix.taken.select("shard", "slot", "row_id").join(mix.docs, "row_id").groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources")).collect()
    assert sum(r.n for r in shards) == sum(r.slots for r in rows)
    # Sizes of shards are drawn: about SHARD_SLOTS each, give or take some deviations.
    mean = sum(r.n for r in shards) / len(shards)
    assert all(abs(r.n - mean) < 6 * mean**0.5 for r in shards) and len(shards) > 10


def test_draws_are_multinomial_with_exact_totals():
    counts = np.array([mixing.split(place, 0, 64, 6400, 1)[1] for place in range(400)])
    assert (counts.sum(1) == 6400).all()
    assert abs(counts.mean(0) - 100).max() < 3
    # Variance of a multinomial count, and the correlation of two of them.
    assert abs(counts.var() / (100 * 63 / 64) - 1) < 0.05
    assert -0.1 < np.corrcoef(counts[:, 0], counts[:, 1])[0, 1] < 0.1
    bounds, again = mixing.split(7, 0, 64, 6400, 1)
    assert (again == counts[7]).all() and bounds.tolist() == list(range(65))


def test_any_number_of_shards(spark, monkeypatch):
    """Splits over three levels give every slot of every source once, whatever the shards."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 4)
    monkeypatch.setattr(mixing, "FAN_OUT", 5)
    made = spark.createDataFrame([(i, "a b c " * (i % 7), "xyz"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.mix(made, block=2)
    slots = mixing._slots(mix.sources, mixing.SEED).collect()
    planned = {r.place: r.slots for r in mix.sources.collect()}
    by = collections.defaultdict(list)
    for r in slots:
        by[r.place].append(r.slot)
    assert {p: sorted(v) for p, v in by.items()} == {p: list(range(n)) for p, n in planned.items() if n}
    assert len({r.shard for r in slots}) > 0.9 * sum(planned.values()) / 4
    # A source's pass over its blocks takes each of them once.
    for place in planned:
        blocks = [r.block for r in slots if r.place == place and r.epoch == 0]
        assert len(set(blocks)) == len(blocks)


def test_nothing_that_grows_is_broadcast(spark, docs):
    """Only the plan of the sources, behind its bound, is sent to every task."""
    made = docs([(i, "some words here " * 9, "ab"[i % 2]) for i in range(50)])
    for frame in (mixing.mixed_documents(made), mixing.mix(made).taken):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for join in re.findall(r"BroadcastHashJoin \[(\w+)", plan):
            assert join in ("source", "coalesce")


def test_query(spark, docs, words, odd_rows, tmp_path):
    """Sizes and targets of every row, and what the mix takes of each source and row."""
    rows = [*odd_rows, (None, "no id but words", "a"), *[(20 + i, f"w{i} " * (i * 3), "abc"[i % 3]) for i in range(60)]]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op2_source_mix"](spark, str(tmp_path)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    of = collections.defaultdict(list)
    for i, t, s in rows:
        of[i, len(words(t))].append(s)
    taken = collections.Counter()
    for r in found:
        source = next(s for s in of[r.doc_id, r["size"]] if sizes[s] == r.source_size and target[s] == pytest.approx(r.target))
        of[r.doc_id, r["size"]].remove(source)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert not any(of.values())
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2 * mixing.BLOCK, 0.02 * target[s])
    again = QUERIES["op2_source_mix"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
