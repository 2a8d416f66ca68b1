"""The stream of pages: state, repeats within and across batches, and clocks that go back."""

import glob

import pytest
from pyspark.sql import functions as F

from secretsift import schemas
from secretsift.operators import scope
from secretsift.streaming import incremental

HERE = "https://x.com/"


@pytest.fixture
def stream(spark, mini_rules, tmp_path):
    """Add a file of pages per call, run, and give what each batch wrote."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seeds = spark.createDataFrame([("x.com", "x")], "domain string, label string")

    class Stream:
        out, checkpoint = target, state

        def add(self, *names):
            rows = [(i, HERE, f"<script src=/{n}.js></script><script src=https://far.org/{n}.js></script>") for i, n in enumerate(names)]
            spark.createDataFrame(rows, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)

        def run(self):
            table = incremental.run_incremental(spark, source, target, state, seeds, mini_rules, files_per_batch=1)
            rows = table.collect()
            assert len({r.resource_url for r in rows}) == len(rows)
            return sorted((r.batch, r.resource_url.removeprefix(HERE)) for r in rows)

    return Stream()


def test_repeats_across_three_batches(stream):
    stream.add("a", "b", "a", "a")
    first = stream.run()
    assert first == [(0, ""), (0, "a.js"), (0, "b.js")]
    stream.add("b", "c", "c")
    stream.add("a", "c", "d")
    # Files of one run are taken in the order they came.
    assert stream.run() == first + [(1, "c.js"), (2, "d.js")]
    stream.add("d", "a")
    assert stream.run() == first + [(1, "c.js"), (2, "d.js")]


def test_state_is_in_the_checkpoint_as_changes(stream):
    stream.add("a")
    stream.run()
    assert glob.glob(f"{stream.checkpoint}/state/0/*/*.changelog")


def test_many_seeds(stream, monkeypatch):
    monkeypatch.setattr(scope, "_listed", lambda *a: None)
    stream.add("a", "b")
    stream.add("b", "c")
    assert [u for _, u in stream.run()] == ["", "a.js", "b.js", "c.js"]


def test_clock_that_goes_back(spark, stream):
    stream.add("a", "b")
    stream.run()
    ahead = spark.read.parquet(f"{stream.out}/batch=0").withColumn("seen_at", F.col("seen_at") + F.expr("INTERVAL 1 DAY"))
    rows = ahead.collect()
    spark.createDataFrame(rows, ahead.schema).write.mode("overwrite").parquet(f"{stream.out}/batch=0")
    # As a batch would write it that takes old addresses for new ones.
    stream.add("b", "c")
    assert [u for _, u in stream.run()] == ["", "a.js", "b.js", "c.js"]


def test_known_addresses_are_left_out_where_times_do_not_tell(spark):
    fresh = spark.createDataFrame([("u",), ("v",)], "resource_url string")
    seen = spark.createDataFrame([("v", 1), ("w", 2)], "resource_url string, batch int")
    assert [r.resource_url for r in incremental.unseen(fresh, seen).collect()] == ["u"]


def test_repeats_are_combined_before_the_shuffle(spark, mini_rules, tmp_path):
    """One walk over the pages, a partial aggregate, and no other state than the addresses."""
    spark.createDataFrame([(1, HERE, "<script src=/a.js></script>")], schemas.PAGES).write.parquet(str(tmp_path / "in"))
    seeds = spark.createDataFrame([("x.com", "x")], "domain string, label string")
    pages = spark.readStream.schema(schemas.PAGES).parquet(str(tmp_path / "in"))
    query = incremental.new_resources(pages, seeds, mini_rules).writeStream.format("noop").outputMode("update").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan
    assert plan.count("StateStoreSave") == 1 and plan.count("FileScan parquet") - plan.count("suffix") <= 1
    exchange, partial = plan.index("Exchange hashpartitioning(resource_url"), plan.index("partial_min(now")
    assert exchange < partial
