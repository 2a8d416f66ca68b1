"""Incremental scan: each run takes the pages that arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from secretsift import schemas
from secretsift.operators.prioritize import resource_tier, tier_name
from secretsift.plans.scan import resource_scan
from secretsift.session import REFERENCE, cut_lineage
from secretsift.sources.suffixes import SuffixRules

NEW_RESOURCES = "resource_url string, tier string, batch long"
_WRITTEN = "resource_url string, tier string, seen_at timestamp"
# Seen addresses are kept in RocksDB on the executors' disks; only changes go to the checkpoint folder.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def new_resources(
    pages: DataFrame, seeds: DataFrame, rules: SuffixRules, semantics: str = REFERENCE
) -> DataFrame:
    """Addresses in scope that a stream of pages names for the first time: ``resource_url, tier, seen_at``.

    The state holds the time of each address's first batch. A batch's repeats are combined before the
    shuffle, so an address that most pages name is no hot key, and each task looks up only
    the addresses that the batch brings it. Addresses met again come out with an earlier time and are dropped.
    """
    found = resource_scan(pages, seeds, rules, semantics, each_seed=False)
    met = found.select("resource_url", F.current_timestamp().alias("now")).groupBy("resource_url").agg(
        F.min("now").alias("seen_at"))
    fresh = met.withColumn("now", F.current_timestamp()).where("seen_at = now")
    return fresh.select("resource_url", tier_name(resource_tier(F.col("resource_url"), semantics)).alias("tier"), "seen_at")


def unseen(fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose address is not in ``seen``.

    The table of seen addresses is large and a batch is not: the table is first
    reduced to the batch's addresses, for which Spark can send a small batch to
    the table's partitions instead of shuffling the table.
    """
    known = seen.select("resource_url").join(fresh, "resource_url", "left_semi")
    return fresh.join(known, "resource_url", "left_anti")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_incremental(
    spark: SparkSession,
    source: str,
    target: str,
    state: str,
    seeds: DataFrame,
    rules: SuffixRules,
    semantics: str = REFERENCE,
    files_per_batch: int | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda pages: pages,
) -> DataFrame:
    """Process what is new under ``source`` and add it to the table at ``target``.

    ``prepare`` is applied to the stream of pages first, for example to unpack
    JSON answers, row by row. ``state`` is the stream's checkpoint folder; source, target and state have to
    be on shared storage. Pages are walked once; a batch reads the state of its own addresses and nothing of
    the table's addresses, only the times it was written at. It writes a folder of its own and
    replaces that folder if it has to run again, with the time of its first attempt, so a restart neither loses nor
    repeats an address. Should the driver's clock have gone back since an earlier batch, times can't tell what is new:
    such a batch is compared with the table. Returns the table so far.
    """
    spark.createDataFrame([], _WRITTEN).write.mode("overwrite").parquet(f"{target}/batch=-1")

    def add(fresh: DataFrame, batch: int) -> None:
        session, path = fresh.sparkSession, f"{target}/batch={batch}"
        fresh.write.mode("overwrite").parquet(path)
        table = session.read.schema(f"{_WRITTEN}, batch long").parquet(target)
        latest = F.max("seen_at").alias("t")
        before = table.where(F.col("batch") < batch).agg(latest).first().t
        written = session.read.schema(_WRITTEN).parquet(path)
        now = written.agg(latest).first().t
        if before is not None and now is not None and now <= before:
            kept = cut_lineage(unseen(written, table.where(F.col("batch") < batch)))
            kept.write.mode("overwrite").parquet(path)

    with _settings(spark, _STORE):
        reader = spark.readStream.schema(schemas.PAGES)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (
            new_resources(prepare(reader.parquet(source)), seeds, rules, semantics)
            .writeStream.foreachBatch(add)
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(NEW_RESOURCES).parquet(target)
