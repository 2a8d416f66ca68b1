"""Session settings, semantics switch and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REFERENCE = "reference"
INTENDED = "intended"


def check_semantics(semantics: str) -> str:
    """Return ``semantics`` if it is one of the two supported modes."""
    if semantics not in (REFERENCE, INTENDED):
        raise ValueError(f"semantics must be {REFERENCE!r} or {INTENDED!r}, not {semantics!r}")
    return semantics


def local_session(cores: str = "8", app: str = "secretsift", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Call sites of column expressions are only kept for error messages; noting
        # them takes longer than the small local jobs themselves.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def work_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and streaming state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session with
    nothing configured gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="secretsift-")


def new_work_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that no other run uses."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the work folder and read it back.

    For a result that several later branches read: each of them then scans a
    table that outlives lost executors instead of repeating the work behind it.
    """
    spark = df.sparkSession
    path = new_work_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
