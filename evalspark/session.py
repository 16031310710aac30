"""Where work files go, and the session used by tests and the bench."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=None)
def _laptop_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="evalspark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may go without it; a cluster must name one, because a
    folder on one machine is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _laptop_dir(spark.sparkContext.applicationId)


_run: contextvars.ContextVar[str] = contextvars.ContextVar("run", default="")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/evalspark/{_run.get()}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """Within it, all staged tables lie in one folder, which is removed at the end.

    Results that are needed longer must be written elsewhere before it ends.
    """
    name = f"run-{uuid.uuid4().hex}/"
    before = _run.set(name)
    try:
        yield
    finally:
        _run.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/evalspark/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the table that needed them is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Used for results read more than once (vocabularies, answers, clusterings). The written table
    survives lost executors, cuts the lineage, and gives the planner a true size, so Spark
    broadcasts it in a later join only when it is really small. A ``path`` made by ``new_path`` outside
    a run folder lets the table outlive the folder.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = 8, app: str = "evalspark") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings a session of their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
