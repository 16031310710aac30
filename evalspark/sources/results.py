"""Result tables on storage: every save commits a new whole version; the newest committed one is read.

A version is written under a hidden name and becomes visible by one rename of its folder, which fails if another saver
has taken the number; the loser then merges into the version that won, and tries again. Readers list committed folders, so a
version that is half written, or left behind by a driver that died, is never seen. The file system must rename
folders atomically, as HDFS and POSIX file systems do.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from evalspark.operators.report import RESULT, in_report_order, upsert_results

ATTEMPTS = 100


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the newest committed version."""
    folder, files = _folder(spark, path)
    if not _exists(spark, path):
        return None
    names = (re.fullmatch(r"version=(\d+)", s.getPath().getName()) for s in files.listStatus(folder))
    return max((int(n[1]) for n in names if n), default=None)


def _read(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(f"{path}/version={version}")


def load_results(spark: SparkSession, path: str, tasks: Sequence[str] = ()) -> DataFrame:
    """The newest version of the results, empty when there is none; sorted for a report when ``tasks`` names an order."""
    found = _read(spark, path, newest_version(spark, path))
    return in_report_order(found, tasks) if tasks else found


def _commit(spark: SparkSession, written: str, target: str) -> bool:
    """Give a written folder its name; False if that is taken."""
    source, files = _folder(spark, written)
    if files.getScheme() == "file":  # Hadoop's local rename copies into a folder that exists
        try:
            os.rename(source.toUri().getPath(), _folder(spark, target)[0].toUri().getPath())
            return True
        except OSError:
            if _exists(spark, target):
                return False
            raise
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(
            files.makeQualified(source), files.makeQualified(_folder(spark, target)[0]), options)
        return True
    except Py4JJavaError:
        if _exists(spark, target):
            return False
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def save_results(new: DataFrame, path: str) -> int:
    """Merge ``new`` into the newest version and commit the merge as the next one; savers can run at the same time."""
    spark = new.sparkSession
    for _ in range(ATTEMPTS):
        newest = newest_version(spark, path)
        version = 0 if newest is None else newest + 1
        pending = f"{path}/_pending-{uuid.uuid4().hex}"
        upsert_results(_read(spark, path, newest), new).write.parquet(pending)
        if _commit(spark, pending, f"{path}/version={version}"):
            return version
        folder, files = _folder(spark, pending)
        files.delete(folder, True)
    raise RuntimeError(f"no version of {path} could be committed in {ATTEMPTS} attempts")
