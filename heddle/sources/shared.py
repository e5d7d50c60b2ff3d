"""Tables cut from their lineage, in the folder that all executors share.

They lie under the application's id, are dropped one by one when nothing reads
them any more, and together by ``cleared``, at the latest when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from heddle.errors import EngineError

KEY = "spark.checkpoint.dir"
#: For a write: Spark removes its shuffle files when it has ended, and writes a few folders at once without a sort.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Where it names none: a new one if all runs in one process, as in tests, else an error."""
    named = spark.conf.get(KEY, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise EngineError(f"{KEY} is not set, so there is no folder that all executors share", f"set {KEY} to one")
        own = tempfile.mkdtemp(prefix="heddle-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set(KEY, named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in a folder for each value of ``by`` if that is given.

    A lost executor costs none of it. The write's shuffle files go when it has ended.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _at_end(spark)
    writer = df.write.option("compression", "zstd")
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(table: DataFrame, part: str = "") -> None:
    """Delete a table that ``written`` returned, or one of its folders, as in ``kind=2``."""
    delete(table.sparkSession, f"{_paths[table]}/{part}")


def cleared(spark: SparkSession) -> None:
    """Delete all tables that the application has written; call it when no result that reads them is needed any more."""
    delete(spark, own_dir(spark))


_ends: set[str] = set()


def _at_end(spark: SparkSession) -> None:
    if (own := spark.sparkContext.applicationId) not in _ends:
        _ends.add(own)

        def end() -> None:
            now = SparkSession.getActiveSession()
            if now is not None and now.sparkContext._jsc is not None and now.sparkContext.applicationId == own:
                # the session may end at the same time
                with contextlib.suppress(Exception):
                    cleared(now)

        atexit.register(end)
