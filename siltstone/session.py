"""A session with the settings that the library counts on, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_SPLIT = 4 << 20  # bytes for which a task of its own is worth starting
_left: list[str] = []


def session(master: str = "local[*]", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; options are further settings."""
    builder = SparkSession.builder.master(master).appName("siltstone")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in (settings | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where the planner takes it for a small table: such a table often has
    one row group, and rows that are costly to work on would wait for one task. Rows are the same
    either way, and nothing is run to decide."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SPLIT else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir, else the
    folder given to setCheckpointDir. Only a session in one process may do without either; a folder
    of this machine then stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"siltstone-{os.getuid()}")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no lineage behind it. The table
    is deleted when the program ends, or by discard(). Options are those of the writer."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame | None) -> None:
    """Deletes the table behind a DataFrame of written(), which nothing reads any more."""
    path = getattr(df, "_siltstone_path", None)
    if path in _left:
        _left.remove(path)
        _delete(df.sparkSession, path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession() if _left else None
    for path in _left if spark else ():
        try:
            _delete(spark, path)
        except Exception:  # the session ended first: its folder is the cluster's to clear
            return
