"""Session defaults and reliable cutting of lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "wardline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; settings of an existing session stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a session without it a temporary one.

    The temporary folder is for local sessions such as tests; a session on a cluster must name its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"wardline-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_kept: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        _remove(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again.

    The lineage ends there, so that a lost executor costs its running tasks only. Unlike checkpoint() the table is
    columnar and compressed, and later reads prune columns. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wardline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes the table of a settled df that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        for entry in [e for e in _kept if path.endswith(e[1].removeprefix("file://"))]:
            _remove(*entry)
            _kept.remove(entry)
