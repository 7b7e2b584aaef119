"""Session settings and the one place that writes intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "ridespark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session (`spark.checkpoint.dir`).

    A temporary one is made for local masters only.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_scopes: list[list[str]] = []


def note_table(path: str) -> None:
    """Tell the innermost open `noted_tables` of an intermediate table."""
    if _scopes:
        _scopes[-1].append(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def noted_tables() -> Iterator[list[str]]:
    """Collects the places of the intermediate tables that are written inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def freeze(df: DataFrame) -> DataFrame:
    """Write `df` once, as Parquet below the checkpoint folder, and read it from there.

    Used where a later step depends on how rows were laid out, where several steps read the same
    rows, and where a loop would otherwise grow its lineage. The plan runs once, its rows have a
    known size, and a lost executor costs its running tasks only.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/frozen-{uuid.uuid4().hex}"
    df.write.parquet(path)
    note_table(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
