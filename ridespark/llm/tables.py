"""Intermediate tables in the folder that all executors share, and unused column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder, note_table


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet below `spark.checkpoint.dir` (or to `path`) and read it from there.

    Cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    note_table(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def refuse(df: DataFrame, *names: str) -> None:
    """An output column may not take the name of one that is there."""
    taken = {c.lower() for c in df.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"the table has the columns {clash}; choose other names")
