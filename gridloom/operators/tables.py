"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode, where none is set, a new one."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new table in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", large: bool = False) -> DataFrame:
    """df, written to the shared folder and read again. large: its values may take megabytes, so the writer looks at its buffers after each row, not
    after a hundred."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if large:
        writer = writer.options(**{"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.enable.dictionary": "false"})
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def shuffles(spark: SparkSession) -> int:
    """The session's number of shuffle partitions. Rows dealt to so many by name are not gathered to fewer tasks for being few bytes, as adaptive
    plans else do; where a row takes long, these would leave all work to one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doubles(values: Iterable[float]) -> Column:
    """An array literal of numbers, however many: one expression of text, not one for each number."""
    texts = [f"{v!r}D" if abs(v) < float("inf") else f"double('{v}')" for v in map(float, values)]
    return F.expr(f"array({', '.join(texts)})") if texts else F.array().cast("array<double>")
