"""Tables, shared scratch storage and small column helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One word: a maximal run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._gridloom_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete tables made by store() that no later result reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(seed: int, *cols: Column) -> Column:
    """A reproducible uniform number in [0, 1) from column values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (column names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(keep: Iterable[str]) -> Column:
    """The columns keep in one struct, row: within it no name clashes with what an operator adds."""
    keep = list(keep)
    return F.struct(*[named(c) for c in keep], *([] if keep else [F.lit(True).alias("none")])).alias("row")


def unpacked(keep: Iterable[str], made: Iterable[str]) -> list[Column]:
    """The columns that carried() holds; those named like one of made give way to it."""
    taken = {c.lower() for c in made}
    return [F.col("row")[c].alias(c) for c in keep if c.lower() not in taken]


def read_texts(docs: DataFrame, keep: Iterable[str], text: str, work: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], made: str) -> DataFrame:
    """row, then the columns made (a DDL string), by work over Arrow batches of row, text."""
    kept = docs.select(carried(keep), named(text).cast("string").alias("text"))
    return kept.mapInArrow(work, StructType([kept.schema["row"], *StructType.fromDDL(made).fields]))
