"""Intermediate tables: results that several later plans read are written once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when the query has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; where it is unset, a new temporary folder (local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-adloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: plans that use it don't compute it again, and lost
    executors lose nothing. Shuffle files behind it go with the query. Removed by dropped(), or when the driver's file system closes."""
    return stored_parts([df], label)


def stored_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """The rows of all parts (one at least, of one schema) as one table. A part is written before the next is asked for, so
    that shuffle files of one part only are on disk at a time."""
    return _written(parts, label)[0]


def stored_slices(parts: Iterable[DataFrame], label: str, key: str, n: int) -> list[DataFrame]:
    """The rows of all parts as n tables, by a hash of the key; equal keys are in one table. Written part by part."""
    return _written(parts, label, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), n)


def _written(parts: Iterable[DataFrame], label: str, cell=None, n: int = 1) -> list[DataFrame]:
    path, schema = "", None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/adloom/{label}-{uuid.uuid4().hex}"
        before = spark.conf.get(SHUFFLES_GO, "false")
        spark.conf.set(SHUFFLES_GO, "true")
        rows = df.write if cell is None else df.withColumn("cell", cell).write.partitionBy("cell")
        try:
            rows.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(SHUFFLES_GO, before)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    found = []
    for at in [path] if cell is None else [f"{path}/cell={i}" for i in range(n)]:
        files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at))  # a slice may have no rows
        table = spark.read.schema(schema).parquet(at)
        table._stored_path = at
        found.append(table)
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes tables of stored() that no later plan reads."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
