"""Readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines of a DDL schema. A byte-order mark and blank lines are ignored; malformed lines are dropped, or fail the job if strict.

    keep_corrupt keeps malformed lines in the column `_corrupt`, so that they can be counted.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if keep_corrupt:
        return rows
    # Spark refuses a query that needs nothing but the corrupt column, as a plain count would be; so a field is looked at too
    read = F.coalesce(F.col(rows.columns[0]).cast("string"), F.lit("")) != "\x00"
    return rows.where(F.col(CORRUPT).isNull() & read).drop(CORRUPT)


def read_jsonl_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """The rows of tolerant read_jsonl() and their counts (n_lines, n_malformed), ready when the rows have been read: no second
    scan. Blank lines are no lines."""
    rows = read_jsonl(spark, path, schema, keep_corrupt=True)
    seen = Observation(f"lines-{uuid.uuid4().hex}")
    bad = F.col(CORRUPT).isNotNull()
    # every field is read, so that the parser's verdict is the same as for the rows
    read = F.to_json(F.struct(*[c for c in rows.columns if c != CORRUPT])) != "\x00"
    counted = rows.where(read | bad).observe(seen, F.count("*").alias("n_lines"), F.count_if(bad).alias("n_malformed"))
    return counted.where(~bad).drop(CORRUPT), seen


def with_file_order(rows: DataFrame) -> DataFrame:
    """Adds `seq`, which sorts rows in file order. Must be applied to a fresh read."""
    return rows.withColumn(
        "seq",
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, text string").csv(path, sep="\t", quote="")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, doc_id string, relevance int").csv(path, sep="\t", quote="")


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id") -> DataFrame:
    """id and vector; the vector stays float."""
    return spark.read.parquet(path).select(F.col(id_col).cast("bigint").alias("id"), "embedding")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """The batches of append_batch() that are whole: those whose manifest was written to its end."""
    files, _ = _files(spark, path)
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS"))
    return sorted(x.getPath().getParent().getName() for x in found or [])


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the batches that are whole."""
    paths = [f"{path}/rows/{name}" for name in committed_batches(spark, path)]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def append_batch(rows: DataFrame, path: str, batch: str, key: str = "query", order: str | None = None) -> int:
    """Adds the rows whose key no whole batch has, one a key (the first in `order`, if given), as JSON lines; returns how many.

    A batch is written in two steps: its rows, then a manifest with their keys. Only the manifest's end makes the batch
    count, so a run that is cut off leaves nothing that a reader sees. The same batch again replaces what there is of it
    and gives the same rows; another batch with the same rows adds none.
    """
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without a slash")
    spark = rows.sparkSession
    others = [name for name in committed_batches(spark, path) if name != batch]
    fresh = rows.where(F.col(key).isNotNull())
    if others:
        known = spark.read.parquet(*[f"{path}/manifest/{name}" for name in others]).select(F.col("key").alias(key))
        fresh = fresh.join(known, key, "left_anti")
    kept = F.struct(*[c for c in rows.columns if c != key])
    first = F.min_by(kept, F.col(order)) if order else F.min(kept)
    fresh = fresh.groupBy(key).agg(first.alias("kept")).select(key, "kept.*").select(rows.columns)
    files, manifest = _files(spark, f"{path}/manifest/{batch}")
    files.delete(manifest, True)
    fresh.write.mode("overwrite").json(f"{path}/rows/{batch}")
    written = spark.read.schema(rows.schema).json(f"{path}/rows/{batch}")
    written.select(F.col(key).alias("key")).write.mode("overwrite").parquet(f"{path}/manifest/{batch}")
    return spark.read.parquet(f"{path}/manifest/{batch}").count()
