"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType

from adloom.llm.common import SPACE, ascii_lower, release, shared_table, ship, text_of

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def line_hash(key: Column) -> Column:
    """128 bits as two independently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


@pandas_udf(ArrayType(BooleanType()))
def among(values: pd.Series, wanted: pd.Series) -> pd.Series:
    """Which of an array's values another array of the row has; null where there is none. Sorts, so its time is nearly in
    proportion to both arrays."""
    return pd.Series([None if w is None or v is None else np.isin(v, w) for v, w in zip(values, wanted, strict=True)], dtype=object)


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, last_doc) in levels, like a log-structured merge tree.

    A new batch is anti-joined with the runs: only keys that no run knows become the batch's own run, so a key is in one run
    alone and runs are compacted by a merge without any aggregation: when a level holds `fan_in` batches, they are one run of
    the next level. What a batch says of keys already known is a change (n_docs, last_doc), kept apart and added up once by
    index(). Every run is a sorted table in the shared folder, so a lost executor costs a re-read.
    """

    def __init__(self, fan_in: int = 2):
        self.fan_in, self.levels, self.changes = fan_in, {}, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for run in level]

    def _store(self, level: int, run: DataFrame) -> None:
        self.levels.setdefault(level, []).append(shared_table(run.sortWithinPartitions(*KEY), f"run-{level}"))
        if len(self.levels[level]) >= self.fan_in:
            merged = self.levels.pop(level)
            self._store(level + 1, _union(merged).repartitionByRange(*KEY))
            release(*merged)

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, doc_id, each key at most once a document."""
        new = batch.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.levels:
            return self._store(0, new)
        new = shared_table(new, "batch")
        keys = _union([run.select(*KEY) for run in self.runs()])
        self.changes.append(shared_table(new.join(keys, KEY, "left_semi"), "changes"))
        self._store(0, new.join(keys, KEY, "left_anti"))
        release(new)

    def index(self) -> DataFrame:
        """h1, h2, n_docs, last_doc of all keys, one row each."""
        runs = _union(self.runs())
        if not self.changes:
            return runs
        more = _union(self.changes).groupBy(*KEY).agg(F.sum("n_docs").alias("more_docs"), F.max("last_doc").alias("more_last"))
        return runs.join(more, KEY, "left").select(
            *KEY, (F.col("n_docs") + F.coalesce("more_docs", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "more_last").alias("last_doc")
        )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Lines whose key has at least `min_chars` code points and is found in at least `min_docs` documents are dropped from
    all documents but the one with the largest doc_id. Documents arrive in `batches` batches by a hash of their id.
    Per document a key counts once and only keys are shuffled; a frequent line is reduced to one row per task before
    any merge, and its way back to the documents is a plain join that adaptive execution can split. A document's lines are
    looked up among its drops in one sorted pass, so a text of many lines and many drops takes no more than both.

    Null or empty text is one empty line. Rows are documents: rows that repeat a doc_id count separately and all rows
    with the largest id keep the line. A null doc_id is below every other. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    lines = F.split(text_of(), "\n", -1)
    keys = F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars)
    held = shared_table(
        docs.select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"),
            F.inline(F.transform(F.array_distinct(keys), line_hash)),
        ),
        "lines",
    )
    runs = LineRuns(fan_in)
    for b in range(batches):
        runs.add(held.where(F.col("batch") == b))
    # stored, so that the join below starts from plain exchanges and a hot line's rows can be split
    common = shared_table(runs.index().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "common-lines")
    drops = (
        held.join(common, KEY)
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy(F.col("doc_id").alias("drop_id"))
        .agg(F.collect_set("h2").alias("drops"))
    )
    rows = docs.select("doc_id", F.col("text").alias("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left"
    )

    def mark(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, line_hash(key)["h2"]).otherwise(0)

    # only documents that lose a line are looked at
    rows = rows.withColumn("gone", among(F.when(F.col("drops").isNotNull(), F.transform(lines, mark)), F.col("drops")))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(F.filter(lines, lambda line, i: ~F.get("gone", i)))
    return rows.select("doc_id", lines.alias("lines"), kept.alias("kept")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
