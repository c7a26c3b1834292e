"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import SPACE, shared_table, text_of

KEY = ["digest", "norm_bytes", "check"]


def run_after(run: Column, check: Column, step: int, fan_in: int) -> Column:
    """The run that takes an entry in the round of this step: its own number with one digit set to the key's."""
    # a quotient is a double: 40 bits of the hash keep it exact
    digit = lambda x: F.pmod(F.floor(x / step), F.lit(fan_in))
    return (run + (digit(F.pmod(check, F.lit(1 << 40))) - digit(run)) * step).cast("long")


def exact_dedup(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after deleting ASCII white space. Of equal texts the row with the most code points
    stays, then the smallest doc_id. Every partition of the table is a run. Runs are numbered in digits of base
    `fan_in`; in round r the `fan_in` runs that differ in digit r only are partners, and each hands every other partner
    the entries whose key has that partner's digit there. A merge sorts what came in and keeps per key only the best row
    and a count, so a text that fills a third of the table is one entry a run before anything moves, and the number of
    entries of a key falls by `fan_in` each round. After the last round every digit is the key's own: a key's entries
    have met in one run, and no run ever held more than its share of the keys. The number of runs, and so of rounds,
    follows from the table's partitions. The identity of a merge key is verified: besides the SHA-256 it holds the
    normalised length and a second hash.

    Null text counts as empty and all empty texts are one group. A null doc_id loses to any other id; if every id of
    a group is null, keep_id is null. Rows that repeat both id and text cannot be told apart and share one verdict.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = text_of()
    norm = F.translate(text, SPACE, "")
    digests = shared_table(
        docs.select(
            "doc_id",
            F.char_length(text).alias("n_chars"),
            F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.octet_length(norm).alias("norm_bytes"),
            F.xxhash64(norm).alias("check"),
            F.spark_partition_id().cast("long").alias("run"),
        ),
        "digests",
    )
    parts = (digests.agg(F.max("run")).first()[0] or 0) + 1
    steps = [1]
    while steps[-1] * fan_in < parts:
        steps.append(steps[-1] * fan_in)
    # ~id falls as id grows and never overflows, so one maximum finds "longest, then smallest id"
    level = digests.select(*KEY, "run", F.struct("n_chars", F.bitwise_not("doc_id").alias("not_id")).alias("best"), F.lit(1).cast("long").alias("group_size"))
    for step in steps:
        level = level.withColumn("run", run_after(F.col("run"), F.col("check"), step, fan_in))
        if step > 1:
            # an entry stands once in its run already: nothing to combine before it moves, and whole runs meet in a task
            level = level.repartition("run")
        level = level.groupBy("run", *KEY).agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
    winners = level.select(*KEY, F.bitwise_not("best.not_id").alias("keep_id"), "group_size")
    # a plain join: adaptive execution splits the rows of a hot digest over tasks
    return digests.join(winners, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
