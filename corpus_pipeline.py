"""A training-corpus pipeline of five stages over `documents`.

quality -> near duplicates -> decontamination -> mixing -> sharding. Every stage works on all rows its predecessor kept;
all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.common import Scope, release, shared_table, table
from adloom.llm.decontaminate import contaminated
from adloom.llm.mixing import mix_sources
from adloom.llm.near_dup import jaccard_components
from adloom.llm.quality import fit, score_column
from adloom.llm.sharding import bounded_ring

CUT = 0.3
MIX_SEED = 42


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged as an empty one. Rows are judged one by one, so repeats share a verdict; a null id is never
    used for learning. Labels of one kind only, or none, reject nothing. An empty table stays empty; extra columns are
    kept, whatever their names.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), cut=CUT)
    return docs.where(score_column(F.col("text"), model) >= CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id stays.

    Documents without words link with nothing and stay. Rows that repeat an id stay or go together; rows without an id
    stay. An empty table stays empty; extra columns are kept, whatever their names.
    """
    found = jaccard_components(docs, n=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing. Rows that repeat an id go when one of them overlaps an item; rows without an
    id stay. Without items, or without documents, nothing changes; extra columns are kept, whatever their names.
    """
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, in proportion to the words the mix takes of them.

    Whole documents are kept: taken / size is rounded up or down by a seeded hash of the id, so a source's words come
    near its target. Documents without words or without an id stay once; rows that repeat an id share one number, from
    the words of all of them. An empty table stays empty; extra columns are kept, whatever their names.
    """
    even = F.pmod(F.xxhash64(F.lit(MIX_SEED), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + even)).otherwise(1).cast("int")
    taken = mix_sources(docs, seed=MIX_SEED).where("doc_id is not null").groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    # the row travels as one struct, so that no name of its columns can clash
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"))
    kept = whole.join(taken.select("doc_id", times.alias("times")), F.col("row_id") == F.col("doc_id"), "left")
    kept = kept.select("row", F.coalesce("times", F.lit(1)).alias("times")).where("times > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document that is left, repeats included.

    Null texts have no bytes; rows without an id are placed by their text. An empty table gives an empty result.
    """
    return bounded_ring(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Two stages hash and learn in ways that SQL does not have; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result replaces the one before; what a stage stored for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with Scope() as scope:
            docs = scope.keep(shared_table(stage(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
