"""Metrics of copies and of retrieval runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback_rate(rows: DataFrame, by: str, flag: str = "fallback") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")), 4).alias("fallback_rate"))


def evidence_coverage(rows: DataFrame, by: str, copy: str, fields: tuple[str, ...]) -> DataFrame:
    """Per group and field: rows that have the field, and the share of them whose copy contains it."""
    def share(field: str) -> list[Column]:
        there = F.coalesce(F.col(field), F.lit("")) != ""
        hit = there & F.contains(F.col(copy), F.col(field))
        return [F.sum(there.cast("int")).alias(f"n_{field}"), F.round(F.sum(hit.cast("int")) / F.nullif(F.sum(there.cast("int")), F.lit(0)), 4).alias(f"covers_{field}")]

    return rows.groupBy(by).agg(*[c for f in fields for c in share(f)])


def distinct_n(rows: DataFrame, by: str, text: str, n: int = 2) -> DataFrame:
    """Distinct character n-grams over all n-grams, per group. Counts per n-gram come first, so no group meets in one task."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substr(F.col(text), i, F.lit(n)))
    long = rows.where(F.char_length(text) >= n).select(by, F.explode(grams).alias("gram"))
    per = long.groupBy(by, "gram").agg(F.count("*").alias("c"))
    return per.groupBy(by).agg(F.count("*").alias("distinct_grams"), F.sum("c").alias("grams"), F.round(F.count("*") / F.sum("c"), 6).alias("ratio"))


def recall_at_k(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """One row: queries with relevant documents, and mean recall at each cutoff. run (query_id, doc_id, pos); qrels
    (query_id, doc_id, relevance). A query without any hit counts as 0."""
    wanted = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    met = wanted.join(run.select("query_id", "doc_id", "pos"), ["query_id", "doc_id"], "left")
    per = met.groupBy("query_id").agg(*[(F.sum((F.col("pos") <= k).cast("int")) / F.count("*")).alias(f"r{k}") for k in cutoffs])
    return per.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(F.coalesce(f"r{k}", F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in cutoffs])
