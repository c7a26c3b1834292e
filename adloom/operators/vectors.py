"""Exact top-k inner products over clustered vectors: bounds skip whole clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.sources.stored import stored

#: Added to bounds: scores are rounded to six places.
SLACK = 2e-6
#: Vectors that the driver sees for each centre.
SAMPLED = 16


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.float32).astype(np.float64)


def chosen_centres(sample: np.ndarray, clusters: int, rounds: int = 3) -> np.ndarray:
    """Centres of a bounded sample: each next one is the point farthest from those before, then they move to the means of
    their points a few times."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(clusters, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    centres = sample[picked]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def cluster_vectors(vectors: DataFrame, clusters: int = 256, chunk_rows: int = 16_384) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """The vectors (id, embedding) with their cluster and chunk, stored; the centres; and per cluster its number of rows, radius
    and number of chunks.

    Up to `clusters` centres come from SAMPLED vectors for each, first by a hash of their id; a vector belongs to the
    nearest centre. Large clusters are cut into chunks, so one cluster may hold any share of the rows. The sample bounds
    what the driver gets; only the number of skipped pairs depends on it.
    """
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(clusters * SAMPLED).select("embedding").toPandas()
    centres = chosen_centres(_matrix(first["embedding"]), clusters) if len(first) else np.zeros((1, 1))
    squares = (centres**2).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["embedding"])
                far = squares - 2 * x @ centres.T
                own = far.argmin(1)
                distance = np.sqrt(((x - centres[own]) ** 2).sum(1))
                yield pa.record_batch([batch["id"], batch["embedding"], pa.array(own.astype(np.int32)), pa.array(distance)], names=["id", "embedding", "cluster", "distance"])

    dealt = stored(vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(assign, "id long, embedding array<float>, cluster int, distance double"), "clustered")
    about = dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).toPandas()  # one row a cluster
    about["chunks"] = -(-about["n"] // chunk_rows)
    sizes = dealt.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(about["cluster"], about["chunks"], strict=True)], "cluster int, chunks int")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    return dealt.join(F.broadcast(sizes), "cluster").select("cluster", chunk.alias("chunk"), "id", "embedding"), centres, about


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, clusters: int = 256, chunk_rows: int = 16_384, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(query_id, pos, id, score), the k highest inner products, lower ids first of equals; and one row (n_read, n_pairs): how
    many pairs of a query and a vector were scored, of how many. Both tables are (id, embedding), ids unique, no nulls.

    A vector's product with a query is at most the centre's plus the query's length times the radius. A query first reads
    the clusters with the highest bounds, until they hold k vectors; then every other cluster whose bound reaches the
    k-th best so far. Clusters below it are never met, so the result is exact.
    """
    dealt, centres, about = cluster_vectors(vectors, clusters, chunk_rows)
    about = about.sort_values("cluster")
    ids, counts, radii = about["cluster"].to_numpy(np.int64), about["n"].to_numpy(np.int64), about["radius"].to_numpy(np.float64)
    chunks = about["chunks"].to_numpy(np.int64)
    own = centres[ids] if len(ids) else centres[:0]
    asked = stored(queries.select(F.col("id").cast("long").alias("query_id"), "embedding"), "asked")
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // block_rows))

    def plan(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                q = _matrix(batch["embedding"])
                bound = q @ own.T + np.sqrt((q**2).sum(1))[:, None] * radii * (1 + 1e-9) + SLACK
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1) - counts[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, held < k, axis=1)
                wanted = first
                if later:
                    reached = np.array(batch["reached"].to_pylist(), dtype=np.float64)  # null: fewer than k vectors
                    wanted = ~first & (np.isnan(reached)[:, None] | (bound >= np.nan_to_num(reached)[:, None]))
                row, which = np.nonzero(wanted)
                at = np.repeat(np.arange(len(row)), chunks[which])
                chunk = np.arange(len(at)) - np.repeat(np.cumsum(chunks[which]) - chunks[which], chunks[which])
                rows = pa.array(row[at])
                yield pa.record_batch(
                    [batch["query_id"].take(rows), batch["embedding"].take(rows), pa.array(ids[which[at]].astype(np.int32)), pa.array(chunk.astype(np.int32))],
                    names=["query_id", "embedding", "cluster", "chunk"],
                )

        return run

    def near(ours: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if ours.empty or held.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        names, others = ours["query_id"].to_numpy(), held["id"].to_numpy()
        score = np.round(_matrix(ours["embedding"]) @ _matrix(held["embedding"]).T, 6)
        order = np.lexsort((np.broadcast_to(others, score.shape), -score), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(names)), order.shape[1])
        return pd.DataFrame({"query_id": names[rows], "id": others[order.ravel()], "score": score[rows, order.ravel()]})

    fields = "query_id long, embedding array<float>, cluster int, chunk int"
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def searched(wanted: DataFrame) -> DataFrame:
        wanted = wanted.withColumn("block", block)
        # a chunk is copied to the query blocks that ask for it, and to no other
        places = wanted.select("cluster", "chunk", F.col("block").alias("place")).distinct()
        met = dealt.join(places, ["cluster", "chunk"])
        found = wanted.groupBy("cluster", "chunk", "block").cogroup(met.groupBy("cluster", "chunk", "place")).applyInPandas(near, "query_id long, id long, score double")
        return found.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k)

    begun = stored(asked.mapInArrow(plan(False), fields), "first-clusters")
    seen = stored(searched(begun), "first-found")
    reached = seen.where(F.col("pos") == k).select("query_id", F.col("score").alias("reached"))
    rest = stored(asked.join(reached, "query_id", "left").select("query_id", "embedding", "reached").mapInArrow(plan(True), fields), "more-clusters")
    best = seen.drop("pos").unionByName(searched(rest).drop("pos")).withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k)
    sizes = dealt.groupBy("cluster", "chunk").agg(F.count("*").alias("n"))
    read = begun.unionByName(rest).groupBy("cluster", "chunk").agg(F.count("*").alias("asked")).join(sizes, ["cluster", "chunk"])
    share = read.agg(F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0)).alias("n_read")).withColumn("n_pairs", F.lit(n_queries * int(counts.sum())))
    return best.select("query_id", "pos", "id", "score"), share


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, **sizes: int) -> DataFrame:
    return dense_search(queries, vectors, k, **sizes)[0]
