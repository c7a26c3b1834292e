"""Hard negatives by exact integer scores: subset-sum tables of anchors, indexed by bytes of the candidates' bit planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.llm.common import shared_table, ship

#: Dimensions whose subset sums one table holds; its index is one byte.
GROUP = 8
#: Anchors and candidates of one task, on average, and anchors that are scored at once.
BLOCK, PART, TILE = 4096, 65_536, 32


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sum of an anchor's components over every subset of eight dimensions (bit 7 of the index is
    the first dimension). Missing dimensions at the end count as zero."""
    n, d = anchors.shape
    groups = -(-d // GROUP)
    padded = np.zeros((groups * GROUP, n), np.int64)
    padded[:d] = anchors.T
    tables = np.zeros((groups, 1 << GROUP, n), np.int64)
    for bit in range(GROUP):
        size = 1 << bit
        tables[:, size : 2 * size] = tables[:, :size] + padded.reshape(groups, GROUP, n)[:, GROUP - 1 - bit, None]
    return tables


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes x groups x rows: bytes of the bits of whole numbers in two's complement; the last plane is the sign."""
    n, d = values.shape
    groups = -(-d // GROUP)
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :d] = values
    planes = [np.packbits(((padded >> k) & 1).astype(np.uint8), axis=1).T for k in range(most.bit_length() + 1)]
    return np.array(planes).reshape(len(planes), groups, n)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows x anchors: exact inner products. A plane's looked-up sums are added over the groups; from the sign plane down,
    the total is shifted by one bit and the next plane added."""
    total = np.zeros((planes.shape[2], tables.shape[2]), np.int64)
    for k in range(len(planes) - 1, -1, -1):
        part = np.zeros(total.shape, tables.dtype)
        for table, index in zip(tables, planes[k], strict=True):
            part += table[index]
        total = (total << 1) + (-part if k == len(planes) - 1 else part)
    return total


def _checked(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Tables of 32-bit numbers where their sums fit. Scores that might not fit 64 bits are an error."""
    most = int(np.abs(tables).max(initial=0)) * max(1, len(tables))
    if most << len(planes) >= 1 << 62:
        raise ValueError("inner products of these components do not fit 64 bits")
    return tables.astype(np.int32) if most < 1 << 31 else tables


def _matrix(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for row, x in zip(out, values, strict=True):
        row[: len(x)] = x
    return out


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, value (floor of `scale` times each component, as array<long>) of the rows that take part, one a vec_id.

    Rows with a null vec_id, label, vector or component, or with a component that is not finite, go. Of rows that repeat a
    vec_id, the one with the smallest label, then vector stays.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    whole = rows.select("vec_id", F.struct("label", F.transform(wide, lambda x: F.floor(x * scale)).alias("value")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding (see whole_vectors for the rows that take part). A row's score is its inner product
    with the anchor in whole numbers; higher first, then smaller vec_id. The anchor's positives are its first
    `positives` other rows of its label. Each is paired with the first `negatives` rows of other labels whose score is
    between `low` and `high` percent of the positive's (a negative positive score leaves no such row). An anchor without
    another row of its label, and a pair without such a row, give nothing.

    Rows are packed once: parts of about `part` rows, as bit planes. Every block of about `block` anchors meets every part
    once for the positives (rows of the anchor's label only) and once for the negatives (the others only); a task keeps
    its first rows per anchor, windows merge them. Nothing is left out: the tables give full scores.

    The work is anchors x rows by definition; a label that many rows share changes nothing, as parts ignore labels. Vectors
    of different lengths count as padded with zeros. Components so large that a score could pass 62 bits are an error.
    An empty table, or no anchor, gives an empty result; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    stored = shared_table(whole_vectors(vectors).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    sizes = stored.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors"), F.max(F.size("value")).alias("width")).first()
    parts, blocks, width = max(1, -(-sizes["n"] // part)), max(1, -(-sizes["anchors"] // block)), max(1, sizes["width"] or 1)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        planes = bit_planes(_matrix(group["value"], width))
        return pd.DataFrame(
            {
                "part": group["part"].iloc[:1].to_numpy(), "planes": [planes.tobytes()], "depth": [len(planes)],
                "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "labels": [group["label"].to_numpy(np.int64).tobytes()],
            }
        )

    deal = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    packed = stored.select("vec_id", F.col("label").cast("long").alias("label"), "value", deal(parts, 1).alias("part")).groupBy("part")
    packed = shared_table(packed.applyInPandas(pack, "part int, planes binary, depth int, ids binary, labels binary"), "planes")
    anchors = stored.where("anchor").select("vec_id", F.col("label").cast("long").alias("label"), "value", deal(blocks, 2).alias("block"))
    dealt = packed.withColumn("block", every(blocks)).groupBy("block", "part")

    def opened(asked: pd.DataFrame, held: pd.DataFrame):
        """For every label of the block: its anchors, their tables in tiles, and the part's ids, labels and planes."""
        row = held.iloc[0]
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        planes = np.frombuffer(row["planes"], np.uint8).reshape(int(row["depth"]), -1, len(ids))
        for label, own in asked.sort_values("vec_id").groupby("label"):
            for at in range(0, len(own), TILE):
                tile = own.iloc[at : at + TILE]
                yield label, tile, _checked(subset_sums(_matrix(tile["value"], width)), planes), ids, labels, planes

    def near(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            for label, tile, tables, ids, labels, planes in opened(asked, held):
                same = np.flatnonzero(labels == label)
                found = scores(tables, planes[:, :, same])
                for column, anchor in enumerate(tile["vec_id"]):
                    score = found[:, column]
                    order = np.argsort(-score, kind="stable")[: positives + 1]
                    order = order[ids[same[order]] != anchor][:positives]
                    out.append(pd.DataFrame({"anchor_id": anchor, "positive_id": ids[same[order]], "positive_score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}).astype("int64")

    rows = "anchor_id long, positive_id long, positive_score long"
    pairs = anchors.withColumn("part", every(parts)).groupBy("block", "part").cogroup(dealt).applyInPandas(near, rows)
    by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= positives)
    wanted = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
    wanted = anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "value", "block", F.col("found.positive_id").alias("near_ids"), F.col("found.positive_score").alias("near_scores")
    )
    wanted = shared_table(wanted, "anchors")

    def hard(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            for label, tile, tables, ids, labels, planes in opened(asked, held):
                other = np.flatnonzero(labels != label)
                found = scores(tables, planes[:, :, other])
                for column, row in enumerate(tile.itertuples()):
                    near_scores = [int(x) for x in row.near_scores]
                    spans = [(-(-low * s // 100), high * s // 100) for s in near_scores]
                    score = found[:, column]
                    within = np.flatnonzero((score >= min(a for a, _ in spans)) & (score <= max(b for _, b in spans)))
                    within = within[np.argsort(-score[within], kind="stable")]
                    falling = -score[within]
                    for positive, own, (least, most) in zip(row.near_ids, near_scores, spans, strict=True):
                        first = int(np.searchsorted(falling, -most, "left"))
                        kept = within[first : min(first + negatives, int(np.searchsorted(falling, -least, "right")))]
                        if least <= most and len(kept):
                            out.append(pd.DataFrame({"anchor_id": row.vec_id, "positive_id": positive, "negative_id": ids[other[kept]], "positive_score": own, "negative_score": score[kept]}))
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names}).astype("int64")

    fields = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    hits = wanted.withColumn("part", every(parts)).groupBy("block", "part").cogroup(dealt).applyInPandas(hard, fields)
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
