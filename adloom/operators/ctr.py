"""Click-through examples: split, labels, id features, padded histories, vectors; and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.sources.stored import stored_parts

#: Bytes of vectors that go to every executor. Where there are more, numbers of vectors that are shuffled at a time, as long
#: as that takes no more rounds than MOST_ROUNDS.
SENT_BYTES, ROUND_VALUES, MOST_ROUNDS = 32 << 20, 1 << 26, 8

# Codes of genders and age buckets, and the codes of missing users.
GENDERS = {"M": 0, "F": 1}
AGES = {"0-11": 0, "12-17": 1, "18-23": 2, "24-30": 3, "31-40": 4, "41-49": 5, "50+": 6}
NO_GENDER, NO_AGE = 2, 9
CATEGORIES = ("category_level1_id", "category_level2_id", "category_level3_id")


def _marked(log: DataFrame, key: str, seed: int) -> DataFrame:
    return log.withColumn("mark", F.md5(F.concat_ws("|", F.lit(str(seed)), key))).withColumn("cell", F.substring("mark", 1, 3))


def split_limits(log: DataFrame, key: str = "seq", percent: int = 10, seed: int = 42) -> DataFrame:
    """One row: where the valid rows of split_examples() end. The cut is found without sorting the table: counts by the first
    hex digits give the bucket that holds it, and only that bucket is ranked."""
    pool = _marked(log, key, seed).where("split <> 'test'")
    sums = Window.partitionBy(F.lit(0)).orderBy("cell")
    counts = pool.groupBy("cell").agg(F.count("*").alias("n"))  # at most 4096 rows
    cells = counts.select(
        F.col("cell"),
        (F.sum("n").over(sums) - F.col("n")).alias("before"),
        "n",
        F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).cast("bigint").alias("wanted"),
    )
    inside = pool.join(F.broadcast(cells.where("before < wanted and before + n > wanted")), "cell")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("mark", key))
    border = inside.withColumn("rank", rank).where(F.col("rank") <= F.col("wanted") - F.col("before")).agg(F.max(F.struct("mark", key)).alias("last"))
    edge = cells.where("before + n <= wanted").agg(F.max("cell").alias("whole"))
    return edge.join(F.broadcast(border))


def split_examples(log: DataFrame, key: str = "seq", percent: int = 10, seed: int = 42, limits: DataFrame | None = None) -> DataFrame:
    """Adds part: test, valid or train. Exactly floor(percent of the non-test rows) are valid: those with the smallest
    md5 of seed and key. `limits` are those of the whole table if log is a share of it."""
    limits = F.broadcast(split_limits(log, key, percent, seed) if limits is None else limits)
    chosen = F.coalesce(F.col("cell") <= F.col("whole"), F.lit(False)) | F.coalesce(F.struct("mark", key) <= F.col("last"), F.lit(False))
    part = F.when(F.col("split") == "test", "test").when(chosen, "valid").otherwise("train")
    return _marked(log, key, seed).join(limits).withColumn("part", part).select(*log.columns, "part")


def ctr_label() -> Column:
    return F.when((F.col("is_clicked") == 1) | (F.col("is_purchased") == 1), 1.0).otherwise(0.0)


def _code(col: Column, codes: dict[str, int], missing: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.lit(missing))


def user_features(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Adds gender and age codes of the row's user; unknown users and values have the missing codes."""
    about = users.select("user_id", F.col("gender").alias("g"), F.col("age_bucket").alias("a"))
    return rows.join(about, "user_id", "left").select(
        *rows.columns, _code(F.coalesce("g", F.lit("")), GENDERS, NO_GENDER).alias("gender"), _code(F.coalesce("a", F.lit("")), AGES, NO_AGE).alias("age")
    )


def item_features(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Adds feature_item and the three category ids of the target item; an unknown item is all 0."""
    about = items.select("item_id", *CATEGORIES, F.lit(True).alias("known"))
    return rows.join(about, "item_id", "left").select(
        *rows.columns,
        F.when(F.col("known"), F.col("item_id")).otherwise(0).alias("feature_item"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in CATEGORIES],
    )


def history_features(histories: DataFrame, items: DataFrame, key: str, length: int = 20, ids: str = "recently_clicked_item_ids") -> DataFrame:
    """key and four arrays of `length`: item and category ids of the last clicks in order, 0 for unknown items and padding.

    One row per distinct history owner, so a user's history is exploded once and not per impression. Positions are
    regrouped into fixed slots by one aggregate; nothing unbounded is collected.
    """
    tail = F.slice(F.col(ids), F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
    size = F.least(F.coalesce(F.size(ids), F.lit(0)), F.lit(length))
    long = histories.where(F.col(ids).isNotNull()).select(key, F.posexplode(tail).alias("p", "item_id"), size.alias("n")).select(key, (F.col("p") + length - F.col("n")).alias("slot"), "item_id")
    about = items.select("item_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in CATEGORIES])
    known = long.join(about, "item_id").groupBy(key).agg(F.collect_list(F.struct("slot", "item_id", *CATEGORIES)).alias("found"))
    names = {"item_id": "hist_item", "category_level1_id": "hist_cat1", "category_level2_id": "hist_cat2", "category_level3_id": "hist_cat3"}
    by_slot = F.map_from_entries(F.transform("found", lambda x: F.struct(x["slot"], x)))
    slots = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.try_element_at(F.col("by_slot"), i))
    table = histories.select(key).join(known, key, "left").withColumn("by_slot", F.when(F.col("found").isNotNull(), by_slot)).withColumn("slots", slots)
    zero = F.lit(0).cast("bigint")

    def field(name: str) -> Column:
        filled = F.transform("slots", lambda x: F.coalesce(x[name], zero))
        return F.when(F.col("by_slot").isNull(), F.array_repeat(zero, length)).otherwise(filled)

    fields = [field(c).alias(n) for c, n in names.items()]
    return table.select(key, *fields)


def join_embeddings(rows: DataFrame, vectors: DataFrame, key: str, name: str, strict: bool = True) -> DataFrame:
    """Adds the vector of rows[key] as `name` from (id, embedding). strict: a missing vector fails the job."""
    out = rows.join(vectors.select(F.col("id").alias(key), F.col("embedding").alias(name)), key, "left")
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit(f"no vector for {key} "), F.col(key).cast("string"))).cast(out.schema[name].dataType)
    return out.withColumn(name, F.coalesce(F.col(name), missing))


def assemble_examples(log: DataFrame, users: DataFrame, items: DataFrame, history: DataFrame, limits: DataFrame | None = None, shown: tuple[Column, ...] = ()) -> DataFrame:
    """part, label, user, item and history features of every log row. The history table is keyed by user_id. For a share of
    the log's users, `limits` are split_limits() of the whole log. `shown`: columns made of a user's history features, instead
    of the features. Both joins by user follow the one by item, so that rows move once for each key."""
    rows = split_examples(log, limits=limits).withColumn("label", ctr_label())
    about = user_features(item_features(rows, items), users).select(*rows.columns, "gender", "age", "feature_item", *CATEGORIES)
    past = history_features(history, items, "user_id")
    return about.join(past.select("user_id", *shown) if shown else past, "user_id", "left")


def _pooled(met: DataFrame, key: str, dims: int, mean: bool) -> DataFrame:
    """key, pooled from rows (key, embedding, target): sums of a run of rows with one key in NumPy, several runs of a key add up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch[key].dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            values = wide(batch["embedding"])
            if not mean:
                values *= np.einsum("ij,ij->i", values, wide(batch["target"]))[:, None]
            sums = pa.ListArray.from_arrays(np.arange(0, (len(starts) + 1) * dims, dims, np.int32), np.add.reduceat(values, starts).ravel())
            yield pa.record_batch([batch[key].take(pa.array(starts)), sums, pa.array(np.diff(np.append(starts, len(place))))], names=[key, "part", "n"])

    parts = met.mapInArrow(add, f"{key} {dict(met.dtypes)[key]}, part array<double>, n long")
    found = parts.groupBy(key).agg(F.collect_list("part").alias("parts"), F.sum("n").alias("n"))
    total = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    return found.select(key, F.transform(total, lambda v: v / F.col("n") if mean else v).alias("pooled"))


def _met_vectors(histories: DataFrame, vectors: DataFrame, key: str, ids: str, target: str | None) -> tuple[Iterator[DataFrame], int]:
    """Tables that together have (key, embedding, target) of every id that is not 0, and the vectors' width.

    Vectors of SENT_BYTES at most go to the histories: a key's rows stay together, and no vector is shuffled. More vectors
    are shuffled to the histories' keys, a share of the keys at a time.
    """
    vectors = vectors.where("embedding is not null").select("id", "embedding")
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    dims = about["width"] or 0
    owned = histories.where(F.col(key).isNotNull()).select(key, F.col(ids).alias("ids"), *([F.col(target).alias("aim")] if target else []))
    aimed = vectors.select(F.col("id").alias("aim"), F.col("embedding").alias("target"))
    long = lambda rows, *more: rows.select(key, *more, F.explode("ids").alias("id")).where("id <> 0")

    def sent() -> Iterator[DataFrame]:
        if target:
            yield long(owned.join(F.broadcast(aimed), "aim"), "target").join(F.broadcast(vectors), "id").select(key, "embedding", "target")
        else:
            yield long(owned).join(F.broadcast(vectors), "id").select(key, "embedding")

    def shuffled() -> Iterator[DataFrame]:
        rows = owned.agg(F.sum(F.size("ids"))).first()[0] or 0
        rounds = max(1, min(MOST_ROUNDS, -(-rows * dims // ROUND_VALUES)))
        for i in range(rounds):
            own = owned.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == i)
            met = long(own).join(vectors.hint("shuffle_merge"), "id").select(key, "embedding")
            if target:
                aims = own.select(key, "aim").join(aimed, "aim").select(key, "target")
                yield met.join(aims.hint("shuffle_merge"), key).select(key, "embedding", "target")
            else:
                yield met.repartition(key).sortWithinPartitions(key)

    return (sent if about["n"] * dims * 4 <= SENT_BYTES else shuffled)(), dims


def _pooled_history(histories: DataFrame, vectors: DataFrame, key: str, ids: str, target: str | None) -> DataFrame:
    """key, pooled of every history; zeros if it met no vector."""
    tables, dims = _met_vectors(histories, vectors, key, ids, target)
    pooled = stored_parts((_pooled(met, key, dims, not target) for met in tables), "pooled")
    return histories.select(key).join(pooled, key, "left").select(key, F.coalesce("pooled", F.array_repeat(F.lit(0.0), dims)).alias("pooled"))


def masked_mean_history(histories: DataFrame, vectors: DataFrame, key: str, ids: str = "hist_item") -> DataFrame:
    """key, pooled: the mean vector of the ids that are not 0; zeros if there are none."""
    return _pooled_history(histories, vectors, key, ids, None)


def weighted_history(histories: DataFrame, vectors: DataFrame, key: str, target: str, ids: str = "hist_item") -> DataFrame:
    """key, pooled: the sum of the vectors of the ids that are not 0, each times its inner product with the vector of the row's
    target id; not divided by anything. Zeros without such ids or without a target vector."""
    return _pooled_history(histories, vectors, key, ids, target)


def logloss(rows: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """One row: n, logloss. The form is stable for large logits."""
    x, y = F.col(logit), F.col(label)
    return rows.agg(F.count("*").alias("n"), F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("logloss"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label", ranges: int = 256) -> DataFrame:
    """One row: n_pos, n_neg, auc; ties count half, and a single class gives 0.

    Rows become counts per score. Scores are range-partitioned; a score's negatives below it are those of the ranges
    before (a running sum over at most `ranges` rows) plus those before it in its own range.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    cut = per.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10000).alias("cuts"))  # one row
    ranged = per.join(F.broadcast(cut)).select("s", "pos", "neg", F.size(F.filter("cuts", lambda c: c < F.col("s"))).alias("range"))
    totals = ranged.groupBy("range").agg(F.sum("neg").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "range").withColumn("low", F.col("below") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    sums = placed.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.sum(F.col("pos").cast("double") * (F.col("low") + F.col("neg") / 2)).alias("wins"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select("n_pos", "n_neg", F.when(pairs > 0, F.col("wins") / pairs).otherwise(0.0).alias("auc"))


def linear_baseline(examples: DataFrame, columns: tuple[str, ...], size: int = 1 << 16):
    """A fitted pipeline that adds `logit` and `probability`: one weight per id, hashed, and a bias."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    hasher = FeatureHasher(inputCols=list(columns), outputCol="features", numFeatures=size, categoricalCols=list(columns))
    model = LogisticRegression(featuresCol="features", labelCol="label", rawPredictionCol="logit", regParam=1e-4, maxIter=30)
    return Pipeline(stages=[hasher, model]).fit(examples)
