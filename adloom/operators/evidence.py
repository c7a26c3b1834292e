"""From the search log to evidence per query and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.functions.copies import template_copy
from adloom.functions.text import category_path, clean_text, first_non_empty, normalize_query, safe_float, safe_int

BLANK = ("item_title", "brand_name", "seller_name", "category_path")


def _given(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def canonical_items(raw: DataFrame) -> DataFrame:
    """Items under any of their field names; rows without a positive id go. A given category path beats the levels."""
    levels = [first_non_empty(*_given(raw, f"category_level{k}_name", f"category_l{k}_name", f"category{k}_name")) for k in (1, 2, 3)]
    path = F.coalesce(F.nullif(first_non_empty(*_given(raw, "category_path")), F.lit("")), category_path(*levels))
    kept = [c for c in ("category_level1_id", "category_level2_id", "category_level3_id", "seq") if c in raw.columns]
    return raw.select(
        safe_int(F.coalesce(*_given(raw, "item_id", "target_item_id"))).alias("item_id"),
        first_non_empty(*_given(raw, "item_title", "title", "item_name", "name")).alias("item_title"),
        first_non_empty(*_given(raw, "brand_name", "brand")).alias("brand_name"),
        first_non_empty(*_given(raw, "seller_name", "seller", "shop_name")).alias("seller_name"),
        path.alias("category_path"),
        *kept,
    ).where("item_id > 0")


def canonical_users(raw: DataFrame) -> DataFrame:
    return raw.select(
        safe_int(raw["user_id"]).alias("user_id"),
        first_non_empty(*_given(raw, "gender")).alias("gender"),
        first_non_empty(*_given(raw, "age_bucket", "age")).alias("age_bucket"),
        first_non_empty(*_given(raw, "fre_city", "city")).alias("city"),
        first_non_empty(*_given(raw, "fre_province", "province")).alias("province"),
        first_non_empty(*_given(raw, "fre_country", "country")).alias("country"),
        *[c for c in ("seq",) if c in raw.columns],
    ).where("user_id > 0")


def canonical_log(raw: DataFrame) -> DataFrame:
    """A nested raw log as the flat log schema. An absent field and a null one are the same here."""
    stats = "target_item_statistical_features"
    return raw.select(
        *[c for c in ("seq",) if c in raw.columns],
        first_non_empty(raw["query"]).alias("query"),
        safe_int(raw["user_id"]).alias("user_id"),
        safe_int(raw["session_id"]).alias("session_id"),
        safe_int(F.coalesce(raw["target_item_id"], raw["item_id"])).alias("item_id"),
        safe_int(raw["is_clicked"]).alias("is_clicked"),
        safe_int(raw["is_purchased"]).alias("is_purchased"),
        safe_float(raw[f"{stats}.item_show_cnt_30d_hist"]).alias("show_cnt"),
        safe_float(raw[f"{stats}.item_click_cnt_30d_hist"]).alias("click_cnt"),
        safe_float(raw[f"{stats}.item_order_cnt_30d_hist"]).alias("order_cnt"),
        F.transform("recently_clicked_item_ids", lambda x: safe_int(x)).alias("recently_clicked_item_ids"),
        F.transform("recently_purchased_item_ids", lambda x: safe_int(x)).alias("recently_purchased_item_ids"),
        F.coalesce(raw["split"], F.lit("train")).alias("split"),
    )


def keep_last_by_key(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row per key: the last in `order`. Aggregates map-side, no sort."""
    return _one_by_key(rows, key, F.max_by, order)


def keep_first_by_key(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    return _one_by_key(rows, key, F.min_by, order)


def _one_by_key(rows: DataFrame, key: str, pick, order: str) -> DataFrame:
    kept = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(pick(kept, F.col(order)).alias("kept")).select(key, "kept.*")


def positives(log: DataFrame, query: str | None = None) -> DataFrame:
    """Rows with a query, a click or purchase, and a positive item id; optionally of one exact query."""
    text = clean_text(F.col("query"))
    rows = log.withColumn("query", text).where((text != "") & ((F.col("is_purchased") == 1) | (F.col("is_clicked") == 1)) & (F.col("item_id") > 0))
    return rows if query is None else rows.where(F.col("query") == query)


def signal_milli() -> Column:
    """5 a purchase, 2 a click, 0.001 a show, 0.01 a click and 0.05 an order of the last 30 days; in whole thousandths, so
    that sums are exact in any order."""
    part = lambda c, w: F.round(F.coalesce(F.col(c), F.lit(0)) * w).cast("bigint")
    return part("is_purchased", 5000) + part("is_clicked", 2000) + part("show_cnt", 1) + part("click_cnt", 10) + part("order_cnt", 50)


def query_item_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Per query (or keys) and item: purchase_cnt, click_cnt, signal. Partial sums absorb head queries."""
    return rows.groupBy(*(keys or ("query",)), "item_id").agg(
        F.sum("is_purchased").cast("bigint").alias("purchase_cnt"),
        F.sum("is_clicked").cast("bigint").alias("item_click_cnt"),
        F.sum(signal_milli()).alias("signal"),
    )


def best_record(rows: DataFrame, *keys: str) -> DataFrame:
    """Per query (or keys) the log row with the highest signal, purchase, click and lowest item id; the first in seq of equals."""
    keys = keys or ("query",)
    kept = F.struct(*[c for c in rows.columns if c not in keys], signal_milli().alias("row_signal"))
    order = F.struct((-signal_milli()).alias("s"), (-F.col("is_purchased")).alias("p"), (-F.col("is_clicked")).alias("c"), "item_id", "seq")
    return rows.groupBy(*keys).agg(F.min_by(kept, order).alias("kept")).select(*keys, "kept.*")


def merge_by_normalized_query(stats: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item sums over raw queries of one normalized form, and the best of their best rows, whose query names the group."""
    merged = (
        stats.withColumn("norm_query", normalize_query(F.col("query")))
        .groupBy("norm_query", "item_id")
        .agg(*[F.sum(c).alias(c) for c in ("purchase_cnt", "item_click_cnt", "signal")])
    )
    named = best.withColumn("norm_query", normalize_query(F.col("query")))
    return merged, best_record(named.drop("row_signal"), "norm_query")


def evidence_topk(stats: DataFrame, items: DataFrame, k: int = 3, key: str = "query") -> DataFrame:
    """The k best items per query, one row each: key, pos, EVIDENCE fields.

    Only rows that survive the top-k meet the item table. Unknown items have blank fields.
    """
    by = Window.partitionBy(key).orderBy(F.desc("signal"), F.desc("purchase_cnt"), F.desc("item_click_cnt"), "item_id")
    top = stats.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k)
    about = items.select("item_id", *BLANK)
    return top.join(about, "item_id", "left").select(
        key,
        "pos",
        "item_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in BLANK],
        "purchase_cnt",
        F.col("item_click_cnt").alias("click_cnt"),
        F.round(F.col("signal") / 1000.0, 6).alias("ranking_signal"),
        F.when(F.col("purchase_cnt") > 0, 2).otherwise(1).alias("relevance_signal"),
    )


def recent_behavior_titles(best: DataFrame, items: DataFrame, limit: int = 5, key: str = "query") -> DataFrame:
    """key, recent_behavior_titles: titles of the clicked, then the purchased items of a row, first of equals, `limit` at most."""
    ids = F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in ("recently_clicked_item_ids", "recently_purchased_item_ids")])
    long = best.select(key, F.posexplode(ids).alias("pos", "item_id")).where("item_id > 0")
    # ids repeat: the first place of an id is enough to find the first place of a title
    long = long.groupBy(key, "item_id").agg(F.min("pos").alias("pos"))
    titled = long.join(items.select("item_id", "item_title"), "item_id").where("item_title <> ''")
    first = titled.groupBy(key, "item_title").agg(F.min("pos").alias("pos"))
    top = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("n") <= limit)
    found = top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item_title"))), lambda x: x["item_title"]).alias("titles"))
    return best.select(key).join(found, key, "left").select(
        key, F.coalesce("titles", F.array().cast("array<string>")).alias("recent_behavior_titles")
    )


def attach_user_profile(rows: DataFrame, users: DataFrame, user_col: str = "user_id", requested: str | None = None) -> DataFrame:
    """Adds user_profile: that of the row's user or, where it is missing, of the requested user. All null if neither is known."""
    fields = ("gender", "age_bucket", "city", "province", "country")
    profile = lambda name: users.select(F.col("user_id").alias(name), F.struct(*fields).alias(f"{name}_profile"))
    out = rows.join(profile("own"), F.col(user_col) == F.col("own"), "left")
    found = F.col("own_profile")
    if requested:
        out = out.join(profile("asked"), F.col(requested) == F.col("asked"), "left")
        found = F.coalesce("own_profile", "asked_profile")
    return out.withColumn("user_profile", found).select(*rows.columns, "user_profile")


def build_train_pairs(log: DataFrame, items: DataFrame, users: DataFrame, history: DataFrame | None = None, k: int = 3) -> DataFrame:
    """One row per query, sorted by query: ids of the best row's user and session, profile, recent titles, evidence, target.

    history (user_id, recently_clicked_item_ids, recently_purchased_item_ids) is joined to the best rows only; without
    it the log must carry the arrays itself.
    """
    rows = positives(log)
    arrays = ["recently_clicked_item_ids", "recently_purchased_item_ids"]
    best = best_record(rows)
    if history is not None:
        best = best.drop(*arrays).join(history.select("user_id", *arrays), "user_id", "left")
    evidence = evidence_topk(query_item_stats(rows), items, k)
    fields = [c for c in evidence.columns if c not in ("query", "pos")]
    listed = evidence.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))).alias("found"))
    pairs = (
        attach_user_profile(best.select("query", "user_id", "session_id", "seq"), users)
        .join(recent_behavior_titles(best, items), "query")
        .join(listed.select("query", F.transform("found", lambda x: x["item"]).alias("evidence_items")), "query")
    )
    target = F.col("evidence_items")[0]
    return pairs.withColumn("target_item", target).withColumn(
        "target_copy", template_copy(F.col("query"), target["item_title"], target["brand_name"], target["seller_name"], target["category_path"])
    ).orderBy("query")
