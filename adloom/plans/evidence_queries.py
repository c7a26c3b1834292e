"""Checked queries of cleaning functions and of the search-log aggregation."""

from pyspark.sql import functions as F

from adloom.functions import text as X
from adloom.functions.copies import template_copy
from adloom.operators import evidence as E
from adloom.plans.base import WITH_ALL, WITH_ITEMS, WITH_LOG, WITH_STATS, WITH_USERS, checked, chunk4, compare, history, items, log, norm, quoted, table, unigram, users

#: Categories for English product names, in order of priority.
CATEGORIES = (("metal", ("BRASS", "COPPER", "STEEL", "TIN")), ("plain", ("STANDARD", "small")), ("fine", ("PROMO", "Economy")))


@checked(f"WITH {WITH_ITEMS} SELECT item_id, item_title, brand_name, seller_name, category_path FROM items")
def c_canonical_items(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", "item_title", "brand_name", "seller_name", "category_path")


@checked(f"WITH {WITH_USERS} SELECT user_id, gender, age_bucket, city, province, '' AS country FROM users")
def c_canonical_users(spark, sf_dir):
    return users(spark, sf_dir)


@checked(
    f"WITH {WITH_LOG} SELECT max_by(item_id, seq) AS last_item, min_by(item_id, seq) AS first_item, query FROM pos GROUP BY query"
)
def c_keep_by_key(spark, sf_dir):
    rows = E.positives(log(spark, sf_dir)).select("query", "item_id", "seq")
    last = E.keep_last_by_key(rows, "query").select("query", F.col("item_id").alias("last_item"))
    return last.join(E.keep_first_by_key(rows, "query").select("query", F.col("item_id").alias("first_item")), "query")


@checked(
    f"""WITH {WITH_LOG}, q AS (SELECT DISTINCT query FROM log), n AS (SELECT query, {norm("query")} AS norm_query FROM q)
SELECT query, norm_query, {compare("query")} AS compared, array_to_string({chunk4("norm_query")}, '|') AS chunks, array_to_string({unigram("query")}, '|') AS unigrams,
  array_to_string(regexp_extract_all(trim(query), '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), '|') AS title_tokens,
  CASE WHEN length(norm_query) <= 6 THEN 'short' WHEN length(norm_query) <= 15 THEN 'medium' ELSE 'long' END AS bucket,
  NOT regexp_matches({compare("query")}, '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}]') AS noisy,
  CASE WHEN length(trim(query)) <= 18 THEN trim(query) ELSE concat(regexp_replace(left(trim(query), 18), '[，。；、 ]+$', ''), '等') END AS short_title
FROM n"""
)
def c_query_text(spark, sf_dir):
    q = F.col("query")
    return (
        log(spark, sf_dir).select("query").distinct().withColumn("norm_query", X.normalize_query(q))
        .select(
            "query", "norm_query", X.compare_text(q).alias("compared"), F.array_join(X.tokens(q, "chunk4"), "|").alias("chunks"),
            F.array_join(X.tokens(q, "unigram"), "|").alias("unigrams"), F.array_join(X.tokens(q, "title"), "|").alias("title_tokens"),
            X.length_bucket(F.col("norm_query")).alias("bucket"), X.query_too_noisy(q).alias("noisy"), X.short_title(q).alias("short_title"),
        )
    )


@checked(
    f"""WITH {WITH_ITEMS} SELECT item_id, {compare("brand_name")} IN ('', '无品牌', '其他', '其他other', '其它', '其它other', 'unknown', 'none', 'null', 'nan', 'other') AS placeholder,
  contains({compare("item_title || ' ' || brand_name")}, {compare("brand_name")}) AS in_title, trim(split_part(category_path, '>', 1)) AS major,
  trim(string_split(category_path, '>')[-1]) AS leaf,
  CASE WHEN regexp_matches(lower(category_path), 'brass|copper|steel|tin') THEN 'metal' WHEN regexp_matches(lower(category_path), 'standard|small') THEN 'plain'
    WHEN regexp_matches(lower(category_path), 'promo|economy') THEN 'fine' ELSE 'misc' END AS category,
  array_to_string(list_filter(['TIN', 'STEEL', 'size-1', 'PROMO'], lambda t: contains(category_path, t)), '|') AS terms FROM items"""
)
def c_item_tags(spark, sf_dir):
    path, brand = F.col("category_path"), F.col("brand_name")
    return items(spark, sf_dir).select(
        "item_id",
        X.is_placeholder_brand(brand).alias("placeholder"),
        X.title_contains_brand(F.concat_ws(" ", "item_title", brand), brand).alias("in_title"),
        X.major_category(path).alias("major"),
        X.leaf_category(path).alias("leaf"),
        X.tag_first_match(path, CATEGORIES).alias("category"),
        F.array_join(X.tag_all_matches(path, ("TIN", "STEEL", "size-1", "PROMO")), "|").alias("terms"),
    )


@checked(
    """SELECT o_orderkey AS id, trunc(o_totalprice / 1000)::BIGINT AS whole, o_totalprice / 1000 AS real, 0::BIGINT AS bad FROM orders"""
)
def c_coercion(spark, sf_dir):
    text = (F.col("o_totalprice") / 1000).cast("string")
    bad = F.concat(F.lit("x"), text)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), X.safe_int(text).alias("whole"), X.safe_float(text).alias("real"), X.safe_int(bad).alias("bad")
    )


@checked(f"WITH {WITH_LOG} SELECT seq, query, item_id, signal::BIGINT AS signal FROM pos")
def a1_positives_signal(spark, sf_dir):
    return E.positives(log(spark, sf_dir)).select("seq", "query", "item_id", E.signal_milli().alias("signal"))


@checked(f"WITH {WITH_LOG}, {WITH_STATS} SELECT query, item_id, purchase_cnt, item_click_cnt, signal FROM stats")
def a2_query_item_stats(spark, sf_dir):
    return E.query_item_stats(E.positives(log(spark, sf_dir)))


@checked(f"WITH {WITH_LOG}, {WITH_STATS} SELECT query, seq, item_id, user_id, session_id, signal::BIGINT AS row_signal FROM best")
def a3_best_record(spark, sf_dir):
    return E.best_record(E.positives(log(spark, sf_dir))).select("query", "seq", "item_id", "user_id", "session_id", "row_signal")


@checked(
    f"""WITH {WITH_LOG}, {WITH_STATS}, m AS (SELECT {norm("query")} AS norm_query, item_id, sum(purchase_cnt)::BIGINT AS purchase_cnt, sum(signal)::BIGINT AS signal FROM stats GROUP BY ALL),
b AS (SELECT {norm("query")} AS norm_query, query FROM best QUALIFY row_number() OVER (PARTITION BY norm_query ORDER BY signal DESC, is_purchased DESC, is_clicked DESC, item_id, seq) = 1)
SELECT norm_query, item_id, purchase_cnt, signal, query AS named_by FROM m JOIN b USING (norm_query)"""
)
def a4_merge_by_normalized_query(spark, sf_dir):
    rows = E.positives(log(spark, sf_dir))
    merged, best = E.merge_by_normalized_query(E.query_item_stats(rows), E.best_record(rows))
    return merged.join(best.select("norm_query", F.col("query").alias("named_by")), "norm_query").select("norm_query", "item_id", "purchase_cnt", "signal", "named_by")


@checked(f"WITH {WITH_ALL} SELECT * FROM evidence")
def a5_evidence_topk(spark, sf_dir):
    return E.evidence_topk(E.query_item_stats(E.positives(log(spark, sf_dir))), items(spark, sf_dir))


TITLES = """shown AS (SELECT b.query, r.item_id, -back AS at_place FROM best b JOIN recent r ON r.user_id = b.user_id WHERE r.item_id > 0),
firsts AS (SELECT query, item_title, min(at_place) AS at_place FROM shown JOIN items USING (item_id) WHERE item_title <> '' GROUP BY ALL),
titles AS (SELECT query, string_agg(item_title, '|' ORDER BY at_place) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY at_place) AS n FROM firsts) WHERE n <= 5 GROUP BY query)"""


@checked(f"WITH {WITH_ALL}, {TITLES} SELECT b.query, coalesce(titles, '') AS titles FROM best b LEFT JOIN titles t ON t.query = b.query")
def a6_recent_behavior_titles(spark, sf_dir):
    best = E.best_record(E.positives(log(spark, sf_dir))).join(history(spark, sf_dir), "user_id", "left")
    return E.recent_behavior_titles(best, items(spark, sf_dir)).select("query", F.array_join("recent_behavior_titles", "|").alias("titles"))


@checked(
    f"""WITH {WITH_ALL} SELECT b.query, b.user_id, u.gender, u.age_bucket, u.city, u.province FROM best b LEFT JOIN users u ON u.user_id = b.user_id"""
)
def a7_attach_user_profile(spark, sf_dir):
    best = E.best_record(E.positives(log(spark, sf_dir))).select("query", "user_id")
    out = E.attach_user_profile(best, users(spark, sf_dir))
    return out.select("query", "user_id", *[F.col(f"user_profile.{c}").alias(c) for c in ("gender", "age_bucket", "city", "province")])


COPY = f"""CASE WHEN shown <> '' AND seller_name <> '' THEN concat('搜“', trim(query), '”可以先看这款', shown, '，由', seller_name, '在售，信息清楚，适合先了解。')
  WHEN shown <> '' AND leaf <> '' THEN concat('搜“', trim(query), '”可先关注这款', shown, '，属于', leaf, '方向，和当前需求更贴近。')
  WHEN shown <> '' THEN concat('结合你搜索的“', trim(query), '”，这款', shown, '是当前更匹配的选择，信息直观，适合优先浏览。')
  WHEN leaf <> '' THEN concat('结合你搜索的“', trim(query), '”，可先关注', leaf, '方向的候选商品，便于更快缩小选择范围。')
  ELSE concat('结合你搜索的“', trim(query), '”，推荐先查看当前匹配度更高的商品证据，快速缩小选择范围。') END"""
SHOWN = f"""CASE WHEN item_title <> '' AND {compare("brand_name")} NOT IN ('', '无品牌', 'unknown', 'other') AND NOT contains({compare("item_title")}, {compare("brand_name")})
  THEN brand_name || item_title ELSE item_title END AS shown, trim(string_split(category_path, '>')[-1]) AS leaf"""


@checked(
    f"""WITH {WITH_ALL}, {TITLES}, top AS (SELECT *, {SHOWN} FROM evidence WHERE pos = 1),
listed AS (SELECT query, count(*) AS n_evidence, string_agg(item_id::VARCHAR, '|' ORDER BY pos) AS evidence_ids FROM evidence GROUP BY query)
SELECT b.query, b.user_id, b.session_id, coalesce(u.city, '') AS city, coalesce(t.titles, '') AS titles, n_evidence, evidence_ids, top.item_id AS target_id,
  {COPY.replace("query", "b.query")} AS target_copy
FROM best b LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN titles t ON t.query = b.query JOIN listed l ON l.query = b.query JOIN top ON top.query = b.query"""
)
def a8_build_train_pairs(spark, sf_dir):
    pairs = E.build_train_pairs(log(spark, sf_dir), items(spark, sf_dir), users(spark, sf_dir), history(spark, sf_dir))
    return pairs.select(
        "query", "user_id", "session_id", F.coalesce("user_profile.city", F.lit("")).alias("city"), F.array_join("recent_behavior_titles", "|").alias("titles"),
        F.size("evidence_items").cast("bigint").alias("n_evidence"),
        F.array_join(F.transform("evidence_items", lambda x: x["item_id"].cast("string")), "|").alias("evidence_ids"),
        F.col("target_item.item_id").alias("target_id"), "target_copy",
    )


@checked(f"WITH {WITH_ALL}, top AS (SELECT *, {SHOWN} FROM evidence) SELECT query, pos, {COPY} AS copy FROM top")
def u10_template_copy(spark, sf_dir):
    top = a5_evidence_topk(spark, sf_dir)
    return top.select("query", "pos", template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path"))).alias("copy"))
