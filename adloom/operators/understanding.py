"""Query understanding: features, hints, intent, rescored evidence, profile tags, style. One pass over ≤ k rows per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.functions import copies as C
from adloom.functions import lexicons as L
from adloom.functions.text import HAN, _any, clean_text, is_placeholder_brand, leaf_category, major_category, normalize_query, short_title, simplify_category, tag_first_match, tokens

# Patterns of model names, the most specific first.
MODEL_PATTERNS = (r"[A-Za-z]+[A-Za-z0-9\-]*\d+[A-Za-z0-9\-]*", r"\d+[A-Za-z]+[A-Za-z0-9\-]*", r"[A-Za-z0-9\-]{3,}")


def _strings(*cols: Column) -> Column:
    return F.array(*cols).cast("array<string>")


def keep_distinct(values: Column) -> Column:
    """Cleaned values without blanks, the first of equals."""
    return F.array_distinct(F.filter(F.transform(values, clean_text), lambda v: v != ""))


def model_hint(query: Column) -> Column:
    """The first match with a digit of the first pattern that has one; empty if none."""
    found = [F.get(F.filter(F.regexp_extract_all(clean_text(query), F.lit(p), F.lit(0)), lambda m: m.rlike("[0-9]")), F.lit(0)) for p in MODEL_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def scene_hint(query: Column, scenes=L.SCENES) -> Column:
    return tag_first_match(query, scenes, "")


def crowd_hint(query: Column, crowds=L.CROWDS) -> Column:
    return tag_first_match(query, crowds, "")


def query_features(queries: DataFrame) -> DataFrame:
    """raw_query, normalized_query, query_length, alnum and Han tokens and four flags of a table with `query`."""
    norm = F.col("normalized_query")
    rows = queries.select(F.col("query"), clean_text(F.col("query")).alias("raw_query"), normalize_query(F.col("query")).alias("normalized_query"))
    words = tokens(norm, "mixed")
    alnum, han = F.filter(words, lambda t: t.rlike("[A-Za-z0-9]")), F.filter(words, lambda t: t.rlike(f"[{HAN}]"))
    return rows.select(
        "*", F.char_length(norm).alias("query_length"), alnum.alias("alpha_num_tokens"), han.alias("han_tokens"),
        (F.size(alnum) > 0).alias("has_alpha_num_token"), (model_hint(norm) != "").alias("has_model_hint"),
        (scene_hint(norm) != "").alias("has_scene_hint"), (crowd_hint(norm) != "").alias("has_crowd_hint"),
    )


def _most_common(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key, name: the most frequent non-blank value; the first by pos of equals."""
    long = rows.select(key, "pos", value.alias("v")).where("v <> ''")
    counts = long.groupBy(key, "v").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return counts.groupBy(key).agg(F.max_by("v", F.struct("n", -F.col("p"))).alias(name))


def hints(evidence: DataFrame, key: str = "query") -> DataFrame:
    """key, brand_hint, category_hint: the brand with an alias in the query, else the most frequent brand; the most frequent
    leaf category. First in evidence order of equals."""
    low = F.lower(normalize_query(F.col(key)))
    brand = clean_text(F.col("brand_name"))
    aliases = F.filter(F.transform(F.split(brand, r"[\\/|]"), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    named = evidence.where((brand != "") & F.exists(aliases, lambda a: F.contains(low, a)))
    first = named.groupBy(key).agg(F.min_by(brand, "pos").alias("named_brand"))
    common = _most_common(evidence, key, brand, "common_brand")
    leaf = _most_common(evidence, key, leaf_category(clean_text(F.col("category_path"))), "leaf")
    keys = evidence.select(key).distinct()
    return keys.join(first, key, "left").join(common, key, "left").join(leaf, key, "left").select(
        key, F.coalesce("named_brand", "common_brand", F.lit("")).alias("brand_hint"), F.coalesce("leaf", F.lit("")).alias("category_hint")
    )


def _special(query: Column, place: int) -> Column:
    return F.coalesce(*[F.when(F.contains(query, F.lit(s[0])), F.lit(s[place])) for s in L.SPECIAL_QUERIES], F.lit(""))


def intent(evidence: DataFrame, key: str = "query") -> DataFrame:
    """One row per query with evidence: hints, scene, crowd, price intent, attributes, search focus and summary."""
    q = F.col("query_text")
    rows = hints(evidence, key).withColumn("query_text", normalize_query(F.col(key)))
    rows = rows.select("*", model_hint(q).alias("model_hint"), scene_hint(q).alias("scene_hint"), crowd_hint(q).alias("crowd_hint"), F.when(_any(q, L.BUDGET_WORDS), "budget").otherwise("unknown").alias("price_intent"))
    known = F.array("brand_hint", "category_hint", "model_hint")
    attributes = F.slice(F.array_except(F.array_distinct(F.filter(tokens(q, "mixed"), lambda t: F.char_length(t) >= 2)), known), 1, 6)
    rows = rows.withColumn("attribute_hints", attributes)
    lead = F.array("brand_hint", "model_hint", "category_hint", "scene_hint", "crowd_hint")
    summary = F.array_join(F.filter(lead, lambda v: v != ""), " / ")
    return rows.select(
        "*",
        F.coalesce(F.nullif(_special(q, 1), F.lit("")), "scene_hint").alias("scenario"),
        F.coalesce(F.nullif(_special(q, 2), F.lit("")), "crowd_hint").alias("audience"),
        F.coalesce(F.nullif(_special(q, 3), F.lit("")), F.array_join(F.slice("attribute_hints", 1, 2), " / ")).alias("purchase_focus"),
        F.slice(keep_distinct(F.concat(lead, "attribute_hints")), 1, 8).alias("search_focus"),
        F.coalesce(F.nullif(summary, F.lit("")), q).alias("intent_summary"),
    )


def rescore_evidence(evidence: DataFrame, intents: DataFrame, k: int = 3, key: str = "query") -> DataFrame:
    """The k best evidence rows after the hints: signal, 2 for the brand, 1 for the category, 1 per focus term in the text.
    pos is new, old_pos the given one."""
    rows = evidence.withColumnRenamed("pos", "old_pos").join(intents.select(key, "brand_hint", "category_hint", "search_focus"), key)
    text = F.lower(F.concat_ws(" ", "item_title", "brand_name", "category_path"))
    has = lambda c: ((F.col(c) != "") & F.contains(text, F.lower(c))).cast("int")
    focus = F.array_distinct(F.transform("search_focus", F.lower))
    score = F.col("ranking_signal") + 2.0 * has("brand_hint") + has("category_hint") + F.size(F.filter(focus, lambda t: F.contains(text, t)))
    by = Window.partitionBy(key).orderBy(F.desc("evidence_fit"), F.desc("ranking_signal"), "item_id")
    ranked = rows.withColumn("evidence_fit", F.round(score, 6)).withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= k)
    return ranked.drop("brand_hint", "category_hint", "search_focus")


def _listed(evidence: DataFrame, key: str, *values: Column) -> DataFrame:
    """key, found: the given values of a query's rows in pos order (≤ k rows a query)."""
    named = [v.alias(f"v{i}") for i, v in enumerate(values)]
    return evidence.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *named))).alias("found"))


def facts(selected: DataFrame, intents: DataFrame, key: str = "query") -> DataFrame:
    """key, selling_points (≤ 4) and fact_block (≤ 8 distinct title=, brand=, category= facts)."""
    title, brand, leaf = clean_text(F.col("item_title")), clean_text(F.col("brand_name")), leaf_category(clean_text(F.col("category_path")))
    fact = lambda p, v: F.when(v != "", F.concat(F.lit(p), v))
    rows = _listed(selected, key, title, F.array_compact(_strings(fact("title=", short_title(title)), fact("brand=", brand), fact("category=", leaf))))
    rows = rows.join(intents.select(key, "query_text", "category_hint"), key)
    joined, q, cat = F.array_join(F.transform("found", lambda x: x["v0"]), " "), F.col("query_text"), F.col("category_hint")
    pool = F.filter(F.array(*map(F.lit, L.SELLING_POINTS)), lambda w: F.contains(joined, w))
    own = F.filter(tokens(_special(q, 3), "mixed"), lambda t: F.contains(joined, t) | F.contains(cat, t))
    points = F.concat(pool, own)
    default = None
    for word, names in L.DEFAULT_POINTS:
        test = F.contains(q, F.lit(word)) | (F.contains(cat, F.lit(word)) if word == L.DEFAULT_POINTS[0][0] else F.lit(False))
        default = F.when(test, F.array(*map(F.lit, names))) if default is None else default.when(test, F.array(*map(F.lit, names)))
    default = F.coalesce(default, F.array().cast("array<string>"))
    return rows.select(
        key,
        F.slice(F.array_distinct(F.when(F.size(points) > 0, points).otherwise(default)), 1, 4).alias("selling_points"),
        F.slice(F.array_distinct(F.flatten(F.transform("found", lambda x: x["v1"]))), 1, 8).alias("fact_block"),
    )


def user_tags(rows: DataFrame) -> DataFrame:
    """Adds demographic_tags, behavior_tags, interest_tags and personalization_strength to rows with user_profile (struct) and
    recent_behavior_titles."""
    p, titles = F.col("user_profile"), F.slice(F.coalesce("recent_behavior_titles", F.array().cast("array<string>")), 1, 5)
    tag = lambda label, c: F.when(clean_text(p[c]) != "", F.concat(F.lit(label), clean_text(p[c])))
    demographic = F.array_compact(_strings(tag("gender=", "gender"), tag("age=", "age_bucket"), tag("city=", "city")))
    known = F.array_join(F.array_compact(_strings(*[p[c] for c in ("gender", "age_bucket", "city", "province", "country")])), "") != ""
    known = F.coalesce(known, F.lit(False))
    recent = F.size(titles) > 0
    interests = F.flatten(F.transform(titles, lambda t: F.filter(F.array(*map(F.lit, L.INTERESTS)), lambda w: F.contains(t, w))))
    return rows.select(
        "*", demographic.alias("demographic_tags"),
        keep_distinct(F.transform(titles, lambda t: F.get(tokens(t, "mixed"), F.lit(0)))).alias("behavior_tags"),
        F.array_distinct(interests).alias("interest_tags"),
        F.when(known & recent, "medium").when(known | recent, "weak").otherwise("none").alias("personalization_strength"),
    )


def select_style(tone: Column, query_length: Column, scene: Column, category: Column) -> Column:
    """struct<style_id, length_range, example_pattern>."""
    style = F.when((tone == "creative") & (query_length <= 6) & (scene == ""), "creative_compact").when(scene != "", "scene_led").when(category != "", "fact_led").otherwise("balanced_generic")
    ranges = {"creative_compact": "20-32字", "scene_led": "24-42字", "fact_led": "22-38字", "balanced_generic": "22-40字"}
    examples = {"creative_compact": "需求点 + 适配方向", "scene_led": "场景开头 + 品类方向 + 自然引导", "fact_led": "选择理由 + 商品方向", "balanced_generic": "选择理由 + 商品方向"}
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), style)
    return F.struct(style.alias("style_id"), of(ranges).alias("length_range"), of(examples).alias("example_pattern"))


def common_title(evidence: DataFrame, key: str = "query") -> DataFrame:
    """key, hint: the longest token (then the first by text) that all titles of a query share; empty if it has fewer than two
    titles."""
    sized = evidence.groupBy(key).agg(F.count("*").alias("n"))
    words = evidence.select(key, F.explode(F.array_distinct(tokens(F.col("item_title"), "title"))).alias("w")).where(F.char_length("w") >= 2)
    counts = words.groupBy(key, "w").agg(F.count("*").alias("c")).join(sized, key).where("c = n and n >= 2")
    best = counts.groupBy(key).agg(F.min(F.struct((-F.char_length("w")).alias("l"), "w")).alias("b"))
    return sized.join(best, key, "left").select(key, "n", F.coalesce("b.w", F.lit("")).alias("hint"))


def summary_copy(evidence: DataFrame, key: str = "query") -> DataFrame:
    """key, copy, fallback, reason: a sentence about what the evidence rows share, else the template on the first row."""
    brand, path = clean_text(F.col("brand_name")), clean_text(F.col("category_path"))
    rows = evidence.select("*", F.when(~is_placeholder_brand(brand), brand).otherwise("").alias("b"), major_category(path).alias("m"), leaf_category(path).alias("l"))

    def top(column: str) -> DataFrame:
        counts = rows.where(F.col(column) != "").groupBy(key, column).agg(F.count("*").alias("c"), F.min("pos").alias("p"))
        return counts.groupBy(key).agg(F.max_by(F.struct(F.col(column).alias("v"), "c"), F.struct("c", -F.col("p"))).alias(f"top_{column}"))

    wide = common_title(evidence, key)
    for c in ("b", "m", "l"):
        wide = wide.join(top(c), key, "left")
    first = evidence.where("pos = 1").select(key, C.template_copy(F.col(key), *map(F.col, ("item_title", "brand_name", "seller_name", "category_path"))).alias("template"))
    wide = wide.join(first, key)
    count = lambda c: F.coalesce(F.col(f"top_{c}.c"), F.lit(0))
    name = lambda c: F.coalesce(F.col(f"top_{c}.v"), F.lit(""))
    values = {"query": clean_text(F.col(key)), "brand": name("b"), "leaf": name("l"), "major": name("m"), "hint": F.col("hint")}
    tests = [
        (F.col("n") < 2, F.col("template"), True, "insufficient_evidence_items"),
        ((count("b") >= 2) & (count("l") >= 2), C.fill(C.SUMMARY_BRAND_LEAF, **values), False, "shared_brand_and_leaf_category"),
        ((count("m") == F.col("n")) & (name("l") != ""), C.fill(C.SUMMARY_MAJOR, **values), False, "shared_major_category"),
        (count("m") >= 2, C.fill(C.SUMMARY_MAJORITY, **values), False, "major_category_majority"),
        (F.col("hint") != "", C.fill(C.SUMMARY_TITLE, **values), False, "common_title_hint"),
        (F.lit(True), F.col("template"), True, "no_summary_signal"),
    ]
    found = F.coalesce(*[F.when(test, F.struct(copy.alias("copy"), F.lit(fell).alias("fallback"), F.lit(why).alias("reason"))) for test, copy, fell, why in tests])
    return wide.select(key, found.alias("f")).select(key, "f.*")


def creative_copy(evidence: DataFrame, key: str = "query") -> DataFrame:
    """key, copy: a sentence on the shared title token (Han, at most 10 characters), else the category, else the item."""
    label = simplify_category(clean_text(F.col("category_path")))
    labels = evidence.where(label != "").groupBy(key).agg(F.min_by(label, "pos").alias("label"))
    titled = evidence.where("pos = 1").select(key, clean_text(F.col("item_title")).alias("title"))
    rows = common_title(evidence, key).join(labels, key, "left").join(titled, key, "left")
    hint = F.when(F.col("hint").rlike(f"[{HAN}]") & (F.char_length("hint") <= 10), F.col("hint"))
    category = F.when(~F.coalesce("label", F.lit("")).isin("", *L.GENERIC_LABELS), F.col("label"))
    values = {"query": clean_text(F.col(key)), "hint": hint, "category": category}
    return rows.select(
        key,
        F.when(hint.isNotNull(), C.fill(C.CREATIVE_TITLE, **values)).when(category.isNotNull(), C.fill(C.CREATIVE_CATEGORY, **values))
        .when(F.coalesce("title", F.lit("")) != "", C.fill(C.CREATIVE_ITEM, **values)).otherwise(C.fill(C.CREATIVE_NONE, **values)).alias("copy"),
    )
