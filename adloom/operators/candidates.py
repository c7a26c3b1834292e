"""Candidate copies: parse, clean, validate, score, rank, choose."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.functions import lexicons as L
from adloom.functions.text import _any, clean_text, suspicious_claims
from adloom.operators.understanding import keep_distinct

COPIES = "copies array<struct<copy:string,strategy:string,used_evidence:array<string>,personalized_tags:array<string>,rationale:string>>"


def parse_generations(generations: DataFrame) -> DataFrame:
    """(query, candidate_id, raw_text) as candidates: every copy of a JSON object, else the first line that is not blank,
    without its label."""
    raw = clean_text(F.col("raw_text"))
    rows = generations.select("query", "candidate_id", raw.alias("raw")).where("raw <> ''").withColumn("copies", F.from_json("raw", COPIES)["copies"])
    empty = F.array().cast("array<string>")
    listed = rows.where("copies is not null").select("query", "candidate_id", F.posexplode("copies").alias("i", "c")).where("c is not null")
    json = listed.select(
        "query", F.concat_ws("_", "candidate_id", (F.col("i") + 1).cast("string")).alias("candidate_id"), clean_text(F.col("c.copy")).alias("text"),
        clean_text(F.col("c.strategy")).alias("strategy"), F.coalesce("c.used_evidence", empty).alias("used_evidence"),
        F.coalesce("c.personalized_tags", empty).alias("personalized_tags"), F.lit("llm_provider_json").alias("source"),
    )
    lines = F.filter(F.transform(F.split("raw", r"\R"), lambda x: F.regexp_replace(clean_text(x), r"^候选\d+[：:]\s*", "")), lambda x: x != "")
    plain = rows.where("copies is null").select(
        "query", "candidate_id", F.coalesce(F.get(lines, F.lit(0)), "raw").alias("text"), F.lit("").alias("strategy"), empty.alias("used_evidence"),
        empty.alias("personalized_tags"), F.lit("llm_provider").alias("source"),
    )
    return json.unionByName(plain)


def clean_candidate(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(clean_text(text), r"^候选\d+[：:]\s*", ""), r"(?U)\s+", ""), F.lit("：:;；"))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Adds issues, is_valid, length and relevance_hits. Columns: text, query_text, brand_hint, category_hint, anchor_title."""
    t = F.col("text")
    rows = candidates.withColumn("text", clean_candidate(t))
    size = F.char_length(t)
    issues = F.array_compact(
        F.array(
            F.when(t == "", "empty"), F.when(size < 12, "too_short"), F.when(size > 60, "too_long"), F.when(_any(t, L.SUMMARY_TONE), "search_summary_tone"),
            *[F.when(F.contains(t, F.lit(w)), f"banned_token:{w}") for w in L.BANNED_TOKENS], F.when(_any(t, L.UNSUPPORTED), "unsupported_claim"),
        )
    )
    named = keep_distinct(F.array("query_text", "brand_hint", "category_hint", "anchor_title"))
    return rows.select("*", issues.alias("issues"), size.alias("length"), F.size(F.filter(named, lambda w: F.contains(t, w))).alias("relevance_hits")).withColumn("is_valid", F.size("issues") == 0)


def _hits(text: Column, words) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def score_candidates(validated: DataFrame) -> DataFrame:
    """Adds validity, relevance, naturalness, brevity and rank_score. Further columns: selling_points, scene_hint, crowd_hint."""
    t, n = F.col("text"), F.char_length("text")
    yes = lambda test, points: F.when(test, points).otherwise(0)
    scenes = _hits(t, L.NATURAL_SCENES)
    evidence = F.size(F.filter("selling_points", lambda w: (w != "") & F.contains(t, w)))
    shown = F.transform("personalized_tags", lambda g: F.element_at(F.split(clean_text(g), "="), -1))
    personal = F.size(F.filter(F.arrays_zip(F.col("personalized_tags").alias("g"), shown.alias("s")), lambda x: (clean_text(x["g"]) != "") & F.contains(t, x["s"])))
    commas = F.regexp_count(t, F.lit("[，、]"))
    title_like = yes(~t.rlike("[，。！？]"), 4) + yes((F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,4}")) >= 6) & (scenes == 0), 4) + yes(_any(t, L.TITLE_WORDS) & (scenes == 0), 3)
    doubled = None
    for a, b in L.DOUBLED:
        test = F.contains(t, F.lit(a)) & F.contains(t, F.lit(b))
        doubled = test if doubled is None else doubled | test
    template = (
        yes(F.contains(t, F.lit("这类")), 4) + yes(F.contains(t, F.lit("更省心")) & (scenes == 0), 3) + yes(_any(t, L.TEMPLATE_WORDS), 6) + yes(commas > 2, (commas - 2) * 3)
        + yes(t.rlike("，[^，。]{1,4}款，"), 4) + yes(doubled, 5) + 2 * _hits(t, L.GENERIC_TAILS) + yes(F.contains(t, F.lit("更顺手")), 2)
    )
    start = lambda c: F.left(F.replace(c, F.lit("_"), F.lit("")), F.lit(2))
    natural = (
        18 + yes(F.contains(t, F.lit("？")), 3) + F.least(F.lit(10), scenes * 4)
        + yes((F.col("scene_hint") != "") & F.contains(t, start("scene_hint")), 3) + yes((F.col("crowd_hint") != "") & F.contains(t, start("crowd_hint")), 2)
        + F.least(F.lit(6), evidence * 3) + F.least(F.lit(4), personal * 2) - title_like - template
    )
    rows = validated.select(
        "*", F.when(F.col("is_valid"), 48).otherwise(F.greatest(F.lit(0), 16 - 8 * F.size("issues"))).alias("validity"), (F.col("relevance_hits") * 8).alias("relevance"),
        natural.alias("naturalness"), F.when(n.between(12, 20), 16).when(n.between(21, 26), 14).when(n.between(27, 30), 8).otherwise(0).alias("brevity"),
    )
    return rows.withColumn("rank_score", F.col("validity") + F.col("relevance") + F.col("naturalness") + F.col("brevity"))


def rank_candidates(scored: DataFrame, key: str = "query") -> DataFrame:
    """Adds rank: highest score, fewest issues, lowest candidate_id."""
    by = Window.partitionBy(key).orderBy(F.desc("rank_score"), F.size("issues"), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(by))


def distinct_candidates(ranked: DataFrame, limit: int = 5, key: str = "query") -> DataFrame:
    """key, text, rank: distinct texts in rank order, at most `limit` a query."""
    first = ranked.groupBy(key, "text").agg(F.min("rank").alias("rank"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("n") <= limit).drop("n")


def _without(text: Column, words) -> Column:
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


def _replaced(*pairs: tuple[str, str]):
    """A step that applies regular-expression replacements in order."""

    def step(t: Column) -> Column:
        for pattern, new in pairs:
            t = F.regexp_replace(t, pattern, new)
        return t

    return step


def _run(text: Column, steps) -> Column:
    """The steps in order. Each binds its input to a name (a one-element array's transform), so that a step may use it often
    while the expression grows by the number of steps only."""
    bound = F.array(text)
    for step in steps:
        bound = F.transform(bound, step)
    return F.get(bound, F.lit(0))


def _cut(limit: int):
    return lambda t: F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit)), F.lit("，。；、 ")), F.lit("。"))).otherwise(t)


def _end_mark(t: Column) -> Column:
    return F.when((t != "") & ~t.rlike("[。！？]$"), F.concat(t, F.lit("。"))).otherwise(t)


def _single_of_pair(a: str, b: str):
    return lambda t: F.when(F.contains(t, F.lit(a)) & F.contains(t, F.lit(b)), _without(t, (f"更{b}", b))).otherwise(t)


_TAIL = "|".join(map(re.escape, L.GENERIC_TAILS))
SANITIZE = (
    lambda t: F.replace(F.replace(clean_text(t), F.lit("“ "), F.lit("“")), F.lit(" ”"), F.lit("”")),
    lambda t: _without(t, (*L.REMOVED_WORDS, *L.REMOVED_FRAGMENTS)),
    lambda t: F.replace(F.replace(t, F.lit("适合使用"), F.lit("更合适")), F.lit("品质好物"), F.lit("")),
    _replaced(
        (r"(?U)\s+", ""), (r"([\x{4e00}-\x{9fa5}]{2,4})\1+", "$1"), ("(更顺手){2,}", "更顺手"), ("(更省心){2,}", "更省心"), ("(刚刚好){2,}", "刚刚好"),
        ("[、，]{2,}", "，"), ("[，。]{2,}", "。"),
    ),
    lambda t: F.trim(t, F.lit("，。；、 ")),
    _cut(32),
    lambda t: F.when((F.char_length(t) < 12) & (t != ""), F.concat(t, F.lit("，日常更顺手。"))).otherwise(t),
    _end_mark,
)
REDUNDANT = (
    *SANITIZE,
    lambda t: F.rtrim(t, F.lit("。")),
    *[_single_of_pair(a, b) for a, b in L.DOUBLED],
    _replaced((f"(，)?({_TAIL})$", ""), (f"(，)?({_TAIL})(，)?({_TAIL})$", ""), ("，日常更顺手$", ""), ("，([^，。]{1,4})款，", "，$1款"), ("[，、]{2,}", "，")),
    lambda t: F.trim(t, F.lit("，、 ")),
    *SANITIZE,
)
REWRITE = (
    lambda t: F.replace(_without(clean_text(t), L.SUMMARY_TONE), F.lit("，，"), F.lit("，")),
    lambda t: F.trim(F.regexp_replace(t, "[，。]{2,}", "。"), F.lit("，。； ")),
    _cut(48),
    _end_mark,
    *REDUNDANT,
)


def sanitize_copy(text: Column) -> Column:
    """Cleaned of listed words, repeats and doubled punctuation; cut to 32 characters, filled up to 12, with an end mark."""
    return _run(text, SANITIZE)


def drop_redundant_tail(text: Column) -> Column:
    """sanitize_copy without one of two words that say the same, and without a generic ending."""
    return _run(text, REDUNDANT)


def rule_rewrite(text: Column) -> Column:
    return _run(text, REWRITE)


def _best_clauses(base: Column) -> Column:
    """The two clauses with most scenes and strong points, then the shortest, then the first."""
    parts = F.filter(F.transform(F.split(base, "[，、]"), F.trim), lambda p: p != "")

    def key(p: Column, i: Column) -> Column:
        score = F.when(_any(p, L.NATURAL_SCENES), 4).otherwise(0) + F.when(_any(p, L.STRONG_POINTS), 3).otherwise(0) - F.when(F.contains(p, F.lit("更")), 1).otherwise(0)
        return F.struct((-score).alias("s"), F.char_length(p).alias("n"), i.alias("i"), p.alias("p"))

    best = F.slice(F.sort_array(F.transform(parts, key)), 1, 2)
    return F.array_join(F.transform(best, lambda x: x["p"]), "，")


def compress_copy(text: Column) -> Column:
    """A copy of over 28 characters becomes its two best clauses."""
    first_clause = lambda t: F.when((F.char_length(F.rtrim(t, F.lit("。"))) > 26) & F.contains(t, F.lit("，")), F.substring_index(t, "，", 1)).otherwise(t)
    shorten = (_best_clauses, _replaced(("(一个包)够用", "$1就够用"), ("(防摔)贴手都在线", "$1手感都兼顾")), *REDUNDANT, first_clause, *SANITIZE)
    whole = lambda t: F.when(F.char_length(t) <= 28, _run(t, SANITIZE)).otherwise(_run(t, shorten))
    return _run(text, (*REDUNDANT, lambda t: F.rtrim(t, F.lit("。")), whole))


def choose_final_copy(top: DataFrame) -> DataFrame:
    """Adds final_copy, final_source, rewrite_reason to one row per query: the top candidate (text, issues; null if none) and the
    texts summary, summary_reason, creative, template. Rewrites are stored columns first, as their rules are long."""
    rows = top.withColumn("once", rule_rewrite(F.col("text")))
    long = F.char_length(F.rtrim(F.col("once"), F.lit("。"))) > 28
    rows = rows.withColumn("rewritten", F.when(long, compress_copy(F.col("once"))).otherwise(F.col("once")))
    new = F.col("rewritten")
    clean = (F.size("issues") == 0) & (new != "")
    fixable = (F.char_length(new) >= 12) & ~F.array_contains("issues", "unsupported_claim")
    pick = lambda copy, source, why: F.struct(copy.alias("final_copy"), F.lit(source).alias("final_source"), why.alias("rewrite_reason"))
    chosen = (
        F.when(F.col("text").isNull(), pick(F.col("summary"), "summary_fallback", F.lit("empty_ranker_result_then_summary_fallback")))
        .when(clean, pick(new, "llm_ranker_top1", F.lit("top_candidate_kept")))
        .when(fixable, pick(new, "llm_rule_rewrite", F.lit("rule_rewrite_from_invalid_candidate")))
        .when(clean_text(F.col("summary")) != "", pick(F.col("summary"), "summary_fallback", F.concat(F.lit("summary_fallback:"), F.coalesce("summary_reason", F.lit("unknown")))))
        .when(F.coalesce("creative", F.lit("")) != "", pick(F.col("creative"), "creative_template_fallback", F.lit("creative_template_fallback")))
        .otherwise(pick(F.col("template"), "template_fallback", F.lit("template_fallback")))
    )
    return rows.select(*top.columns, chosen.alias("f")).select(*top.columns, "f.*")


def flatten_outcome(chosen: DataFrame, provider_fallback: str = "provider_fallback") -> DataFrame:
    """One reporting row per query: fallback_triggered if the provider fell back or the copy is not the top candidate's."""
    fell = F.coalesce(F.col(provider_fallback), F.lit(False)) | (F.col("final_source") != "llm_ranker_top1")
    return chosen.select("query", "final_copy", "final_source", "rewrite_reason", fell.alias("fallback_triggered"), F.when(fell, F.col("rewrite_reason")).otherwise("").alias("fallback_reason"), suspicious_claims(F.col("final_copy")).alias("suspicious_claims"))


def backfill_generations(generations: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(query, place, text) with empty or repeated texts replaced by synthetic (query, place, copy) ones; adds status.

    All texts empty: all replaced. All non-empty texts equal: empty slots and repeats are replaced. Else texts stay.
    """
    t = clean_text(F.col("text"))
    rows = generations.withColumn("t", t)
    whole = rows.groupBy("query").agg(F.sum((F.col("t") != "").cast("int")).alias("n_text"), F.count_distinct(F.nullif("t", F.lit(""))).alias("n_distinct"), F.min(F.when(F.col("t") != "", F.col("place"))).alias("first"), F.count("*").alias("n"))
    met = rows.join(whole, "query").join(synthetic.select("query", "place", "copy"), ["query", "place"], "left")
    none, equal = F.col("n_text") == 0, (F.col("n_distinct") == 1) & (F.col("n") > 1)
    replace = none | (equal & ((F.col("t") == "") | (F.col("place") != F.col("first"))))
    status = F.when(none, "synthetic_candidates").when(equal | (F.col("n_text") < F.col("n")), "provider_partial").otherwise("provider_ok")
    return met.select("query", "place", F.when(replace, F.coalesce("copy", "t")).otherwise(F.col("t")).alias("text"), status.alias("status"), (status != "provider_ok").alias("fallback"))


def assign_copies(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """query, item_id, candidate_id, how for items (query, item_id, pos) and candidates (query, candidate_id, rank_score,
    used_evidence): the best candidate that cites the item (linked), else the next unused candidate by score (distributed),
    else the top candidate (fallback), else none."""
    cited = candidates.select("query", "candidate_id", "rank_score", F.explode(F.array_distinct("used_evidence")).alias("cited"))
    order = F.struct((-F.col("rank_score")).alias("s"), "candidate_id")
    linked = items.join(cited, (items["query"] == cited["query"]) & (items["item_id"].cast("string") == cited["cited"])).groupBy(items["query"], "item_id").agg(F.min(order)["candidate_id"].alias("candidate_id")).withColumn("how", F.lit("linked"))
    left = items.join(linked.select("query", "item_id"), ["query", "item_id"], "left_anti")
    unused = candidates.join(linked.select("query", "candidate_id").distinct(), ["query", "candidate_id"], "left_anti")
    turn = lambda *by: F.row_number().over(Window.partitionBy("query").orderBy(*by))
    dealt = left.withColumn("turn", turn("pos", "item_id")).join(unused.select("query", "candidate_id", turn(F.desc("rank_score"), "candidate_id").alias("turn")), ["query", "turn"], "left")
    top = candidates.groupBy("query").agg(F.min(order)["candidate_id"].alias("top_id"))
    rest = dealt.join(top, "query", "left").select("query", "item_id", F.coalesce("candidate_id", "top_id").alias("candidate_id"), F.when(F.col("candidate_id").isNotNull(), "distributed").when(F.col("top_id").isNotNull(), "fallback").otherwise("none").alias("how"))
    return linked.unionByName(rest)
