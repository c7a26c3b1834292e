"""Chat training sets, evaluation samples and their statistics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.functions import lexicons as L
from adloom.functions.copies import template_copy
from adloom.functions.prompts import chat_user_content, evidence_block, user_context
from adloom.functions.text import clean_text, normalize_query, query_too_noisy, related_to_evidence, suspicious_claims, tag_all_matches, tag_first_match
from adloom.operators.understanding import summary_copy
from adloom.sources.stored import stored

# System message of chat samples.
SYSTEM_PROMPT = "你是电商搜索广告创意生成助手。请基于用户搜索意图、用户画像和商品证据，生成自然、短促、合规的广告文案。不得编造证据中没有的信息。"
# Last line of a chat sample's request.
CHAT_REQUEST = "请生成1条自然广告文案。"
# Quotas of an evaluation set by query length and evidence strength.
QUOTAS = {("short", "high"): 20, ("short", "low"): 20, ("medium", "high"): 30, ("medium", "low"): 30, ("long", "high"): 10, ("long", "low"): 10}
FILLED = 6


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pairs_to_chat(pairs: DataFrame, max_samples: int | None = None, k: int = 3) -> DataFrame:
    """messages and metadata of pairs with a copy, the first max_samples in seq."""
    rows = pairs.where(clean_text(F.col("target_copy")) != "")
    if max_samples is not None:
        rows = rows.orderBy("seq").limit(max_samples)
    user = chat_user_content(F.col("query"), F.col("user_profile"), F.col("recent_behavior_titles"), F.slice("evidence_items", 1, k))
    meta = F.struct(clean_text(F.col("query")).alias("query"), "user_id", "session_id", F.lit("template_pseudo_label").alias("source"))
    return rows.select(
        F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user), message("assistant", clean_text(F.col("target_copy")))).alias("messages"),
        meta.alias("metadata"),
    )


def intent_text(intent: Column) -> Column:
    """A line for each part of an intent that is there; five attributes at most."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    parts = [line(label, clean_text(intent[c])) for label, c in (("意图总结：", "intent_summary"), ("场景：", "scenario"), ("人群：", "audience"), ("关注点：", "purchase_focus"))]
    hints = F.filter(F.transform(F.coalesce(intent["attribute_hints"], F.array().cast("array<string>")), clean_text), lambda x: x != "")
    return F.concat_ws("\n", *parts, line("属性提示：", F.array_join(F.slice(hints, 1, 5), "、")))


def outcomes_to_chat(outcomes: DataFrame) -> DataFrame:
    """Accepted pipeline rows as chat samples: messages and metadata (query, provider, score, evidence_confidence, quality_tags).

    Columns: query, intent (struct), user_profile (struct), recent_behavior_titles, selected_evidence and style_examples
    (arrays), final_copy, final_source, provider, llm_status, retrieval_source, rewritten, score. A part without text
    says "(empty)"; five style examples at most are numbered.
    """
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(empty)"))
    none = F.array().cast("array<string>")
    styles = F.filter(F.transform(F.coalesce("style_examples", none), clean_text), lambda x: x != "")
    numbered = F.array_join(F.transform(F.slice(styles, 1, 5), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    body = F.concat_ws(
        "\n", F.concat(F.lit("Query: "), clean_text(F.col("query"))), F.concat(F.lit("Intent: "), intent_text(F.col("intent"))),
        F.concat(F.lit("User Profile: "), shown(user_context(F.col("user_profile"), F.col("recent_behavior_titles")))),
        F.concat(F.lit("Evidence: "), shown(evidence_block(F.col("selected_evidence")))), F.concat(F.lit("Style Examples: "), shown(numbered)), F.lit(CHAT_REQUEST),
    )
    confidence = evidence_confidence(clean_text(F.col("retrieval_source")), F.coalesce(F.size("selected_evidence"), F.lit(0)))
    tags = quality_tags(F.col("provider"), clean_text(F.col("llm_status")), clean_text(F.col("final_source")), confidence, F.size(styles), F.coalesce("rewritten", F.lit(False)))
    score = F.round(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), 2)
    meta = F.struct(clean_text(F.col("query")).alias("query"), "provider", score.alias("score"), confidence.alias("evidence_confidence"), tags.alias("quality_tags"))
    return outcomes.select(F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", body), message("assistant", clean_text(F.col("final_copy")))).alias("messages"), meta.alias("metadata"))


def is_template_like(copy: Column) -> Column:
    text = clean_text(copy)
    return (F.size(tag_all_matches(text, L.TEMPLATE_PATTERNS)) > 0) | (F.contains(text, F.lit("搜“")) & F.contains(text, F.lit("推荐看看这款")))


def filter_reason(min_score: float = 80.0, provider: str = "deepseek_chat") -> Column:
    """The first rule that an outcome breaks, else null. Columns: query, llm_status, top_valid, top_issues, final_source,
    final_copy, rank_score, evidence_texts, candidate_source, rewrite_reason."""
    good = {"deepseek_chat": "provider_ok", "local_fake": "local_fake_json_ok"}[provider]
    copy, size = clean_text(F.col("final_copy")), F.char_length(clean_text(F.col("final_copy")))
    return (
        F.when(query_too_noisy(F.col("query")), "query_too_noisy")
        .when(F.coalesce("llm_status", F.lit("")) != good, "provider_not_ok")
        .when(~F.coalesce("top_valid", F.lit(False)) | (F.coalesce(F.size("top_issues"), F.lit(0)) > 0), "validator_invalid")
        .when(F.col("final_source").isin("summary_fallback", "creative_template_fallback", "template_fallback"), "fallback_copy_source")
        .when(F.size(suspicious_claims(copy)) > 0, "suspicious_claims")
        .when(F.coalesce("rank_score", F.lit(0.0)) < min_score, "score_below_min")
        .when((size < 12) | (size > 40), "copy_length_out_of_range")
        .when(is_template_like(copy), "template_like")
        .when(~related_to_evidence(copy, F.col("query"), F.col("evidence_texts")), "unrelated_to_evidence")
        .when((F.col("candidate_source") == "llm_rule_rewrite") & (size < 14), "rewritten_copy_too_short")
        .when(F.col("rewrite_reason") == "rule_rewrite_from_invalid_candidate", "validator_invalid")
    )


def funnel_counts(outcomes: DataFrame, reason: str = "reason") -> DataFrame:
    """outcome, n: accepted rows, and filtered rows by reason."""
    return outcomes.groupBy(F.coalesce(reason, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


#: Every rule of filter_reason, and the other outcomes of a run.
REASONS = (
    "query_too_noisy", "provider_not_ok", "validator_invalid", "fallback_copy_source", "suspicious_claims", "score_below_min", "copy_length_out_of_range",
    "template_like", "unrelated_to_evidence", "rewritten_copy_too_short",
)


def funnel_status(outcomes: DataFrame, target: int, max_source: int, done: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """order, query, kind, why of every outcome (query, error, reason) that a run looks at.

    The run takes rows in order, at most max_source, and ends with the target-th accepted one. A row is filtered
    (empty_query, or its reason), skipped if its query was accepted before (duplicate_query) or is in `done`
    (resume_existing_query), an error (its text, cut to 80 characters), or accepted.
    """
    query = clean_text(F.col("query"))
    rows = outcomes.withColumn("query", query).orderBy(order).limit(max_source)
    good = (F.col("query") != "") & (F.coalesce("error", F.lit("")) == "") & F.col("reason").isNull()
    if done is not None:
        known = done.select(clean_text(F.col("query")).alias("query"), F.lit(True).alias("known")).distinct()
        rows = rows.join(known, "query", "left")
    else:
        rows = rows.withColumn("known", F.lit(False))
    known = F.coalesce("known", F.lit(False))
    rows = rows.withColumn("first", F.min(F.when(good & ~known, F.col(order))).over(Window.partitionBy("query")))
    again = F.coalesce(F.col("first") < F.col(order), F.lit(False))
    kind = (
        F.when(F.col("query") == "", "filtered").when(known | again, "skipped").when(F.coalesce("error", F.lit("")) != "", "error")
        .when(F.col("reason").isNotNull(), "filtered").otherwise("accepted")
    )
    why = (
        F.when(F.col("query") == "", "empty_query").when(known, "resume_existing_query").when(again, "duplicate_query")
        .when(F.coalesce("error", F.lit("")) != "", F.left("error", F.lit(80))).otherwise(F.coalesce("reason", F.lit("")))
    )
    judged = rows.select(order, "query", kind.alias("kind"), why.alias("why"))
    # max_source rows at most, ranked once
    place = F.sum((F.col("kind") == "accepted").cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return judged.withColumn("before", F.coalesce(place, F.lit(0))).where(F.col("before") < target).drop("before")


def observed_funnel(statuses: DataFrame) -> tuple[DataFrame, Observation]:
    """The accepted rows, and counts that are ready when they have been written: one pass gives both. Errors count as one."""
    whys = [("accepted", ""), ("filtered", "empty_query"), *[("filtered", r) for r in REASONS], ("skipped", "duplicate_query"), ("skipped", "resume_existing_query")]
    same = lambda kind, why: F.count_if((F.col("kind") == kind) & (F.col("why") == why))
    counts = [same(*w).alias("|".join(w)) for w in whys] + [F.count_if(F.col("kind") == "error").alias("error|"), F.count("*").alias("scanned|")]
    texts = F.collect_set(F.when(F.col("kind") == "error", F.col("why"))).alias("errors")
    seen = Observation(f"funnel-{uuid.uuid4().hex}")
    return statuses.observe(seen, *counts, texts).where("kind = 'accepted'"), seen


def funnel_table(seen: Observation) -> list[tuple[str, str, int]]:
    """(kind, why, n) of an observed run, zeros left out; errors under their text if there is only one."""
    found = dict(seen.get)
    errors = found.pop("errors")
    rows = [(*name.split("|"), n) for name, n in found.items() if n or name == "scanned|"]
    return [(kind, errors[0] if kind == "error" and len(errors) == 1 else why, n) for kind, why, n in rows]


def accept_first_n(outcomes: DataFrame, target: int, max_source: int, order: str = "seq") -> DataFrame:
    """The first `target` accepted rows (reason is null) among the first max_source rows in order; empty queries and
    queries accepted before are skipped."""
    scanned = outcomes.orderBy(order).limit(max_source)
    kept = scanned.where(F.col("reason").isNull() & (clean_text(F.col("query")) != ""))
    first = Window.partitionBy("query").orderBy(order)
    return kept.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn").orderBy(order).limit(target)


def resume_anti(rows: DataFrame, done: DataFrame, key: str = "query") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def evidence_confidence(source: Column, n_evidence: Column) -> Column:
    high = source.isin(*L.HIGH_CONFIDENCE)
    return (
        F.when(high & (n_evidence >= 2), "high").when(high | source.isin(*L.MEDIUM_CONFIDENCE), "medium").when(n_evidence > 0, "low").otherwise("very_low")
    )


def quality_tags(provider: Column, status: Column, source: Column, confidence: Column, n_styles: Column, rewritten: Column) -> Column:
    named = lambda p, c: F.concat(F.lit(p), c)
    return F.array(
        named("provider_", provider), named("llm_status_", status), named("final_source_", source), named("evidence_", confidence),
        F.when(n_styles > 0, "style_conditioned").otherwise("style_unconditioned"),
        F.when(rewritten, "rewritten").otherwise("direct_rank_top1"),
    )


def validate_chat(samples: DataFrame) -> DataFrame:
    """Adds errors (array, empty if valid), training_text and assistant_length. The last message of a role counts.

    samples: messages array<struct<role, content>>, metadata struct.
    """
    role = lambda r: F.filter("messages", lambda m: F.trim(F.coalesce(m["role"], F.lit(""))) == r)
    last = lambda r: F.get(role(r), F.size(role(r)) - 1)["content"]
    text = lambda r: F.coalesce(last(r), F.lit(""))
    no_messages = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    keys = [k for k in ("provider", "score", "evidence_confidence") if k not in samples.schema["metadata"].dataType.fieldNames()]
    found = F.array_compact(
        F.array(
            *[F.when(F.size(role(r)) == 0, f"missing_{r}") for r in ("system", "user", "assistant")],
            F.when(F.trim(text("assistant")) == "", "empty_assistant"),
            *[F.lit(f"missing_metadata_{k}") for k in keys],
        )
    )
    errors = F.when(no_messages, F.array(F.lit("missing_messages"))).when(F.col("metadata").isNull(), F.array(F.lit("missing_metadata"))).otherwise(found)
    whole = F.concat_ws("\n", F.lit("<|system|>"), text("system"), F.lit("<|user|>"), text("user"), F.lit("<|assistant|>"), text("assistant"))
    return samples.select("*", errors.alias("errors"), whole.alias("training_text"), F.char_length(F.trim(text("assistant"))).alias("assistant_length"))


def chat_stats(validated: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, mean length of valid assistants and, if metadata has a score, its mean over them."""
    valid = F.size("errors") == 0
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(valid, F.col(c))), 2), F.lit(0.0))
    scored = "score" in validated.schema["metadata"].dataType.fieldNames()
    return validated.agg(
        F.count("*").alias("total_samples"),
        F.coalesce(F.sum(valid.cast("int")), F.lit(0)).alias("valid_samples"),
        F.coalesce(F.sum((~valid).cast("int")), F.lit(0)).alias("invalid_samples"),
        mean("assistant_length").alias("avg_assistant_length"),
        *([mean("metadata.score").alias("avg_score")] if scored else []),
    )


def chat_distributions(validated: DataFrame) -> DataFrame:
    """field, value, n: provider and evidence_confidence of the valid samples, invalid_reason once per error; one aggregate."""
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), F.coalesce(value, F.lit("")).alias("value"))
    kept = F.array(*[pair(c, F.col(f"metadata.{c}")) for c in ("provider", "evidence_confidence")])
    pairs = F.when(F.size("errors") == 0, kept).otherwise(F.transform("errors", lambda e: pair("invalid_reason", e)))
    return validated.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def invalid_reasons(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def field_hits() -> Column:
    """How many of an evidence row's six fields are filled."""
    brand = F.lower(F.trim(F.coalesce("brand_name", F.lit(""))))
    there = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("int")
    return (
        there("item_title") + there("category_path") + (~brand.isin(*L.PLACEHOLDER_BRANDS_SCORE)).cast("int") + there("seller_name")
        + F.col("ranking_signal").isNotNull().cast("int") + F.col("relevance_signal").isNotNull().cast("int")
    )


def evidence_score(evidence: DataFrame, k: int = 3, key: str = "query") -> DataFrame:
    """key, evidence_score (filled fields of the first k rows over 6k) and evidence_strength."""
    hits = evidence.where(F.col("pos") <= k).groupBy(key).agg(F.sum(field_hits()).alias("hits"))
    score = F.col("hits") / F.lit(float(FILLED * max(1, k)))
    return hits.select(key, score.alias("evidence_score"), F.when(score >= 0.75, "high").otherwise("low").alias("evidence_strength"))


def query_category(evidence: DataFrame, key: str = "query", k: int = 3, lexicon=L.QUERY_CATEGORIES) -> DataFrame:
    """key, query_category of the query and the paths and titles of its first k evidence rows."""
    texts = evidence.where(F.col("pos") <= k).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "category_path", "item_title").alias("t")))).alias("found"))
    return texts.select(key, tag_first_match(F.concat_ws(" ", key, F.transform("found", lambda x: x["t"])), lexicon).alias("query_category"))


def candidate_pool(pairs: DataFrame, evidence: DataFrame, k: int = 3, lexicon=L.QUERY_CATEGORIES) -> DataFrame:
    """One row per normalized query with evidence (its first pair in seq): query, normalized_query, query_bucket, query_len,
    evidence_score, evidence_strength, query_category."""
    from adloom.functions.text import length_bucket

    rated = pairs.select("query", "seq").join(evidence_score(evidence, k), "query").join(query_category(evidence, "query", k, lexicon), "query")
    rated = rated.withColumn("normalized_query", normalize_query(F.col("query"))).where("normalized_query <> ''")
    first = rated.groupBy("normalized_query").agg(F.min_by(F.struct("query", "evidence_score", "evidence_strength", "query_category"), "seq").alias("kept"))
    return first.select("normalized_query", "kept.*", length_bucket(F.col("normalized_query")).alias("query_bucket"), F.char_length("normalized_query").alias("query_len"))


#: Cells of the hash that a stratum's histogram counts.
CELLS = 1 << 16


def stratified_sample(pool: DataFrame, quotas: dict[tuple[str, str], int] | None = None, strata: tuple[str, str] = ("query_bucket", "evidence_strength"), key: str = "normalized_query", seed: int = 42, strict: bool = True) -> DataFrame:
    """Per stratum the `quota` rows with the smallest md5 of seed and key, with `picked` from 1. strict: a stratum with fewer
    rows fails the job.

    The pool is stored and counted once, by the first 16 bits of the md5. That histogram says in which cell a stratum's
    quota is full; rows of later cells go without being ranked, so only about the quota is sorted, however large the pool.
    """
    quotas = QUOTAS if quotas is None else quotas
    spark = pool.sparkSession
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    pool = stored(pool.withColumn("mark", mark).withColumn("cell", F.conv(F.left("mark", F.lit(4)), 16, 10).cast("int")), "pool")
    table = spark.createDataFrame([(a, b, n) for (a, b), n in quotas.items()], f"{strata[0]} string, {strata[1]} string, quota int")
    histogram = pool.groupBy(*strata, "cell").agg(F.count("*").alias("n")).join(F.broadcast(table), list(strata))
    held = histogram.withColumn("held", F.sum("n").over(Window.partitionBy(*strata).orderBy("cell")))
    full = held.groupBy(*strata).agg(F.min(F.when(F.col("held") >= F.col("quota"), F.col("cell"))).alias("last"), F.sum("n").alias("n"))
    limits = table.join(full, list(strata), "left").select(*strata, "quota", F.coalesce("last", F.lit(CELLS)).alias("last"), F.coalesce("n", F.lit(0)).alias("n")).collect()  # one row a stratum
    short = [r for r in limits if r["n"] < r["quota"]]
    if strict and short:
        raise ValueError("strata with too few rows: " + ", ".join(f"{r[0]}/{r[1]} {r['n']} of {r['quota']}" for r in short))
    limits = spark.createDataFrame([tuple(r[:4]) for r in limits], f"{strata[0]} string, {strata[1]} string, quota int, last int")
    near = pool.join(F.broadcast(limits), list(strata)).where("cell <= last")
    ranked = near.withColumn("picked", F.row_number().over(Window.partitionBy(*strata).orderBy("mark", key))).where("picked <= quota")
    return ranked.drop("quota", "last", "mark", "cell")


def distribution(rows: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """value, n: counts of a field, zero for listed values that do not occur, other values after them."""
    listed = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "place int, value string")
    counts = rows.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(listed), "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(keys))).alias("place"))


def number_samples(sample: DataFrame, orders: dict[str, Sequence[str]], then: Sequence[str] = ("query_category", "normalized_query"), prefix: str = "v5eval") -> DataFrame:
    """Adds sample_no from 1 and sample_id: by the listed order of each field in `orders`, then by the fields of `then`.

    A sample is as large as its quotas add up to, so one window numbers it.
    """
    places = [F.array_position(F.array(*map(F.lit, values)), F.col(field)) for field, values in orders.items()]
    numbered = sample.withColumn("sample_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*places, *then)))
    return numbered.withColumn("sample_id", F.format_string(f"{prefix}_%03d", "sample_no"))


def domain_sample(pool: DataFrame, quotas: dict[tuple[str, str], int], orders: dict[str, Sequence[str]], least: int = 30, size: int | None = None, then: Sequence[str] = ("normalized_query",)) -> DataFrame:
    """The sample of every (domain, length) in order, with sample_no; its first `size` rows. Fewer than `least` rows in all
    are an error."""
    sample = stored(number_samples(stratified_sample(pool, quotas, tuple(orders), strict=False), orders, then, "case"), "sample")
    found = sample.count()  # at most the quotas' sum
    if found < least:
        raise ValueError(f"only {found} samples of at least {least}")
    return sample if size is None else sample.where(F.col("sample_no") <= size)


def eval_distributions(records: DataFrame, listed: dict[str, Sequence[str]], quotas: dict[tuple[str, str], int], strata: tuple[str, str] = ("query_bucket", "evidence_strength")) -> DataFrame:
    """field, value, n, place, requested of evaluation records in one aggregate.

    Fields are those of `listed`, whose values come with their place (from 0) even where n is 0, other values without a
    place; and `quota`, with one value per stratum ("short-high") and the requested number beside the actual one.
    """
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), F.coalesce(value, F.lit("")).alias("value"))
    pairs = F.array(pair("quota", F.concat_ws("-", *strata)), *[pair(c, F.col(c).cast("string")) for c in listed])
    counts = records.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))
    keys = [(f, v, i, None) for f, values in listed.items() for i, v in enumerate(values)]
    keys += [("quota", f"{a}-{b}", i, quotas[a, b]) for i, (a, b) in enumerate(sorted(quotas))]
    table = records.sparkSession.createDataFrame(keys, "field string, value string, place int, requested int")
    return counts.join(table, ["field", "value"], "full").select("field", "value", F.coalesce("n", F.lit(0)).alias("n"), "place", "requested")


def eval_summary(records: DataFrame) -> DataFrame:
    """One row: total_samples, fallback_triggered_count, fallback_triggered_ratio (0 without records)."""
    fallback = F.coalesce("fallback", F.lit(False)).cast("int")
    return records.agg(
        F.count("*").alias("total_samples"),
        F.coalesce(F.sum(fallback), F.lit(0)).alias("fallback_triggered_count"),
        F.coalesce(F.round(F.avg(fallback), 4), F.lit(0.0)).alias("fallback_triggered_ratio"),
    )


def eval_records(planned: DataFrame, outcomes: DataFrame, evidence: DataFrame, k: int = 3, lexicon=L.QUERY_CATEGORIES) -> DataFrame:
    """Planned samples with their outcomes; score, strength and category come from the evidence selected there."""
    base = planned.drop("evidence_score", "evidence_strength", "query_category")
    return base.join(outcomes, "query").join(evidence_score(evidence, k), "query", "left").join(query_category(evidence, "query", k, lexicon), "query", "left")


def replay_baselines(requests: DataFrame, evidence: DataFrame, llm: DataFrame, pipeline: DataFrame) -> DataFrame:
    """query, baseline, copy, fallback, reason, retrieval_source, llm_provider, llm_status, provider, model: the same requests
    through five baselines.

    requests: query, user_id, session_id. evidence: query, pos and item fields; a request takes the evidence of the first
    query (by text) with its normalized form, and it is an error if there is none. template_top1 and template_personalized
    show the first item (the latter names the tier of user, session or query), summary_topk sums up all items. llm and
    pipeline are given texts (query, copy, provider, model, status); a request without one falls back to the template.
    """
    asked = requests.select("query", "user_id", "session_id").dropDuplicates(["query"]).withColumn("norm_query", normalize_query(F.col("query")))
    known = evidence.select(F.col("query").alias("pair_query")).distinct().groupBy(normalize_query(F.col("pair_query")).alias("norm_query")).agg(F.min("pair_query").alias("pair_query"))
    paired = asked.join(known, "norm_query", "left")
    missing = F.raise_error(F.concat(F.lit("no pair for query: "), F.col("query")))
    paired = paired.withColumn("pair_query", F.when(F.col("pair_query").isNull(), missing).otherwise(F.col("pair_query")))
    shown = paired.select("query", "pair_query").join(evidence.withColumnRenamed("query", "pair_query"), "pair_query").drop("pair_query")
    shown = stored(shown, "shown")
    tier = F.when(F.col("user_id").isNotNull(), "train_pairs_user_exact").when(F.col("session_id").isNotNull(), "train_pairs_session_exact").otherwise("train_pairs_query_exact")
    first = shown.where("pos = 1").select("query", template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path"))).alias("template"))
    # the left side is every paired request, so that a missing pair is met
    base = stored(paired.select("query", "pair_query", tier.alias("tier")).join(first, "query", "left").where("pair_query is not null"), "paired")
    none = F.lit("")

    def branch(rows: DataFrame, name: str, copy: Column, fallback: Column, reason: Column, source: Column, *llm_fields: Column) -> DataFrame:
        fields = [*llm_fields, *[none] * (4 - len(llm_fields))]
        named = [f.alias(n) for f, n in zip(fields, ("llm_provider", "llm_status", "provider", "model"), strict=True)]
        return rows.select("query", F.lit(name).alias("baseline"), copy.alias("copy"), fallback.alias("fallback"), reason.alias("reason"), source.alias("retrieval_source"), *named)

    def given(texts: DataFrame, name: str) -> DataFrame:
        rows = base.join(texts.select("query", "copy", F.col("provider").alias("p"), F.col("model").alias("m"), F.col("status").alias("s")), "query", "left")
        absent = clean_text(F.col("copy")) == ""
        fields = [F.coalesce(c, none) for c in ("p", "s", "p", "m")]
        return branch(rows, name, F.when(absent, F.col("template")).otherwise(F.col("copy")), absent, F.when(absent, "no_text_given").otherwise(""), F.col("tier"), *fields)

    no = F.lit(False)
    summed = base.join(summary_copy(shown), "query")
    return (
        branch(base, "template_top1", F.col("template"), no, none, F.lit("train_pairs_query_exact"))
        .unionByName(branch(base, "template_personalized", F.col("template"), no, none, F.col("tier")))
        .unionByName(branch(summed, "summary_topk", F.col("copy"), F.col("fallback"), F.when(F.col("fallback"), F.col("reason")).otherwise(""), F.col("tier")))
        .unionByName(given(llm, "llm_topk"))
        .unionByName(given(pipeline, "full_pipeline"))
    )


def baseline_distributions(rows: DataFrame) -> DataFrame:
    """baseline, field, value, n of replayed rows: fallback reason, llm provider, llm status, provider and model; blanks left out."""
    fields = {"fallback_reason": "reason", "llm_provider": "llm_provider", "llm_status": "llm_status", "provider": "provider", "model": "model"}
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(c, F.lit("")).alias("value")) for name, c in fields.items()])
    return rows.select("baseline", F.inline(pairs)).where("value <> ''").groupBy("baseline", "field", "value").agg(F.count("*").alias("n"))


def baseline_summary(rows: DataFrame) -> DataFrame:
    """Per baseline of (baseline, copy, fallback): n, n_non_empty, n_fallback, fallback_ratio."""
    fallback = F.coalesce("fallback", F.lit(False)).cast("int")
    return rows.groupBy("baseline").agg(
        F.count("*").alias("n"),
        F.sum((clean_text(F.col("copy")) != "").cast("int")).alias("n_non_empty"),
        F.sum(fallback).alias("n_fallback"),
        F.round(F.avg(fallback), 4).alias("fallback_ratio"),
    )


def compare_baselines(rows: DataFrame, one: str, other: str, key: str = "query") -> DataFrame:
    """One row: samples that both baselines have, and how many of them have different copies."""
    wide = rows.where(F.col("baseline").isin(one, other)).groupBy(key).pivot("baseline", [one, other]).agg(F.first("copy"))
    both = wide.where(F.col(f"`{one}`").isNotNull() & F.col(f"`{other}`").isNotNull())
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(f"`{one}`") != F.col(f"`{other}`")).cast("int")), F.lit(0)).alias("n_different"))


def comparison_summary(rows: DataFrame, key: str = "query") -> DataFrame:
    """One row of replayed baselines: n_samples, fallbacks and their ratios of summary and model, and how many samples have
    different copies: personalised against plain template, model against summary and against template."""
    named = {"template": "template_top1", "personalized": "template_personalized", "summary": "summary_topk", "llm": "llm_topk"}
    of = lambda name, c: F.max(F.when(F.col("baseline") == named[name], F.col(c)))
    wide = rows.groupBy(key).agg(*[of(n, "copy").alias(n) for n in named], *[of(n, "fallback").alias(f"{n}_fell") for n in ("summary", "llm")])
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    ratio = lambda c: F.coalesce(F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4), F.lit(0.0))
    differ = lambda a, b: F.col(a) != F.col(b)
    return wide.agg(
        F.count("*").alias("n_samples"),
        count(F.col("summary_fell")).alias("summary_fallback_count"),
        ratio(F.col("summary_fell")).alias("summary_fallback_ratio"),
        count(F.col("llm_fell")).alias("llm_fallback_count"),
        ratio(F.col("llm_fell")).alias("llm_fallback_ratio"),
        count(differ("template", "personalized")).alias("personalized_changed"),
        count(differ("llm", "summary")).alias("llm_vs_summary_changed"),
        count(differ("llm", "template")).alias("llm_vs_template_changed"),
    )


def compare_providers(rows: DataFrame, one: str, other: str, key: str = "query") -> DataFrame:
    """query, the two copies and what is to be seen: same, first longer, second longer, only one."""
    wide = rows.where(F.col("provider").isin(one, other)).groupBy(key).pivot("provider", [one, other]).agg(F.first("copy")).select(key, F.col(f"`{one}`").alias("first_copy"), F.col(f"`{other}`").alias("second_copy"))
    a, b = F.col("first_copy"), F.col("second_copy")
    seen = F.when(a.isNull() | b.isNull(), "only_one").when(a == b, "same").when(F.char_length(a) > F.char_length(b), "first_longer").when(F.char_length(a) < F.char_length(b), "second_longer").otherwise("same_length")
    return wide.withColumn("observation", seen)


def provider_rows(rows: DataFrame, *more: str) -> DataFrame:
    """query, the columns of `more`, provider, model, llm_status, fallback, copy, copy_length, is_bad_copy, claims: what each model gave.

    A copy is bad if it is blank or reads like a search result; claims are the listed words that it contains.
    """
    copy = clean_text(F.col("copy"))
    bad = (copy == "") | (F.size(tag_all_matches(copy, L.BAD_COPY_PATTERNS)) > 0)
    return rows.select(
        "query", *more, "provider", "model", "llm_status", F.coalesce("fallback", F.lit(False)).alias("fallback"), copy.alias("copy"),
        F.char_length(copy).alias("copy_length"), bad.alias("is_bad_copy"), tag_all_matches(copy, L.COMPARED_CLAIMS).alias("claims"),
    )


def bad_copy_gate(copy: Column, rewritten: Column, fallback: Column) -> Column:
    """struct<copy, status, reason>: a copy that reads like a search result is replaced by its rewrite, else by the fallback."""
    first = lambda c: F.get(tag_all_matches(c, L.BAD_COPY_PATTERNS), F.lit(0))
    ok, ok_again = first(copy).isNull(), first(rewritten).isNull() & (clean_text(rewritten) != "")
    pick = lambda a, b, c: F.when(ok, a).when(ok_again, b).otherwise(c)
    none = F.lit("")
    return F.struct(
        pick(copy, rewritten, fallback).alias("copy"), pick(F.lit("ok"), F.lit("rewritten"), F.lit("fallback")).alias("status"), pick(none, first(copy), first(copy)).alias("reason")
    )


def gated_copies(rows: DataFrame) -> DataFrame:
    """Adds final_copy, llm_status, rewrite_attempted, bad_copy_reason, fallback_triggered and fallback_reason to rows (tone,
    candidate, error, rewritten, summary, summary_fell, summary_reason, creative, template).

    A candidate is taken as it is, unless the tone is creative and it reads like a search result: then its rewrite is
    tried once. A failed call (error, or no candidate), or a rewrite that reads so too, falls back by tone: creative to
    the creative copy, others to the summary, or to the template where the summary fell back itself; an empty copy to
    the next one. Nulls count as empty.
    """
    text = {c: clean_text(F.col(c)) for c in ("candidate", "error", "rewritten", "summary", "creative", "template")}
    bad = lambda c: F.coalesce(F.get(tag_all_matches(c, L.BAD_COPY_PATTERNS), F.lit(0)), F.lit(""))
    creative_tone = F.coalesce(F.col("tone") == "creative", F.lit(False))
    failed = (text["error"] != "") | (text["candidate"] == "")
    first, again = bad(text["candidate"]), bad(text["rewritten"])
    checked = ~failed & creative_tone & (first != "")
    hopeless = checked & ((again != "") | (text["rewritten"] == ""))
    reason = F.when(hopeless & (again != ""), again).otherwise(first)
    why = F.when(hopeless, F.concat(F.lit("bad_ad_copy_detected:"), reason)).otherwise(F.coalesce(F.nullif(text["error"], F.lit("")), F.lit("no_candidate")))
    fell = failed | hopeless
    status = F.when(fell, F.concat(F.lit("llm_failed: "), why)).when(checked, "llm_ok_rewritten").otherwise("llm_ok")
    summary_fell = F.coalesce("summary_fell", F.lit(False))
    stage = (
        F.when(hopeless, "llm_bad_copy_then_creative_template").when(creative_tone, "llm_failed_then_creative_template")
        .when(summary_fell, F.concat(F.lit("llm_failed_then_summary_"), clean_text(F.col("summary_reason")))).otherwise("llm_failed_then_summary_ok")
    )
    some = lambda *names: F.coalesce(*[F.nullif(text[n], F.lit("")) for n in names], F.lit(""))
    instead = F.when(creative_tone, some("creative", "template")).when(summary_fell, some("template", "summary")).otherwise(some("summary", "template"))
    return rows.select(
        "*", F.when(fell, instead).when(checked, text["rewritten"]).otherwise(text["candidate"]).alias("final_copy"), status.alias("llm_status"),
        checked.alias("rewrite_attempted"), F.when(checked, reason).otherwise("").alias("bad_copy_reason"), fell.alias("fallback_triggered"),
        F.when(fell, stage).otherwise("").alias("fallback_reason"),
    )


def provider_observations(local: DataFrame, remote: DataFrame) -> DataFrame:
    """query, naturalness, richness, risk: what a remote provider's outcome shows beside the local one. Both: query, copy,
    n_candidates; remote also status ('skipped_no_api_key', 'error', else good). A query that only one has is left out.

    naturalness: skipped, error, no_output, same, longer (not shorter), different. richness: skipped, error, richer (more
    candidates or a longer copy), similar (both equal), not_richer. risk: the listed claims in the remote copy, else in
    the local one.
    """
    both = local.select("query", clean_text(F.col("copy")).alias("a"), F.coalesce("n_candidates", F.lit(0)).alias("n_a")).join(
        remote.select("query", clean_text(F.col("copy")).alias("b"), F.coalesce("n_candidates", F.lit(0)).alias("n_b"), "status"), "query"
    )
    a, b, n_a, n_b = (F.char_length("a"), F.char_length("b"), F.col("n_a"), F.col("n_b"))
    unseen = F.when(F.col("status") == "skipped_no_api_key", "skipped").when(F.col("status") == "error", "error")
    natural = unseen.when(F.col("b") == "", "no_output").when(F.col("a") == F.col("b"), "same").when(b >= a, "longer").otherwise("different")
    rich = unseen.when((n_b > n_a) | (b > a), "richer").when((n_b == n_a) & (b == a), "similar").otherwise("not_richer")
    return both.select("query", natural.alias("naturalness"), rich.alias("richness"), tag_all_matches(F.coalesce(F.nullif("b", F.lit("")), "a"), L.COMPARED_CLAIMS).alias("risk"))


def comparison_counts(rows: DataFrame, about: DataFrame, domain: Sequence[str], lengths: Sequence[str], key: str = "query") -> DataFrame:
    """field, value, n of replayed baselines beside comparison_summary(): domain and length of the samples (listed values even
    where n is 0), why the summary fell back, and who gave the model's texts ('none' for blanks).

    about: key, domain, length_bucket of every sample.
    """
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), F.coalesce(F.nullif(value, F.lit("")), F.lit("none")).alias("value"))
    samples = rows.select(key).distinct().join(about.select(key, "domain", "length_bucket"), key, "left")
    samples = samples.select(F.inline(F.array(pair("domain", F.coalesce("domain", F.lit("misc"))), pair("length", F.coalesce("length_bucket", F.lit("medium"))))))
    own = F.when(F.col("baseline") == "summary_topk", pair("summary_reason", F.col("reason"))).when(F.col("baseline") == "llm_topk", pair("llm_provider", F.col("llm_provider")))
    counts = samples.unionByName(rows.select(F.inline(F.array_compact(F.array(own))))).groupBy("field", "value").agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([("domain", v) for v in domain] + [("length", v) for v in lengths], "field string, value string")
    return counts.join(listed, ["field", "value"], "full").select("field", "value", F.coalesce("n", F.lit(0)).alias("n"))


def eval_samples(planned: DataFrame, outcomes: DataFrame, intents: DataFrame, selected: DataFrame, generations: DataFrame, ranked: DataFrame, k: int = 3, lexicon=L.QUERY_CATEGORIES) -> DataFrame:
    """The whole evaluation record of every planned sample that has an outcome.

    planned: sample_id, query, normalized_query, query_bucket, query_len. outcomes: query, provider, model, llm_status,
    final_copy, final_source, rewrite_reason, top_candidate_id, fallback, fallback_reason, cache_status. intents and selected (evidence
    with pos) come from the run; score, strength, category and anchor are read off the selected evidence. generations:
    query, candidate_id, raw_text. ranked: all candidates with text, strategy, used_evidence, personalized_tags, issues,
    is_valid, length, relevance_hits, rank_score, rank.

    Arrays are at most k items and a query's candidates. rewritten_candidates has the top candidate's new text if the run
    rewrote it, else it is empty; best_copy is the top candidate as ranked.
    """
    listed = lambda df, order, value, name: df.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]).alias(name))
    fields = [c for c in selected.columns if c not in ("query", "pos")]
    evidence = listed(selected.where(F.col("pos") <= k), "pos", F.struct(*fields), "selected_evidence")
    raw = listed(generations, "candidate_id", F.col("raw_text"), "raw_llm_output")
    parsed, judged = ("candidate_id", "strategy", "text", "used_evidence", "personalized_tags"), ("issues", "is_valid", "length", "relevance_hits")
    candidates = ranked.groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct(*parsed))).alias("parsed_candidates"),
        F.sort_array(F.collect_list(F.struct("candidate_id", "text", *judged))).alias("validated_candidates"),
        F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "text", "rank_score"))).alias("ranked_candidates"),
    )
    intent_fields = ("intent_summary", "scenario", "audience", "purchase_focus", "attribute_hints", "search_focus")
    scores = evidence_score(selected, k).join(query_category(selected, "query", k, lexicon), "query")
    rows = planned.select("sample_id", "query", "normalized_query", "query_bucket", "query_len").join(outcomes, "query")
    for side in (intents.select("query", F.struct(*intent_fields).alias("intent")), evidence, scores, raw, candidates):
        rows = rows.join(side, "query", "left")
    top = F.get("ranked_candidates", F.lit(0))
    source = F.get(F.filter("parsed_candidates", lambda x: x["candidate_id"] == F.col("top_candidate_id")), F.lit(0))
    again = F.struct(F.col("top_candidate_id").alias("candidate_id"), source["strategy"].alias("strategy"), F.col("final_copy").alias("text"), "rewrite_reason", F.col("final_source").alias("source"))
    rewritten = (F.col("final_source") == "llm_rule_rewrite") & F.col("top_candidate_id").isNotNull()
    return rows.select(
        "sample_id", "query", "normalized_query", "query_bucket", "query_len", "query_category", "intent", "selected_evidence",
        F.get("selected_evidence", F.lit(0))["item_id"].alias("anchor_item_id"), F.round("evidence_score", 4).alias("evidence_score"), "evidence_strength",
        "provider", "model", "llm_status", "raw_llm_output", "parsed_candidates", "validated_candidates", "ranked_candidates",
        F.filter(F.array(again), lambda x: rewritten).alias("rewritten_candidates"), F.coalesce(top["text"], F.lit("")).alias("best_copy"), F.col("final_copy").alias("final_ad_copy"),
        F.coalesce("fallback", F.lit(False)).alias("fallback_triggered"), F.coalesce("fallback_reason", F.lit("")).alias("fallback_reason"), "cache_status",
    )
