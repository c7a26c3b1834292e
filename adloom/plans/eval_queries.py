"""Checked queries that run the whole chain from evidence to final copies: evaluation records, chat samples, prompts."""

from pyspark.sql import functions as F

from adloom.functions import prompts as P
from adloom.operators import candidates as K
from adloom.operators import datasets
from adloom.operators import evidence as E
from adloom.operators import understanding as U
from adloom.plans.base import WITH_ALL, WITH_BEHAVIOR, behavior, checked, items, log, users
from adloom.plans.copy_queries import FINAL, HINTS, INTENT, PARSED, RESCORED, SCORED, VALID, _chosen, _evidence, _generations, _ranked
from adloom.plans.data_queries import BLOCK, NUMBERED, _numbered
from adloom.plans.evidence_queries import CATEGORIES
from adloom.sources.stored import stored

CHAIN = f"{HINTS}, {INTENT}, {RESCORED}, {PARSED}, {VALID}, {SCORED}, {FINAL}"
SUMMARY_TEXT = "coalesce(nullif(array_to_string(list_filter([i.brand_hint, i.model_hint, i.category_hint], lambda x: x <> ''), ' / '), ''), i.query_text)"


def _chain(spark, sf_dir):
    """evidence, intents, selected evidence, all ranked candidates, and the final copies."""
    top = _evidence(spark, sf_dir)
    intents = stored(U.intent(top), "intents")
    selected = stored(U.rescore_evidence(top, intents), "selected")
    ranked = stored(_ranked(spark, sf_dir, top), "ranked")
    chosen = stored(_chosen(spark, sf_dir, top, ranked), "chosen")
    return top, intents, selected, ranked, chosen


@checked(
    f"""WITH {WITH_ALL}, {CHAIN}, {NUMBERED}, sel AS (SELECT query, string_agg(item_id::VARCHAR, '|' ORDER BY new_pos) AS selected_ids, min_by(item_id, new_pos) AS anchor_item_id FROM selected WHERE new_pos <= 3 GROUP BY query),
cs AS (SELECT query, string_agg(candidate_id || '=' || clean, '|' ORDER BY candidate_id) AS parsed, string_agg(candidate_id || '=' || issues || ':' || length || ':' || relevance_hits, '|' ORDER BY candidate_id) AS validated,
  string_agg(candidate_id || '=' || rank_score, '|' ORDER BY rank) AS ranked FROM rankd GROUP BY query)
SELECT printf('v5eval_%03d', sample_no) AS sample_id, p.query, p.normalized_query, query_bucket, length(p.normalized_query)::INT AS query_len, query_category, {SUMMARY_TEXT} AS intent_summary, array_to_string(attributes, '|') AS attributes, array_to_string(focus, '|') AS focus,
  selected_ids, anchor_item_id, round(evidence_score, 4) AS evidence_score, evidence_strength, 'local' AS provider, 'm1' AS model, 'ok' AS llm_status, len(string_split(parsed, '|'))::INT AS n_raw, parsed, validated, ranked, 0 AS n_rewritten,
  coalesce(clean, '') AS best_copy, final_copy AS final_ad_copy, NOT good AS fallback_triggered, CASE WHEN good THEN '' ELSE rewrite_reason END AS fallback_reason, 'miss' AS cache_status
FROM numbered p JOIN intents i ON i.query = p.query JOIN sel ON sel.query = p.query JOIN cs ON cs.query = p.query JOIN final f ON f.query = p.query"""
)
def d18_eval_samples(spark, sf_dir):
    """The numbered samples with everything the run of their query made. No copy of this data is rewritten; a test has one."""
    top, intents, selected, ranked, chosen = _chain(spark, sf_dir)
    flat = K.flatten_outcome(chosen.withColumn("provider_fallback", F.lit(False))).select("query", "fallback_triggered", "fallback_reason")
    outcomes = chosen.join(flat, "query").select(
        "query", F.lit("local").alias("provider"), F.lit("m1").alias("model"), F.lit("ok").alias("llm_status"), "final_copy", "final_source", "rewrite_reason",
        F.col("candidate_id").alias("top_candidate_id"), F.col("fallback_triggered").alias("fallback"), "fallback_reason", F.lit("miss").alias("cache_status"),
    )
    made = datasets.eval_samples(_numbered(spark, sf_dir), outcomes, intents, selected, _generations(spark, sf_dir, top), ranked, 3, CATEGORIES)
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return made.select(
        "sample_id", "query", "normalized_query", "query_bucket", "query_len", "query_category", F.col("intent.intent_summary").alias("intent_summary"), F.array_join("intent.attribute_hints", "|").alias("attributes"),
        F.array_join("intent.search_focus", "|").alias("focus"), joined("selected_evidence", lambda x: x["item_id"].cast("string")).alias("selected_ids"), "anchor_item_id", "evidence_score", "evidence_strength",
        "provider", "model", "llm_status", F.size("raw_llm_output").alias("n_raw"), joined("parsed_candidates", lambda x: text(x["candidate_id"], "=", x["text"])).alias("parsed"),
        joined("validated_candidates", lambda x: text(x["candidate_id"], "=", F.array_join(x["issues"], "|"), ":", x["length"], ":", x["relevance_hits"])).alias("validated"),
        joined("ranked_candidates", lambda x: text(x["candidate_id"], "=", x["rank_score"])).alias("ranked"), F.size("rewritten_candidates").alias("n_rewritten"),
        "best_copy", "final_ad_copy", "fallback_triggered", "fallback_reason", "cache_status",
    )


@checked(
    f"""WITH {WITH_ALL}, {WITH_BEHAVIOR}, {CHAIN}, ev AS (SELECT query, count(*) AS n, {BLOCK.replace("pos", "new_pos")} AS block FROM selected WHERE new_pos <= 3 GROUP BY query),
u AS (SELECT b.query, array_to_string(list_filter([CASE WHEN gender <> '' THEN '性别：' || gender END, CASE WHEN age_bucket <> '' THEN '年龄段：' || age_bucket END, CASE WHEN city <> '' THEN '城市：' || city WHEN province <> '' THEN '地区：' || province END], lambda x: x IS NOT NULL), '，') AS traits,
  array_to_string(coalesce(titles, []), '；') AS titles FROM best b LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN behaved t ON t.query = b.query),
c AS (SELECT query, concat_ws(chr(10), CASE WHEN traits <> '' THEN '用户画像：' || traits END, CASE WHEN titles <> '' THEN '最近行为：' || titles END) AS context FROM u),
src AS (SELECT *, (['train_pairs_user_exact', 'rank_query_exact', 'bm25'])[n] AS source FROM ev),
cf AS (SELECT *, CASE WHEN source = 'train_pairs_user_exact' THEN CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END WHEN source = 'rank_query_exact' THEN 'medium' ELSE 'low' END AS confidence FROM src)
SELECT f.query, md5(concat_ws(chr(10), 'Query: ' || f.query, 'Intent: ' || concat_ws(chr(10), '意图总结：' || {SUMMARY_TEXT}, CASE WHEN len(attributes) > 0 THEN '关注点：' || array_to_string(attributes[1:2], ' / ') END, CASE WHEN len(attributes) > 0 THEN '属性提示：' || array_to_string(attributes[1:5], '、') END),
  'User Profile: ' || coalesce(nullif(context, ''), '(empty)'), 'Evidence: ' || coalesce(nullif(block, ''), '(empty)'), 'Style Examples: ' || CASE WHEN length(f.query) % 2 = 0 THEN '1. ' || f.query || chr(10) || '2. b' ELSE '(empty)' END, '请生成1条自然广告文案。')) AS user_md5,
  final_copy AS assistant, round(rank_score, 2)::DOUBLE AS score, confidence AS evidence_confidence, concat_ws('|', 'provider_local', 'llm_status_ok', 'final_source_' || final_source, 'evidence_' || confidence, CASE WHEN length(f.query) % 2 = 0 THEN 'style_conditioned' ELSE 'style_unconditioned' END, 'direct_rank_top1') AS quality_tags
FROM final f JOIN intents i ON i.query = f.query JOIN cf ON cf.query = f.query JOIN c ON c.query = f.query JOIN rankd r ON r.query = f.query AND r.rank = 1 WHERE good"""
)
def d1_outcomes_to_chat(spark, sf_dir):
    """The runs whose top candidate was kept, with real users and behaviour; style examples for queries of even length."""
    top, intents, selected, ranked, chosen = _chain(spark, sf_dir)
    best = E.best_record(E.positives(log(spark, sf_dir))).select("query", "user_id")
    titles = E.recent_behavior_titles(best.join(behavior(spark, sf_dir), "user_id", "left"), items(spark, sf_dir))
    known = E.attach_user_profile(best, users(spark, sf_dir)).join(titles, "query")
    fields = [c for c in selected.columns if c not in ("query", "pos")]
    listed = selected.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))).alias("found"))
    listed = listed.select("query", F.transform("found", lambda x: x["item"]).alias("selected_evidence"))
    kept = chosen.where("final_source = 'llm_ranker_top1'").select("query", "final_copy", "final_source")
    rows = kept.join(intents.select("query", F.struct("intent_summary", "scenario", "audience", "purchase_focus", "attribute_hints").alias("intent")), "query").join(known, "query").join(listed, "query")
    rows = rows.join(ranked.where("rank = 1").select("query", F.col("rank_score").alias("score")), "query")
    source = F.element_at(F.array(*map(F.lit, ("train_pairs_user_exact", "rank_query_exact", "bm25"))), F.size("selected_evidence"))
    styles = F.when(F.char_length("query") % 2 == 0, F.array(F.col("query"), F.lit(" "), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(
        "*", source.alias("retrieval_source"), styles.alias("style_examples"), F.lit("local").alias("provider"), F.lit("ok").alias("llm_status"), F.lit(False).alias("rewritten")
    )
    content = lambda i: F.col("messages")[i]["content"]
    return datasets.outcomes_to_chat(rows).select(
        "metadata.query", F.md5(content(1)).alias("user_md5"), content(2).alias("assistant"), "metadata.score", "metadata.evidence_confidence", F.array_join("metadata.quality_tags", "|").alias("quality_tags")
    )


def _listed(top):
    fields = [c for c in top.columns if c not in ("query", "pos")]
    found = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))).alias("found"))
    return found.select("query", F.transform("found", lambda x: x["item"]).alias("items"))


@checked(
    f"""WITH {WITH_ALL} SELECT query, string_agg(pos || '. ' || concat_ws(' | ', CASE WHEN item_title <> '' THEN 'title=' || item_title END, CASE WHEN brand_name <> '' THEN 'brand=' || brand_name END, CASE WHEN seller_name <> '' THEN 'seller=' || seller_name END,
  CASE WHEN category_path <> '' THEN 'category_path=' || category_path END, 'ranking_signal=' || ranking_signal, 'relevance_signal=' || relevance_signal), chr(10) ORDER BY pos) AS block FROM evidence GROUP BY query"""
)
def u9_llm_evidence_block(spark, sf_dir):
    return _listed(_evidence(spark, sf_dir)).select("query", P.llm_evidence_block(F.col("items")).alias("block"))


@checked(
    f"""WITH {WITH_ALL}, b AS (SELECT query, coalesce({BLOCK}, '') AS block FROM evidence GROUP BY query),
u AS (SELECT b.query, array_to_string(list_filter([CASE WHEN gender <> '' THEN '性别：' || gender END, CASE WHEN age_bucket <> '' THEN '年龄段：' || age_bucket END, CASE WHEN city <> '' THEN '城市：' || city WHEN province <> '' THEN '地区：' || province END], lambda x: x IS NOT NULL), '，') AS traits FROM best b LEFT JOIN users u ON u.user_id = b.user_id)
SELECT query, md5(concat_ws(chr(10) || chr(10), '{P.AD_ROLE}', 'Query:' || chr(10) || query, CASE WHEN traits <> '' THEN 'User Context:' || chr(10) || '用户画像：' || traits END, CASE WHEN block <> '' THEN 'Evidence Items:' || chr(10) || block END, '{P.AD_OUTPUT}')) AS prompt_md5 FROM b JOIN u USING (query)"""
)
def u9_ad_prompt(spark, sf_dir):
    best = E.best_record(E.positives(log(spark, sf_dir))).select("query", "user_id")
    rows = _listed(_evidence(spark, sf_dir)).join(E.attach_user_profile(best, users(spark, sf_dir)), "query")
    prompt = P.ad_prompt(F.col("query"), F.col("user_profile"), F.array().cast("array<string>"), F.col("items"))
    return rows.select("query", F.md5(prompt).alias("prompt_md5"))
