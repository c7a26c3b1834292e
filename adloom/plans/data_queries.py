"""Checked queries of click-through data, chat and evaluation sets, and metrics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions import prompts as P
from adloom.functions.copies import conservative_copy, template_copy
from adloom.functions.text import length_bucket, normalize_query
from adloom.operators import ctr, datasets, metrics
from adloom.operators import evidence as E
from adloom.operators.containment import documents_holding
from adloom.operators.understanding import summary_copy
from adloom.plans.base import WITH_ALL, WITH_BEHAVIOR, behavior, checked, emptied, history, items, last_items, log, norm, stored_history, table, user_slices, users
from adloom.plans.copy_queries import SUMMARY, TOP
from adloom.plans.evidence_queries import CATEGORIES, COPY, SHOWN, a5_evidence_topk
from adloom.plans.retrieval_queries import TOKENS_SQL, _bench, _bm25_sql, j5_bm25_topk
from adloom.sources.stored import stored, stored_parts

SPLIT = """marked AS (SELECT *, md5(concat_ws('|', '42', seq)) AS mark FROM log),
parts AS (SELECT *, CASE WHEN split = 'test' THEN 'test' WHEN row_number() OVER (PARTITION BY split = 'test' ORDER BY mark, seq) <= floor((SELECT count(*) FROM log WHERE split <> 'test') * 10 / 100) THEN 'valid' ELSE 'train' END AS part FROM marked)"""


@checked(f"WITH {WITH_ALL}, {SPLIT} SELECT seq, part FROM parts")
def r1_split(spark, sf_dir):
    return ctr.split_examples(log(spark, sf_dir)).select("seq", "part")


USER_CODES = "coalesce(CASE u.gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 END, 2) AS gender, coalesce(list_position(['0-11', '12-17', '18-23', '24-30', '31-40', '41-49', '50+'], u.age_bucket) - 1, 9) AS age"


@checked(
    f"""WITH {WITH_ALL} SELECT l.seq, CASE WHEN is_clicked = 1 OR is_purchased = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, {USER_CODES}, coalesce(i.item_id, 0) AS feature_item,
  coalesce(i.category_level1_id, 0)::BIGINT AS category_level1_id, coalesce(i.category_level2_id, 0)::BIGINT AS category_level2_id, coalesce(i.category_level3_id, 0)::BIGINT AS category_level3_id
FROM log l LEFT JOIN users u ON u.user_id = l.user_id LEFT JOIN items i ON i.item_id = l.item_id"""
)
def r2_label_and_ids(spark, sf_dir):
    rows = ctr.item_features(ctr.user_features(log(spark, sf_dir).withColumn("label", ctr.ctr_label()), users(spark, sf_dir)), items(spark, sf_dir))
    return rows.select("seq", "label", "gender", "age", "feature_item", *ctr.CATEGORIES)


HIST = """h AS (SELECT user_id, 20 - back AS slot, item_id FROM recent WHERE back <= 20),
slots AS (SELECT user_id, unnest(range(20)) AS slot FROM (SELECT DISTINCT user_id FROM log)),
hist AS (SELECT s.user_id, string_agg(coalesce(i.item_id, 0)::VARCHAR, ',' ORDER BY slot) AS hist_item, string_agg(coalesce(i.category_level2_id, 0)::VARCHAR, ',' ORDER BY slot) AS hist_cat2
  FROM slots s LEFT JOIN h USING (user_id, slot) LEFT JOIN items i ON i.item_id = h.item_id GROUP BY s.user_id)"""


@checked(f"WITH {WITH_ALL}, {HIST} SELECT user_id, hist_item, hist_cat2 FROM hist")
def r5_history_features(spark, sf_dir):
    made = ctr.history_features(history(spark, sf_dir), items(spark, sf_dir), "user_id")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return made.select("user_id", joined("hist_item"), joined("hist_cat2"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@checked(
    """WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey % n AS vec, round(e.embedding[1]::DOUBLE, 4) AS first_value
FROM lineitem, n JOIN embeddings e ON e.vec_id = l_partkey % n"""
)
def r6_join_embeddings(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") % F.lit(vectors.count())).alias("vec"))
    out = ctr.join_embeddings(rows, vectors, "vec", "vector")
    return out.select("order_id", "line_no", "vec", F.round(F.col("vector")[0].cast("double"), 4).alias("first_value"))


@checked(
    f"""WITH {WITH_ALL}, {SPLIT}, {HIST} SELECT p.seq, p.part, CASE WHEN is_clicked = 1 OR is_purchased = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, {USER_CODES}, coalesce(i.item_id, 0) AS feature_item, md5(hist_item) AS hist
FROM parts p LEFT JOIN users u ON u.user_id = p.user_id LEFT JOIN items i ON i.item_id = p.item_id LEFT JOIN hist h ON h.user_id = p.user_id"""
)
def r7_assemble_examples(spark, sf_dir):
    slices = user_slices(spark, sf_dir, "seq", "split", "user_id", "item_id", "is_clicked", "is_purchased", "shown_at")
    limits = stored(ctr.split_limits(reduce(DataFrame.unionByName, slices)), "limits")
    about, goods = users(spark, sf_dir), items(spark, sf_dir)
    ids = F.array_join(F.transform("hist_item", lambda x: x.cast("string")), ",")
    made = (ctr.assemble_examples(rows, about, goods, last_items(rows, 20), limits, (F.md5(ids).alias("hist"),)) for rows in emptied(slices))
    return stored_parts((x.select("seq", "part", "label", "gender", "age", "feature_item", "hist") for x in made), "examples")


VECTOR_HISTORY = """n AS (SELECT count(*) AS n FROM embeddings), owners AS (SELECT DISTINCT user_id FROM log), dims AS (SELECT unnest(range(1, (SELECT len(any_value(embedding)) FROM embeddings) + 1)) AS dim),
h AS (SELECT user_id, item_id % n AS vec FROM recent, n WHERE back <= 20 AND item_id % n <> 0)"""


def _vector_history(spark, sf_dir):
    """user_id, hist_item: the vectors of a user's last 20 items; target: the user's own."""
    n = F.lit(_vectors(spark, sf_dir).count())
    last = stored_history(spark, sf_dir, 20)
    return last.select("user_id", F.transform("recently_clicked_item_ids", lambda x: x % n).alias("hist_item"), (F.col("user_id") % n).alias("target"))


def _by_dimension(pooled):
    return pooled.select("user_id", F.posexplode("pooled").alias("at", "v")).select("user_id", (F.col("at") + 1).cast("long").alias("dim"), F.round("v", 5).alias("value"))


@checked(
    f"""WITH {WITH_ALL}, {VECTOR_HISTORY}, m AS (SELECT user_id, dim, avg(embedding[dim]::DOUBLE) AS v FROM h JOIN embeddings ON vec_id = vec, dims GROUP BY ALL)
SELECT user_id, dim, round(coalesce(v, 0.0), 5) AS value FROM owners CROSS JOIN dims LEFT JOIN m USING (user_id, dim)"""
)
def r8_masked_mean_history(spark, sf_dir):
    return _by_dimension(ctr.masked_mean_history(_vector_history(spark, sf_dir), _vectors(spark, sf_dir), "user_id"))


@checked(
    f"""WITH {WITH_ALL}, {VECTOR_HISTORY}, w AS (SELECT user_id, e.embedding, list_inner_product(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS w FROM h JOIN embeddings e ON e.vec_id = vec, n JOIN embeddings t ON t.vec_id = user_id % n),
m AS (SELECT user_id, dim, sum(w * embedding[dim]::DOUBLE) AS v FROM w, dims GROUP BY ALL)
SELECT user_id, dim, round(coalesce(v, 0.0), 5) AS value FROM owners CROSS JOIN dims LEFT JOIN m USING (user_id, dim)"""
)
def r8_weighted_history(spark, sf_dir):
    return _by_dimension(ctr.weighted_history(_vector_history(spark, sf_dir), _vectors(spark, sf_dir), "user_id", "target"))


def _judged(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.select(F.col("quality").alias("label"), (F.col("n_chars") % 4000 / 1000.0 - 1).alias("logit"))


JUDGED = "j AS (SELECT quality AS label, n_chars % 4000 / 1000.0 - 1 AS logit FROM labels JOIN documents USING (doc_id))"


@checked(f"WITH {JUDGED} SELECT count(*) AS n, round(avg(greatest(logit, 0.0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS logloss FROM j")
def r9_logloss(spark, sf_dir):
    return ctr.logloss(_judged(spark, sf_dir)).withColumn("logloss", F.round("logloss", 6))


@checked(
    f"""WITH {JUDGED}, p AS (SELECT logit, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM j GROUP BY logit),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY logit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM p)
SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(sum(pos * (low + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w"""
)
def r10_roc_auc(spark, sf_dir):
    return ctr.roc_auc(_judged(spark, sf_dir), "logit").withColumn("auc", F.round("auc", 6))


@checked(None)
def r11_linear_baseline(spark, sf_dir):
    """Evaluation of a linear model on id features; its learned weights have no SQL form."""
    made = ctr.assemble_examples(log(spark, sf_dir), users(spark, sf_dir), items(spark, sf_dir), history(spark, sf_dir))
    columns = ("gender", "age", *ctr.CATEGORIES)
    made = stored(made.select("part", "label", *columns), "examples")
    from pyspark.ml.functions import vector_to_array

    model = ctr.linear_baseline(made.where("part = 'train'"), columns)
    scored = stored(model.transform(made.where("part = 'test'")).select("label", vector_to_array("logit")[1].alias("logit")), "scored")
    return ctr.logloss(scored).join(ctr.roc_auc(scored, "logit"))


POOL_SQL = f"""score AS (SELECT query, sum((item_title <> '')::INT + (category_path <> '')::INT + (lower(brand_name) NOT IN ('', '无品牌', '其他', 'other', 'unknown', '未知', 'nan', 'none', 'null'))::INT + (seller_name <> '')::INT + 2)::BIGINT AS hits FROM evidence GROUP BY query),
paths AS (SELECT query, lower(query || ' ' || string_agg(concat_ws(' ', category_path, item_title), ' ' ORDER BY pos)) AS t FROM evidence GROUP BY query),
rated AS (SELECT b.query, b.seq, hits / 18.0 AS evidence_score, CASE WHEN hits / 18.0 >= 0.75 THEN 'high' ELSE 'low' END AS evidence_strength,
  CASE WHEN regexp_matches(t, 'brass|copper|steel|tin') THEN 'metal' WHEN regexp_matches(t, 'standard|small') THEN 'plain' WHEN regexp_matches(t, 'promo|economy') THEN 'fine' ELSE 'misc' END AS query_category,
  {norm("b.query")} AS normalized_query FROM best b JOIN score USING (query) JOIN paths USING (query)),
pool AS (SELECT *, CASE WHEN length(normalized_query) <= 6 THEN 'short' WHEN length(normalized_query) <= 15 THEN 'medium' ELSE 'long' END AS query_bucket FROM rated
  QUALIFY row_number() OVER (PARTITION BY normalized_query ORDER BY seq) = 1)"""


def _pool(spark, sf_dir):
    best = E.best_record(E.positives(log(spark, sf_dir))).select("query", "seq")
    return datasets.candidate_pool(best, a5_evidence_topk(spark, sf_dir), 3, CATEGORIES)


@checked(f"WITH {WITH_ALL}, {POOL_SQL} SELECT normalized_query, query, round(evidence_score, 6) AS evidence_score, evidence_strength, query_category, query_bucket FROM pool")
def d9_candidate_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("normalized_query", "query", F.round("evidence_score", 6).alias("evidence_score"), "evidence_strength", "query_category", "query_bucket")


SAMPLE_QUOTAS = {(b, s): n for b, n in (("short", 2), ("medium", 3), ("long", 10)) for s in ("high", "low")}


@checked(
    f"""WITH {WITH_ALL}, {POOL_SQL} SELECT normalized_query, query_bucket, evidence_strength, row_number() OVER (PARTITION BY query_bucket, evidence_strength ORDER BY md5(concat_ws('|', '42', normalized_query)), normalized_query) AS picked
FROM pool QUALIFY picked <= CASE query_bucket WHEN 'short' THEN 2 WHEN 'medium' THEN 3 ELSE 10 END"""
)
def d10_stratified_sample(spark, sf_dir):
    picked = datasets.stratified_sample(_pool(spark, sf_dir), SAMPLE_QUOTAS, strict=False)
    return picked.select("normalized_query", "query_bucket", "evidence_strength", "picked")


@checked(
    f"""WITH {WITH_ALL}, {POOL_SQL} SELECT normalized_query, query_category, query_bucket, row_number() OVER (PARTITION BY query_category, query_bucket ORDER BY md5(concat_ws('|', '42', normalized_query)), normalized_query) AS picked
FROM pool QUALIFY picked <= CASE query_category WHEN 'misc' THEN 1 ELSE 3 END"""
)
def d11_domain_sample(spark, sf_dir):
    quotas = {(c, b): 1 if c == "misc" else 3 for c in ("metal", "plain", "fine", "misc") for b in ("short", "medium", "long")}
    picked = datasets.stratified_sample(_pool(spark, sf_dir), quotas, ("query_category", "query_bucket"), strict=False)
    return picked.select("normalized_query", "query_category", "query_bucket", "picked")


@checked(
    f"""WITH {WITH_ALL}, {POOL_SQL}, d AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_category, query_bucket ORDER BY md5(concat_ws('|', '42', normalized_query)), normalized_query) <= CASE query_category WHEN 'misc' THEN 1 ELSE 3 END)
SELECT row_number() OVER (ORDER BY list_position(['metal', 'plain', 'fine', 'misc'], query_category), list_position(['short', 'medium', 'long'], query_bucket), normalized_query)::INT AS sample_no, normalized_query, query_category, query_bucket FROM d QUALIFY sample_no <= 15"""
)
def d11_ordered_sample(spark, sf_dir):
    """The test data have too few kinds of queries for 30 samples, so 5 are asked for at least."""
    orders = {"query_category": ("metal", "plain", "fine", "misc"), "query_bucket": ("short", "medium", "long")}
    quotas = {(c, b): 1 if c == "misc" else 3 for c in orders["query_category"] for b in orders["query_bucket"]}
    picked = datasets.domain_sample(_pool(spark, sf_dir), quotas, orders, 5, 15)
    return picked.select("sample_no", "normalized_query", "query_category", "query_bucket")


@checked(
    f"""WITH {WITH_ALL}, {POOL_SQL}, k AS (SELECT unnest(['short', 'medium', 'long', 'endless']) AS value, unnest([0, 1, 2, 3]) AS place)
SELECT k.value, count(p.query) AS n, place FROM k LEFT JOIN pool p ON p.query_bucket = k.value GROUP BY ALL"""
)
def d12_distribution(spark, sf_dir):
    return datasets.distribution(_pool(spark, sf_dir), "query_bucket", ["short", "medium", "long", "endless"])


CHATS = """c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'system')[-1].text AS s, list_filter(m, lambda x: x.role = 'user')[-1].text AS u, list_filter(m, lambda x: x.role = 'assistant')[-1].text AS a FROM c),
v AS (SELECT conv_id, list_filter([CASE WHEN s IS NULL THEN 'missing_system' END, CASE WHEN u IS NULL THEN 'missing_user' END, CASE WHEN a IS NULL THEN 'missing_assistant' END,
  CASE WHEN trim(coalesce(a, '')) = '' THEN 'empty_assistant' END], lambda x: x IS NOT NULL) AS errors, length(trim(coalesce(a, ''))) AS assistant_length,
  concat_ws(chr(10), '<|system|>', coalesce(s, ''), '<|user|>', coalesce(u, ''), '<|assistant|>', coalesce(a, '')) AS training_text FROM r)"""


def _validated(spark, sf_dir):
    """Conversations as chat samples; a conversation is one group of a few turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    meta = F.struct(F.lit("given").alias("provider"), F.lit(0.0).alias("score"), F.lit("low").alias("evidence_confidence"))
    samples = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), meta.alias("metadata"))
    return datasets.validate_chat(samples)


@checked(f"WITH {CHATS} SELECT conv_id, array_to_string(errors, '|') AS errors, assistant_length, md5(training_text) AS training_md5 FROM v")
def d7_validate_chat(spark, sf_dir):
    return _validated(spark, sf_dir).select("conv_id", F.array_join("errors", "|").alias("errors"), "assistant_length", F.md5("training_text").alias("training_md5"))


@checked(
    f"""WITH {CHATS} SELECT count(*) AS total_samples, sum((len(errors) = 0)::INT)::BIGINT AS valid_samples, sum((len(errors) > 0)::INT)::BIGINT AS invalid_samples,
  coalesce(round(avg(CASE WHEN len(errors) = 0 THEN assistant_length END), 2), 0.0) AS avg_assistant_length FROM v"""
)
def d8_chat_stats(spark, sf_dir):
    return datasets.chat_stats(_validated(spark, sf_dir)).drop("avg_score")


RATED = f"""{CHATS}, x AS (SELECT v.*, 'p' || conv_id % 3 AS provider, len(m) * 1.5 AS score, CASE WHEN len(m) >= 6 THEN 'high' WHEN len(m) >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM v JOIN c USING (conv_id))"""


def _rated(spark, sf_dir):
    """The same samples with a provider by id, and a score and confidence by the number of turns."""
    turns = F.size("messages")
    confidence = F.when(turns >= 6, "high").when(turns >= 4, "medium").otherwise("low")
    meta = F.struct(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("provider"), (turns * 1.5).alias("score"), confidence.alias("evidence_confidence"))
    return _validated(spark, sf_dir).withColumn("metadata", meta)


@checked(
    f"""WITH {RATED} SELECT count(*) AS total_samples, count(*) FILTER (len(errors) = 0) AS valid_samples, count(*) FILTER (len(errors) > 0) AS invalid_samples,
  coalesce(round(avg(assistant_length) FILTER (len(errors) = 0), 2), 0.0) AS avg_assistant_length, coalesce(round(avg(score::DOUBLE) FILTER (len(errors) = 0), 2), 0.0) AS avg_score FROM x"""
)
def d8_chat_scores(spark, sf_dir):
    return datasets.chat_stats(_rated(spark, sf_dir))


@checked(
    f"""WITH {RATED}, y AS (SELECT 'provider' AS field, provider AS value FROM x WHERE len(errors) = 0 UNION ALL SELECT 'evidence_confidence', confidence FROM x WHERE len(errors) = 0
  UNION ALL SELECT 'invalid_reason', unnest(errors) FROM x) SELECT field, value, count(*) AS n FROM y GROUP BY ALL"""
)
def d8_chat_distributions(spark, sf_dir):
    return datasets.chat_distributions(_rated(spark, sf_dir))


@checked(f"WITH {CHATS} SELECT reason, count(*) AS n FROM (SELECT unnest(errors) AS reason FROM v) GROUP BY reason")
def d8_invalid_reasons(spark, sf_dir):
    return datasets.invalid_reasons(_validated(spark, sf_dir))


def _baselines(spark, sf_dir):
    """Two baselines of every query with evidence: the template on the first item, and on the second (a fallback if none)."""
    top = a5_evidence_topk(spark, sf_dir)
    copy = template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path")))
    first = top.where("pos = 1").select("query", F.lit("first").alias("baseline"), copy.alias("copy"), F.lit(False).alias("fallback"))
    second = top.where("pos = 1").select("query").join(top.where("pos = 2").select("query", copy.alias("copy")), "query", "left")
    second = second.select("query", F.lit("second").alias("baseline"), F.coalesce("copy", F.lit("")).alias("copy"), F.col("copy").isNull().alias("fallback"))
    return first.unionByName(second)


BASELINES = f"""copies AS (SELECT *, {COPY} AS copy FROM (SELECT *, {SHOWN} FROM evidence)),
b1 AS (SELECT query, 'first' AS baseline, copy, false AS fallback FROM copies WHERE pos = 1),
b2 AS (SELECT a.query, 'second' AS baseline, coalesce(c.copy, '') AS copy, c.copy IS NULL AS fallback FROM b1 a LEFT JOIN (SELECT * FROM copies WHERE pos = 2) c ON c.query = a.query),
bl AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""


def _replayed(spark, sf_dir):
    """All queries with evidence, every third without a user; the second and third items' templates stand for given texts."""
    top = stored(a5_evidence_topk(spark, sf_dir), "evidence")
    copy = template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path")))
    texts = lambda pos, name: top.where(F.col("pos") == pos).select("query", copy.alias("copy"), F.lit(name).alias("provider"), F.lit("m1").alias("model"), F.lit("ok").alias("status"))
    size = F.char_length("query")
    asked = top.select("query").distinct().select("query", F.when(size % 3 != 0, size).alias("user_id"), F.when(size % 2 != 0, size).alias("session_id"))
    return datasets.replay_baselines(asked, top, texts(2, "second"), texts(3, "third"))


REPLAY = f"""pq AS (SELECT nq, min(query) AS pair_query FROM (SELECT DISTINCT query, {norm("query")} AS nq FROM evidence) GROUP BY nq),
asked AS (SELECT query, pair_query, CASE WHEN length(query) % 3 <> 0 THEN 'train_pairs_user_exact' WHEN length(query) % 2 <> 0 THEN 'train_pairs_session_exact' ELSE 'train_pairs_query_exact' END AS tier
  FROM (SELECT DISTINCT query, {norm("query")} AS nq FROM evidence) JOIN pq USING (nq)),
e2 AS (SELECT a.query, e.* EXCLUDE (query) FROM asked a JOIN evidence e ON e.query = a.pair_query), {TOP.replace("evidence", "e2")},
given AS (SELECT *, {COPY} AS copy FROM (SELECT *, {SHOWN} FROM evidence)),
t AS (SELECT query, {COPY} AS template FROM (SELECT *, {SHOWN} FROM e2 WHERE pos = 1)), {SUMMARY},
g AS (SELECT a.query, tier, template, pos, c.copy AS c FROM asked a JOIN t USING (query) CROSS JOIN (SELECT unnest([2, 3]) AS pos) LEFT JOIN given c USING (query, pos)),
rp AS (SELECT query, 'template_top1' AS baseline, template AS copy, false AS fallback, '' AS reason, 'train_pairs_query_exact' AS retrieval_source, '' AS provider, '' AS model, '' AS status FROM asked JOIN t USING (query)
  UNION ALL SELECT query, 'template_personalized', template, false, '', tier, '', '', '' FROM asked JOIN t USING (query)
  UNION ALL SELECT query, 'summary_topk', copy, fallback, CASE WHEN fallback THEN reason ELSE '' END, tier, '', '', '' FROM asked JOIN summed USING (query)
  UNION ALL SELECT query, CASE pos WHEN 2 THEN 'llm_topk' ELSE 'full_pipeline' END, coalesce(c, template), c IS NULL, CASE WHEN c IS NULL THEN 'no_text_given' ELSE '' END, tier,
    CASE WHEN c IS NULL THEN '' WHEN pos = 2 THEN 'second' ELSE 'third' END, CASE WHEN c IS NULL THEN '' ELSE 'm1' END, CASE WHEN c IS NULL THEN '' ELSE 'ok' END FROM g)"""


@checked(f"WITH {WITH_ALL}, {REPLAY} SELECT query, baseline, copy, fallback, reason, retrieval_source, provider AS llm_provider, status AS llm_status, provider, model FROM rp")
def d13_replay_baselines(spark, sf_dir):
    return _replayed(spark, sf_dir)


@checked(
    f"""WITH {WITH_ALL}, {REPLAY} SELECT baseline, field, value, count(*) AS n FROM (SELECT baseline, unnest([{{'field': 'fallback_reason', 'value': reason}}, {{'field': 'llm_provider', 'value': provider}},
  {{'field': 'llm_status', 'value': status}}, {{'field': 'provider', 'value': provider}}, {{'field': 'model', 'value': model}}], recursive := true) FROM rp) WHERE value <> '' GROUP BY ALL"""
)
def d14_baseline_distributions(spark, sf_dir):
    return datasets.baseline_distributions(_replayed(spark, sf_dir))


@checked(
    f"""WITH {WITH_ALL}, {REPLAY}, w AS (SELECT query, max(copy) FILTER (baseline = 'template_top1') AS t, max(copy) FILTER (baseline = 'template_personalized') AS p, max(copy) FILTER (baseline = 'summary_topk') AS s, max(copy) FILTER (baseline = 'llm_topk') AS l,
  bool_or(fallback) FILTER (baseline = 'summary_topk') AS sf, bool_or(fallback) FILTER (baseline = 'llm_topk') AS lf FROM rp GROUP BY query)
SELECT count(*) AS n_samples, count(*) FILTER (sf) AS summary_fallback_count, round(avg(sf::INT), 4) AS summary_fallback_ratio, count(*) FILTER (lf) AS llm_fallback_count, round(avg(lf::INT), 4) AS llm_fallback_ratio,
  count(*) FILTER (t <> p) AS personalized_changed, count(*) FILTER (l <> s) AS llm_vs_summary_changed, count(*) FILTER (l <> t) AS llm_vs_template_changed FROM w"""
)
def d15_comparison_summary(spark, sf_dir):
    return datasets.comparison_summary(_replayed(spark, sf_dir))


@checked(
    f"""WITH {WITH_ALL}, x AS (SELECT query, pos, trim(query) AS q, item_title AS t, seller_name AS s, trim(string_split(category_path, '>')[-1]) AS c FROM evidence),
y AS (SELECT query, pos, regexp_replace(CASE WHEN t <> '' AND s <> '' THEN concat('围绕“', q, '”，可先看看这款', t, '，由', s, '在售，信息更直观。') WHEN t <> '' THEN concat('围绕“', q, '”，可先看看这款', t, '，更贴近当前搜索需求。')
  WHEN c <> '' THEN concat('围绕“', q, '”，建议先关注', c, '方向的候选商品。') ELSE concat('围绕“', q, '”，建议先关注当前更匹配的候选商品方向。') END, '\\s+', ' ', 'g') AS made FROM x)
SELECT query, pos, CASE WHEN length(made) <= 50 THEN made ELSE rtrim(left(made, 49), '，。；、 ') || '。' END AS copy FROM y"""
)
def u10_conservative_copy(spark, sf_dir):
    copy = conservative_copy(*map(F.col, ("query", "item_title", "seller_name", "category_path")))
    return a5_evidence_topk(spark, sf_dir).select("query", "pos", copy.alias("copy"))


ORDERS = {"query_bucket": ("short", "medium", "long"), "evidence_strength": ("high", "low")}
NUMBERED = f"""{POOL_SQL},
picked AS (SELECT *, row_number() OVER (PARTITION BY query_bucket, evidence_strength ORDER BY md5(concat_ws('|', '42', normalized_query)), normalized_query) AS picked FROM pool
  QUALIFY picked <= CASE query_bucket WHEN 'short' THEN 2 WHEN 'medium' THEN 3 ELSE 10 END),
numbered AS (SELECT *, row_number() OVER (ORDER BY list_position(['short', 'medium', 'long'], query_bucket), list_position(['high', 'low'], evidence_strength), query_category, normalized_query) AS sample_no FROM picked)"""
RECORDS = f"""{NUMBERED}, {REPLAY}, rec AS (SELECT printf('v5eval_%03d', sample_no) AS sample_id, p.*, r.copy, r.provider, r.model, r.status AS llm_status, r.fallback, CASE WHEN length(r.copy) % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache_status
  FROM numbered p JOIN rp r USING (query) WHERE baseline = 'full_pipeline')"""


def _numbered(spark, sf_dir):
    return datasets.number_samples(datasets.stratified_sample(_pool(spark, sf_dir), SAMPLE_QUOTAS, strict=False), ORDERS)


def _records(spark, sf_dir):
    """The numbered sample with the full pipeline's outcomes; whether a copy was cached is read off its length."""
    outcomes = _replayed(spark, sf_dir).where("baseline = 'full_pipeline'").select("query", "copy", "provider", "model", "llm_status", "fallback", F.when(F.char_length("copy") % 2 == 0, "hit").otherwise("miss").alias("cache_status"))
    planned = _numbered(spark, sf_dir)
    return datasets.eval_records(planned, outcomes, a5_evidence_topk(spark, sf_dir), 3, CATEGORIES)


@checked(f"WITH {WITH_ALL}, {NUMBERED} SELECT printf('v5eval_%03d', sample_no) AS sample_id, sample_no::INT AS sample_no, query_bucket, evidence_strength, query_category, normalized_query FROM numbered")
def d10_numbered_sample(spark, sf_dir):
    return _numbered(spark, sf_dir).select("sample_id", "sample_no", "query_bucket", "evidence_strength", "query_category", "normalized_query")


@checked(f"WITH {WITH_ALL}, {RECORDS} SELECT sample_id, query, query_bucket, query_category, round(evidence_score, 6) AS evidence_score, evidence_strength, copy, provider, model, llm_status, fallback, cache_status FROM rec")
def d18_eval_records(spark, sf_dir):
    kept = ("query_bucket", "query_category", F.round("evidence_score", 6).alias("evidence_score"), "evidence_strength", "copy", "provider", "model", "llm_status", "fallback", "cache_status")
    return _records(spark, sf_dir).select("sample_id", "query", *kept)


@checked(
    f"""WITH {WITH_ALL}, {RECORDS}, k(field, value, place, requested) AS (VALUES ('query_bucket', 'short', 0, NULL), ('query_bucket', 'medium', 1, NULL), ('query_bucket', 'long', 2, NULL), ('evidence_strength', 'high', 0, NULL), ('evidence_strength', 'low', 1, NULL),
  ('query_category', 'metal', 0, NULL), ('query_category', 'plain', 1, NULL), ('query_category', 'fine', 2, NULL), ('query_category', 'misc', 3, NULL),
  ('quota', 'long-high', 0, 10), ('quota', 'long-low', 1, 10), ('quota', 'medium-high', 2, 3), ('quota', 'medium-low', 3, 3), ('quota', 'short-high', 4, 2), ('quota', 'short-low', 5, 2)),
c AS (SELECT field, value, count(*) AS n FROM (SELECT unnest([{{'field': 'quota', 'value': query_bucket || '-' || evidence_strength}}, {{'field': 'query_bucket', 'value': query_bucket}}, {{'field': 'evidence_strength', 'value': evidence_strength}},
  {{'field': 'query_category', 'value': query_category}}, {{'field': 'provider', 'value': provider}}, {{'field': 'model', 'value': model}}, {{'field': 'llm_status', 'value': llm_status}}, {{'field': 'cache_status', 'value': cache_status}}], recursive := true) FROM rec) GROUP BY ALL)
SELECT coalesce(k.field, c.field) AS field, coalesce(k.value, c.value) AS value, coalesce(n, 0) AS n, place, requested FROM k FULL JOIN c ON k.field = c.field AND k.value = c.value"""
)
def d12_eval_distributions(spark, sf_dir):
    listed = ORDERS | {"query_category": ("metal", "plain", "fine", "misc"), "provider": (), "model": (), "llm_status": (), "cache_status": ()}
    return datasets.eval_distributions(_records(spark, sf_dir), listed, SAMPLE_QUOTAS)


@checked(f"WITH {WITH_ALL}, {RECORDS} SELECT count(*) AS total_samples, count(*) FILTER (fallback) AS fallback_triggered_count, coalesce(round(avg(fallback::INT), 4), 0.0) AS fallback_triggered_ratio FROM rec")
def d12_eval_summary(spark, sf_dir):
    return datasets.eval_summary(_records(spark, sf_dir))


@checked(
    f"""WITH {WITH_ALL}, {REPLAY}, w AS (SELECT ['元', '¥', '折', '优惠', '立减', '销量', '热销', '爆款', '治', '改善', '修复', '药效', '功效', '续航', '认证'] AS claims, ['当前候选主要集中', '建议先从这类商品里继续筛选', '更贴近当前需求', '信息清楚，适合先了解', '可先关注', '等商品'] AS bad)
SELECT query, baseline, provider, model, status AS llm_status, fallback, copy, length(copy)::INT AS copy_length, copy = '' OR len(list_filter(bad, lambda t: contains(copy, t))) > 0 AS is_bad_copy,
  array_to_string(list_filter(claims, lambda t: contains(copy, t)), '|') AS claims FROM (SELECT * REPLACE (trim(copy) AS copy) FROM rp WHERE baseline IN ('summary_topk', 'llm_topk', 'full_pipeline')), w"""
)
def d16_provider_rows(spark, sf_dir):
    rows = _replayed(spark, sf_dir).where("baseline in ('summary_topk', 'llm_topk', 'full_pipeline')")
    return datasets.provider_rows(rows, "baseline").withColumn("claims", F.array_join("claims", "|"))


@checked(f"WITH {WITH_ALL}, {BASELINES} SELECT baseline, count(*) AS n, count(*) FILTER (copy <> '') AS n_non_empty, count(*) FILTER (fallback) AS n_fallback, round(avg(fallback::INT), 4) AS fallback_ratio FROM bl GROUP BY baseline")
def d14_baseline_summary(spark, sf_dir):
    return datasets.baseline_summary(_baselines(spark, sf_dir))


@checked(f"WITH {WITH_ALL}, {BASELINES} SELECT count(*) AS n, count(*) FILTER (b1.copy <> b2.copy) AS n_different FROM b1 JOIN b2 USING (query)")
def d15_compare_baselines(spark, sf_dir):
    return datasets.compare_baselines(_baselines(spark, sf_dir), "first", "second")


@checked(
    f"""WITH {WITH_ALL}, {BASELINES} SELECT query, b1.copy AS first_copy, b2.copy AS second_copy, CASE WHEN b1.copy = b2.copy THEN 'same' WHEN length(b1.copy) > length(b2.copy) THEN 'first_longer'
  WHEN length(b1.copy) < length(b2.copy) THEN 'second_longer' ELSE 'same_length' END AS observation FROM b1 JOIN b2 USING (query)"""
)
def d16_compare_providers(spark, sf_dir):
    return datasets.compare_providers(_baselines(spark, sf_dir).withColumnRenamed("baseline", "provider"), "first", "second")


@checked(
    f"""WITH {WITH_ALL}, {BASELINES}, g AS (SELECT query, baseline, copy, list_filter(['当前候选主要集中', '建议先从这类商品里继续筛选', '更贴近当前需求', '信息清楚，适合先了解', '可先关注', '等商品'], lambda t: contains(copy, t))[1] AS bad FROM bl)
SELECT query, baseline, CASE WHEN bad IS NULL THEN 'ok' ELSE 'rewritten' END AS status, coalesce(bad, '') AS reason, CASE WHEN bad IS NULL THEN copy ELSE query || '!' END AS chosen FROM g"""
)
def d17_bad_copy_gate(spark, sf_dir):
    gate = datasets.bad_copy_gate(F.col("copy"), F.concat("query", F.lit("!")), F.lit("none"))
    return _baselines(spark, sf_dir).withColumn("g", gate).select("query", "baseline", "g.status", "g.reason", F.col("g.copy").alias("chosen"))


GATED = f"""{REPLAY}, cw AS (SELECT t.query, t.template, s.copy AS summary, s.fallback AS summary_fell, s.reason AS summary_reason, CASE WHEN length(t.query) % 2 = 0 THEN 'creative' ELSE 'plain' END AS tone,
  CASE length(t.query) % 5 WHEN 0 THEN NULL WHEN 1 THEN s.copy ELSE t.query || '，日常' END AS candidate, CASE WHEN length(t.query) % 7 = 0 THEN 'timeout' ELSE '' END AS error,
  CASE length(t.query) % 3 WHEN 0 THEN NULL WHEN 1 THEN '可先关注' || t.query ELSE t.query || '！' END AS rewritten, CASE WHEN length(t.query) % 4 <> 0 THEN t.query || '好搭' END AS creative FROM t JOIN summed s USING (query)),
gb AS (SELECT *, list_filter(['当前候选主要集中', '建议先从这类商品里继续筛选', '更贴近当前需求', '信息清楚，适合先了解', '可先关注', '等商品'], lambda w: contains(coalesce(candidate, ''), w))[1] AS bad1,
  list_filter(['当前候选主要集中', '建议先从这类商品里继续筛选', '更贴近当前需求', '信息清楚，适合先了解', '可先关注', '等商品'], lambda w: contains(coalesce(rewritten, ''), w))[1] AS bad2 FROM cw),
gf AS (SELECT *, error <> '' OR candidate IS NULL AS failed, NOT failed AND tone = 'creative' AND bad1 IS NOT NULL AS tried, tried AND (bad2 IS NOT NULL OR rewritten IS NULL) AS hopeless, failed OR hopeless AS fell, CASE WHEN hopeless THEN coalesce(bad2, bad1) ELSE bad1 END AS bad FROM gb)"""


@checked(
    f"""WITH {WITH_ALL}, {GATED} SELECT query, tone, trim(CASE WHEN NOT fell THEN CASE WHEN tried THEN rewritten ELSE candidate END WHEN tone = 'creative' THEN coalesce(creative, template) WHEN summary_fell THEN template ELSE summary END) AS final_copy,
  CASE WHEN hopeless THEN 'llm_failed: bad_ad_copy_detected:' || bad WHEN error <> '' THEN 'llm_failed: ' || error WHEN failed THEN 'llm_failed: no_candidate' WHEN tried THEN 'llm_ok_rewritten' ELSE 'llm_ok' END AS llm_status, tried AS rewrite_attempted, CASE WHEN tried THEN bad ELSE '' END AS bad_copy_reason,
  fell AS fallback_triggered, CASE WHEN NOT fell THEN '' WHEN hopeless THEN 'llm_bad_copy_then_creative_template' WHEN tone = 'creative' THEN 'llm_failed_then_creative_template' WHEN summary_fell THEN 'llm_failed_then_summary_' || summary_reason ELSE 'llm_failed_then_summary_ok' END AS fallback_reason FROM gf"""
)
def d17_gated_copies(spark, sf_dir):
    """Every way through the gate: tone, candidate, error, rewrite and creative copy are told by the query's length."""
    top = stored(a5_evidence_topk(spark, sf_dir), "evidence")
    asked = top.select("query").distinct()
    # the replay's evidence: that of the first query with the same normalized form
    known = asked.groupBy(normalize_query(F.col("query")).alias("norm_query")).agg(F.min("query").alias("pair_query"))
    paired = asked.withColumn("norm_query", normalize_query(F.col("query"))).join(known, "norm_query").select("query", "pair_query")
    shown = paired.join(top.withColumnRenamed("query", "pair_query"), "pair_query").drop("pair_query")
    summed = summary_copy(shown).select("query", F.col("copy").alias("summary"), F.col("fallback").alias("summary_fell"), F.col("reason").alias("summary_reason"))
    template = shown.where("pos = 1").select("query", template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path"))).alias("template"))
    q, size = F.col("query"), F.char_length("query")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rows = summed.join(template, "query").select(
        "*", F.when(size % 2 == 0, "creative").otherwise("plain").alias("tone"), F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, F.col("summary")).otherwise(said(q, "，日常")).alias("candidate"),
        F.when(size % 7 == 0, "timeout").otherwise("").alias("error"), F.when(size % 3 == 0, F.lit(None)).when(size % 3 == 1, said("可先关注", q)).otherwise(said(q, "！")).alias("rewritten"),
        F.when(size % 4 != 0, said(q, "好搭")).alias("creative"),
    )
    return datasets.gated_copies(rows).select("query", "tone", "final_copy", "llm_status", "rewrite_attempted", "bad_copy_reason", "fallback_triggered", "fallback_reason")


@checked(
    f"""WITH {WITH_ALL}, {BASELINES}, n AS (SELECT query, max(pos) AS n FROM evidence GROUP BY query), o AS (SELECT b1.query, trim(b1.copy) AS a, trim(b2.copy) AS b, n, CASE WHEN length(b1.query) % 6 = 0 THEN 1 ELSE n END AS m,
  CASE WHEN length(b1.query) % 9 = 0 THEN 'skipped_no_api_key' WHEN length(b1.query) % 11 = 0 THEN 'error' ELSE 'ok' END AS status FROM b1 JOIN b2 USING (query) JOIN n USING (query))
SELECT query, CASE WHEN status = 'skipped_no_api_key' THEN 'skipped' WHEN status = 'error' THEN 'error' WHEN b = '' THEN 'no_output' WHEN a = b THEN 'same' WHEN length(b) >= length(a) THEN 'longer' ELSE 'different' END AS naturalness,
  CASE WHEN status = 'skipped_no_api_key' THEN 'skipped' WHEN status = 'error' THEN 'error' WHEN m > n OR length(b) > length(a) THEN 'richer' WHEN m = n AND length(b) = length(a) THEN 'similar' ELSE 'not_richer' END AS richness,
  array_to_string(list_filter(['元', '¥', '折', '优惠', '立减', '销量', '热销', '爆款', '治', '改善', '修复', '药效', '功效', '续航', '认证'], lambda w: contains(CASE WHEN b <> '' THEN b ELSE a END, w)), '|') AS risk FROM o"""
)
def d16_provider_observations(spark, sf_dir):
    """The template on the first item as the local provider, on the second as the remote one."""
    counts = a5_evidence_topk(spark, sf_dir).groupBy("query").agg(F.max("pos").alias("n"))
    rows = stored(_baselines(spark, sf_dir).join(counts, "query"), "baselines")
    size = F.char_length("query")
    local = rows.where("baseline = 'first'").select("query", "copy", F.col("n").alias("n_candidates"))
    status = F.when(size % 9 == 0, "skipped_no_api_key").when(size % 11 == 0, "error").otherwise("ok")
    remote = rows.where("baseline = 'second'").select("query", "copy", F.when(size % 6 == 0, 1).otherwise(F.col("n")).alias("n_candidates"), status.alias("status"))
    return datasets.provider_observations(local, remote).withColumn("risk", F.array_join("risk", "|"))


@checked(
    f"""WITH {WITH_ALL}, {POOL_SQL}, {REPLAY}, m AS (SELECT DISTINCT rp.query, CASE WHEN regexp_matches(t, 'brass|copper|steel|tin') THEN 'metal' WHEN regexp_matches(t, 'standard|small') THEN 'plain' WHEN regexp_matches(t, 'promo|economy') THEN 'fine' ELSE 'misc' END AS domain,
  CASE WHEN length(n) <= 6 THEN 'short' WHEN length(n) <= 15 THEN 'medium' ELSE 'long' END AS length_bucket FROM rp JOIN paths USING (query) JOIN (SELECT query, {norm("query")} AS n FROM paths) USING (query)),
k(field, value) AS (VALUES ('domain', 'metal'), ('domain', 'plain'), ('domain', 'fine'), ('domain', 'misc'), ('length', 'short'), ('length', 'medium'), ('length', 'long')),
c AS (SELECT 'domain' AS field, domain AS value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'length', length_bucket, count(*) FROM m GROUP BY ALL
  UNION ALL SELECT 'summary_reason', coalesce(nullif(reason, ''), 'none'), count(*) FROM rp WHERE baseline = 'summary_topk' GROUP BY ALL UNION ALL SELECT 'llm_provider', coalesce(nullif(provider, ''), 'none'), count(*) FROM rp WHERE baseline = 'llm_topk' GROUP BY ALL)
SELECT coalesce(k.field, c.field) AS field, coalesce(k.value, c.value) AS value, coalesce(n, 0) AS n FROM k FULL JOIN c ON k.field = c.field AND k.value = c.value"""
)
def d15_comparison_counts(spark, sf_dir):
    top = stored(a5_evidence_topk(spark, sf_dir), "evidence")
    about = datasets.query_category(top, "query", 3, CATEGORIES).select("query", F.col("query_category").alias("domain"), length_bucket(normalize_query(F.col("query"))).alias("length_bucket"))
    return datasets.comparison_counts(_replayed(spark, sf_dir), about, ("metal", "plain", "fine", "misc"), ("short", "medium", "long"))


@checked(
    f"""WITH {WITH_ALL}, {BASELINES} SELECT baseline, count(*) AS n, round(avg(fallback::INT), 4) AS fallback_rate FROM bl GROUP BY baseline"""
)
def m1_fallback_rate(spark, sf_dir):
    return metrics.fallback_rate(_baselines(spark, sf_dir), "baseline")


@checked(
    f"""WITH {WITH_ALL}, copies AS (SELECT *, {COPY} AS copy FROM (SELECT *, {SHOWN} FROM evidence))
SELECT pos, count(*) FILTER (item_title <> '') AS n_item_title, round(avg(contains(copy, item_title)::INT) FILTER (item_title <> ''), 4) AS covers_item_title,
  count(*) FILTER (brand_name <> '') AS n_brand_name, round(avg(contains(copy, brand_name)::INT) FILTER (brand_name <> ''), 4) AS covers_brand_name FROM copies GROUP BY pos"""
)
def m2_evidence_coverage(spark, sf_dir):
    copy = template_copy(*map(F.col, ("query", "item_title", "brand_name", "seller_name", "category_path")))
    return metrics.evidence_coverage(a5_evidence_topk(spark, sf_dir).withColumn("copy", copy), "pos", "copy", ("item_title", "brand_name"))


@checked(
    f"""WITH {WITH_ALL}, {BASELINES}, g AS (SELECT baseline, substr(copy, i, 2) AS gram, count(*) AS c FROM (SELECT baseline, copy, unnest(range(1, length(copy))) AS i FROM bl) GROUP BY ALL)
SELECT baseline, count(*) AS distinct_grams, sum(c)::BIGINT AS grams, round(count(*) / sum(c), 6) AS ratio FROM g GROUP BY baseline"""
)
def m3_distinct_n(spark, sf_dir):
    return metrics.distinct_n(_baselines(spark, sf_dir), "baseline", "copy", 2)


@checked(
    f"""WITH {TOKENS_SQL}, {_bm25_sql(100)}, rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
p AS (SELECT rel.query_id, avg((coalesce(pos, 999) <= 10)::INT) AS a, avg((coalesce(pos, 999) <= 20)::INT) AS b, avg((coalesce(pos, 999) <= 50)::INT) AS c, avg((coalesce(pos, 999) <= 100)::INT) AS d FROM rel LEFT JOIN run USING (query_id, doc_id) GROUP BY rel.query_id)
SELECT count(*) AS n_queries, round(avg(a), 6) AS recall_at_10, round(avg(b), 6) AS recall_at_20, round(avg(c), 6) AS recall_at_50, round(avg(d), 6) AS recall_at_100 FROM p"""
)
def m4_recall_at_k(spark, sf_dir):
    """Documents that hold a benchmark text are its relevant documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = documents_holding(docs, _bench(spark, sf_dir))
    return metrics.recall_at_k(j5_bm25_topk(spark, sf_dir), held.withColumn("relevance", F.lit(1)))


BLOCK = """string_agg(pos || '. ' || concat_ws(' | ', nullif(item_title, ''), CASE WHEN brand_name NOT IN ('', '无品牌') THEN '品牌：' || brand_name END, CASE WHEN category_path <> '' THEN '类目：' || category_path END,
  CASE WHEN seller_name <> '' THEN '店铺：' || seller_name END), chr(10) ORDER BY pos) FILTER (item_title <> '' OR category_path <> '' OR seller_name <> '')"""


@checked(f"WITH {WITH_ALL} SELECT query, coalesce({BLOCK}, '') AS block FROM evidence GROUP BY query")
def u9_evidence_block(spark, sf_dir):
    top = a5_evidence_topk(spark, sf_dir)
    fields = [c for c in top.columns if c not in ("query", "pos")]
    listed = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))).alias("found"))
    return listed.select("query", P.evidence_block(F.transform("found", lambda x: x["item"])).alias("block"))


@checked(
    f"""WITH {WITH_ALL}, blocks AS (SELECT query, coalesce({BLOCK}, '') AS block FROM evidence GROUP BY query),
p AS (SELECT b.query, concat_ws('，', CASE WHEN u.gender <> '' THEN '性别：' || u.gender END, CASE WHEN u.age_bucket <> '' THEN '年龄段：' || u.age_bucket END, CASE WHEN u.city <> '' THEN '城市：' || u.city END) AS traits, block
  FROM best b LEFT JOIN users u ON u.user_id = b.user_id JOIN blocks USING (query))
SELECT query, md5(concat_ws(chr(10) || chr(10), '根据以下用户搜索词和商品证据，生成一条真实、自然、简洁的中文广告文案。', 'query:' || chr(10) || trim(query), CASE WHEN traits <> '' THEN '用户信息:' || chr(10) || '用户画像：' || traits END,
  CASE WHEN block <> '' THEN 'top-k 商品证据:' || chr(10) || block END, '生成约束：' || chr(10) || '1. 不编造价格、折扣、销量。' || chr(10) || '2. 不编造商品不存在的功效。' || chr(10) || '3. 只输出一条 20~50 字中文广告文案。' || chr(10) || '4. 语气自然，不要夸张营销。',
  '只输出文案本身，不要解释。')) AS user_md5 FROM p"""
)
def d1_pairs_to_chat(spark, sf_dir):
    empty = history(spark, sf_dir).select("user_id", *[F.array().cast("array<bigint>").alias(c) for c in ("recently_clicked_item_ids", "recently_purchased_item_ids")])
    pairs = E.build_train_pairs(log(spark, sf_dir), items(spark, sf_dir), users(spark, sf_dir), empty)
    chats = datasets.pairs_to_chat(pairs)
    return chats.select("metadata.query", F.md5(F.col("messages")[1]["content"]).alias("user_md5"))


@checked(
    f"""WITH {WITH_ALL}, {WITH_BEHAVIOR}, blocks AS (SELECT query, coalesce({BLOCK}, '') AS block FROM evidence GROUP BY query),
p AS (SELECT b.query, concat_ws('，', CASE WHEN u.gender <> '' THEN '性别：' || u.gender END, CASE WHEN u.age_bucket <> '' THEN '年龄段：' || u.age_bucket END, CASE WHEN u.city <> '' THEN '城市：' || u.city END) AS traits, block,
  coalesce(array_to_string(titles, '；'), '') AS seen FROM best b LEFT JOIN users u ON u.user_id = b.user_id JOIN blocks USING (query) LEFT JOIN behaved t ON t.query = b.query),
c AS (SELECT *, concat_ws(chr(10), CASE WHEN traits <> '' THEN '用户画像：' || traits END, CASE WHEN seen <> '' THEN '最近行为：' || seen END) AS context FROM p)
SELECT query, seen <> '' AS has_behavior, md5(concat_ws(chr(10) || chr(10), '根据以下用户搜索词和商品证据，生成一条真实、自然、简洁的中文广告文案。', 'query:' || chr(10) || trim(query), CASE WHEN context <> '' THEN '用户信息:' || chr(10) || context END,
  CASE WHEN block <> '' THEN 'top-k 商品证据:' || chr(10) || block END, '生成约束：' || chr(10) || '1. 不编造价格、折扣、销量。' || chr(10) || '2. 不编造商品不存在的功效。' || chr(10) || '3. 只输出一条 20~50 字中文广告文案。' || chr(10) || '4. 语气自然，不要夸张营销。',
  '只输出文案本身，不要解释。')) AS user_md5 FROM c"""
)
def d1_pairs_with_behavior(spark, sf_dir):
    """Prompts with the titles of the items that the best row's user clicked and purchased."""
    pairs = E.build_train_pairs(log(spark, sf_dir), items(spark, sf_dir), users(spark, sf_dir), behavior(spark, sf_dir))
    content = F.col("messages")[1]["content"]
    return datasets.pairs_to_chat(pairs).select("metadata.query", F.contains(content, F.lit("最近行为：")).alias("has_behavior"), F.md5(content).alias("user_md5"))


@checked(
    f"""WITH {WITH_ALL}, l AS (SELECT query, max(pos) AS n FROM evidence GROUP BY query), s AS (SELECT query, n, (['train_pairs_user_exact', 'rank_query_exact', 'bm25'])[n] AS source FROM l)
SELECT query, CASE WHEN source = 'train_pairs_user_exact' THEN CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END WHEN source = 'rank_query_exact' THEN 'medium' ELSE 'low' END AS confidence FROM s"""
)
def d6_evidence_confidence(spark, sf_dir):
    counts = a5_evidence_topk(spark, sf_dir).groupBy("query").agg(F.max("pos").alias("n"))
    source = F.element_at(F.array(*map(F.lit, ("train_pairs_user_exact", "rank_query_exact", "bm25"))), F.col("n"))
    return counts.select("query", datasets.evidence_confidence(source, F.col("n")).alias("confidence"))


#: Outcomes with every kind of failure, made from the copies of all evidence rows.
def _outcomes(spark, sf_dir):
    top = a5_evidence_topk(spark, sf_dir)
    texts = F.array("item_title", "brand_name", "seller_name", "category_path")
    return top.select(
        F.concat_ws("#", "query", F.col("pos").cast("string")).alias("seq"), "query", "pos",
        F.when(F.col("item_id") % 11 == 0, "provider_partial").otherwise("provider_ok").alias("llm_status"),
        (F.col("item_id") % 7 != 0).alias("top_valid"), F.array().cast("array<string>").alias("top_issues"),
        F.when(F.col("item_id") % 13 == 0, "summary_fallback").otherwise("llm_ranker_top1").alias("final_source"),
        F.concat(F.left("item_title", F.lit(30)), F.when(F.col("item_id") % 5 == 0, F.lit("正品")).otherwise(F.lit(""))).alias("final_copy"),
        F.col("ranking_signal").alias("rank_score"), texts.alias("evidence_texts"), F.lit("llm").alias("candidate_source"), F.lit("").alias("rewrite_reason"),
    )


REASONS = """o AS (SELECT query, pos, query || '#' || pos AS seq, item_id, left(item_title, 30) || CASE WHEN item_id % 5 = 0 THEN '正品' ELSE '' END AS copy, ranking_signal FROM evidence),
f AS (SELECT *, CASE WHEN NOT regexp_matches(query, '[a-zA-Z]') THEN 'query_too_noisy' WHEN item_id % 11 = 0 THEN 'provider_not_ok' WHEN item_id % 7 = 0 THEN 'validator_invalid' WHEN item_id % 13 = 0 THEN 'fallback_copy_source'
  WHEN contains(copy, '正品') THEN 'suspicious_claims' WHEN ranking_signal < 8 THEN 'score_below_min' WHEN length(trim(copy)) < 12 OR length(trim(copy)) > 40 THEN 'copy_length_out_of_range' END AS reason FROM o)"""


@checked(f"WITH {WITH_ALL}, {REASONS} SELECT seq, reason FROM f")
def d2_filter_reason(spark, sf_dir):
    """Copies are cut titles, so they are always related to their evidence; the rules after that are unit-tested."""
    return _outcomes(spark, sf_dir).select("seq", datasets.filter_reason(8.0).alias("reason"))


@checked(f"WITH {WITH_ALL}, {REASONS} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM f GROUP BY ALL")
def d3_funnel_counts(spark, sf_dir):
    return datasets.funnel_counts(_outcomes(spark, sf_dir).withColumn("reason", datasets.filter_reason(8.0)))


#: A run over the first outcomes in order: some failed, some have no query; a query is taken once, and 60 are wanted.
RUN = f"""{REASONS}, r AS (SELECT seq, CASE WHEN item_id % 17 = 0 THEN '' ELSE query END AS query, CASE WHEN item_id % 19 = 0 THEN 'timeout' ELSE '' END AS error, reason FROM f),
s AS (SELECT * FROM r ORDER BY seq LIMIT 3000), g AS (SELECT *, min(seq) FILTER (error = '' AND reason IS NULL) OVER (PARTITION BY query) AS first FROM s),
t AS (SELECT seq, query, CASE WHEN query = '' THEN 'filtered' WHEN first < seq THEN 'skipped' WHEN error <> '' THEN 'error' WHEN reason IS NOT NULL THEN 'filtered' ELSE 'accepted' END AS kind,
  CASE WHEN query = '' THEN 'empty_query' WHEN first < seq THEN 'duplicate_query' WHEN error <> '' THEN error ELSE coalesce(reason, '') END AS why FROM g),
u AS (SELECT * FROM t WHERE seq <= coalesce((SELECT seq FROM t WHERE kind = 'accepted' ORDER BY seq LIMIT 1 OFFSET 59), 'zzzz'))"""


def _run(spark, sf_dir):
    judged = _outcomes(spark, sf_dir).withColumn("reason", datasets.filter_reason(8.0))
    given = a5_evidence_topk(spark, sf_dir).select(F.concat_ws("#", "query", F.col("pos").cast("string")).alias("seq"), "item_id")
    rows = judged.join(given, "seq").withColumn("query", F.when(F.col("item_id") % 17 == 0, "").otherwise(F.col("query")))
    rows = rows.withColumn("error", F.when(F.col("item_id") % 19 == 0, "timeout").otherwise(""))
    return datasets.funnel_status(rows.select("seq", "query", "error", "reason"), 60, 3000)


@checked(f"WITH {WITH_ALL}, {RUN} SELECT seq, query, kind, why FROM u")
def d3_funnel_status(spark, sf_dir):
    return _run(spark, sf_dir)


@checked(f"WITH {WITH_ALL}, {RUN} SELECT kind, why, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'scanned', '', count(*) FROM u")
def d3_funnel_report(spark, sf_dir):
    """The counts of a run, read off while its accepted rows are written."""
    accepted, seen = datasets.observed_funnel(_run(spark, sf_dir))
    accepted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(datasets.funnel_table(seen), "kind string, why string, n long")


@checked(
    f"""WITH {WITH_ALL}, {REASONS}, s AS (SELECT * FROM f ORDER BY seq LIMIT 1500), a AS (SELECT * FROM s WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY seq) = 1)
SELECT seq, query FROM a ORDER BY seq LIMIT 100"""
)
def d4_accept_first_n(spark, sf_dir):
    judged = _outcomes(spark, sf_dir).withColumn("reason", datasets.filter_reason(8.0))
    return datasets.accept_first_n(judged, 100, 1500).select("seq", "query")


@checked(f"WITH {WITH_ALL}, {REASONS} SELECT seq FROM f WHERE query NOT IN (SELECT query FROM f WHERE reason IS NULL)")
def d5_resume_anti(spark, sf_dir):
    judged = _outcomes(spark, sf_dir).withColumn("reason", datasets.filter_reason(8.0))
    return datasets.resume_anti(judged, judged.where("reason is null")).select("seq")
