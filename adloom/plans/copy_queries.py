"""Checked queries of query understanding and of candidate copies."""

from pyspark.sql import functions as F

from adloom.functions import lexicons as L
from adloom.operators import candidates as K
from adloom.operators import templates as T
from adloom.operators import understanding as U
from adloom.plans.base import WITH_ALL, WITH_BEHAVIOR, checked, log, norm, quoted
from adloom.plans.evidence_queries import COPY, SHOWN, a5_evidence_topk
from adloom.sources.stored import stored

def _evidence(spark, sf_dir):
    """The evidence of all queries, written once for the plans that read it several times."""
    return stored(a5_evidence_topk(spark, sf_dir), "evidence")


HINTS = f"""nq AS (SELECT DISTINCT query, {norm("query")} AS query_text FROM evidence),
named AS (SELECT query, min_by(brand_name, pos) AS b FROM evidence JOIN nq USING (query) WHERE brand_name <> '' AND contains(lower(query_text), lower(brand_name)) GROUP BY query),
cb AS (SELECT query, brand_name AS b FROM (SELECT query, brand_name, count(*) AS n, min(pos) AS p FROM evidence WHERE brand_name <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, p) = 1),
cl AS (SELECT query, leaf FROM (SELECT query, trim(string_split(category_path, '>')[-1]) AS leaf, count(*) AS n, min(pos) AS p FROM evidence GROUP BY ALL) WHERE leaf <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, p) = 1),
hints AS (SELECT nq.query, query_text, coalesce(named.b, cb.b, '') AS brand_hint, coalesce(leaf, '') AS category_hint,
  coalesce(list_filter(regexp_extract_all(query_text, '[A-Za-z]+[A-Za-z0-9\\-]*\\d+[A-Za-z0-9\\-]*'), lambda m: regexp_matches(m, '[0-9]'))[1], list_filter(regexp_extract_all(query_text, '\\d+[A-Za-z]+[A-Za-z0-9\\-]*'), lambda m: regexp_matches(m, '[0-9]'))[1],
    list_filter(regexp_extract_all(query_text, '[A-Za-z0-9\\-]{{3,}}'), lambda m: regexp_matches(m, '[0-9]'))[1], '') AS model_hint
  FROM nq LEFT JOIN named USING (query) LEFT JOIN cb USING (query) LEFT JOIN cl USING (query))"""


@checked(
    f"""WITH {WITH_ALL}, q AS (SELECT DISTINCT query, {norm("query")} AS n FROM log), t AS (SELECT *, regexp_extract_all(n, '[A-Za-z0-9][A-Za-z0-9\\-]*|[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}') AS w FROM q)
SELECT query, n AS normalized_query, length(n)::INT AS query_length, array_to_string(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z0-9]')), '|') AS alnum, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z0-9]'))) > 0 AS has_alpha_num_token FROM t"""
)
def u1_query_features(spark, sf_dir):
    made = U.query_features(log(spark, sf_dir).select("query").distinct())
    return made.select("query", "normalized_query", "query_length", F.array_join("alpha_num_tokens", "|").alias("alnum"), "has_alpha_num_token")


@checked(f"WITH {WITH_ALL}, {HINTS} SELECT query, brand_hint, category_hint, model_hint FROM hints")
def u3_hints(spark, sf_dir):
    return U.intent(a5_evidence_topk(spark, sf_dir)).select("query", "brand_hint", "category_hint", "model_hint")


INTENT = f"""words AS (SELECT *, regexp_extract_all(query_text, '[A-Za-z0-9][A-Za-z0-9\\-]*|[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}') AS w FROM hints),
al AS (SELECT *, list_filter(w, lambda x, i: length(x) >= 2 AND list_position(w, x) = i AND x NOT IN (brand_hint, category_hint, model_hint))[1:6] AS attributes FROM words),
fl AS (SELECT *, list_filter([brand_hint, model_hint, category_hint] || attributes, lambda x: x <> '') AS raw_focus FROM al),
intents AS (SELECT *, list_filter(raw_focus, lambda x, i: list_position(raw_focus, x) = i)[1:8] AS focus FROM fl)"""


@checked(
    f"""WITH {WITH_ALL}, {HINTS}, {INTENT} SELECT query, array_to_string(attributes, '|') AS attributes, array_to_string(focus, '|') AS focus,
  coalesce(nullif(array_to_string(list_filter([brand_hint, model_hint, category_hint], lambda x: x <> ''), ' / '), ''), query_text) AS intent_summary FROM intents"""
)
def u4_intent(spark, sf_dir):
    made = U.intent(a5_evidence_topk(spark, sf_dir))
    return made.select("query", F.array_join("attribute_hints", "|").alias("attributes"), F.array_join("search_focus", "|").alias("focus"), "intent_summary")


RESCORED = """fit AS (SELECT e.*, i.brand_hint, i.category_hint, i.focus, lower(concat_ws(' ', item_title, brand_name, e.category_path)) AS t FROM evidence e JOIN intents i USING (query)),
sc AS (SELECT *, round(ranking_signal + 2 * (brand_hint <> '' AND contains(t, lower(brand_hint)))::INT + (category_hint <> '' AND contains(t, lower(category_hint)))::INT + len(list_filter(list_distinct(list_transform(focus, lambda x: lower(x))), lambda x: contains(t, x))), 6) AS evidence_fit FROM fit),
selected AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evidence_fit DESC, ranking_signal DESC, item_id) AS new_pos FROM sc)"""


@checked(f"WITH {WITH_ALL}, {HINTS}, {INTENT}, {RESCORED} SELECT query, item_id, pos AS old_pos, new_pos AS pos, evidence_fit FROM selected WHERE new_pos <= 2")
def u5_rescore_evidence(spark, sf_dir):
    top = _evidence(spark, sf_dir)
    return U.rescore_evidence(top, U.intent(top), 2).select("query", "item_id", "old_pos", "pos", "evidence_fit")


@checked(
    f"""WITH {WITH_ALL}, {HINTS}, {INTENT}, {RESCORED}, f AS (SELECT query, new_pos, unnest(list_filter([CASE WHEN item_title <> '' THEN 'title=' || CASE WHEN length(item_title) <= 18 THEN item_title ELSE regexp_replace(left(item_title, 18), '[，。；、 ]+$', '') || '等' END END,
  CASE WHEN brand_name <> '' THEN 'brand=' || brand_name END, CASE WHEN category_path <> '' THEN 'category=' || trim(string_split(category_path, '>')[-1]) END], lambda x: x IS NOT NULL)) AS fact, unnest([1, 2, 3]) AS k FROM selected),
g AS (SELECT query, fact, min(new_pos * 10 + k) AS place FROM f WHERE fact IS NOT NULL GROUP BY ALL)
SELECT query, string_agg(fact, '|' ORDER BY place) AS facts FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY place) <= 8) GROUP BY query"""
)
def u6_facts(spark, sf_dir):
    top = _evidence(spark, sf_dir)
    intents = U.intent(top)
    return U.facts(U.rescore_evidence(top, intents), intents).select("query", F.array_join("fact_block", "|").alias("facts"))


TOP = """lf AS (SELECT *, trim(split_part(category_path, '>', 1)) AS major, trim(string_split(category_path, '>')[-1]) AS leaf, CASE WHEN brand_name IN ('', '无品牌') THEN '' ELSE brand_name END AS usable FROM evidence),
tb AS (SELECT * FROM (SELECT query, usable AS v, count(*) AS c, min(pos) AS p FROM lf WHERE usable <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, p) = 1),
tm AS (SELECT * FROM (SELECT query, major AS v, count(*) AS c, min(pos) AS p FROM lf WHERE major <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, p) = 1),
tl AS (SELECT * FROM (SELECT query, leaf AS v, count(*) AS c, min(pos) AS p FROM lf WHERE leaf <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, p) = 1),
n AS (SELECT query, count(*) AS n FROM evidence GROUP BY query),
hw AS (SELECT query, w, count(*) AS c FROM (SELECT DISTINCT query, pos, unnest(regexp_extract_all(item_title, '[A-Za-z0-9]+|[\\x{4e00}-\\x{9fff}]{2,}')) AS w FROM evidence) WHERE length(w) >= 2 GROUP BY ALL),
hint AS (SELECT query, w FROM hw JOIN n USING (query) WHERE c = n AND n >= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(w) DESC, w) = 1)"""


SUMMARY = """s AS (SELECT n.query, n, coalesce(tb.v, '') AS b, coalesce(tb.c, 0) AS bc, coalesce(tm.v, '') AS m, coalesce(tm.c, 0) AS mc, coalesce(tl.v, '') AS l, coalesce(tl.c, 0) AS lc, coalesce(hint.w, '') AS h
  FROM n LEFT JOIN tb USING (query) LEFT JOIN tm USING (query) LEFT JOIN tl USING (query) LEFT JOIN hint USING (query)),
r AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_evidence_items' WHEN bc >= 2 AND lc >= 2 THEN 'shared_brand_and_leaf_category' WHEN mc = n AND l <> '' THEN 'shared_major_category' WHEN mc >= 2 THEN 'major_category_majority'
  WHEN h <> '' THEN 'common_title_hint' ELSE 'no_summary_signal' END AS reason FROM s),
summed AS (SELECT query, reason, reason IN ('insufficient_evidence_items', 'no_summary_signal') AS fallback, CASE reason WHEN 'shared_brand_and_leaf_category' THEN concat('搜“', trim(query), '”时，可先关注', b, l, '方向，当前候选主要集中在这类商品，便于更快缩小选择范围。')
  WHEN 'shared_major_category' THEN concat('搜“', trim(query), '”时，当前候选主要集中在', m, '下的', l, '方向，建议先从这类商品里继续筛选。') WHEN 'major_category_majority' THEN concat('结合“', trim(query), '”的搜索意图，当前证据更多落在', m, '相关商品上，可优先关注这一类方向。')
  WHEN 'common_title_hint' THEN concat('搜“', trim(query), '”时，当前候选多围绕“', h, '”相关商品，可先从这一方向继续筛选。') ELSE template END AS copy FROM r JOIN t USING (query))"""


@checked(
    f"""WITH {WITH_ALL}, {TOP}, t AS (SELECT query, {COPY} AS template FROM (SELECT *, {SHOWN} FROM evidence WHERE pos = 1)), {SUMMARY}
SELECT query, reason, fallback, copy FROM summed"""
)
def u11_summary_copy(spark, sf_dir):
    return U.summary_copy(_evidence(spark, sf_dir)).select("query", "reason", "fallback", "copy")


@checked(
    f"""WITH {WITH_ALL}, l AS (SELECT query, min_by(trim(string_split(category_path, '>')[-1]), pos) AS label, min_by(item_title, pos) AS title FROM evidence WHERE trim(string_split(category_path, '>')[-1]) <> '' GROUP BY query)
SELECT query, concat('围绕“', trim(query), '”这类需求，不妨先看', label, '相关款，更容易找到贴合场景的选择。') AS copy FROM l"""
)
def u12_creative_copy(spark, sf_dir):
    """Titles here have no Han tokens and every item has a category, so the category sentence applies."""
    return U.creative_copy(_evidence(spark, sf_dir))


@checked(
    f"""WITH {WITH_ALL} SELECT b.query, concat_ws('|', CASE WHEN u.gender <> '' THEN 'gender=' || u.gender END, CASE WHEN u.age_bucket <> '' THEN 'age=' || u.age_bucket END, CASE WHEN u.city <> '' THEN 'city=' || u.city END) AS demographic,
  CASE WHEN u.user_id IS NULL THEN 'none' ELSE 'weak' END AS strength FROM best b LEFT JOIN users u ON u.user_id = b.user_id"""
)
def u7_user_tags(spark, sf_dir):
    from adloom.operators import evidence as E
    from adloom.plans.base import users

    best = E.attach_user_profile(E.best_record(E.positives(log(spark, sf_dir))).select("query", "user_id"), users(spark, sf_dir))
    made = U.user_tags(best.withColumn("recent_behavior_titles", F.array().cast("array<string>")))
    return made.select("query", F.array_join("demographic_tags", "|").alias("demographic"), F.col("personalization_strength").alias("strength"))


@checked(
    f"""WITH {WITH_ALL}, {WITH_BEHAVIOR}, p AS (SELECT b.query, u.*, coalesce(titles, []) AS titles FROM best b LEFT JOIN users u ON u.user_id = b.user_id LEFT JOIN behaved t ON t.query = b.query),
t AS (SELECT *, list_transform(titles, lambda x: regexp_extract(x, '[A-Za-z0-9][A-Za-z0-9\\-]*|[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}')) AS firsts,
  flatten(list_transform(titles, lambda x: list_filter([{", ".join(map(quoted, L.INTERESTS))}], lambda w: contains(x, w)))) AS found FROM p)
SELECT query, concat_ws('|', CASE WHEN gender <> '' THEN 'gender=' || gender END, CASE WHEN age_bucket <> '' THEN 'age=' || age_bucket END, CASE WHEN city <> '' THEN 'city=' || city END) AS demographic,
  array_to_string(list_filter(firsts, lambda x, i: x <> '' AND list_position(firsts, x) = i), '|') AS behavior, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), '|') AS interests,
  CASE WHEN user_id IS NOT NULL AND len(titles) > 0 THEN 'medium' WHEN user_id IS NOT NULL OR len(titles) > 0 THEN 'weak' ELSE 'none' END AS strength FROM t"""
)
def u7_behavior_tags(spark, sf_dir):
    """All tags of the best row's user, with the titles of the items that the user clicked and purchased."""
    from adloom.operators import evidence as E
    from adloom.plans.base import behavior, items, users

    best = E.best_record(E.positives(log(spark, sf_dir))).select("query", "user_id")
    titles = E.recent_behavior_titles(best.join(behavior(spark, sf_dir), "user_id", "left"), items(spark, sf_dir))
    made = U.user_tags(E.attach_user_profile(best, users(spark, sf_dir)).join(titles, "query"))
    joined = [F.array_join(f"{c}_tags", "|").alias(name) for c, name in (("demographic", "demographic"), ("behavior", "behavior"), ("interest", "interests"))]
    return made.select("query", *joined, F.col("personalization_strength").alias("strength"))


@checked(
    f"""WITH {WITH_ALL}, {HINTS} SELECT query, CASE WHEN length(query_text) <= 6 THEN 'creative_compact' WHEN category_hint <> '' THEN 'fact_led' ELSE 'balanced_generic' END AS style_id FROM hints"""
)
def u8_select_style(spark, sf_dir):
    made = U.intent(a5_evidence_topk(spark, sf_dir))
    style = U.select_style(F.lit("creative"), F.char_length("query_text"), F.col("scene_hint"), F.col("category_hint"))
    return made.select("query", style["style_id"].alias("style_id"))


def _generations(spark, sf_dir, top=None):
    """Raw generator outputs of every evidence row: JSON with one copy at odd positions, labelled lines at even ones."""
    top = a5_evidence_topk(spark, sf_dir) if top is None else top
    copy = F.concat(F.col("item_title"), F.lit("，"), F.col("brand_name"), F.when(F.col("item_id") % 3 == 0, F.lit("优惠")).otherwise(F.lit("日常")))
    json = F.to_json(F.struct(F.array(F.struct(copy.alias("copy"), F.lit("卖点型").alias("strategy"), F.array(F.col("item_id").cast("string")).alias("used_evidence"))).alias("copies")))
    plain = F.concat(F.lit("\n候选"), F.col("pos").cast("string"), F.lit("："), copy)
    raw = F.when(F.col("pos") % 2 == 1, json).otherwise(plain)
    return top.select("query", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("candidate_id"), raw.alias("raw_text"))


PARSED = """parsed AS (SELECT query, pos, 'g' || pos || CASE WHEN pos % 2 = 1 THEN '_1' ELSE '' END AS candidate_id, concat(item_title, '，', brand_name, CASE WHEN item_id % 3 = 0 THEN '优惠' ELSE '日常' END) AS text,
  CASE WHEN pos % 2 = 1 THEN item_id::VARCHAR ELSE '' END AS used FROM evidence)"""


@checked(f"WITH {WITH_ALL}, {PARSED} SELECT query, candidate_id, text, used FROM parsed")
def k2_parse_generations(spark, sf_dir):
    return K.parse_generations(_generations(spark, sf_dir)).select("query", "candidate_id", "text", F.array_join("used_evidence", "|").alias("used"))


def _validated(spark, sf_dir, top=None):
    top = _evidence(spark, sf_dir) if top is None else top
    intents = U.intent(top).select("query", "query_text", "brand_hint", "category_hint", "scene_hint", "crowd_hint")
    anchor = top.where("pos = 1").select("query", F.col("item_title").alias("anchor_title"))
    return K.validate_candidates(K.parse_generations(_generations(spark, sf_dir, top)).join(intents, "query").join(anchor, "query"))


VALID = """cand AS (SELECT p.*, regexp_replace(text, '\\s+', '', 'g') AS clean, query_text, brand_hint, category_hint, a.item_title AS anchor FROM parsed p JOIN hints USING (query) JOIN (SELECT query, item_title FROM evidence WHERE pos = 1) a USING (query)),
valid AS (SELECT *, array_to_string(list_filter([CASE WHEN length(clean) < 12 THEN 'too_short' END, CASE WHEN length(clean) > 60 THEN 'too_long' END, CASE WHEN contains(clean, '优惠') THEN 'unsupported_claim' END], lambda x: x IS NOT NULL), '|') AS issues, length(clean)::INT AS length,
  len(list_filter(list_distinct(list_filter([trim(query_text), trim(brand_hint), trim(category_hint), trim(anchor)], lambda x: x <> '')), lambda x: contains(clean, x)))::INT AS relevance_hits FROM cand)"""


@checked(f"WITH {WITH_ALL}, {HINTS}, {PARSED}, {VALID} SELECT query, candidate_id, clean AS text, issues, length, relevance_hits FROM valid")
def k4_validate_candidates(spark, sf_dir):
    return _validated(spark, sf_dir).select("query", "candidate_id", "text", F.array_join("issues", "|").alias("issues"), "length", "relevance_hits")


def _ranked(spark, sf_dir, top=None):
    top = _evidence(spark, sf_dir) if top is None else top
    intents = stored(U.intent(top), "intents")
    points = U.facts(U.rescore_evidence(top, intents), intents).select("query", "selling_points")
    return K.rank_candidates(K.score_candidates(_validated(spark, sf_dir, top).join(points, "query")))


SCORED = """scored AS (SELECT *, CASE WHEN issues = '' THEN 48 ELSE greatest(0, 16 - 8 * len(string_split(issues, '|'))) END + 8 * relevance_hits + 18 + CASE WHEN contains(clean, '日常') THEN 4 ELSE 0 END
  + CASE WHEN length BETWEEN 12 AND 20 THEN 16 WHEN length BETWEEN 21 AND 26 THEN 14 WHEN length BETWEEN 27 AND 30 THEN 8 ELSE 0 END AS rank_score FROM valid),
rankd AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank_score DESC, CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, '|')) END, candidate_id) AS rank FROM scored)"""


@checked(f"WITH {WITH_ALL}, {HINTS}, {PARSED}, {VALID}, {SCORED} SELECT query, candidate_id, rank_score, rank FROM rankd")
def k6_rank_candidates(spark, sf_dir):
    """Every copy has one comma and at most the scene word, and English titles have no selling points of the Chinese
    lexicon, so the score's other terms are 0 on this data; tests cover them."""
    return _ranked(spark, sf_dir).select("query", "candidate_id", "rank_score", "rank")


@checked(f"WITH {WITH_ALL}, {HINTS}, {PARSED}, {VALID}, {SCORED}, d AS (SELECT query, clean AS text, min(rank) AS rank FROM rankd GROUP BY ALL) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 2")
def k8_distinct_candidates(spark, sf_dir):
    return K.distinct_candidates(_ranked(spark, sf_dir), 2)


#: final: the top candidate with an end mark if it has no issues; else the summary, as all of its issues are claims here.
FINAL = f"""{TOP}, t AS (SELECT query, {COPY} AS template FROM (SELECT *, {SHOWN} FROM evidence WHERE pos = 1)), {SUMMARY},
final AS (SELECT s.query, r.candidate_id, r.clean, r.issues, coalesce(issues = '', false) AS good, CASE WHEN good THEN clean || '。' ELSE s.copy END AS final_copy, CASE WHEN good THEN 'llm_ranker_top1' ELSE 'summary_fallback' END AS final_source,
  CASE WHEN good THEN 'top_candidate_kept' WHEN clean IS NULL THEN 'empty_ranker_result_then_summary_fallback' ELSE 'summary_fallback:' || s.reason END AS rewrite_reason
  FROM summed s LEFT JOIN (SELECT * FROM rankd WHERE rank = 1) r ON r.query = s.query)"""
CLAIMS = f"list_filter([{', '.join(map(quoted, L.SUSPICIOUS_CLAIMS))}], lambda w: contains(final_copy, w))"


def _chosen(spark, sf_dir, top, ranked):
    best = ranked.where("rank = 1").select("query", "candidate_id", "text", "issues")
    summary = U.summary_copy(top).select("query", F.col("copy").alias("summary"), F.col("reason").alias("summary_reason"))
    creative = U.creative_copy(top).select("query", F.col("copy").alias("creative"))
    return K.choose_final_copy(summary.join(best, "query", "left").join(creative, "query").withColumn("template", F.col("summary")))


@checked(
    f"""WITH {WITH_ALL}, {HINTS}, {PARSED}, {VALID}, {SCORED}, {FINAL}
SELECT query, final_copy, final_source, rewrite_reason, NOT good AS fallback_triggered, CASE WHEN good THEN '' ELSE rewrite_reason END AS fallback_reason, array_to_string({CLAIMS}, '|') AS suspicious_claims FROM final"""
)
def k7_choose_final_copy(spark, sf_dir):
    """The whole chain to the final copy. On this data's titles cleaning only adds the end mark, so it has an SQL form; the
    other rewriting rules are unit-tested."""
    top = _evidence(spark, sf_dir)
    chosen = _chosen(spark, sf_dir, top, _ranked(spark, sf_dir, top)).withColumn("provider_fallback", F.lit(False))
    return K.flatten_outcome(chosen).withColumn("suspicious_claims", F.array_join("suspicious_claims", "|"))


#: The vertical of an item's last digit in eights, its two first points, and pieces of its scene and audience.
def _vertical_values() -> str:
    rows = []
    for i, (name, _, scene, audience) in enumerate(L.VERTICALS):
        pieces = [scene[:4], audience[:4], *[t[k : k + n] for t in (scene, audience) for n in (2, 3) for k in range(len(t) - n + 1)], *L.NATURAL_SCENES]
        first, second = L.VERTICAL_POINTS[name][1][:2]
        rows.append(f"({i}, {quoted(name)}, {quoted(scene)}, {quoted(audience)}, {quoted(first)}, {quoted(second)}, [{', '.join(map(quoted, pieces))}])")
    return ", ".join(rows)


SENTENCE_VALUES = ", ".join(f"({quoted(v)}, {quoted(L.STRATEGIES[i])}, {i}, {quoted(x)})" for v, found in L.SENTENCES.items() for i, x in enumerate(found))
FILLED = "sentence"
for mark, value in (("{ab}", "CASE WHEN a <> b THEN a || b ELSE a END"), ("{s}", "scene"), ("{u}", "audience"), ("{q}", "term"), ("{a}", "a"), ("{b}", "b"), ("{o}", "b")):
    FILLED = f"replace({FILLED}, '{mark}', {value})"


@checked(
    f"""WITH {WITH_ALL}, v(k, vertical, scene, audience, p1, p2, pieces) AS (VALUES {_vertical_values()}), st(vertical, strategy, turn, sentence) AS (VALUES {SENTENCE_VALUES}),
e AS (SELECT query, item_id, item_title, brand_name FROM evidence WHERE pos = 1),
w AS (SELECT *, coalesce(list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda t: length(t) >= 2)[1], query) AS term, list_filter(regexp_extract_all(brand_name, '[A-Za-z0-9][A-Za-z0-9\\-]*|[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}'), lambda t: length(t) >= 2) AS focus FROM e JOIN v ON v.k = item_id % 8),
p AS (SELECT *, ([p1, p2] || list_filter([item_title] || focus, lambda x, i: list_position([item_title] || focus, x) = i))[1:4] AS points FROM w),
d AS (SELECT p.*, strategy, turn, sentence, CASE WHEN turn = 1 THEN points[2] ELSE p1 END AS a, CASE WHEN turn = 1 THEN points[3] ELSE p2 END AS b FROM p JOIN st USING (vertical)),
f AS (SELECT *, {FILLED} AS filled FROM d)
SELECT query, 'tpl_' || (turn + 1) AS candidate_id, strategy, vertical, CASE WHEN len(list_filter(pieces || regexp_extract_all(term, '[A-Za-z0-9][A-Za-z0-9\\-]*')[1:3], lambda t: contains(filled, t))) > 0 THEN filled ELSE scene || filled END AS draft,
  a || '|' || b AS evidence, audience AS tags FROM f"""
)
def k1_template_drafts(spark, sf_dir):
    """The filled sentences for every query; its first item's id in eights says which vertical's word stands for its category."""
    named = F.array(*[F.lit(words[0] if words else "") for _, words, *_ in L.VERTICALS])
    none = F.array().cast("array<string>")
    asked = a5_evidence_topk(spark, sf_dir).where("pos = 1").select(
        "query", F.get(named, (F.col("item_id") % 8).cast("int")).alias("category_hint"), F.array("item_title").alias("titles"), F.lit("").alias("scenario"), F.lit(None).cast("string").alias("audience"),
        F.col("brand_name").alias("purchase_focus"), F.array("item_title").alias("points"), none.alias("interest_tags"), none.alias("demographic_tags"),
    )
    made = T.template_drafts(asked)
    return made.select("query", "candidate_id", "strategy", "vertical", "draft", F.array_join("used_evidence", "|").alias("evidence"), F.array_join("personalized_tags", "|").alias("tags"))


@checked(
    f"""WITH {WITH_ALL}, g AS (SELECT query, pos AS place, CASE WHEN item_id % 2 = 0 THEN item_title ELSE '' END AS text FROM evidence),
w AS (SELECT query, count(*) AS n, count(*) FILTER (text <> '') AS nt, count(DISTINCT nullif(text, '')) AS nd, min(place) FILTER (text <> '') AS f FROM g GROUP BY query)
SELECT query, place, CASE WHEN nt = 0 OR (nd = 1 AND n > 1 AND (text = '' OR place <> f)) THEN 'made ' || place ELSE text END AS text, CASE WHEN nt = 0 THEN 'synthetic_candidates' WHEN (nd = 1 AND n > 1) OR nt < n THEN 'provider_partial' ELSE 'provider_ok' END AS status FROM g JOIN w USING (query)"""
)
def k10_backfill_generations(spark, sf_dir):
    top = _evidence(spark, sf_dir)
    given = top.select("query", F.col("pos").alias("place"), F.when(F.col("item_id") % 2 == 0, F.col("item_title")).otherwise("").alias("text"))
    made = top.select("query", F.col("pos").alias("place"), F.concat(F.lit("made "), F.col("pos").cast("string")).alias("copy"))
    return K.backfill_generations(given, made).select("query", "place", "text", "status")


@checked(
    f"""WITH {WITH_ALL}, c AS (SELECT query, 'g' || pos AS candidate_id, pos, CASE WHEN pos = 2 THEN item_id END AS cited, 10 - pos AS score FROM evidence WHERE item_id % 3 <> 0),
linked AS (SELECT e.query, e.item_id, c.candidate_id FROM evidence e JOIN c ON c.query = e.query AND c.cited = e.item_id),
rest AS (SELECT e.query, e.item_id, row_number() OVER (PARTITION BY e.query ORDER BY e.pos, e.item_id) AS turn FROM evidence e WHERE (e.query, e.item_id) NOT IN (SELECT query, item_id FROM linked)),
unused AS (SELECT query, candidate_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate_id) AS turn FROM c WHERE (query, candidate_id) NOT IN (SELECT query, candidate_id FROM linked)),
top AS (SELECT query, min_by(candidate_id, pos) AS top_id FROM c GROUP BY query)
SELECT query, item_id, candidate_id, 'linked' AS how FROM linked UNION ALL
SELECT r.query, r.item_id, coalesce(u.candidate_id, t.top_id), CASE WHEN u.candidate_id IS NOT NULL THEN 'distributed' WHEN t.top_id IS NOT NULL THEN 'fallback' ELSE 'none' END
FROM rest r LEFT JOIN unused u ON u.query = r.query AND u.turn = r.turn LEFT JOIN top t ON t.query = r.query"""
)
def j10_assign_copies(spark, sf_dir):
    top = _evidence(spark, sf_dir)
    cites = F.when(F.col("pos") == 2, F.array(F.col("item_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    made = top.where("item_id % 3 <> 0").select("query", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("candidate_id"), (10 - F.col("pos")).alias("rank_score"), cites.alias("used_evidence"))
    return K.assign_copies(top.select("query", "item_id", "pos"), made)
