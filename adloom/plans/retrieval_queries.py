"""Checked queries of the retrieval tiers."""

from pyspark.sql import functions as F

from adloom.functions.text import leaf_category
from adloom.operators import evidence as E
from adloom.operators import retrieval as R
from adloom.operators import search as S
from adloom.operators import vectors as V
from adloom.plans.base import WITH_ALL, WITH_ITEMS, WITH_LOG, WITH_USERS, checked, chunk4, items, log, norm, table, unigram, users


def train_pairs(spark, sf_dir):
    """Pairs of the training rows: query, user, session, seq and evidence."""
    rows = E.positives(log(spark, sf_dir).where("split = 'train'"))
    top = E.evidence_topk(E.query_item_stats(rows), items(spark, sf_dir))
    fields = [c for c in top.columns if c not in ("query", "pos")]
    listed = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("item")))).alias("found"))
    best = E.best_record(rows).select("query", "user_id", "session_id", "seq")
    return best.join(listed.select("query", F.transform("found", lambda x: x["item"]).alias("evidence_items")), "query")


def requests(spark, sf_dir):
    """Every distinct request of the test rows."""
    rows = log(spark, sf_dir).where("split = 'test'")
    asked = rows.select("query", "user_id", "session_id").distinct()
    return asked.withColumn("request_id", F.md5(F.concat_ws("|", "query", "user_id", "session_id")))


WITH_REQUESTS = f"""requests AS (SELECT DISTINCT query, user_id, session_id, {norm("query")} AS nq FROM log WHERE split = 'test'),
asked AS (SELECT *, md5(concat_ws('|', query, user_id, session_id)) AS request_id FROM requests),
tp AS (SELECT * FROM pos WHERE split = 'train'),
pairs AS (SELECT query, user_id, session_id, seq, {norm("query")} AS nq FROM tp QUALIFY row_number() OVER (PARTITION BY query ORDER BY signal DESC, is_purchased DESC, is_clicked DESC, item_id, seq) = 1),
exact AS (SELECT request_id, p.seq AS pair_seq, CASE WHEN p.user_id = a.user_id THEN 1 WHEN p.session_id = a.session_id THEN 2 ELSE 3 END AS tier FROM asked a JOIN pairs p USING (nq)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, p.seq) = 1)"""
ALL = WITH_ALL + ",\n" + WITH_REQUESTS
SOURCES = "(['train_pairs_user_exact', 'train_pairs_session_exact', 'train_pairs_query_exact'])[tier]"


@checked(f"WITH {ALL} SELECT request_id, pair_seq, {SOURCES} AS source FROM exact")
def j1_match_pairs_exact(spark, sf_dir):
    return R.match_pairs_exact(requests(spark, sf_dir), train_pairs(spark, sf_dir))


FUZZY = f"""qt AS (SELECT DISTINCT nq, unnest({chunk4("nq")}) AS token FROM asked),
kp AS (SELECT nq AS pq, min(seq) AS pair_seq FROM pairs GROUP BY nq), pt AS (SELECT DISTINCT pq, unnest({chunk4("pq")}) AS token FROM kp),
ov AS (SELECT nq, pq, count(*) AS overlap FROM qt JOIN pt USING (token) GROUP BY ALL),
fz AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY nq ORDER BY overlap DESC, abs(length(pq) - length(nq)), pq) = 1)"""


@checked(f"WITH {ALL}, {FUZZY} SELECT request_id, pair_seq, pq AS matched_query, overlap FROM asked JOIN fz USING (nq) JOIN kp USING (pq)")
def j2_match_pairs_fuzzy(spark, sf_dir):
    return R.match_pairs_fuzzy(requests(spark, sf_dir), train_pairs(spark, sf_dir))


def _rank_sql(rows: str) -> str:
    """rk: request_id, source, pos, item_id, ranking_signal by the first tier that has rows."""
    return f"""lg AS (SELECT *, {norm("query")} AS nq FROM {rows}),
j3 AS (SELECT a.request_id, l.item_id, l.is_purchased, l.is_clicked, l.signal, CASE WHEN l.user_id = a.user_id THEN 1 WHEN l.session_id = a.session_id THEN 2 ELSE 3 END AS row_tier,
  l.user_id = a.user_id AS u, l.session_id = a.session_id AS s FROM asked a JOIN lg l USING (nq)),
tiers AS (SELECT request_id, CASE WHEN bool_or(u) THEN 1 WHEN bool_or(s) THEN 2 ELSE 3 END AS tier FROM j3 GROUP BY request_id),
sums AS (SELECT request_id, tier, item_id, sum(is_purchased)::BIGINT AS p, sum(is_clicked)::BIGINT AS c, sum(signal)::BIGINT AS s FROM j3 JOIN tiers USING (request_id)
  WHERE tier = 3 OR (tier = 1 AND u) OR (tier = 2 AND s) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, p DESC, c DESC, item_id) AS pos FROM sums QUALIFY pos <= 3)"""


RANK_SOURCES = "(['rank_user_exact', 'rank_session_exact', 'rank_query_exact'])[tier]"


@checked(f"WITH {ALL}, {_rank_sql('tp')} SELECT request_id, {RANK_SOURCES} AS source, pos, item_id, p AS purchase_cnt, round(s / 1000.0, 6) AS ranking_signal FROM rk")
def j3_match_rank_exact(spark, sf_dir):
    rows = E.positives(log(spark, sf_dir).where("split = 'train'"))
    found = R.match_rank_exact(requests(spark, sf_dir), rows, items(spark, sf_dir))
    return found.select("request_id", "source", "pos", "item_id", "purchase_cnt", "ranking_signal")


def _bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TOKENS_SQL = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({unigram("text")}) AS token FROM benchmark),
d AS (SELECT doc_id, unnest({unigram("text")}) AS token FROM documents), sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tf AS (SELECT doc_id, token, count(*) AS tf FROM d GROUP BY ALL)"""


@checked(
    f"""WITH {TOKENS_SQL}, o AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN tf USING (token) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap * 1000 + n DESC, doc_id) AS pos, doc_id, overlap, round((overlap * 1000 + n) / 1000.0, 6) AS score
FROM o JOIN sizes USING (doc_id) QUALIFY pos <= 10"""
)
def j4_lexical_overlap_topk(spark, sf_dir):
    return S.lexical_overlap_topk(_bench(spark, sf_dir), table(spark, sf_dir, "documents"), 10)


def _bm25_sql(k: int) -> str:
    return f"""w AS (SELECT count(*) AS nd, avg(n) AS mean FROM sizes), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, doc_id, sum(round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) * 1000000)::BIGINT) / 1000000 AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN sizes USING (doc_id), w GROUP BY ALL),
run AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM s QUALIFY pos <= {k})"""


@checked(f"WITH {TOKENS_SQL}, {_bm25_sql(100)} SELECT query_id, pos, doc_id, score FROM run")
def j5_bm25_topk(spark, sf_dir):
    return S.bm25_topk(_bench(spark, sf_dir), table(spark, sf_dir, "documents"), 100)


@checked(
    """WITH g AS (SELECT item_id % (SELECT count(*) FROM documents) AS doc_id, item_id AS seq, text AS t FROM benchmark),
l AS (SELECT doc_id, string_agg(t, ' ' ORDER BY seq) AS t FROM g GROUP BY doc_id) SELECT d.doc_id, concat_ws(' ', d.text, l.t) AS text FROM documents d LEFT JOIN l USING (doc_id)"""
)
def j6_expand_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = _bench(spark, sf_dir).select((F.col("query_id") % F.lit(docs.count())).alias("doc_id"), F.col("query_id").alias("seq"), "text")
    return R.expand_corpus(docs, made)


@checked(
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, id, round(score, 4) AS score FROM p QUALIFY pos <= 5"""
)
def j7_dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.dense_topk(vectors.where("id % 20 = 0"), vectors, 5).withColumn("score", F.round("score", 4))


def cascade_requests(spark, sf_dir):
    """The test rows' requests, and what their users might ask for besides: the item's shop, its category, their city. So
    every tier of the cascade has requests that only it resolves, and some stay open."""
    rows = log(spark, sf_dir).where("split = 'test'").select("query", "user_id", "session_id", "item_id")
    about = items(spark, sf_dir).select("item_id", "seller_name", leaf_category(F.col("category_path")).alias("leaf"))
    shown = rows.join(about, "item_id", "left").join(users(spark, sf_dir).select("user_id", "city"), "user_id", "left")
    asked = shown.select(F.explode(F.array("query", "seller_name", "leaf", "city")).alias("query"), "user_id", "session_id").where("query <> ''").distinct()
    return asked.withColumn("request_id", F.md5(F.concat_ws("|", "query", "user_id", "session_id")))


def cascade_rows(spark, sf_dir):
    """The positive training rows; purchases count for the shop's name as well."""
    rows = E.positives(log(spark, sf_dir).where("split = 'train'"))
    shops = items(spark, sf_dir).where("seller_name <> ''").select("item_id", "seller_name")
    bought = rows.where("is_purchased = 1").join(shops, "item_id").withColumn("query", F.col("seller_name")).select(rows.columns)
    return rows.unionByName(bought)


CASCADE = f"""{WITH_ITEMS}, {WITH_USERS}, {WITH_LOG}, tp AS (SELECT * FROM pos WHERE split = 'train'),
shown AS (SELECT l.query, l.user_id, session_id, seller_name, trim(string_split(category_path, '>')[-1]) AS leaf, city FROM log l LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN users u ON u.user_id = l.user_id WHERE split = 'test'),
asked AS (SELECT *, md5(concat_ws('|', query, user_id, session_id)) AS request_id, {norm("query")} AS nq FROM
  (SELECT DISTINCT unnest([query, seller_name, leaf, city]) AS query, user_id, session_id FROM shown) WHERE query <> ''),
pairs AS (SELECT query, user_id, session_id, seq, {norm("query")} AS nq FROM tp QUALIFY row_number() OVER (PARTITION BY query ORDER BY signal DESC, is_purchased DESC, is_clicked DESC, item_id, seq) = 1),
tev AS (SELECT query, item_id, sum(is_purchased)::BIGINT AS p, sum(is_clicked)::BIGINT AS c, sum(signal)::BIGINT AS s FROM tp GROUP BY query, item_id QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, p DESC, c DESC, item_id) <= 3),
pev AS (SELECT pairs.seq AS pair_seq, item_id, p, c, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, p DESC, c DESC, item_id) AS pos FROM tev JOIN pairs USING (query)),
exact AS (SELECT request_id, p.seq AS pair_seq, CASE WHEN p.user_id = a.user_id THEN 1 WHEN p.session_id = a.session_id THEN 2 ELSE 3 END AS tier FROM asked a JOIN pairs p USING (nq)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, p.seq) = 1),
logged AS (SELECT query, user_id, session_id, item_id, is_purchased, is_clicked, signal FROM tp UNION ALL
  SELECT seller_name, user_id, session_id, item_id, is_purchased, is_clicked, signal FROM tp JOIN items USING (item_id) WHERE is_purchased = 1 AND seller_name <> ''),
docs AS (SELECT item_id AS doc_id, unnest({unigram("concat_ws(' ', item_title, brand_name, seller_name, category_path)")}) AS token FROM items),
sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id), tf AS (SELECT doc_id, token, count(*) AS tf FROM docs GROUP BY ALL)"""
SHOWN_ITEM = "coalesce(i.item_title, '') AS item_title, coalesce(i.brand_name, '') AS brand_name, coalesce(i.category_path, '') AS category_path"
LOGGED_ITEM = "p AS purchase_cnt, c AS click_cnt, round(s / 1000.0, 6) AS ranking_signal, CASE WHEN p > 0 THEN 2 ELSE 1 END AS relevance_signal"
NO_ITEM = "NULL::BIGINT AS pos, NULL::BIGINT AS item_id, NULL AS item_title, NULL AS brand_name, NULL AS category_path, NULL::BIGINT AS purchase_cnt, NULL::BIGINT AS click_cnt, NULL::DOUBLE AS ranking_signal, NULL::INT AS relevance_signal"
FOUND_ITEM = "0::BIGINT AS purchase_cnt, 0::BIGINT AS click_cnt, round(score, 6) AS ranking_signal, 0 AS relevance_signal"


def _cascade(spark, sf_dir, mode):
    pairs = train_pairs(spark, sf_dir)
    found = R.retrieve_cascade(cascade_requests(spark, sf_dir), pairs, cascade_rows(spark, sf_dir), items(spark, sf_dir), mode)
    return found.drop("seller_name")


@checked(
    f"""WITH {CASCADE}, {FUZZY},
open1 AS (SELECT * FROM asked WHERE request_id NOT IN (SELECT request_id FROM exact)), fuzzy AS (SELECT request_id, pair_seq FROM open1 JOIN fz USING (nq) JOIN kp USING (pq)),
open2 AS (SELECT * FROM open1 WHERE request_id NOT IN (SELECT request_id FROM fuzzy)),
sm AS (SELECT nq, item_id, sum(is_purchased)::BIGINT AS p, sum(is_clicked)::BIGINT AS c, sum(signal)::BIGINT AS s FROM (SELECT *, {norm("query")} AS nq FROM logged) GROUP BY ALL),
rank AS (SELECT request_id, sm.*, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, p DESC, c DESC, item_id) AS pos FROM open2 JOIN sm USING (nq) QUALIFY pos <= 3),
open3 AS (SELECT * FROM open2 WHERE request_id NOT IN (SELECT request_id FROM rank)),
q AS (SELECT DISTINCT nq, unnest({unigram("nq")}) AS token FROM open3),
o AS (SELECT nq, doc_id AS item_id, (count(*) * 1000 + n) / 1000.0 AS score FROM q JOIN tf USING (token) JOIN sizes USING (doc_id) GROUP BY nq, doc_id, n QUALIFY row_number() OVER (PARTITION BY nq ORDER BY score DESC, doc_id) <= 3),
lexical AS (SELECT request_id, item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS pos FROM open3 JOIN o USING (nq))
SELECT request_id, {SOURCES} AS source, pos, item_id, {SHOWN_ITEM}, {LOGGED_ITEM} FROM exact JOIN pev USING (pair_seq) LEFT JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'train_pairs_query_fuzzy', pos, item_id, {SHOWN_ITEM}, {LOGGED_ITEM} FROM fuzzy JOIN pev USING (pair_seq) LEFT JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'rank_query_exact', pos, item_id, {SHOWN_ITEM}, {LOGGED_ITEM} FROM rank LEFT JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'lexical_overlap', pos, item_id, {SHOWN_ITEM}, {FOUND_ITEM} FROM lexical JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'none', {NO_ITEM} FROM open3 WHERE request_id NOT IN (SELECT request_id FROM lexical)"""
)
def j8_cascade_runtime(spark, sf_dir):
    """The evidence rows of every request, through pairs, fuzzy pairs, log and lexical overlap."""
    return _cascade(spark, sf_dir, "runtime")


@checked(
    f"""WITH {CASCADE}, {_rank_sql("logged")},
open1 AS (SELECT * FROM asked WHERE request_id NOT IN (SELECT request_id FROM exact)), rank AS (SELECT * FROM rk WHERE request_id IN (SELECT request_id FROM open1)),
open2 AS (SELECT * FROM open1 WHERE request_id NOT IN (SELECT request_id FROM rank)), q AS (SELECT DISTINCT nq AS query_id, unnest({unigram("nq")}) AS token FROM open2), {_bm25_sql(3)},
bm25 AS (SELECT request_id, pos, doc_id AS item_id, score FROM open2 JOIN run ON query_id = nq)
SELECT request_id, {SOURCES} AS source, pos, item_id, {SHOWN_ITEM}, {LOGGED_ITEM} FROM exact JOIN pev USING (pair_seq) LEFT JOIN items i USING (item_id)
UNION ALL SELECT request_id, {RANK_SOURCES}, pos, item_id, {SHOWN_ITEM}, {LOGGED_ITEM} FROM rank LEFT JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'bm25', pos, item_id, {SHOWN_ITEM}, {FOUND_ITEM} FROM bm25 JOIN items i USING (item_id)
UNION ALL SELECT request_id, 'none', {NO_ITEM} FROM open2 WHERE request_id NOT IN (SELECT request_id FROM bm25)"""
)
def j8_cascade_offline(spark, sf_dir):
    """The evidence rows of every request, through pairs, log by user, session and query, and BM25."""
    return _cascade(spark, sf_dir, "offline")


@checked(
    f"""WITH {ALL}, k AS (SELECT seq, lower(trim(unnest([query, nq]))) AS s FROM pairs), a AS (SELECT DISTINCT query, lower(trim(query)) AS q FROM asked),
e AS (SELECT query, min(seq) AS sample_seq FROM a JOIN k ON a.q = k.s GROUP BY query),
c AS (SELECT a.query, min(seq) AS sample_seq FROM a JOIN k ON contains(a.q, k.s) OR contains(k.s, a.q) WHERE a.query NOT IN (SELECT query FROM e) GROUP BY a.query)
SELECT query, sample_seq, 'exact' AS tier FROM e UNION ALL SELECT query, sample_seq, 'contains' FROM c"""
)
def j9_lookup_sample(spark, sf_dir):
    from adloom.functions.text import normalize_query

    samples = train_pairs(spark, sf_dir).select("seq", F.array("query", normalize_query(F.col("query"))).alias("keys"))
    return R.lookup_sample(requests(spark, sf_dir), samples)


@checked(
    """WITH n AS (SELECT vec_id, concat(label, '_', vec_id) AS name, embedding::DOUBLE[] AS e FROM embeddings), i AS (SELECT concat(name, '') AS name, e FROM n),
p AS (SELECT i.name AS image, n.name AS sketch, round(list_cosine_similarity(i.e, n.e), 4) AS score FROM i LEFT JOIN n ON starts_with(n.name, i.name))
SELECT image, coalesce(sketch, 'NO MATCH') AS sketch, coalesce(score, 0.0) AS score FROM p QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC NULLS LAST, sketch) = 1"""
)
def j11_prefix_best_match(spark, sf_dir):
    named = table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws("_", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    found = R.prefix_best_match(named.select("name", "embedding"), named.select("name", "embedding"))
    return found.withColumn("score", F.round("score", 4))


@checked(
    f"""WITH {ALL} SELECT e.request_id, coalesce(u.city, v.city) AS city FROM exact e JOIN pairs p ON p.seq = e.pair_seq JOIN asked a USING (request_id)
LEFT JOIN users u ON u.user_id = p.user_id LEFT JOIN users v ON v.user_id = a.user_id"""
)
def a7_requested_profiles(spark, sf_dir):
    found = R.requested_profiles(requests(spark, sf_dir), train_pairs(spark, sf_dir), users(spark, sf_dir))
    return found.select("request_id", F.col("user_profile.city").alias("city"))
