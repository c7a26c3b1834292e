"""Retrieval of evidence for a table of requests: each tier is one join for all requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.text import normalize_query, tokens
from adloom.operators.containment import containment_candidates
from adloom.operators.evidence import attach_user_profile, evidence_topk, query_item_stats
from adloom.operators.search import bm25_topk, lexical_overlap_topk
from adloom.sources.stored import dropped, stored


#: Requests of one query, and rows of one frequent key, are dealt to so many tasks.
SALTS = 16
#: A pair token is hot if more pair queries have it; at most so many tokens are hot at all, and in one query.
HOT, MOST_HOT, WIDEST = 1000, 65_536, 8


def _three_keys(rows: DataFrame, *kept: str) -> DataFrame:
    """Every row under its (query, user), (query, session) and query: norm_query, the columns of `kept`, tier, who."""
    keys = [F.struct(F.lit(tier).alias("tier"), F.col(c).cast("string").alias("who")) for tier, c in ((1, "user_id"), (2, "session_id"))]
    query_key = F.struct(F.lit(3).alias("tier"), F.lit("").alias("who"))
    return rows.select(normalize_query(F.col("query")).alias("norm_query"), *kept, F.inline(F.array(*keys, query_key))).where("who is not null")


def match_pairs_exact(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id, pair_seq, source for requests (request_id, query, user_id, session_id) whose normalized query has pairs
    (query, user_id, session_id, seq). A pair of the same user comes first, then of the same session, then any; the first
    in seq of each.

    Pairs are reduced before they meet anything: to the first per (query, user), (query, session) and query. A request
    looks up three keys, so it has three rows at most, however many pairs and requests its query has.
    """
    known = _three_keys(pairs, "seq").groupBy("norm_query", "tier", "who").agg(F.min("seq").alias("seq"))
    # the query's own key may be asked for by very many requests
    salts = F.when(F.col("tier") == 3, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = known.select("norm_query", "tier", "who", "seq", F.explode(salts).alias("salt"))
    salt = F.when(F.col("tier") == 3, F.pmod(F.xxhash64("request_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    met = _three_keys(requests, "request_id").withColumn("salt", salt).join(known, ["norm_query", "tier", "who", "salt"])
    best = met.groupBy("request_id").agg(F.min(F.struct("tier", "seq")).alias("best"))
    names = F.array(*map(F.lit, ("train_pairs_user_exact", "train_pairs_session_exact", "train_pairs_query_exact")))
    return best.select("request_id", F.col("best.seq").alias("pair_seq"), F.element_at(names, F.col("best.tier")).alias("source"))


def _subsets(words: Column) -> Column:
    """Every subset of a short sorted array but the empty one, as struct<n, key>."""
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("key")))
    grown = lambda found, w: F.concat(found, F.transform(found, lambda x: F.struct((x["n"] + 1).alias("n"), F.concat(x["key"], F.lit("\x01"), w).alias("key"))))
    return F.filter(F.aggregate(words, none, grown), lambda x: x["n"] > 0)


def fuzzy_candidates(left: DataFrame, right: DataFrame, hot: int = HOT, most_hot: int = MOST_HOT, widest: int = WIDEST) -> tuple[DataFrame, DataFrame]:
    """Two tables of (norm_query, few, gap, pair_query), one row of each being a query's best: pairs of queries that share a
    token that is not hot in both, with all they share; and the best pair query by hot tokens alone.

    left (norm_query, words) and right (pair_query, words) are distinct. Up to `widest` hot tokens of a query, the most
    frequent ones, are hot in it, the others keyed. Keyed tokens join both sides. Hot tokens never do: every subset of a
    pair query's hot tokens keeps, for each length, the first text, and a query looks its own subsets up, one row each.
    """
    counts = right.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > hot)
    frequent = counts.orderBy(F.desc("df"), "token").limit(most_hot)  # bounded, so it is broadcast

    def split(side: DataFrame, name: str) -> DataFrame:
        marked = side.select(name, F.explode("words").alias("token")).join(F.broadcast(frequent), "token").groupBy(name)
        marked = marked.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("few"), "token"))), 1, widest).alias("hot"))
        marked = marked.select(name, F.sort_array(F.transform("hot", lambda x: x["token"])).alias("hot"))
        found = side.join(marked, name, "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<string>")))
        return stored(found.withColumn("keyed", F.array_except("words", "hot")), "split")

    asked, known = split(left, "norm_query"), split(right, "pair_query")
    own = lambda side, name, which: side.select(name, F.explode(which).alias("token"))
    spilled = lambda side, name: own(side, name, "keyed").select("token").distinct().join(F.broadcast(frequent), "token", "left_semi")
    asked_keys = own(asked, "norm_query", "keyed").unionByName(own(asked, "norm_query", "hot").join(spilled(known, "pair_query"), "token", "left_semi"))
    known_keys = own(known, "pair_query", "keyed").unionByName(own(known, "pair_query", "hot").join(spilled(asked, "norm_query"), "token", "left_semi"))
    met = asked_keys.join(known_keys, "token").select("norm_query", "pair_query").distinct()
    met = met.join(left, "norm_query").join(right.withColumnRenamed("words", "others"), "pair_query")
    gap = F.abs(F.char_length("pair_query") - F.char_length("norm_query"))
    by_key = met.select("norm_query", (-F.size(F.array_intersect("words", "others"))).alias("few"), gap.alias("gap"), "pair_query")

    first = known.select("pair_query", F.char_length("pair_query").alias("size"), F.inline(_subsets(F.col("hot")))).groupBy("key", "size").agg(F.min("pair_query").alias("pair_query"))
    listed = first.groupBy("key").agg(F.collect_list(F.struct("size", "pair_query")).alias("found"))
    looked = asked.select("norm_query", F.char_length("norm_query").alias("own"), F.inline(_subsets(F.col("hot")))).join(listed, "key")
    nearest = F.array_min(F.transform("found", lambda x: F.struct(F.abs(x["size"] - F.col("own")).alias("gap"), x["pair_query"].alias("pair_query"))))
    by_hot = looked.select("norm_query", (-F.col("n")).alias("few"), nearest.alias("best")).select("norm_query", "few", "best.*")
    return by_key, by_hot


def match_pairs_fuzzy(requests: DataFrame, pairs: DataFrame, hot: int = HOT, most_hot: int = MOST_HOT, widest: int = WIDEST) -> DataFrame:
    """request_id, pair_seq, matched_query, overlap: the pair query that shares most distinct tokens, then has the closest
    length, then comes first by text; its first pair.

    Distinct normalized queries on both sides meet (see fuzzy_candidates), so repeated requests and pairs cost nothing extra.
    """
    asked = requests.select("request_id", normalize_query(F.col("query")).alias("norm_query"))
    known = pairs.select(normalize_query(F.col("query")).alias("pair_query"), "seq").groupBy("pair_query").agg(F.min("seq").alias("pair_seq"))
    worded = lambda df, name: df.select(name, F.array_distinct(tokens(F.col(name), "chunk4")).alias("words")).where(F.size("words") > 0)
    left = stored(worded(asked.select("norm_query").distinct(), "norm_query"), "asked")
    right = stored(worded(known, "pair_query"), "known")
    by_key, by_hot = fuzzy_candidates(left, right, hot, most_hot, widest)
    best = by_key.unionByName(by_hot).groupBy("norm_query").agg(F.min(F.struct("few", "gap", "pair_query")).alias("best"))
    best = best.select("norm_query", F.col("best.pair_query").alias("pair_query"), (-F.col("best.few")).cast("long").alias("overlap"))
    return (
        asked.join(best, "norm_query").join(known, "pair_query")
        .select("request_id", "pair_seq", F.col("pair_query").alias("matched_query"), "overlap")
    )


def match_rank_exact(requests: DataFrame, rows: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """request_id, source, pos and evidence of requests whose normalized query is among positive log rows.

    Rows of the requesting user are aggregated if there are any, else rows of the session, else all rows of the query.
    A request first picks its group among the distinct keys of the log; the sums and the top k of a group are then made
    once for all of its requests.
    """
    key = ["norm_query", "tier", "who"]
    known = _three_keys(rows).distinct()
    picked = _three_keys(requests, "request_id").join(known, key, "left_semi").groupBy("request_id", "norm_query").agg(F.min(F.struct("tier", "who")).alias("best"))
    picked = stored(picked.select("request_id", "norm_query", "best.*"), "groups")
    signs = ("item_id", "is_purchased", "is_clicked", "show_cnt", "click_cnt", "order_cnt")
    wanted = _three_keys(rows, *signs).join(picked.select(key).distinct(), key, "left_semi")
    group = F.concat_ws("\x01", "tier", "who", "norm_query").alias("group")
    top = evidence_topk(query_item_stats(wanted.select(group, *signs), "group"), items, k, key="group")
    names = F.array(*map(F.lit, ("rank_user_exact", "rank_session_exact", "rank_query_exact")))
    return picked.select("request_id", F.element_at(names, F.col("tier")).alias("source"), group).join(top, "group").drop("group")


def expand_corpus(docs: DataFrame, generated: DataFrame, doc_id: str = "doc_id", order: str = "seq") -> DataFrame:
    """Documents with the queries generated for them appended to the text, in order."""
    listed = generated.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct(order, F.col("text").alias("query")))).alias("found"))
    return docs.join(listed, doc_id, "left").select(
        *[c for c in docs.columns if c != "text"],
        F.concat_ws(" ", "text", F.transform("found", lambda x: x["query"])).alias("text"),
    )


EVIDENCE = ["item_id", "item_title", "brand_name", "seller_name", "category_path", "purchase_cnt", "click_cnt", "ranking_signal", "relevance_signal"]


def retrieve_cascade(requests: DataFrame, pairs: DataFrame, rows: DataFrame, items: DataFrame, mode: str = "offline", k: int = 3) -> DataFrame:
    """request_id, source, pos and evidence; requests that no tier resolves come back once with source 'none'.

    offline: pairs, rank log by user, session and query, BM25, lexical overlap. runtime: pairs, fuzzy pairs, rank log
    merged by normalized query, lexical overlap, then those offline tiers that have not been asked yet. pairs carry
    evidence_items.

    A tier only sees requests that no earlier tier resolved. What it found and what it left open are written once, so the
    next tier's plan begins at a table and the plans add up instead of multiplying; when nothing is open, the rest is
    skipped.
    """
    pairs = stored(pairs.select("query", "user_id", "session_id", "seq", F.slice("evidence_items", 1, k).alias("evidence_items")), "pairs")
    listed = pairs.select(F.col("seq").alias("pair_seq"), F.posexplode("evidence_items").alias("place", "item")).select("pair_seq", (F.col("place") + 1).alias("pos"), "item.*")

    def of_pairs(hits: DataFrame) -> DataFrame:
        return hits.select("request_id", "pair_seq", "source").join(listed, "pair_seq")

    text = F.concat_ws(" ", "item_title", "brand_name", "seller_name", "category_path")
    about = items.select("item_id", "item_title", "brand_name", "seller_name", "category_path", text.alias("text"))

    def asked_of(left: DataFrame) -> DataFrame:
        return left.select("request_id", normalize_query(F.col("query")).alias("norm_query"))

    def by_query(left: DataFrame, search, source: str) -> DataFrame:
        hits = search(asked_of(left).select("norm_query").distinct(), about, k, query_id="norm_query", doc_id="item_id", query_text=F.col("norm_query"))
        zero = F.lit(0).cast("bigint")
        shown = hits.join(about.drop("text"), "item_id").select(
            "norm_query", F.lit(source).alias("source"), "pos", *EVIDENCE[:5], zero.alias("purchase_cnt"), zero.alias("click_cnt"),
            F.round("score", 6).alias("ranking_signal"), F.lit(0).alias("relevance_signal"),
        )
        return asked_of(left).join(shown, "norm_query")

    def merged_rank(left: DataFrame) -> DataFrame:
        logged = rows.withColumn("norm_query", normalize_query(F.col("query"))).join(asked_of(left).select("norm_query").distinct(), "norm_query", "left_semi")
        top = evidence_topk(query_item_stats(logged, "norm_query"), items, k, key="norm_query")
        return asked_of(left).join(top, "norm_query").withColumn("source", F.lit("rank_query_exact"))

    exact = lambda left: of_pairs(match_pairs_exact(left, pairs))
    fuzzy = lambda left: of_pairs(match_pairs_fuzzy(left, pairs).withColumn("source", F.lit("train_pairs_query_fuzzy")))
    rank = lambda left: match_rank_exact(left, rows, items, k)
    bm25 = lambda left: by_query(left, bm25_topk, "bm25")
    lexical = lambda left: by_query(left, lexical_overlap_topk, "lexical_overlap")
    tiers = {"offline": (exact, rank, bm25, lexical), "runtime": (exact, fuzzy, merged_rank, lexical, rank, bm25)}[mode]
    left, out = stored(requests, "open"), None
    for tier in tiers:
        found = stored(tier(left).select("request_id", "source", "pos", *EVIDENCE), "found")
        out = found if out is None else out.unionByName(found)
        rest = stored(left.join(found.select("request_id").distinct(), "request_id", "left_anti"), "open")
        dropped(left)
        left = rest
        if left.isEmpty():
            break
    return out.unionByName(left.select("request_id", F.lit("none").alias("source")), allowMissingColumns=True)


def requested_profiles(requests: DataFrame, pairs: DataFrame, users: DataFrame) -> DataFrame:
    """request_id and the profile of the pair's user or, where that is unknown, of the requesting user."""
    hits = match_pairs_exact(requests, pairs).join(pairs.select(F.col("seq").alias("pair_seq"), F.col("user_id").alias("pair_user")), "pair_seq")
    both = hits.join(requests.select("request_id", F.col("user_id").alias("asked_user")), "request_id")
    return attach_user_profile(both, users, "pair_user", "asked_user")


def lookup_sample(queries: DataFrame, samples: DataFrame) -> DataFrame:
    """query, sample_seq, tier: the first sample (seq, keys array<string>) with an equal key (lower-cased, stripped), else the
    first where one text contains the other.

    The second tier is a search of the queries the first left open against all keys, both as distinct texts, over the
    rarest trigram of the contained one.
    """
    low = lambda c: F.lower(F.trim(c))
    asked = queries.select("query", low(F.col("query")).alias("q")).where("q <> ''").distinct()
    keys = samples.select("seq", F.explode("keys").alias("key")).select("seq", low(F.col("key")).alias("s")).where("s <> ''")
    keys = stored(keys.groupBy("s").agg(F.min("seq").alias("seq")), "keys")
    exact = stored(asked.join(keys, asked["q"] == keys["s"]).groupBy("query").agg(F.min("seq").alias("sample_seq")).withColumn("tier", F.lit("exact")), "exact")
    rest = stored(asked.join(exact, "query", "left_anti"), "rest")
    texts = rest.select("q").distinct()
    named = lambda df, c, name: df.select(F.col(c).alias(name))
    holding = containment_candidates(named(texts, "q", "o"), named(keys, "s", "i")).where(F.contains("o", "i")).select(F.col("o").alias("q"), F.col("i").alias("s"))
    held = containment_candidates(named(keys, "s", "o"), named(texts, "q", "i")).where(F.contains("o", "i")).select(F.col("i").alias("q"), F.col("o").alias("s"))
    best = holding.unionByName(held).join(keys, "s").groupBy("q").agg(F.min("seq").alias("sample_seq"))
    near = rest.join(best, "q").select("query", "sample_seq", F.lit("contains").alias("tier"))
    return exact.unionByName(near)


def prefix_best_match(images: DataFrame, sketches: DataFrame) -> DataFrame:
    """image, sketch, score: of the sketches whose name starts with the image's name, the one with the highest cosine (name
    first of equals); NO MATCH and 0.0 if there is none. Both tables are (name, embedding).

    Names meet on equality of prefixes: a sketch offers the prefixes that have the length of some image name.
    """
    lengths = images.select(F.char_length("name").alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    offered = sketches.join(F.broadcast(lengths)).select(
        F.col("name").alias("sketch"), F.col("embedding").alias("other"),
        F.explode(F.filter("lengths", lambda n: n <= F.char_length(F.col("name")))).alias("n"),
    ).withColumn("name", F.left(F.col("sketch"), F.col("n")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = F.round(dot("embedding", "other") / F.sqrt(dot("embedding", "embedding") * dot("other", "other")), 6)
    met = images.join(offered, "name", "left").select(F.col("name").alias("image"), "sketch", cosine.alias("score"))
    best = met.groupBy("image").agg(F.min(F.when(F.col("sketch").isNotNull(), F.struct((-F.col("score")).alias("low"), "sketch"))).alias("best"))
    return best.select("image", F.coalesce("best.sketch", F.lit("NO MATCH")).alias("sketch"), F.coalesce(-F.col("best.low"), F.lit(0.0)).alias("score"))
