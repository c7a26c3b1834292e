"""Retrieval against plain Python, and bounds on what the joins make."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.operators import retrieval as R
from adloom.operators import search as S
from adloom.operators import vectors as V
from adloom.operators.containment import containment_candidates, documents_holding
from adloom.sources import schemas

REQUESTS = "request_id string, query string, user_id long, session_id long"
PAIRS = "query string, user_id long, session_id long, seq string"


def test_exact_pairs_of_a_head_query(spark):
    rng = random.Random(1)
    draw = lambda n: rng.choice((None, *range(n)))
    queries = ("head", "“head”", "# head", "rare", "other")
    pairs = [(rng.choices(queries, (60, 20, 10, 5, 5))[0], draw(40), draw(60), f"s{i:04d}") for i in range(900)]
    asked = [(f"r{i}", rng.choice((*queries, "unknown")), draw(50), draw(90)) for i in range(300)]
    got = {r["request_id"]: (r["pair_seq"], r["source"]) for r in R.match_pairs_exact(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(pairs, PAIRS)).collect()}
    form = lambda q: q.strip("“”# ")
    want = {}
    for i, q, user, session in asked:
        own = [p for p in pairs if form(p[0]) == form(q)]
        tiers = [[p for p in own if user is not None and p[1] == user], [p for p in own if session is not None and p[2] == session], own]
        for tier, name in zip(tiers, ("user", "session", "query"), strict=True):
            if tier:
                want[i] = (min(p[3] for p in tier), f"train_pairs_{name}_exact")
                break
    assert got == want
    keys = R._three_keys(spark.createDataFrame(asked, REQUESTS), "request_id").groupBy("request_id").count()
    assert keys.agg(F.max("count")).first()[0] == 3


def test_log_rows_of_the_user_then_the_session_then_the_query(spark):
    rng = random.Random(2)
    rows = [(f"l{i}", rng.choice(("a", "b", "c")), rng.randrange(6), rng.randrange(9), rng.randrange(1, 8), 1, rng.randrange(2), 0, 0, 0) for i in range(120)]
    log = spark.createDataFrame(rows, "seq string, query string, user_id long, session_id long, item_id long, is_clicked long, is_purchased long, show_cnt long, click_cnt long, order_cnt long")
    items = spark.createDataFrame([(i, f"t{i}", "", "", "") for i in range(1, 6)], schemas.ITEM)
    asked = [(f"r{i}", rng.choice("abcd"), rng.choice((None, *range(9))), rng.choice((None, *range(14)))) for i in range(60)]
    got = {}
    for r in R.match_rank_exact(spark.createDataFrame(asked, REQUESTS), log, items, 2).collect():
        got.setdefault((r["request_id"], r["source"]), []).append((r["pos"], r["item_id"], r["purchase_cnt"], r["item_title"]))
    want = {}
    for i, q, user, session in asked:
        own = [x for x in rows if x[1] == q]
        for name, group in (("user", [x for x in own if x[2] == user]), ("session", [x for x in own if x[3] == session]), ("query", own)):
            if group:
                sums = {}
                for x in group:
                    p, c = sums.get(x[4], (0, 0))
                    sums[x[4]] = (p + x[6], c + 1)
                top = sorted(sums, key=lambda k: (-(5 * sums[k][0] + 2 * sums[k][1]), -sums[k][0], -sums[k][1], k))[:2]
                want[i, f"rank_{name}_exact"] = [(n + 1, k, sums[k][0], f"t{k}" if k < 6 else "") for n, k in enumerate(top)]
                break
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("hot,most_hot,widest", [(1000, 65_536, 8), (5, 65_536, 8), (5, 65_536, 2), (2, 3, 1), (0, 65_536, 3)])
def test_fuzzy_pairs(spark, hot, most_hot, widest):
    rng = random.Random(3)
    words = ["the", "of", "and", "red", *(f"w{i}" for i in range(30))]
    weights = [60, 40, 30, 20, *[2] * 30]
    said = lambda: " ".join(rng.choices(words, weights, k=rng.randrange(1, 7)))
    pairs = [(said(), 1, 1, f"s{i:03d}") for i in range(150)] + [("the " + "x" * i, 1, 1, f"t{i}") for i in range(1, 30)]
    asked = [(f"r{i}", said(), 1, 1) for i in range(120)] + [("n1", "zzz", 1, 1), ("n2", "...", 1, 1), ("n3", "the", 1, 1), ("n4", "the of and red the of", 1, 1)]
    found = R.match_pairs_fuzzy(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(pairs, PAIRS), hot, most_hot, widest)
    got = {r["request_id"]: (r["pair_seq"], r["matched_query"], r["overlap"]) for r in found.collect()}
    tokens = lambda q: set(re.findall("[A-Za-z0-9]+", q))
    want = {}
    for i, q, *_ in asked:
        near = [(-len(tokens(q) & tokens(p[0])), abs(len(p[0]) - len(q)), p[0]) for p in pairs if tokens(q) & tokens(p[0])]
        if near:
            few, _, text = min(near)
            want[i] = (min(p[3] for p in pairs if p[0] == text), text, -few)
    assert got == want


def test_hot_tokens_are_not_joined_on_both_sides(spark):
    left = spark.createDataFrame([(f"the of q{i}", ["the", "of", f"q{i}"]) for i in range(200)], "norm_query string, words array<string>")
    right = spark.createDataFrame([(f"the of p{i}", ["the", "of", f"p{i}"]) for i in range(300)], "pair_query string, words array<string>")
    by_key, by_hot = R.fuzzy_candidates(left, right, hot=50)
    assert by_key.count() == 0
    assert by_hot.count() == 200 * 3  # one row for each of {the}, {of}, {the, of}
    assert {r["few"] for r in by_hot.collect()} == {-1, -2}


def corpus(rng, n):
    words = ["the", *(f"w{i}" for i in range(60))]
    return [(i, " ".join(["the"] * rng.randrange(1, 4) + rng.choices(words, k=rng.randrange(0, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "?!")]


def plain_scores(queries, docs, bm25):
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    held = {d: split(t) for d, t in docs if split(t)}
    mean = sum(map(len, held.values())) / len(held)
    df = {}
    for w in held.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for q, text in queries:
        own = set(split(text))
        for d, w in held.items():
            shared = own & set(w)
            if not shared:
                continue
            if bm25:
                idf = lambda t: math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5))
                score = sum(round(idf(t) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) * 1e6) for t in shared)
            else:
                score = 1000 * len(shared) + len(w)
            yield q, score, d


@pytest.mark.parametrize("levels,chunk", [(32, 16_384), (1, 7), (3, 40)])
@pytest.mark.parametrize("bm25", [False, True])
def test_text_search(spark, monkeypatch, bm25, levels, chunk):
    monkeypatch.setattr(S, "LEVELS", levels)
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(4)
    docs = corpus(rng, 220)
    queries = [(i, " ".join(rng.choices(["the", *(f"w{i}" for i in range(70))], k=rng.randrange(1, 6)))) for i in range(40)] + [(90, "the"), (91, "nothing"), (92, ""), (93, None)]
    search = S.bm25_topk if bm25 else S.lexical_overlap_topk
    found = search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 5)
    got = sorted((r["query_id"], r["pos"], r["doc_id"], round(r["score"] * (1e6 if bm25 else 1e3))) for r in found.collect())
    want, by_query = [], {}
    for q, score, d in plain_scores(queries, docs, bm25):
        by_query.setdefault(q, []).append((-score, d))
    for q, ranked in by_query.items():
        want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(sorted(ranked)[:5])]
    assert got == sorted(want)


def test_a_stop_word_brings_few_candidates(spark):
    rng = random.Random(5)
    docs = [(i, "the " * rng.randrange(1, 3) + f"a{i % 150} b{i % 97} " + "x " * (i % 11)) for i in range(3000)]
    queries = [(i, f"the a{i} b{i % 97}") for i in range(100)]
    asked = S.query_tokens(spark.createDataFrame(queries, "query_id long, text string"), "query_id", F.col("text"))
    terms, sizes = S.doc_terms(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", F.col("text"), asked.select("token").distinct())
    joined = terms.join(sizes, "d")
    weighted = joined.select("d", "token", F.when(F.col("token") == "the", 1).otherwise(3000).cast("long").alias("weight"), F.lit(0).cast("long").alias("bonus"))
    pairs = S.candidate_pairs(asked, S.index_terms(weighted), 3).count()
    assert pairs < 100 * 60  # 20 + 31 documents have the rare words; all 3000 have the stop word


def test_containing_texts(spark):
    rng = random.Random(6)
    said = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    samples = [(f"s{i:03d}", [said(rng.randrange(1, 14)), said(3)]) for i in range(60)] + [("s900", ["", None]), ("s901", [" HEAD "])]
    queries = [(said(rng.randrange(1, 12)),) for _ in range(80)] + [("head",), ("",), ("zzzz",), ("overheads",)]
    got = {r["query"]: (r["sample_seq"], r["tier"]) for r in R.lookup_sample(spark.createDataFrame(queries, "query string"), spark.createDataFrame(samples, "seq string, keys array<string>")).collect()}
    want = {}
    for (q,) in queries:
        low = q.strip(" ").lower()
        keys = [(k.strip(" ").lower(), s) for s, found in samples for k in found if k and k.strip(" ")]
        equal, near = [s for k, s in keys if k == low], [s for k, s in keys if k in low or low in k]
        if low and (equal or near):
            want[q] = (min(equal), "exact") if equal else (min(near), "contains")
    assert got == want
    # texts that all begin alike meet on what is rare in them
    outer = spark.createDataFrame([(f"the same beginning {i:04d}",) for i in range(400)], "o string")
    inner = spark.createDataFrame([(f"the same beginning {i:04d}",) for i in range(0, 400, 20)], "i string")
    assert containment_candidates(outer, inner).count() <= 20 * 40


def test_documents_that_hold_a_text(spark):
    rng = random.Random(8)
    said = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) for _ in range(n))
    docs = [(i, said(rng.randrange(1, 30))) for i in range(150)] + [(900, None), (901, ""), (902, "zz the  end")]
    wanted = []
    for i in range(120):
        text = rng.choice(docs[:150])[1]
        a = rng.randrange(len(text) + 1)
        wanted.append((i, text[a : a + rng.randrange(0, 14)]))
    wanted += [(500, "zz the  end"), (501, "e  e"), (502, "nowhere to be found at all"), (503, " "), (504, "  ")]
    got = {tuple(r) for r in documents_holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(wanted, "query_id long, text string")).collect()}
    assert got == {(q, d) for q, w in wanted for d, t in docs if w and t and w in t}
    assert documents_holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_clusters_are_skipped_and_the_result_is_exact(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(x) for x in (centres[i % 40] + rng.normal(size=16) * 0.2).astype(np.float32)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    best, share = V.dense_search(df.where("id % 20 = 0"), df, 7, clusters=64, chunk_rows=30, block_rows=16)
    matrix = np.array([v for _, v in rows])
    for r_id in [i for i, _ in rows if i % 20 == 0][:12]:
        score = np.round(matrix @ np.array(dict(rows)[r_id]), 6)
        want = sorted(zip(-score, [i for i, _ in rows], strict=True))[:7]
        got = sorted((r["pos"], r["id"]) for r in best.where(F.col("query_id") == r_id).collect())
        assert [i for _, i in got] == [i for _, i in want]
    read = share.first()
    assert read["n_pairs"] == 76 * 1520 and 0 < read["n_read"] < 0.3 * read["n_pairs"]
    few, _ = V.dense_search(df.where("id = 5"), df.where("id < 4"), 7)
    assert few.count() == 4
    assert V.dense_topk(df.where("false"), df, 3).count() == 0 and V.dense_topk(df, df.where("false"), 3).count() == 0


def test_the_cascade_reads_stored_tables_only(spark):
    items = spark.createDataFrame([(1, "red shoe", "b", "s", "c"), (2, "blue hat", "b", "s", "c"), (3, "green coat", "b", "shop", "c")], schemas.ITEM)
    rows = spark.createDataFrame([("l1", "winter", 7, 8, 2, 1, 0, 0, 0, 0)], "seq string, query string, user_id long, session_id long, item_id long, is_clicked long, is_purchased long, show_cnt long, click_cnt long, order_cnt long")
    evidence = "array<struct<item_id:bigint,item_title:string,brand_name:string,seller_name:string,category_path:string,purchase_cnt:bigint,click_cnt:bigint,ranking_signal:double,relevance_signal:int>>"
    item = (1, "red shoe", "b", "s", "c", 1, 1, 7.0, 2)
    pairs = spark.createDataFrame([("red shoe", 7, 8, "p1", [item, item, item])], PAIRS + f", evidence_items {evidence}")
    asked = [("a", "red shoe", 7, 1), ("b", " red shoe", 1, 8), ("c", "#red shoe", None, None), ("d", "red", 1, 1), ("e", "winter", 7, 1), ("f", "winter", 1, 1), ("g", "coat", 1, 1), ("h", "?", 1, 1)]
    for mode, sources in (
        ("runtime", ["train_pairs_user_exact", "train_pairs_session_exact", "train_pairs_query_exact", "train_pairs_query_fuzzy", "rank_query_exact", "rank_query_exact", "lexical_overlap", "none"]),
        ("offline", ["train_pairs_user_exact", "train_pairs_session_exact", "train_pairs_query_exact", "bm25", "rank_user_exact", "rank_query_exact", "bm25", "none"]),
    ):
        found = R.retrieve_cascade(spark.createDataFrame(asked, REQUESTS), pairs, rows, items, mode, 2)
        assert {r["request_id"]: r["source"] for r in found.collect()} == dict(zip("abcdefgh", sources, strict=True))
        assert {r["pos"] for r in found.where("request_id = 'a'").collect()} == {1, 2}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 9 and "Join" not in plan
    # nothing is left open: later tiers are not run
    done = R.retrieve_cascade(spark.createDataFrame(asked[:3], REQUESTS), pairs, rows, items, "runtime", 2)
    assert done._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
