"""What is shuffled or stored at a time stays a share of the tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.operators import containment, ctr
from adloom.operators import search as S


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_history_vectors_are_not_shuffled_one_by_one(spark, monkeypatch, sent):
    """Small tables of vectors go to the histories; large ones are shuffled a share of the keys at a time."""
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(1, 60)] + [(60, None)]
    owned = [(k, [int(x) for x in rng.integers(0, 63, 20)], int(rng.integers(0, 63))) for k in range(200)] + [(200, [], 1), (201, None, 1), (None, [1, 2], 1)]
    df = spark.createDataFrame(owned, "user_id long, hist_item array<long>, target long").repartition(5)
    met = spark.createDataFrame(vectors, "id long, embedding array<float>")
    monkeypatch.setattr(ctr, "SENT_BYTES", sent)
    monkeypatch.setattr(ctr, "ROUND_VALUES", 3000)
    at = {i: np.array(v) for i, v in vectors if v}
    want = {k: np.mean([at[i] for i in ids or [] if i in at] or [np.zeros(3)], axis=0) if k is not None else np.zeros(3) for k, ids, _ in owned}
    made = ctr.masked_mean_history(df, met, "user_id")
    got = {r["user_id"]: r["pooled"] for r in made.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    aimed = {k: sum([at[i] * (at[i] @ at[t]) for i in ids or [] if i in at and t in at], np.zeros(3)) if k is not None else np.zeros(3) for k, ids, t in owned}
    found = {r["user_id"]: r["pooled"] for r in ctr.weighted_history(df, met, "user_id", "target").collect()}
    assert found.keys() == aimed.keys() and all(np.allclose(found[k], aimed[k]) for k in aimed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Arrow" not in plan  # what is left to shuffle is one row a key
    tables, dims = ctr._met_vectors(df, met, "user_id", "hist_item", None)
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in tables]
    assert dims == 3 and len(plans) == (1 if sent else 4)
    assert all(("BroadcastHashJoin" in p) == bool(sent) and ("Exchange hashpartitioning" in p) == (not sent) for p in plans)
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in ctr._met_vectors(df, met, "user_id", "hist_item", "target")[0]]
    assert len(plans) == (1 if sent else 4) and all(("Exchange hashpartitioning" in p) == (not sent) for p in plans)


@pytest.mark.parametrize("rows", [4_000_000, 1500])
def test_histories_slice_by_slice(spark, monkeypatch, rows):
    """The joins behind the log and the windows of users run on a share of it at a time; slices go when they are read."""
    from adloom.plans import base

    monkeypatch.setattr(base, "ROUND_ROWS", rows)
    data = "/root/testdata/sf0.001"
    slices = base.user_slices(spark, data, "user_id", "seq")
    assert len(slices) == (1 if rows > 10_000 else 4)
    owners = [{r["user_id"] for r in s.select("user_id").distinct().collect()} for s in slices]
    assert sum(map(len, owners)) == len(set().union(*owners)) > 0
    whole = base.log(spark, data).select("user_id", "seq")
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for s in base.emptied(slices) for r in s.collect())
    assert not any(os.path.exists(s._stored_path.removeprefix("file://")) for s in slices)
    assert sorted(map(tuple, base.stored_history(spark, data, 20).collect())) == sorted(map(tuple, base.history(spark, data, 20).collect()))


@pytest.mark.parametrize("met,sent", [(256, 1 << 18), (0, 1 << 18), (256, 3)])
def test_few_queries_are_scored_where_the_documents_are(spark, monkeypatch, met, sent):
    """Few queries don't build an index of all terms; both ways give the same documents."""
    rng = random.Random(12)
    words = ["the", *(f"w{i}" for i in range(80))]
    docs = [(i, " ".join(["the"] * rng.randrange(1, 4) + rng.choices(words, k=rng.randrange(0, 50)))) for i in range(300)] + [(300, None), (301, "?"), (302, "other words only")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(25)] + [(90, "the"), (91, "nothing"), (92, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    want = sorted(map(tuple, S.bm25_topk(q, d, 7).collect()))
    indexed = []
    monkeypatch.setattr(S, "index_terms", lambda terms, made=S.index_terms: indexed.append(1) or made(terms))
    monkeypatch.setattr(S, "MET", met)
    monkeypatch.setattr(S, "SENT_TOKENS", sent)
    monkeypatch.setattr(S, "TASK_PAIRS", 40)
    assert sorted(map(tuple, S.bm25_topk(q, d, 7).collect())) == want and len(want) > 150
    assert bool(indexed) == (met == 0 or sent == 3)
    counted = S.counted_terms(d, "doc_id", F.col("text"), S.query_tokens(q, "query_id", F.col("text")).select("token").distinct())
    assert counted.where("token = ''").count() == 301  # one row a document with tokens


@pytest.mark.parametrize("sent", [16 << 20, 400])
def test_wanted_texts_go_to_the_documents(spark, monkeypatch, sent):
    """Neither documents nor the hashes of their pieces are shuffled for texts of three pieces or more."""
    rng = random.Random(13)
    said = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) for _ in range(n))
    docs = [(i, said(rng.randrange(1, 40))) for i in range(150)] + [(900, None), (901, "a  b"), (902, "zz the  end")]
    wanted = []
    for i in range(100):
        text = rng.choice(docs[:150])[1]
        a = rng.randrange(len(text) + 1)
        wanted.append((i, text[a : a + rng.randrange(6, 30)]))
    wanted = [(i, w) for i, w in wanted if w.count(" ") > 1] + [(500, "zz the  end"), (501, "a  b"), (502, "nowhere to be found")]
    written = []
    monkeypatch.setattr(containment, "SENT_BYTES", sent)
    monkeypatch.setattr(containment, "stored_parts", lambda parts, label, made=containment.stored_parts: made((written.append(p._jdf.queryExecution().executedPlan().toString()) or p for p in parts), label))
    found = containment.documents_holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(wanted, "query_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((q, d) for q, w in wanted for d, t in docs if t and w in t)
    assert len(written) == 3 if sent > 400 else len(written) > 3  # one size of texts after the other
    assert all("SortMergeJoin" not in p and p.count("Exchange hashpartitioning(query_id") == p.count("Exchange hashpartitioning") == 1 for p in written)


def test_examples_slice_by_slice(spark, monkeypatch):
    """Examples are assembled for a share of the users at a time, with the split of the whole log."""
    from adloom import plans
    from adloom.plans import base

    data = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, plans.QUERIES["r7_assemble_examples"](spark, data).collect()))
    assert sorted(r[:2] for r in whole) == sorted(map(tuple, plans.QUERIES["r1_split"](spark, data).collect()))
    parts = []
    monkeypatch.setattr(base, "ROUND_ROWS", 2500)
    monkeypatch.setattr(ctr, "assemble_examples", lambda rows, *more, made=ctr.assemble_examples: parts.append(rows.count()) or made(rows, *more))
    made = plans.QUERIES["r7_assemble_examples"](spark, data)
    assert len(parts) == 3 and sum(parts) == len(whole) and max(parts) < 0.6 * len(whole)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == whole
