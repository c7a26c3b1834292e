"""Queries that feed an operator all of its inputs: behaviour titles and selling points."""

from pyspark.sql import functions as F

import adloom.plans as plans
from adloom.functions import lexicons as L

DATA = "/root/testdata/sf0.001"


def test_behavior_reaches_tags_and_prompts(spark):
    tags = plans.QUERIES["u7_behavior_tags"](spark, DATA)
    assert tags.where("behavior <> '' and strength = 'medium'").count() > 0.9 * tags.count() > 0
    chats = plans.QUERIES["d1_pairs_with_behavior"](spark, DATA)
    assert chats.where("has_behavior").count() > 0.9 * chats.count() > 0


def test_interests_of_clicked_titles_are_returned(spark, monkeypatch):
    monkeypatch.setattr(L, "INTERESTS", ("copper", "steel", "small"))
    found = plans.QUERIES["u7_behavior_tags"](spark, DATA).where("interests <> ''").select(F.explode(F.split("interests", "[|]")).alias("w"))
    assert {r["w"] for r in found.distinct().collect()} <= set(L.INTERESTS) and found.count() > 0


def test_selling_points_reach_the_score(spark, monkeypatch):
    score = lambda: {(r["query"], r["candidate_id"]): r["rank_score"] for r in plans.QUERIES["k6_rank_candidates"](spark, DATA).collect()}
    before = score()
    monkeypatch.setattr(L, "SELLING_POINTS", ("copper", "steel", "small"))
    after = score()
    assert before.keys() == after.keys()
    assert {after[k] - before[k] for k in before} >= {0, 3}
    assert {after[k] - before[k] for k in before} <= {0, 3, 6}


def test_replay_fails_without_a_pair(spark):
    import pytest

    from adloom.operators.datasets import replay_baselines

    item = "query string, pos int, item_title string, brand_name string, seller_name string, category_path string"
    evidence = spark.createDataFrame([("red shoe", 1, "shoe", "", "", "")], item)
    texts = spark.createDataFrame([], "query string, copy string, provider string, model string, status string")
    asked = lambda *q: spark.createDataFrame([(x, None, None) for x in q], "query string, user_id long, session_id long")
    rows = replay_baselines(asked(" red  shoe "), evidence, texts, texts).collect()
    assert sorted((r["baseline"], r["fallback"]) for r in rows) == [("full_pipeline", True), ("llm_topk", True), ("summary_topk", True), ("template_personalized", False), ("template_top1", False)]
    with pytest.raises(Exception, match="no pair for query: blue hat"):
        replay_baselines(asked("red shoe", "blue hat"), evidence, texts, texts).collect()
