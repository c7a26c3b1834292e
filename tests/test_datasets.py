"""Runs and their counts, samples, records, batches and template copies on small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from adloom.functions import lexicons as L
from adloom.operators import ctr, datasets
from adloom.operators import templates as T
from adloom.sources import files

OUTCOMES = "seq int, query string, error string, reason string"


def plain_run(rows, target, most, done=()):
    taken, out = set(), []
    for seq, query, error, reason in sorted(rows)[:most]:
        if sum(k == "accepted" for *_, k, _ in out) >= target:
            break
        query = (query or "").strip()
        if not query:
            found = ("filtered", "empty_query")
        elif query in done:
            found = ("skipped", "resume_existing_query")
        elif query in taken:
            found = ("skipped", "duplicate_query")
        elif error:
            found = ("error", error[:80])
        elif reason:
            found = ("filtered", reason)
        else:
            found = ("accepted", "")
            taken.add(query)
        out.append((seq, query, *found))
    return out


@pytest.mark.parametrize("target,most,done", [(1000, 1000, ()), (12, 1000, ()), (1000, 40, ("a", "c")), (0, 10, ()), (5, 1000, ("b",))])
def test_a_run_and_its_counts_in_one_pass(spark, target, most, done):
    rng = random.Random(1)
    rows = [(i, rng.choice(("a", "b", " b", "c", "d", "", None, *(f"q{k}" for k in range(20)))), rng.choice(("", "", "", "x" * 100)), rng.choice((None, None, "template_like", "score_below_min"))) for i in range(150)]
    known = spark.createDataFrame([(q,) for q in (*done, *done)], "query string") if done else None
    statuses = datasets.funnel_status(spark.createDataFrame(rows, OUTCOMES), target, most, known)
    want = plain_run(rows, target, most, done)
    assert sorted(map(tuple, statuses.collect())) == want
    accepted, seen = datasets.observed_funnel(statuses)
    assert accepted.count() == sum(w[2] == "accepted" for w in want)
    counts = {}
    for _, _, kind, why in want:
        counts[kind, why] = counts.get((kind, why), 0) + 1
    assert {(k, w): n for k, w, n in datasets.funnel_table(seen)} == counts | {("scanned", ""): len(want)}


def test_malformed_lines_are_counted_while_reading(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "n": "x"}\nnot json\n\n[1]\n{"id": 2}\n{"id": {"a": 1}}\n')
    rows, seen = files.read_jsonl_counted(spark, str(tmp_path / "a.jsonl"), "id int, n string")
    assert {r["id"] for r in rows.collect()} == {1, 2}
    assert seen.get == {"n_lines": 5, "n_malformed": 3}


def test_batches_can_be_cut_off_and_repeated(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "out"), "query string, copy string, n int"
    made = lambda *rows: spark.createDataFrame(rows, schema)
    read = lambda: {tuple(r) for r in files.read_batches(spark, path, schema).collect()}
    assert read() == set() and files.committed_batches(spark, path) == []
    first = made(("a", "1", 2), ("a", "0", 1), ("b", "2", 1), (None, "3", 1))
    assert files.append_batch(first, path, "one", order="n") == 2
    assert read() == {("a", "0", 1), ("b", "2", 1)}
    assert files.append_batch(first, path, "one", order="n") == 2 and files.append_batch(first, path, "again", order="n") == 0
    assert read() == {("a", "0", 1), ("b", "2", 1)}

    # a run that ends after its rows and before its manifest
    second = made(("b", "9", 9), ("c", "4", 1), ("d", "5", 1))
    files.append_batch(second, path, "two")
    assert ("c", "4", 1) in read()
    for name in ("_SUCCESS", "._SUCCESS.crc"):
        (tmp_path / "out" / "manifest" / "two" / name).unlink(missing_ok=True)
    assert files.committed_batches(spark, path) == ["again", "one"] and ("c", "4", 1) not in read()
    assert files.append_batch(second, path, "two") == 2
    assert read() == {("a", "0", 1), ("b", "2", 1), ("c", "4", 1), ("d", "5", 1)}
    with pytest.raises(ValueError):
        files.append_batch(second, path, "a/b")


def test_samples_by_threshold_are_the_smallest_hashes(spark):
    rows = [(f"q{i}", "short" if i % 3 else "long", "high" if i % 7 else "low") for i in range(600)]
    pool = spark.createDataFrame(rows, "normalized_query string, query_bucket string, evidence_strength string").repartition(5)
    quotas = {("short", "high"): 25, ("short", "low"): 4, ("long", "high"): 1, ("long", "low"): 900}
    got = {(r["query_bucket"], r["evidence_strength"], r["picked"]): r["normalized_query"] for r in datasets.stratified_sample(pool, quotas, strict=False).collect()}
    want = {}
    for (bucket, strength), quota in quotas.items():
        own = sorted((q for q, b, s in rows if (b, s) == (bucket, strength)), key=lambda q: hashlib.md5(f"42|{q}".encode()).hexdigest())
        want |= {(bucket, strength, i + 1): q for i, q in enumerate(own[:quota])}
    assert got == want
    with pytest.raises(ValueError, match="long/low 29 of 900"):
        datasets.stratified_sample(pool, quotas)


def test_every_rule_of_the_funnel(spark):
    base = {
        "query": "跑步手环", "llm_status": "provider_ok", "top_valid": True, "top_issues": [], "final_source": "llm_ranker_top1", "final_copy": "跑步手环轻巧好戴日常计步", "rank_score": 90.0,
        "evidence_texts": ["跑步手环"], "candidate_source": "llm", "rewrite_reason": "",
    }
    cases = [
        ({}, None), ({"query": "123"}, "query_too_noisy"), ({"llm_status": "provider_partial"}, "provider_not_ok"), ({"top_valid": False}, "validator_invalid"), ({"top_issues": ["too_short"]}, "validator_invalid"),
        ({"final_source": "template_fallback"}, "fallback_copy_source"), ({"final_copy": "跑步手环正品计步好戴轻巧"}, "suspicious_claims"), ({"rank_score": 79.9}, "score_below_min"), ({"final_copy": "手环跑步" * 2}, "copy_length_out_of_range"),
        ({"final_copy": "手环跑步" * 11}, "copy_length_out_of_range"), ({"final_copy": "跑步手环可以先看这款轻巧好戴"}, "template_like"), ({"final_copy": "完全无关的句子写在这里了吧"}, "unrelated_to_evidence"),
        ({"candidate_source": "llm_rule_rewrite", "final_copy": "跑步手环轻巧好戴日常计步"}, "rewritten_copy_too_short"), ({"rewrite_reason": "rule_rewrite_from_invalid_candidate"}, "validator_invalid"),
    ]
    schema = "query string, llm_status string, top_valid boolean, top_issues array<string>, final_source string, final_copy string, rank_score double, evidence_texts array<string>, candidate_source string, rewrite_reason string"
    rows = [(i, *(base | change).values()) for i, (change, _) in enumerate(cases)]
    got = {r["i"]: r["reason"] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", datasets.filter_reason().alias("reason")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert set(datasets.REASONS) == {want for _, want in cases if want}


def test_gate_by_tone(spark):
    bad, good = "可先关注这款手环", "通勤路上戴着正合适"
    rows = [
        (1, "creative", good, "", None, "S", False, "", "C", "T"), (2, "creative", bad, "", good + "呀", "S", False, "", "C", "T"), (3, "creative", bad, "", "等商品", "S", False, "", "C", "T"),
        (4, "creative", bad, "", None, "S", False, "", "", "T"), (5, "safe", bad, "", None, "S", False, "", "C", "T"), (6, "safe", None, "timeout", None, "S", False, "", "C", "T"),
        (7, "safe", None, None, None, "S", True, "few", "C", "T"), (8, "creative", good, "timeout", None, "S", False, "", None, "T"), (9, None, good, None, None, None, None, None, None, None), (10, "safe", "", "", "", "", True, "few", "", ""),
    ]
    names = "i int, tone string, candidate string, error string, rewritten string, summary string, summary_fell boolean, summary_reason string, creative string, template string"
    got = {r["i"]: (r["final_copy"], r["llm_status"], r["rewrite_attempted"], r["fallback_reason"]) for r in datasets.gated_copies(spark.createDataFrame(rows, names)).collect()}
    assert got == {
        1: (good, "llm_ok", False, ""), 2: (good + "呀", "llm_ok_rewritten", True, ""), 3: ("C", "llm_failed: bad_ad_copy_detected:等商品", True, "llm_bad_copy_then_creative_template"),
        4: ("T", "llm_failed: bad_ad_copy_detected:可先关注", True, "llm_bad_copy_then_creative_template"), 5: (bad, "llm_ok", False, ""), 6: ("S", "llm_failed: timeout", False, "llm_failed_then_summary_ok"),
        7: ("T", "llm_failed: no_candidate", False, "llm_failed_then_summary_few"), 8: ("T", "llm_failed: timeout", False, "llm_failed_then_creative_template"), 9: (good, "llm_ok", False, ""), 10: ("", "llm_failed: no_candidate", False, "llm_failed_then_summary_few"),
    }


def test_records_have_a_rewritten_candidate_only_if_the_run_rewrote_it(spark):
    planned = spark.createDataFrame([("e1", "q1", "q1", "short", 2), ("e2", "q2", "q2", "short", 2), ("e3", "q3", "q3", "short", 2)], "sample_id string, query string, normalized_query string, query_bucket string, query_len int")
    outcomes = [("q1", "p", "m", "ok", "new text", "llm_rule_rewrite", "why", "g1", True, "why", "hit"), ("q2", "p", "m", "ok", "kept", "llm_ranker_top1", "top_candidate_kept", "g1", False, None, "miss")]
    names = "query string, provider string, model string, llm_status string, final_copy string, final_source string, rewrite_reason string, top_candidate_id string, fallback boolean, fallback_reason string, cache_status string"
    intents = spark.createDataFrame([("q1", "s", "", "", "", [], ["f"])], "query string, intent_summary string, scenario string, audience string, purchase_focus string, attribute_hints array<string>, search_focus array<string>")
    fields = "query string, pos int, item_id long, item_title string, brand_name string, seller_name string, category_path string, ranking_signal double, relevance_signal int"
    selected = spark.createDataFrame([("q1", 2, 8, "t", "b", "s", "c", 1.0, 1), ("q1", 1, 7, "", "other", "", "", 1.0, None), ("q1", 4, 9, "x", "x", "x", "x", 1.0, 1)], fields)
    generations = spark.createDataFrame([("q1", "g2", "r2"), ("q1", "g1", "r1")], "query string, candidate_id string, raw_text string")
    kinds = "query string, candidate_id string, text string, strategy string, used_evidence array<string>, personalized_tags array<string>, issues array<string>, is_valid boolean, length int, relevance_hits int, rank_score int, rank int"
    ranked = spark.createDataFrame([("q1", "g1", "old", "st", [], [], ["too_short"], False, 3, 0, 50, 1), ("q1", "g2", "other", "st", [], [], [], True, 5, 1, 40, 2)], kinds)
    got = {r["sample_id"]: r for r in datasets.eval_samples(planned, spark.createDataFrame(outcomes, names), intents, selected, generations, ranked).collect()}
    assert set(got) == {"e1", "e2"}  # the third has no outcome
    one = got["e1"].asDict(recursive=True)
    assert one["rewritten_candidates"] == [{"candidate_id": "g1", "strategy": "st", "text": "new text", "rewrite_reason": "why", "source": "llm_rule_rewrite"}]
    assert (one["best_copy"], one["final_ad_copy"], one["anchor_item_id"], one["fallback_triggered"]) == ("old", "new text", 7, True)
    assert [e["item_id"] for e in one["selected_evidence"]] == [7, 8] and one["evidence_score"] == round(7 / 18, 4) and one["evidence_strength"] == "low"
    assert one["raw_llm_output"] == ["r1", "r2"] and [c["candidate_id"] for c in one["ranked_candidates"]] == ["g1", "g2"]
    assert [c["issues"] for c in one["validated_candidates"]] == [["too_short"], []]
    assert (got["e2"]["rewritten_candidates"], got["e2"]["best_copy"], got["e2"]["fallback_reason"]) == ([], "", "")


def test_chat_samples_of_runs(spark):
    intent = "struct<intent_summary:string,scenario:string,audience:string,purchase_focus:string,attribute_hints:array<string>>"
    profile = "struct<gender:string,age_bucket:string,city:string,province:string,country:string>"
    item = "struct<item_title:string,brand_name:string,seller_name:string,category_path:string>"
    names = f"query string, intent {intent}, user_profile {profile}, recent_behavior_titles array<string>, selected_evidence array<{item}>, style_examples array<string>, final_copy string, final_source string, provider string, llm_status string, retrieval_source string, rewritten boolean, score double"
    rows = [
        (" q ", ("s", "", "党", None, ["a", " ", "b", "c", "d", "e", "f"]), ("F", None, None, "粤", None), ["t"], [("x", "无品牌", "", "c"), ("y", "b", "", "")], ["1", "", "2", "3", "4", "5", "6"], " copy ", "llm_rule_rewrite", "p", "ok", "train_pairs_user_exact", True, 81.239),
        ("r", None, None, None, None, None, None, None, "p", None, None, None, None),
    ]
    first, second = datasets.outcomes_to_chat(spark.createDataFrame(rows, names)).collect()
    assert first["messages"][1]["content"] == (
        "Query: q\nIntent: 意图总结：s\n人群：党\n属性提示：a、b、c、d、e\nUser Profile: 用户画像：性别：F，地区：粤\n最近行为：t\n"
        "Evidence: 1. x | 类目：c\n2. y | 品牌：b\nStyle Examples: 1. 1\n2. 2\n3. 3\n4. 4\n5. 5\n请生成1条自然广告文案。"
    )
    assert first["messages"][2]["content"] == "copy"
    assert first["metadata"].asDict() == {
        "query": "q", "provider": "p", "score": 81.24, "evidence_confidence": "high", "quality_tags": ["provider_p", "llm_status_ok", "final_source_llm_rule_rewrite", "evidence_high", "style_conditioned", "rewritten"],
    }
    assert second["messages"][1]["content"] == "Query: r\nIntent: \nUser Profile: (empty)\nEvidence: (empty)\nStyle Examples: (empty)\n请生成1条自然广告文案。"
    assert second["metadata"]["evidence_confidence"] == "very_low" and second["metadata"]["quality_tags"][-2:] == ["style_unconditioned", "direct_rank_top1"]


def test_weighted_history(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0]), (3, [3.0, 0.0])], "id long, embedding array<float>")
    owned = [("a", [0, 1, 2, 1], 3), ("b", [0, 0], 3), ("c", [2, 9], 8), ("d", None, 1)]
    df = spark.createDataFrame(owned, "k string, hist_item array<long>, target long")
    got = {r["k"]: [round(x, 6) for x in r["pooled"]] for r in ctr.weighted_history(df, vectors, "k", "target").collect()}
    # a: vector 1 twice with weight 3, vector 2 with weight 1.5
    assert got == {"a": [6.75, 10.5], "b": [0.0, 0.0], "c": [0.0, 0.0], "d": [0.0, 0.0]}
    mean = {r["k"]: [round(x, 6) for x in r["pooled"]] for r in ctr.masked_mean_history(df, vectors, "k").collect()}
    assert mean == {"a": [round(2.5 / 3, 6), 1.0], "b": [0.0, 0.0], "c": [0.5, -1.0], "d": [0.0, 0.0]}


ASKED = "query string, category_hint string, titles array<string>, scenario string, audience string, purchase_focus string, points array<string>, interest_tags array<string>, demographic_tags array<string>"


def test_template_copies(spark):
    rows = [
        ("华为手环", "智能手环", ["运动手环计步"], "", "", "计步心率", ["支持心率和睡眠"], ["运动"], ["gender=F"]), ("连衣裙", "", [], "约会", "女生", "", None, None, None), ("abc x", None, None, None, None, None, None, None, None),
        ("零食礼包", "食品", ["坚果"], "追剧分享", "囤零食人群", "", [], [], []), ("手机壳 手环", "", [], "", "", "", [], [], []),
    ]
    made = T.template_candidates(spark.createDataFrame(rows, ASKED)).collect()
    got = {}
    for r in sorted(made, key=lambda r: r["candidate_id"]):
        got.setdefault(r["query"], []).append(r)
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys((r[0] for r in rows), 5)
    assert all([r["strategy"] for r in x] == list(L.STRATEGIES) for x in got.values())
    assert got["华为手环"][0]["text"] == "跑步通勤都能戴，心率睡眠随手看。" and got["华为手环"][0]["used_evidence"] == ["心率", "睡眠"]
    assert got["华为手环"][0]["personalized_tags"] == ["运动", "gender=F", "运动党"] and got["华为手环"][1]["used_evidence"] == ["睡眠", "计步"]
    assert got["连衣裙"][0]["text"] == "约会不想纠结，好搭舒适穿着就能出门。" and got["连衣裙"][3]["text"] == "女生穿连衣裙，好搭舒适更贴合日常。"
    assert got["连衣裙"][0]["rationale"] == "结合场景型表达，落到约会和好搭舒适。"
    # the last vertical: nothing names the query, so the scene leads; a copy that names no point gets one
    assert got["abc x"][3]["text"].startswith("不想挑太久，先看abc这一类") and "实用" in got["abc x"][3]["text"]
    assert all(len(r["text"]) >= 12 and r["text"][-1] in "。！？" for r in made)
    assert got["手机壳 手环"][0]["text"].startswith("日常防摔先安排")  # the first vertical in order
    few = T.template_candidates(spark.createDataFrame(rows, ASKED), 1).groupBy("query").count()
    assert {r["count"] for r in few.collect()} == {3}
    assert T.template_candidates(spark.createDataFrame([], ASKED)).count() == 0


def test_observations_and_counts(spark):
    local = spark.createDataFrame([(q, "abc", 2) for q in "abcdefgh"] + [("only", "x", 1)], "query string, copy string, n_candidates int")
    remote = [("a", "abc", 2, "ok"), ("b", "abcd", 1, "ok"), ("c", "a元", 3, "ok"), ("d", "", 0, "ok"), ("e", "z", 9, "error"), ("f", "z", 9, "skipped_no_api_key"), ("g", "ab", 2, None), ("h", "xyz", None, "ok")]
    got = {r["query"]: (r["naturalness"], r["richness"], r["risk"]) for r in datasets.provider_observations(local, spark.createDataFrame(remote, "query string, copy string, n_candidates int, status string")).collect()}
    assert got == {
        "a": ("same", "similar", []), "b": ("longer", "richer", []), "c": ("different", "richer", ["元"]), "d": ("no_output", "not_richer", []), "e": ("error", "error", []), "f": ("skipped", "skipped", []),
        "g": ("different", "not_richer", []), "h": ("longer", "not_richer", []),
    }
    rows = spark.createDataFrame([("q", "summary_topk", "few", ""), ("q", "llm_topk", "", "p"), ("r", "summary_topk", "", ""), ("r", "llm_topk", "", None)], "query string, baseline string, reason string, llm_provider string")
    about = spark.createDataFrame([("q", "food", "short")], "query string, domain string, length_bucket string")
    counts = {(r["field"], r["value"]): r["n"] for r in datasets.comparison_counts(rows, about, ("food", "health"), ("short", "long")).collect()}
    assert counts == {
        ("domain", "food"): 1, ("domain", "health"): 0, ("domain", "misc"): 1, ("length", "short"): 1, ("length", "long"): 0, ("length", "medium"): 1, ("summary_reason", "few"): 1, ("summary_reason", "none"): 1,
        ("llm_provider", "p"): 1, ("llm_provider", "none"): 1,
    }
