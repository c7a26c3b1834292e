"""Overlaps with replaced middles and substitutions near an edge."""

import random

import numpy as np

from adloom.llm.decontaminate import contaminated, overlap_tables, tokens, verify


def kept(text: str, lost) -> str:
    return " ".join(f"other{k}" if k in lost else w for k, w in enumerate(text.split()))


def test_passages_after_a_replaced_middle_and_swaps_near_an_edge(spark):
    long, short = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 15)))
    texts = {1: kept(long, {*range(6, 19), *range(41, 60)}), 2: kept(short, {1, 7, 13}), 3: kept(short, {1, 5, 9, 13}), 4: "x y " + kept(long, {*range(20), 21, 23, 34, *range(36, 60)})}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["item_start"], r["item_end"], r["n_matched"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1): (19, 19, 41, 22), (2, 2): (0, 0, 15, 12), (4, 1): (22, 20, 34, 12)}


def test_every_stretch_that_counts_is_found():
    rng = random.Random(3)
    found = 0
    for _ in range(2000):
        n = rng.choice((6, 15, 25, 60))
        item = np.arange(n)
        doc = np.array([k if rng.random() < 0.75 else -1 for k in range(n)])
        same, need = doc == item, min(12, -(-n * 4 // 5))
        spans = [(s, e) for s in range(n) for e in range(s + 1, n + 1) if 5 * same[s:e].sum() >= 4 * (e - s) and same[s:e].sum() >= need]
        got = verify(np.concatenate([[-5, -5], doc]), item, 2, 0.8, 12)
        assert bool(spans) == (got is not None)
        if got:
            found += 1
            assert got[:2] in spans and got[2] == same[got[0] : got[1]].sum()
    assert 200 < found < 1800


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_recall_against_every_alignment(spark):
    rng = random.Random(11)
    items = {i: sentence(rng, rng.choice((4, 5, 8, 15, 30, 60))) for i in range(40)}
    docs = {}
    for i in range(300):
        w = items[rng.randrange(40)].split()
        a = rng.randrange(max(1, len(w) - 20))
        share = rng.choice((0, 0.05, 0.1, 0.2))
        docs[i] = " ".join([sentence(rng, rng.randrange(30)), *(x if rng.random() >= share else "other" for x in w[a : a + rng.choice((4, 14, 25, 60))]), sentence(rng, rng.randrange(30))])
    docs |= {i + 1000: docs[i] for i in range(50)}
    want = set()
    spelled = {i: tokens(t.encode()) for i, t in items.items()}
    for d, text in docs.items():
        t = tokens(text.encode())
        for i, item in spelled.items():
            if any(verify(t, item, shift, 0.8, 12) for shift in range(-len(item) + 1, len(t))):
                want.add((d, i))
    rows, members = overlap_tables(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in rows.join(members.withColumnRenamed("item_id", "member"), "passage").select("doc_id", "member").toDF("doc_id", "item_id").collect()}
    assert len(want) > 150 and got <= want
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


def test_short_items_count_as_whole_texts_only(spark):
    docs = spark.createDataFrame([(1, "New York City!"), (2, "in new york city"), (3, "yes"), (4, "yes yes"), (5, ""), (6, "new york")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "new york city"), (2, "Yes."), (3, "..."), (4, "yes")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_items"], r["n_matched"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1, 3), (3, 2, 2, 1)}


def test_a_phrase_of_many_items_in_many_documents(spark):
    rng = random.Random(4)
    phrase = sentence(rng, 14)
    make = lambda: f"{sentence(rng, 20)} {phrase} {sentence(rng, 20)}"
    docs = spark.createDataFrame([(i, make()) for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, make()) for i in range(300)], "item_id long, text string")
    rows, members = overlap_tables(docs, bench)
    got = rows.groupBy("doc_id").sum("n_items").collect()
    assert len(got) == 300 and all(r[1] == 300 for r in got)
    assert rows.count() < 3000 and members.select("item_id").distinct().count() == 300
