"""Learned operators use every row and every context, however many there are."""

import math
import random
from collections import defaultdict
from functools import cache
from pathlib import Path

import brute
import numpy as np
import pytest

from adloom.llm import language_model, quality
from adloom.llm.language_model import DEPTH, lm_scores


def test_quality_learns_from_every_pair_of_labelled_rows(spark):
    """The weights have no slope left in the loss of all pairs, added up one by one."""
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(("word", "Other", "12", "#x!", "longer")) for _ in range(rng.randrange(1, 40))) for i in range(150)}
    marks = {i: int(x.count("#") * 6 < len(x.split()) + rng.randrange(8)) for i, x in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    weights, _ = quality.fit(docs, labels)
    table, used = quality.groups(), [i for i in texts if brute.crc(i) % 5]
    value = {i: quality.features(texts[i].encode(), table) for i in used}
    gaps = np.array([value[i] - value[j] for i in used for j in used if marks[i] and not marks[j]])
    slope = -(gaps / (1 + np.exp(gaps @ weights))[:, None]).mean(0) + 1e-4 * weights
    assert len(gaps) > 1000 and np.abs(slope).max() < 1e-4


def test_quality_uses_labelled_rows_beyond_20000(spark):
    """21,000 rows of either label all count."""
    values = [(i, [float(i % 7 + 3 * (i % 2))] + [0.0] * (len(quality.NAMES) - 1)) for i in range(42_000)]
    rated = spark.createDataFrame([(i % 2, v) for i, v in values], "quality int, value array<double>")
    d = len(quality.NAMES)
    sums = quality.PairSums(rated, np.zeros(d), np.zeros(d), np.eye(d))
    assert sums.rows == [21_000, 21_000]
    x = np.array([v[0] for _, v in values])
    slope = -(x[1::2].mean() - x[::2].mean()) / 2
    assert sums.loss()[1][0] == pytest.approx(slope) and sums.loss()[0] == pytest.approx(np.log(2))


def test_every_context_is_in_the_model(spark):
    """More contexts than the 32,768 that a small model once held: scores are those of the tree of all of them."""
    rng = random.Random(6)
    texts = {i: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(700)) for i in range(24)} | {30: None, 31: ""}
    seen, children = defaultdict(lambda: defaultdict(lambda: [0, 0])), defaultdict(set)

    def path(data, i):
        return [data[i - d : i][::-1] for d in range(DEPTH + 1)]

    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    for x in [(x or "").encode() for i, x in texts.items() if brute.crc(i) % 10]:
        data = bytes(DEPTH) + x + b"\xff"
        for i in range(DEPTH, len(data)):
            for s in path(data, i):
                if s:
                    children[s[:-1]].add(s)
                for node, bit in bits(data[i]):
                    seen[s][node][bit] += 1
    assert len(seen) > 40_000

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    @cache
    def inner(s, node):
        return sum(weighted(c, node) for c in children[s] if node in seen[c])

    def weighted(s, node):
        return np.logaddexp(kt(seen[s][node]), inner(s, node)) - math.log(2) if len(s) < DEPTH else kt(seen[s][node])

    def predict(way, node, bit):
        s, n = way[0], seen[way[0]].get(node, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if len(way) == 1 or way[1] not in seen or node not in seen[way[1]]:
            return own
        share = 1 / (1 + math.exp(min(700, inner(s, node) - kt(n))))
        return share * own + (1 - share) * predict(way[1:], node, bit)

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lm_scores(docs).collect():
        data = bytes(DEPTH) + (texts[r["doc_id"]] or "").encode() + b"\xff"
        want = sum(math.log10(predict(path(data, i), node, bit)) for i in range(DEPTH, len(data)) for node, bit in bits(data[i]))
        assert r["score"] == pytest.approx(want, rel=1e-5), r["doc_id"]


def test_texts_of_the_model_are_not_stored(spark, monkeypatch):
    """What the model keeps on disk are counts and answers: no table holds a copy of the texts, and all together are smaller than those."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(("adenine", "cytosine", "guanine", "thymine"), k=2_500))) for i in range(100)], "doc_id long, text string")
    kept, made = language_model.shared_table, []

    def stored(df, label):
        out = kept(df, label)
        made.append((df.columns, sum(x.stat().st_size for x in Path(out._shared_path.removeprefix("file:")).rglob("*.parquet"))))
        return out

    monkeypatch.setattr(language_model, "shared_table", stored)
    assert lm_scores(docs).count() == 100 and made
    assert not any("bytes" in columns for columns, _ in made) and sum(size for _, size in made) < 500_000


def test_scores_do_not_depend_on_chunks(spark, monkeypatch):
    """Many small chunks give what one gives, with rows dealt otherwise too; repeated rows and ids, null ids and texts included."""
    rng = random.Random(9)
    made = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(400)))) for i in range(150)]
    made += made[:5] + [(7, "another text"), (None, "no id"), (None, None), (3, None), (4, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string")

    def scores(df):
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in lm_scores(df).collect())

    one = scores(docs)
    monkeypatch.setattr(language_model, "CHUNK", 2_000)
    assert len(one) == len(made) and scores(docs) == one and scores(docs.repartition(7)) == one
