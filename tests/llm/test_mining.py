"""Hard negatives, language identification and phrases against brute force, with nulls, ties, repeats and long texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import phrases
from adloom.llm.hard_negatives import bit_planes, hard_negatives, scores, subset_sums
from adloom.llm.language_id import LONGEST, characters, grams, identify_languages, kernel, presences, slot
from adloom.llm.phrases import Words, chunks, mine_phrases, segments

# hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if kept[i][0] == label][:positives]:
            hard = [i for i in ranked if kept[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(hard[:negatives])}
    return out


def vectors(seed, n, d=11, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(3) if rng.random() < 0.7 else 0, [rng.uniform(-spread, spread) for _ in range(d)]) for i in range(n)]


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("part,block", [(65_536, 4096), (37, 5)])
def test_hard_negatives(spark, part, block):
    rows = vectors(1, 240)
    rows += [(300, None, [1.0] * 11), (301, 1, None), (302, 1, [None] + [1.0] * 10), (310, 0, [math.nan] * 11), (320, 0, [math.inf] * 11), (None, 0, [1.0] * 11)]
    # ties, a repeated id with another vector, a short and an empty vector, zero vectors
    rows += [(400 + i, i % 2, rows[20][2]) for i in range(30)] + [(20, 2, [0.5] * 11), (20, rows[20][1], rows[20][2]), (330, 0, [0.9]), (340, 1, []), (350, 1, [0.0] * 11)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], VECTORS + ", part string, anchor int")
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, part=part, block=block)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_one_label_or_nothing(spark):
    rows = [(i, 4, [0.1 * i, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    assert hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0
    mixed = rows + [(50 + i, 5, [0.05 * i, 0.4]) for i in range(40)]
    got = hard_negatives(spark.createDataFrame(mixed, VECTORS), F.col("vec_id") % 10 == 0, positives=2, negatives=3)
    assert {tuple(r) for r in got.collect()} == brute_negatives(mixed, lambda i: i % 10 == 0, 2, 3)


def test_lookups_give_exact_scores():
    rng = np.random.default_rng(2)
    for d, most in ((1, 1), (8, 300), (13, 70_000), (64, 255)):
        a, b = rng.integers(-most, most + 1, (5, d)), rng.integers(-most, most + 1, (40, d))
        planes = bit_planes(b)
        assert planes.shape[1] == -(-d // 8) and planes.shape[2] == 40
        assert (scores(subset_sums(a), planes) == b @ a.T).all()


def test_components_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(i, i % 2, [1e17, 1.0]) for i in range(20)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        hard_negatives(df, F.col("vec_id") % 10 == 0).collect()


# languages


def spoken(rng, lang, n):
    parts = {"aa": "the ing er th on an re he".split(), "bb": "sch ein ung ich ä der ver lich".split(), "cc": "ção nho os mente que ar lh".split()}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, spoken(rng, lang, rng.choice((3, 30, 300))), lang) for i in range(600) for lang in [rng.choice(("aa", "aa", "bb", "cc"))]]
    rows += [(1001, None, "aa"), (1002, "", "bb"), (1003, "12 ,. !\n", "cc"), (1004, "中文字符", None), (None, spoken(rng, "bb", 40), "bb"), (1006, spoken(rng, "cc", 60_000), None)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, lang in rows:
        assert by_id[i]["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)
        assert 0 <= by_id[i]["score"] <= 1
    for i in (1001, 1002, 1003):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[1004]["lang_pred"] in ("aa", "bb", "cc") and by_id[1006]["lang_pred"] == "cc" and by_id[None]["lang_pred"] == "bb"
    held = [(by_id[i]["lang_pred"], lang) for i, _, lang in rows if i is not None and i < 1000 and by_id[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 100
    # the same rows in another order and layout give the same result
    again = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify_languages(df.orderBy(F.desc("text")).repartition(3)).collect()}
    assert again == {i: (r["lang_pred"], round(r["score"], 9)) for i, r in by_id.items()}


def test_languages_without_training(spark):
    schema = "doc_id long, text string, lang string"
    assert identify_languages(spark.createDataFrame([], schema)).count() == 0
    got = identify_languages(spark.createDataFrame([(1, "some text", None), (2, None, None)], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = identify_languages(spark.createDataFrame([(i, f"word {i} text", "zz") for i in range(9)], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("zz", 1.0)}


def test_the_kernel_counts_shared_grams(monkeypatch):
    from adloom.llm import language_id

    rng = random.Random(8)
    texts = [spoken(rng, lang, 12) for lang in ("aa", "bb", "cc", "aa")] + ["x", "  Ünï, Ünï! 𐐀 中 "]
    codes = [characters(t) for t in texts]
    plain = lambda t: " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
    assert ["".join(map(chr, c)) for c in codes[:5]] == [plain(t) for t in texts[:5]]
    sets = [{s[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(s) - n + 1)} for s in map(lambda c: "".join(map(chr, c)), codes)]
    keys = np.unique(np.concatenate([h for c in codes[:3] for _, h in grams(c)]))
    keys = keys[np.sort(np.unique(slot(keys), return_index=True)[1])]
    slots = np.full(language_id.SLOTS, -1, np.int32)
    slots[slot(keys)] = np.arange(len(keys))
    landmark = presences(codes[:3], keys, slots)
    known = set().union(*sets[:3])
    got = kernel(codes, keys, slots, landmark.T)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:3]):
            want = len(a & b) / math.sqrt(max(1, len(a & known)) * len(b))
            assert abs(got[i, j] - want) < 1e-4
    monkeypatch.setattr(language_id, "CHARS", 7)  # slices of a long text give the same presence
    assert (presences(codes, keys, slots)[:3] == landmark).all()


# phrases


def brute_phrases(rows, least=30, inside=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3, 4):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in counts.items():
        found = [(g, a) for g, a in f.items() if len(g) > 1 and a >= least]
        longer = defaultdict(int)
        for g, a in found:
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    longer[g[i : i + n]] = max(longer[g[i : i + n]], a)
        kept = []
        for g, a in found:
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * longer[g] < inside * a or not longer[g]:
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(12) for c in ("Wo", "é", "z")]
    said = lambda n: "".join(rng.choice(vocabulary[: rng.choice((4, 12, 36))]) + rng.choice((" ", " ", " ", "  ", "\t", ", ", ".\n", "? ", "\r\n", "\x0b")) for _ in range(n))
    passage = said(80)
    rows = [(rng.choice(("en", "de", None, "und", "")), said(rng.randrange(1, 120))) for _ in range(150)]
    rows += [("en", said(5) + passage + said(5)) for _ in range(60)] + [("de", passage)] * 70
    rows += [(None, None), ("en", ""), ("en", " .,\n"), ("fr", "one"), ("fr", "same " * 3000), ("fr", "a b " * 2500), ("en", said(9000)), ("xx", "x" * 50_000 + " y")]
    return rows


@pytest.mark.parametrize("period,longest", [(32, 8192), (3, 10), (1, 5), (10**9, 7)])
def test_phrases(spark, monkeypatch, period, longest):
    rows = corpus(3)
    monkeypatch.setattr(chunks, "__defaults__", (period, longest))
    df = spark.createDataFrame([(i, x, lang, "s", 1, "f") for i, (lang, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int, f string")
    assert {tuple(r) for r in mine_phrases(df).collect()} == brute_phrases(rows)


def test_phrases_of_small_tops_and_empty_tables(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(x, lang) for lang, x in rows], "text string, lang string").repartition(5)
    got = mine_phrases(df, least=10, inside=50, top=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 10, 50, 7)
    assert mine_phrases(df.where("false")).count() == 0
    assert mine_phrases(df.where("lang = 'xx'")).count() == 0


def test_every_phrase_lies_in_the_chunk_that_owns_its_first_word():
    rng = random.Random(9)
    for period in (1, 2, 5, 1000):
        text = " ".join(rng.choice("abcdefgh") for _ in range(400)).replace("a b", "a. b").encode()
        words = Words(text)
        first, last, own = chunks(words, period, 50)
        owned = Counter()
        for a, b, n in zip(first, last, own, strict=True):
            assert words.piece[a] == words.piece[b]
            owned.update(range(a, a + n))
            for i in range(a, a + n):
                whole = [j for j in range(i, min(i + 4, len(words))) if words.piece[j] == words.piece[i]]
                assert whole[-1] <= b
        assert owned == Counter(range(len(words)))


def test_copies_are_one_chunk_row(spark):
    text = " ".join(f"w{i % 97}" for i in range(4000))
    one = phrases.parse_chunks(spark.createDataFrame([("en", text.encode())], "lang string, bytes binary"))
    many = phrases.parse_chunks(spark.createDataFrame([("en", text.encode())] * 50, "lang string, bytes binary"))
    assert one.count() == many.count() and many.agg(F.min("n")).first()[0] >= 50
    assert b"".join(segments(b"ab cd. ef gh, ij" * 50, 100)) == b"ab cd. ef gh, ij" * 50
