"""Very long texts of the secret scan, and the ring against a plain walk over it."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adloom.llm.secrets import ALLOW, CLASSES, KINDS, scan_secrets
from adloom.llm.sharding import CELLS, bounded_ring

ALPHABET = CLASSES[1][1]


def plain_spans(text, window=24, bits=4.05):
    spans = []
    for k in range(len(text) - window + 1):
        counts = Counter(text[k : k + window])
        if math.log2(window) - sum(c * math.log2(c) for c in counts.values()) / window >= bits - 1e-9:
            if spans and spans[-1][1] >= k:
                spans[-1] = (spans[-1][0], k + window)
            else:
                spans.append((k, k + window))
    return spans


def test_windows_of_long_runs_cross_the_chunks(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(ALPHABET[: rng.choice((24, 30, 66))]) * rng.choice((1, 1, 2)) for _ in range(n)) for n in (23, 24, 127, 128, 129, 151, 152, 400, 1500)]
    texts += ["".join(rng.choices(ALPHABET, k=120)) + "a" * gap + "".join(rng.choices(ALPHABET, k=140)) for gap in (0, 5, 8, 30, 130, 260)]
    got = scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), allow=()).collect()
    for r in got:
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "entropy_base64"] == plain_spans(texts[r["doc_id"]]), r["doc_id"]


def test_one_run_of_a_million_letters_and_many_matches(spark):
    rng = random.Random(9)
    run = "".join(rng.choices(ALPHABET, k=1_000_000))
    many = " ".join(f"é token=abcdef{i}" for i in range(20_000))
    start = time.time()
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string"), allow=()).collect()}
    assert time.time() - start < 90
    spans = [s for s in got[1] if s["kind"] == "entropy_base64"]
    assert sum(s["end"] - s["start"] for s in spans) > 990_000
    assert [(s["kind_no"], many[s["start"] : s["end"]]) for s in got[2]] == [(KINDS.index("assign"), f"token=abcdef{i}") for i in range(20_000)]


def plain_ring(keys, shards, vnodes, load, places):
    """key -> shard: keys in ring order fill their arc's shard and go on clockwise when it is full."""
    nodes = {}
    for node, cell in enumerate(places):
        nodes.setdefault(cell, node // vnodes)
    order = sorted(nodes)
    names = [nodes[c] for c in order]
    total = len(keys)
    each = total // shards if load == 1 else math.floor(total * load / shards) + 1
    free = [each + (1 if load == 1 and s < total % shards else 0) for s in range(shards)]
    arcs = [[] for _ in order]
    for key, (cell, h) in sorted(keys.items(), key=lambda x: (x[1], x[0])):
        at = next((i for i, c in enumerate(order) if c >= cell), None)
        arcs[at or 0].append((at is not None, cell, h, key))
    out = {}
    for i, arc in enumerate(arcs):
        for *_, key in sorted(arc):
            shard = next(names[(i + k) % len(names)] for k in range(len(names)) if free[names[(i + k) % len(names)]])
            free[shard] -= 1
            out[key] = shard
    return out


@pytest.mark.parametrize("load", [1.0, 1.25])
def test_ring_against_a_plain_walk(spark, load):
    docs = spark.range(700).selectExpr("id * 3 as doc_id", "'t' as text")
    h = F.xxhash64(F.lit(17), "doc_id")
    made = docs.select("doc_id", F.pmod(F.shiftrightunsigned(h, 24), F.lit(CELLS)).alias("cell"), h.alias("h"))
    keys = {r["doc_id"]: (r["cell"], r["h"]) for r in made.collect()}
    places = [r[0] for r in spark.range(5 * 7).orderBy("id").select(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(CELLS))).collect()]
    got = {r["doc_id"]: r["shard"] for r in bounded_ring(docs, shards=5, vnodes=7, load=load).collect()}
    assert got == plain_ring(keys, 5, 7, load, places)


@pytest.mark.parametrize("load", [1.0, 1.25])
def test_one_more_shard_moves_few_rows(spark, load):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    before, after = ({r["doc_id"]: r["shard"] for r in bounded_ring(docs, shards=n, load=load).collect()} for n in (16, 17))
    moved = [i for i in before if before[i] != after[i]]
    into_new = sum(after[i] == 16 for i in before)
    assert into_new and len(moved) <= 3 * len(before) / 17


def test_allow_listed_windows_leave_the_rest_of_a_run(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices(ALPHABET, k=n))
    a, b, path = key(74), key(74), key(37)
    texts = [a + "xxxx" + b, "/sample/" + path, path * 3, "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "abcdefghijklmnopqrstuvwxyz_-abcdefghi"]
    pattern = re.compile("|".join(f"(?:{p})" for p in (x.replace("(?i)", "(?i:") + ")" if x.startswith("(?i)") else x for x in ALLOW)))

    def plain(text):
        spans, starts = [], [k for k in range(len(text) - 23) if plain_spans(text[k : k + 24]) and not pattern.search(text[k : k + 24])]
        for k in [] if pattern.fullmatch(text) else starts:
            if spans and spans[-1][1] >= k:
                spans[-1] = (spans[-1][0], k + 24)
            else:
                spans.append((k, k + 24))
        return spans

    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "entropy_base64"] for r in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    # windows on both sides of the listed word hold part of it, so they touch
    assert got[0] == [(0, 152)] and got[1][0][1] == 45 and got[2] and not got[3] and not got[4]
