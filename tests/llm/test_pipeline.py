"""The stages of the pipeline against plain rules on a small corpus."""

import random

import brute

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n)) + "."
    bench = [text(30) for _ in range(4)]
    good = {i: text(90) for i in range(120)}
    copies = {200 + i: good[i] + " one more" for i in range(10)}
    leaks = {300 + i: text(30) + " " + bench[i] + " " + text(20) for i in range(4)}
    junk = {400 + i: "BUY!! NOW!! " * 40 for i in range(30)} | {500 + i: "| x | y " * 50 for i in range(30)}
    rows = good | copies | leaks | junk
    made = [(i, x, "en", f"s{i % 3}", len(x)) for i, x in rows.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, columns, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), None, {}
    for name, stage in P.STAGES:
        columns = columns or docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "shard" or docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("quality") == set(rows) - set(junk)
    left = {i: rows[i] for i in ids("quality")}
    firsts = {i for i, (_, c) in brute.components(list(left.items()), 5, 80).items() if i == c}
    assert ids("near_duplicates") == firsts == set(good) | set(leaks)
    assert ids("decontaminate") == set(good)
    words = {}
    for r in seen["decontaminate"]:
        words[r["source"]] = words.get(r["source"], 0) + len(brute.words(r["text"]))
    taken = {}
    for r in seen["mix"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.words(r["text"]))
    for source, goal in brute.targets(words).items():
        assert abs(taken[source] - goal) <= 0.35 * goal
    counts = {}
    for r in seen["shard"]:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert len(seen["shard"]) == len(seen["mix"]) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted(r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in seen["shard"])


CLASHING = ("row", "row_id", "times", "size", "taken", "component_id", "n_shingles", "score", "kept", "node", "key", "bytes", "item_id", "shard", "slot", "value")


def odd_tables(spark, path, rows):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    made = [(*r, *CLASHING) for r in rows]
    spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_null_empty_repeated_and_clashing_rows(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    long = text(20_000)
    leak = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, text(40), "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \n\t", "en", "s0", 0), (53, long, "en", "s0", 1), (54, long, "en", None, 1), (None, text(30), "en", "s1", 1), (None, None, None, None, None)]
    rows += [(60, leak, "en", "s1", 1), (None, "before " + leak + " after", "en", "s1", 1), (7, rows[7][1], "en", "s1", 1), (61, "w", "en", "s1", 1)]
    docs = odd_tables(spark, tmp_path, rows)
    kept = {name: stage(spark, docs, str(tmp_path)) for name, stage in P.STAGES}
    assert all(kept[name].columns == docs.columns for name, _ in P.STAGES[:-1])
    got = {name: [(r["doc_id"], r["text"]) for r in kept[name].collect()] for name, _ in P.STAGES[:-1]}
    given = [(r[0], r[1]) for r in rows]
    assert set(got["quality"]) <= set(given)
    # of two equal long texts the one with the smaller id stays; rows without an id and without words all stay
    assert sorted(map(str, got["near_duplicates"])) == sorted(map(str, [r for r in given if r[0] != 54]))
    # the item's text goes, but not where the row has no id
    assert sorted(map(str, got["decontaminate"])) == sorted(map(str, [r for r in given if r[0] != 60]))
    assert set(map(str, got["mix"])) <= set(map(str, given)) and all(str(r) in set(map(str, got["mix"])) for r in given if r[0] in (50, 51, 52, None))
    placed = kept["shard"].collect()
    assert len(placed) == len(rows) and {r["shard"] for r in placed} <= set(range(16))
    assert all(r["size"] == 1 for r in placed if r["doc_id"] in (50, 51))


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [])
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    some = spark.createDataFrame([(1, "a text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        # two words are less than one block of the mix
        assert stage(spark, some, f"{tmp_path}/none").count() == (0 if name == "mix" else 1)
