"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import shared_table, ship, text_of
from adloom.llm.textbytes import BARE_WORDS, arrays, mix, rows, word_hashes

#: Offsets of the tokens that a seed looks at; the others are ignored. Spans of 6 to 12 tokens, weight 6.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 6, 9), (0, 1, 2, 5, 7, 8), (0, 3, 4, 7, 10, 11))
SPAN = max(m[-1] for m in MASKS) + 1
#: Bits of the benchmark filter, and words of 64 bits in one of its slices: 16 MB in all, whatever the tables' sizes.
BITS, SLICE = 1 << 27, 1 << 10
#: Tokens kept on both sides of a hit for verification.
REACH = 64
#: An item of fewer tokens says nothing inside a longer text; it counts only as a whole text.
ALONE = 4
#: Places of one seed in a cell of the join.
HOT = 256
FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words: A-Z lower-cased, ASCII punctuation dropped."""
    return word_hashes(text, BARE_WORDS)


def seeds(t: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of every placement of a mask."""
    n = len(t) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for k, offset in enumerate(mask):
        total += t[offset : offset + n] * FACTORS[k]
    return mix(total)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of a seed."""
    return h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)


def item_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for an item of n tokens: all that fit, or, for one shorter than every mask, the whole item."""
    return [m for m in MASKS if m[-1] < n] or [tuple(range(n))] * (n > 0)


def doc_masks(n: int, short: list[int]) -> list[tuple[int, ...]]:
    """Masks for a document of n tokens; `short` are the lengths of the items that are shorter than every mask.

    An item of fewer than ALONE tokens is found only where the document has no other tokens.
    """
    return [*MASKS, *(tuple(range(k)) for k in short if k >= ALONE or k == n)]


def placed_seeds(t: np.ndarray, mask: tuple[int, ...], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Every placement's seed, and the seed one token before it (`first` at the start)."""
    h = seeds(t, mask)
    return h, np.concatenate([np.array([first], np.uint64), h[:-1]])[: len(h)]


def verify(doc: np.ndarray, item: np.ndarray, shift: int, share: float, min_match: int) -> tuple[int, int, int] | None:
    """The best overlap of an alignment (item token i at doc token shift + i): start and end in the item, and matches.

    An overlap counts when it matches min_match tokens, or four fifths of a short item, and `share` of its length. From
    every matching token an overlap grows both ways while matches (+1) outweigh substitutions (-2); of those that count,
    the one with most matches is taken. Where none counts, it is the stretch with most matches that has `share` at all,
    so that substitutions near an edge do not hide a passage.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if lo >= hi:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    at = np.flatnonzero(same)
    need = min(min_match, int(np.ceil(share * len(item))))
    if len(at) < max(need, 1):
        return None
    matches = np.concatenate([[0], np.cumsum(same)])
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    # ends are first maxima of the score to the right, starts last minima to the left
    peaks = np.flatnonzero(score == np.maximum.accumulate(score[::-1])[::-1])
    lows = np.flatnonzero(score == np.minimum.accumulate(score))
    end, start = peaks[np.searchsorted(peaks, at + 1)], lows[np.searchsorted(lows, at, "right") - 1]
    matched = matches[end] - matches[start]
    counts = (matched >= need) & (matched >= share * (end - start))
    if not counts.any():
        # from each match to the farthest end before which at least `share` of the tokens match
        spare = matches - share * np.arange(len(matches))
        ahead = np.maximum.accumulate(spare[::-1])[::-1]
        start, end = at, np.searchsorted(-ahead, 1e-9 - spare[at], "right") - 1
        end = at[np.searchsorted(at, end) - 1] + 1
        matched = matches[end] - matches[start]
        counts = matched >= need
        if not counts.any():
            return None
    k = int(np.where(counts, matched, -1).argmax())
    return int(start[k]) + lo, int(end[k]) + lo, int(matched[k])


def overlap_tables(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, min_match: int = 12) -> tuple[DataFrame, DataFrame]:
    """The overlaps of documents with passages of benchmark items, and the items of each passage.

    Overlaps, one row per document and passage (the item's tokens in the overlap): doc_id, item_id (the smallest that has
    the passage there), n_items, passage, doc_start, doc_end, item_start, item_end, n_matched, item_tokens. Where a
    document holds a passage several times, the row is that with most matches, then most items, then the first.
    Items of passages: passage, item_id.

    Items of equal tokens are one class. Spaced seeds of the classes set two bits each in a filter of fixed size, which
    is broadcast. A map over the documents keeps the seeds that pass, with the tokens around them; equal stretches are
    one class too, so copies are matched once. A shuffle join with the benchmark's seeds makes them hits, and each
    alignment is verified token by token. Substituted words are tolerated: a mask ignores some positions, and the
    verification counts matches.

    Neighbouring hits of one alignment differ from their predecessors' only by a token, so every seed carries the one
    before it, and only the first hit of a row of hits makes a pair. A seed whose places all have the document's
    predecessor makes none, so the inside of a passage that many items share costs one look-up a place. What such a
    passage still brings together, at its edges, is dealt over cells of at most HOT places.

    Items of fewer than ALONE tokens count only where a document has no other tokens; an item without tokens never.
    Null texts have no tokens. Rows without an id take no part. Repeated rows give one row per id and passage; an item id
    that repeats with other texts stands for all of them. Either
    table empty gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            found = [tokens(text).view(np.int64) for text in part["bytes"]]
            yield pa.record_batch([pa.array(part["item_id"], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "item"])

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for item_id, t in zip(batch["item_id"].to_numpy(), arrays(batch["item"]), strict=True):
                for mask in item_masks(len(t)):
                    h, before = placed_seeds(t.view(np.uint64), mask, 1)
                    for column, value in zip(out, (np.full(len(h), item_id), h.view(np.int64), before.view(np.int64), np.arange(len(h))), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["item_id", "seed", "item_before", "item_at"])

    items = benchmark.where("item_id is not null").select("item_id", F.encode(text_of(), "utf-8").alias("bytes"))
    every_item = shared_table(items.mapInArrow(item_tokens, "item_id long, item array<long>").distinct(), "items")
    classes = shared_table(every_item.groupBy("item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")), "item-classes")
    known = shared_table(classes.mapInArrow(item_seeds, "item_id long, seed long, item_before long, item_at long"), "seeds")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's part of the filter, as the words that are not zero."""
        words = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            h = batch["seed"].to_numpy().view(np.uint64)
            for p in places(h):
                np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    # at most BITS / 64 rows reach the driver
    filled = known.select("seed").mapInArrow(slices, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    short = sorted(r[0] for r in classes.select(F.size("item").alias("n")).where(f"n between 1 and {min(m[-1] for m in MASKS)}").distinct().collect())
    shared = spark.sparkContext.broadcast(bits)

    def doc_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of a document around seeds that pass the filter; seeds close together share a window."""
        bits = shared.value
        for part in rows(batches):
            out = {k: [] for k in ("doc_id", "doc_at", "window", "seeds", "befores", "spots")}
            for doc_id, text in zip(part["doc_id"], part["bytes"], strict=True):
                t = tokens(text)
                found = []
                for mask in doc_masks(len(t), short):
                    h, before = placed_seeds(t, mask, 0)
                    a, b = places(h)
                    one = np.uint64(1)
                    hit = (bits[a >> np.uint64(6)] >> (a & np.uint64(63))) & (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & one
                    spots = np.flatnonzero(hit)
                    found.append((spots, h[spots], before[spots]))
                spots, values, befores = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(spots):
                    continue
                order = np.argsort(spots, kind="stable")
                spots, values, befores = spots[order], values[order].view(np.int64), befores[order].view(np.int64)
                for group in np.split(np.arange(len(spots)), np.flatnonzero(np.diff(spots) > REACH) + 1):
                    lo = max(0, int(spots[group[0]]) - REACH)
                    hi = int(spots[group[-1]]) + SPAN + REACH
                    for column, value in zip(out.values(), (doc_id, lo, t[lo:hi].view(np.int64), values[group], befores[group], spots[group] - lo), strict=True):
                        column.append(value)
            longs = pa.list_(pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), longs, longs, longs, longs), strict=True)], names=list(out))

    texts = docs.where("doc_id is not null").select("doc_id", F.encode(text_of(), "utf-8").alias("bytes"))
    longs = "array<long>"
    windows = texts.mapInArrow(doc_hits, f"doc_id long, doc_at long, window {longs}, seeds {longs}, befores {longs}, spots {longs}")
    # two hashes of all that the matching sees name a class of windows
    seen = ("window", "seeds", "befores", "spots")
    windows = shared_table(windows.withColumns({"h1": F.xxhash64(*seen), "h2": F.xxhash64(F.lit(1), *seen)}), "windows")
    name = ["h1", "h2"]
    distinct = windows.select(*name, *seen).dropDuplicates(name)

    hits = distinct.select(*name, F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("befores").alias("before"), F.col("spots").alias("spot"))))
    cells = F.ceil(F.count("*") / HOT).cast("int").alias("cells")
    befores = known.groupBy("seed").agg(cells, F.min("item_before").alias("low"), F.max("item_before").alias("high"))
    first = hits.join(befores, "seed").where("not (low = before and high = before)")
    first = first.select(*name, "seed", "before", "spot", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    dealt = known.join(befores.select("seed", "cells"), "seed").withColumn("cell", F.pmod(F.xxhash64("item_id", "item_at"), F.col("cells")).cast("int"))
    # an alignment is verified over its whole length, so one row stands for all its hits
    aligned = first.join(dealt, ["seed", "cell"]).where("before <> item_before")
    aligned = aligned.select(*name, "item_id", (F.col("spot") - F.col("item_at")).alias("shift")).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ("h1", "h2", "item_id", "copies")
        for batch in batches:
            given = [batch[c].to_numpy() for c in kept]
            out = [[] for _ in range(len(kept) + 7)]
            for k, (doc, item, shift) in enumerate(zip(arrays(batch["window"]), arrays(batch["item"]), batch["shift"].to_pylist(), strict=True)):
                best = verify(doc, item, shift, share, min_match)
                if best:
                    start, end, matched = best
                    passage = int.from_bytes(blake2b(item[start:end].tobytes(), digest_size=8).digest(), "little", signed=True)
                    values = (*(g[k] for g in given), passage, shift + start, shift + end, start, end, matched, len(item))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            names = [*kept, "passage", "doc_start", "doc_end", "item_start", "item_end", "n_matched", "item_tokens"]
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out], names=names)

    places_of = ["doc_start", "doc_end", "item_start", "item_end", "item_tokens"]
    fields = ", ".join(f"{c} long" for c in [*name, "item_id", "copies", "passage", *places_of[:4], "n_matched", "item_tokens"])
    found = (
        aligned.join(distinct.select(*name, "window"), name)
        .join(classes, "item_id")
        .select(*name, "item_id", "copies", "shift", "window", "item")
        .mapInArrow(check, fields)
    )
    # the best alignment of a stretch and an item class, then the classes that share a passage
    rank = lambda *more: F.max(F.struct("n_matched", *more, *[(-F.col(c)).alias(c) for c in places_of], F.col("passage").alias("same"))).alias("best")
    best = [(-F.col(f"best.{c}")).alias(c) for c in places_of]
    pairs = found.groupBy(*name, "item_id", "copies").agg(rank()).select(*name, "item_id", "copies", "best.n_matched", *best, F.col("best.same").alias("passage"))
    pairs = shared_table(pairs, "pairs")
    held = pairs.groupBy(*name, "passage").agg(
        F.min("item_id").alias("item_id"), F.sum("copies").alias("n_items"), F.min_by(F.struct("n_matched", *places_of), "item_id").alias("at")
    )
    held = held.select(*name, "passage", "item_id", "n_items", "at.*")
    owned = windows.select("doc_id", "doc_at", *name).join(held, name)
    owned = owned.withColumns({c: F.col(c) + F.col("doc_at") for c in places_of[:2]})
    top = rank("n_items", (-F.col("item_id")).alias("item_id"))
    overlaps = owned.groupBy("doc_id", "passage").agg(top)
    overlaps = overlaps.select("doc_id", (-F.col("best.item_id")).alias("item_id"), "best.n_items", "passage", *best[:4], "best.n_matched", best[4])
    members = pairs.select("passage", "item_id").distinct().join(classes.select("item_id", "item"), "item_id")
    members = members.select("passage", "item").join(every_item, "item").select("passage", "item_id").distinct()
    return overlaps, members


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, min_match: int = 12) -> DataFrame:
    """The overlaps of overlap_tables()."""
    return overlap_tables(docs, benchmark, share, min_match)[0]
