"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import Scope, release, shared_table, ship, text_of
from adloom.llm.components import components
from adloom.llm.decontaminate import FACTORS
from adloom.llm.textbytes import mix, rows, word_hashes

#: A band holds sizes from its lower bound up to RATIO times as much.
RATIO = 1.5
#: Most documents, and most shingles, of one side of a tile, on average.
TILE, TILE_ITEMS = 512, 1 << 22
#: Most members of one side of a tile of signatures, on average.
SIGN_TILE = 4096
#: Counters of the frequency sketch: 16 MB, whatever the table's size; they travel in CHUNKS pieces.
SKETCH, CHUNKS = 1 << 22, 16
#: Bits of a filter over ids or keys: 16 MB, whatever the table's size.
BITS = 1 << 27
#: Rounds in which the nodes of a large cluster are tested against one other node each, before tiles.
ROUNDS = 4


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; of the whole sequence if it has fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(n, len(w))
    total = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        total += w[k : k + len(total)] * FACTORS[k % len(FACTORS)]
    return np.unique(mix(total))


@cache
def bands() -> list[int]:
    """Upper sizes of the bands."""
    uppers, low = [], 1
    while low < 1 << 40:
        uppers.append(max(low, math.floor(low * RATIO)))
        low = uppers[-1] + 1
    return uppers


def bands_of(size: int, percent: int) -> list[int]:
    """The band of a size, and the lower bands that hold sizes it may link to."""
    uppers = bands()
    band = own = next(i for i, high in enumerate(uppers) if size <= high)
    while band > 0 and 100 * uppers[band - 1] >= percent * size:
        band -= 1
    return list(range(band, own + 1))


def set_hashes(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """A hash of every set, whatever its order."""
    return np.array([mix(s ^ FACTORS[seed]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def parity(items: np.ndarray) -> bytes:
    """A bitmap of 1 to 2 bits an element (256 at least); each bit is the parity of the elements that hash to it.

    An element that only one of two sets has flips one bit, so bits that differ are no more than such elements. Halves of
    a bitmap, one upon the other, are the bitmap of half the width.
    """
    width = 1 << max(8, (len(items) - 1).bit_length())
    odd = np.bincount(((items >> np.uint64(24)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def plausible(sizes: np.ndarray, signs: list[bytes], sides: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a tile have another (of the other side, if there are two) that the parity bitmaps allow to link."""
    width = min(map(len, signs)) // 8
    bits = np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in signs])
    found = np.zeros(len(signs), bool)
    one_tile = bool((sides == sides[0]).all())
    for i in range(len(signs)):
        if found[i]:
            continue
        total = sizes + sizes[i]
        most = np.minimum((total - np.bitwise_count(bits ^ bits[i]).sum(1, dtype=np.int64)) // 2, np.minimum(sizes, sizes[i]))
        fits = (100 * most >= percent * (total - most)) & (one_tile | (sides != sides[i]))
        fits[i] = False
        if fits.any():
            found |= fits
            found[i] = True
    return found


def slots(items: np.ndarray) -> np.ndarray:
    """The counters of the sketch that elements add to."""
    return (items & np.uint64(SKETCH - 1)).astype(np.int64)


def prefix_keys(items: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: its rarest elements, once for each band of bands_of. The last six bits of a key are the band.

    Linked sets share at least percent of the larger one. Under one order of all elements, each set's first
    size - ceil(percent of size) + 1 elements then have one in common. The order is by the sketch's counter, then by hash:
    any counters keep this exact, and good ones put passages that many documents hold last.
    """
    size = len(items)
    first = items[np.argsort(sketch[slots(items)], kind="stable")[: size - -(-percent * size // 100) + 1]]
    bare = first >> np.uint64(6) << np.uint64(6)
    return np.concatenate([bare | np.uint64(band % 64) for band in bands_of(size, percent)])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on sorted arrays."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps, 16 to 32 bits an element of the largest set."""
    width = 1 << max(10, (32 * max(map(len, sets))).bit_length() - 1)
    out = np.zeros((len(sets), width // 64), np.uint64)
    for row, items in zip(out, sets, strict=True):
        bit = items & np.uint64(width - 1)
        np.bitwise_or.at(row, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    return out


def bound(own: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """What the overlaps are at most: a bit that only one side has stands for an element that only this side has."""
    mine = n - np.bitwise_count(own & ~others).sum(1, dtype=np.int64)
    theirs = sizes - np.bitwise_count(others & ~own).sum(1, dtype=np.int64)
    return np.minimum(mine, theirs)


def tile_links(nodes, labels, sides, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the labels of a pair of tiles: a spanning forest, not all pairs.

    Documents that already share a label are not compared. Sizes and bit counts come first; the sorted arrays decide.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, labels, sides, sizes = np.asarray(nodes)[order], np.asarray(labels)[order].copy(), np.asarray(sides)[order], sizes[order]
    sets = [sets[i] for i in order]
    bits = signatures(sets)
    one_tile = bool((sides == sides[0]).all())
    out = []
    for i in range(len(nodes) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
        rest = np.arange(i + 1, end)
        rest = rest[(labels[rest] != labels[i]) & (one_tile | (sides[rest] != sides[i]))]
        if not len(rest):
            continue
        most = bound(bits[i], bits[rest], sizes[i], sizes[rest])
        for j in rest[100 * most >= percent * (sizes[i] + sizes[rest] - most)]:
            if labels[i] != labels[j] and linked(sets[i], sets[j], percent):
                out.append((int(nodes[i]), int(nodes[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def packed_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with the hash of every value of the one column set. At most BITS / 64 rows reach the driver."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            h = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(BITS - 1)
            np.bitwise_or.at(words, h >> np.uint64(6), np.uint64(1) << (h & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(words_of, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (int64) may be in a packed filter."""
    h = mix(values.view(np.uint64)) & np.uint64(BITS - 1)
    return ((bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def merged_sketch(pieces: DataFrame, fan_in: int = 32) -> np.ndarray:
    """One sketch of all tasks' pieces (chunk, part, counts): merged by chunk in rounds of `fan_in`, so that no task holds
    more than that many pieces of one size. Counters stop at the largest 32-bit number."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // CHUNKS, np.uint64)
        for packed in group["counts"]:
            total += np.frombuffer(zlib.decompress(packed), np.uint32)
        counts = zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1].values, "part": group["part"].iloc[:1].values // fan_in, "counts": [counts]})

    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        pieces = pieces.groupBy("chunk", F.floor(F.col("part") / fan_in).alias("group")).applyInPandas(merge, "chunk int, part long, counts binary")
        parts = -(-parts // fan_in)
        if parts == 1:
            break
        pieces = shared_table(pieces, "sketch")
    sketch = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint32)
    for row in pieces.toArrow().to_pylist():
        sketch[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return sketch.reshape(-1)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two texts link when 100 * intersection >= percent * union over their sets of distinct n-word shingles (A-Z
    lower-cased; a text of fewer words is one shingle). component_id is the smallest doc_id reachable by links.

    Equal sets are one class with its smallest id as node, so copies are never keyed or paired. A first pass counts all
    shingles in a sketch of fixed size. A node's keys are its rarest shingles in every size band it may link in (see
    `prefix_keys`): every pair that can link shares one. Keys of one node, and keys with the members of another key, go, and so do
    members whose small parity bitmap allows a link to no other member of their key. Nodes that keys connect are a cluster; a cluster of up to TILE nodes is one tile. In a larger one, nodes are first
    tested against one other node each, in a few rounds, which turns a large group of near copies into stars. What is
    still apart is compared in pairs of tiles: over the cluster (the largest star's nodes only against the others), or
    over each of its keys if that ships less. In a tile bit counts of hashed bitmaps bound the overlap, sorted arrays
    decide, documents already linked are not compared, and only links that join components come out. Nothing is capped.

    Empty texts, null texts and texts without words have n_shingles 0 and link with nothing. A row without an id can't
    represent its class: it gets its class's component, null if no row of the class has an id. Rows that repeat an id
    count as one document for linking. An empty table gives an empty result; other columns are ignored.
    """
    same = ["n_shingles", "h1", "h2"]
    with Scope() as scope:
        sets, named = _linked_classes(docs, n, percent, scope)
    return (
        sets.where("n_shingles > 0").join(named, same).select("doc_id", "n_shingles", "component_id")
        .unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def _linked_classes(docs: DataFrame, n: int, percent: int, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (doc_id, n_shingles, h1, h2) and the component of every class of equal sets. The scope removes
    all other tables."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", F.encode(text_of(), "utf-8").alias("bytes"))

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "h1", "h2", "sign", "chunk", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        counts = np.zeros(SKETCH, np.int64)
        for part in rows(batches):
            found = [shingles(x, n) for x in part["bytes"]]
            sizes = np.array([len(s) for s in found], np.int64)
            at = slots(np.concatenate(found)) if found else np.zeros(0, np.int64)
            if len(at) > SKETCH // 8:
                counts += np.bincount(at, minlength=SKETCH)
            else:
                np.add.at(counts, at, 1)
            columns = [part["doc_id"], sizes, set_hashes(found, 1), set_hashes(found, 2), [parity(x) for x in found], [None] * len(sizes), [None] * len(sizes)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        packed = [zlib.compress(c.tobytes(), 1) for c in np.minimum(counts, (1 << 32) - 1).astype(np.uint32).reshape(CHUNKS, -1)]
        none = [None] * CHUNKS
        yield pa.record_batch([pa.array(c, t) for c, t in zip([none, none, none, none, none, range(CHUNKS), packed], types, strict=True)], names=names)

    passed = texts.mapInArrow(classes_of, "doc_id long, n_shingles long, h1 long, h2 long, sign binary, chunk int, counts binary")
    passed = scope.keep(shared_table(passed.withColumn("part", F.spark_partition_id().cast("long")), "sets"))
    sets = passed.where("chunk is null").select("doc_id", "n_shingles", "h1", "h2", "sign")
    same = ["n_shingles", "h1", "h2"]
    classes = shared_table(sets.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.where("node is not null").select("node").distinct()
    sketch = spark.sparkContext.broadcast(merged_sketch(passed.where("chunk is not null").select("chunk", "part", "counts")))
    named_texts = texts.where("doc_id is not null")

    node_bits = spark.sparkContext.broadcast(packed_filter(nodes))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows([batch.filter(pa.array(passes(node_bits.value, batch["doc_id"].to_numpy())))]):
                keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for doc_id, text in zip(part["doc_id"], part["bytes"], strict=True):
                    items = shingles(text, n)
                    if len(items):
                        keys.append(prefix_keys(items, sketch.value, percent))
                        ids.append(np.full(len(keys[-1]), doc_id, np.int64))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "node"])

    keyed = shared_table(named_texts.mapInArrow(keys_of, "key long, node long"), "keys")
    shared_keys = shared_table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    key_bits = spark.sparkContext.broadcast(packed_filter(shared_keys))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(key_bits.value, batch["key"].to_numpy())))

    # both filters may let others through; the joins after them are exact
    members = keyed.mapInArrow(shared_only, "key long, node long").join(shared_keys, "key", "left_semi").join(nodes, "node", "left_semi").distinct()
    members = shared_table(members, "members")
    release(keyed, shared_keys)
    # two similar documents share many keys; of keys with the same members one is enough
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    heads = (
        members.groupBy("key")
        .agg(F.min("node").alias("head"), F.count("*").alias("n"), mark(1).alias("m1"), mark(2).alias("m2"))
        .where("n > 1")
        .groupBy("n", "m1", "m2", "head")
        .agg(F.min("key").alias("key"))
        .select("key", "head")
    )
    buckets = shared_table(members.join(heads.select("key"), "key"), "buckets")
    release(members)
    # members stay with a key if their parity bitmap allows a link to another member; a hot key's members are dealt to
    # pairs of tiles
    tiles = F.ceil(F.col("n") / SIGN_TILE).cast("int")
    own = ["n_shingles", "h1", "h2"]
    signed = classes.where("node is not null").join(sets.where("doc_id is not null"), own).where("doc_id = node").groupBy("node").agg(F.min(F.struct("n_shingles", "sign")).alias("kept"))
    dealt = (
        buckets.join(buckets.groupBy("key").agg(F.count("*").alias("n")), "key")
        .withColumn("side", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        .select("key", "node", "side", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        .select("key", "node", "side", F.least("side", "other").alias("t1"), F.greatest("side", "other").alias("t2"))
        .join(signed, "node")
        .select("key", "t1", "t2", "node", "side", F.col("kept.n_shingles").alias("size"), "kept.sign")
        .repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    )

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in tiles, one after the other; the last tile of a batch may go on in the next."""
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            unit = np.stack([held[c].to_numpy().astype(np.int64) for c in ("key", "t1", "t2")])
            starts = np.flatnonzero(np.r_[True, (unit[:, 1:] != unit[:, :-1]).any(0)])
            ends = np.r_[starts[1:], held.num_rows]
            if batch is not None:
                starts, ends = starts[:-1], ends[:-1]
            sizes, sides, signs = held["size"].to_numpy(), held["side"].to_numpy(), held["sign"].to_pylist()
            keep = np.zeros(held.num_rows, bool)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    keep[a:b] = plausible(sizes[a:b], signs[a:b], sides[a:b], percent)
            yield held.filter(pa.array(keep)).select(["key", "node"])
            held = held.slice(int(ends[-1])) if len(ends) else held
            if batch is None:
                return

    members = shared_table(dealt.mapInArrow(allowed, "key long, node long").distinct(), "allowed")
    release(buckets)
    members = members.join(members.groupBy("key").agg(F.min("node").alias("head")), "key")
    wanted = shared_table(members.select("node").distinct(), "candidates")
    wanted_bits = spark.sparkContext.broadcast(packed_filter(wanted))

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows([batch.filter(pa.array(passes(wanted_bits.value, batch["doc_id"].to_numpy())))]):
                found = [shingles(x, n) for x in part["bytes"]]
                sizes = [len(x) for x in found]
                columns = [pa.array(part["doc_id"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(set_hashes(found, 1)), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.record_batch(columns, names=["node", "size", "h1", "items"])

    # where an id is repeated with other texts, the row with the class's set is the node; the ids come first, so that
    # sets move once
    own = classes.join(wanted, "node", "left_semi").select("node", F.col("n_shingles").alias("own_size"), F.col("h1").alias("own_h1"))
    items = named_texts.mapInArrow(items_of, "node long, size long, h1 long, items binary").join(own, "node").where("size = own_size and h1 = own_h1")
    items = shared_table(items.groupBy("node").agg(F.first("size").alias("size"), F.min("items").alias("items")), "items")
    sizes = items.select("node", "size")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            out = ([], [])
            for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    continue
                sign = signatures([x, y])
                most = bound(sign[0], sign[1:], len(x), np.array([len(y)]))[0]
                if 100 * most >= percent * (small + large - most) and linked(x, y, percent):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        found = tile_links(group["node"], group["label"], group["side"], [np.frombuffer(x, np.uint64) for x in group["items"]], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spokes = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    clusters = components(spokes).withColumnRenamed("component", "cluster").join(sizes, "node")
    measured = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    clusters = shared_table(clusters.join(measured, "cluster"), "clusters")
    is_small = (F.col("m") <= TILE) & (F.col("total") <= TILE_ITEMS)

    small = (
        clusters.where(is_small).join(items.drop("size"), "node")
        .select("cluster", "node", F.col("node").alias("label"), F.lit(0).alias("side"), "items")
        .groupBy("cluster").applyInPandas(tile, "a long, b long")
    )
    links = shared_table(small, "small-links")
    large = shared_table(clusters.where(~is_small).select("cluster", "node", "size"), "large")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, members, items, test, tile))
    labels = components(links)
    named = scope.keep(shared_table(classes.join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id")), "named"))
    return sets, named


def _large_links(large: DataFrame, members: DataFrame, items: DataFrame, test, tile) -> DataFrame:
    """Links of the clusters that are no single tile: rounds of stars, then tiles. large: cluster, node, size."""
    labels = large.select("node", F.col("node").alias("label"))
    inside = shared_table(members.join(large.select("node"), "node", "left_semi").select("key", "node"), "large-members")
    links = None
    for turn in range(ROUNDS):
        labelled = inside.join(labels, "node")
        order = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")
        end = F.struct(order.alias("order"), "node", "label")
        ends = labelled.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high")).where("low.label <> high.label")
        other = F.when(F.col("low.label") == F.col("label"), F.col("high")).otherwise(F.col("low"))
        pairs = labelled.join(ends, "key").select("node", other.alias("other")).groupBy("node").agg(F.min("other")["node"].alias("a"))
        tested = (
            pairs.select("a", F.col("node").alias("b"))
            .join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(test, "a long, b long")
        )
        found = shared_table(tested, "star")
        links = found if links is None else links.unionByName(found)
        new = components(links).withColumnRenamed("component", "label")
        before = labels.select("label").distinct().count()
        labels = shared_table(large.select("node").join(new, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "star-labels")
        if labels.select("label").distinct().count() > 0.8 * before:
            break
    labelled = large.join(labels, "node")
    # the largest label of a cluster is side B: its nodes are compared with the others, never among themselves
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    top = F.max(F.struct("m", "label", "total"))
    tiles = lambda m, total: F.greatest(F.ceil(m / TILE), F.ceil(total / TILE_ITEMS)).cast("int")
    shape = by_label.groupBy("cluster").agg(top.alias("top"), F.sum("m").alias("m"), F.sum("total").alias("total")).where("m > top.m")
    shape = shape.select(
        "cluster", F.col("top.label").alias("top"), "m", F.col("top.m").alias("m_top"),
        tiles(F.col("m") - F.col("top.m"), F.col("total") - F.col("top.total")).alias("t_rest"), tiles(F.col("top.m"), F.col("top.total")).alias("t_top"),
    )
    labelled = shared_table(labelled.join(shape, "cluster"), "labelled")
    split_keys = (
        inside.join(labelled, "node")
        .groupBy("key", "cluster")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"))
        .where("low <> high")
        .withColumn("tiles", tiles(F.col("n"), F.col("total")))
    )
    split_keys = shared_table(split_keys, "split-keys")
    # a cluster is compared as a whole or by its keys, whichever ships fewer rows
    whole_rows = (F.col("m") - F.col("m_top")) * (F.col("t_rest") + F.col("t_top")) + F.col("m_top") * F.col("t_rest")
    ships = split_keys.groupBy("cluster").agg(F.sum(F.col("n") * F.col("tiles")).alias("by_keys"))
    choice = shared_table(shape.select("cluster", whole_rows.alias("whole")).join(ships, "cluster").select("cluster", (F.col("by_keys") < F.col("whole")).alias("by_key")), "choice")

    def side(first: Column, count: Column) -> Column:
        return first + F.pmod(F.xxhash64("node"), count).cast("int")

    is_top = F.col("label") == F.col("top")
    whole = labelled.join(choice.where("not by_key"), "cluster").select(
        F.lit(0).alias("kind"), F.col("cluster").alias("unit"), "node", "label",
        F.when(is_top, side(F.col("t_rest"), F.col("t_top"))).otherwise(side(F.lit(0), F.col("t_rest"))).alias("side"),
        F.when(is_top, F.col("t_rest")).otherwise(F.col("t_rest") + F.col("t_top")).alias("others"),
    )
    keys = split_keys.join(choice.where("by_key"), "cluster").select("key", "tiles")
    parts = inside.join(keys, "key").join(labelled.select("node", "label"), "node").select(
        F.lit(1).alias("kind"), F.col("key").alias("unit"), "node", "label", side(F.lit(0), F.col("tiles")).alias("side"), F.col("tiles").alias("others")
    )
    spread = (
        whole.unionByName(parts)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .select("kind", "unit", "node", "label", "side", F.least("side", "other").alias("t1"), F.greatest("side", "other").alias("t2"))
    )
    rest = spread.join(items.drop("size"), "node").groupBy("kind", "unit", "t1", "t2").applyInPandas(tile, "a long, b long")
    return links.unionByName(shared_table(rest.distinct(), "tile-links"))
