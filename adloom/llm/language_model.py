"""LM scoring: a context tree over binary-decomposed bytes, beside a word-frequency base score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import release, shared_table, ship, text_of
from adloom.llm.textbytes import mix, rows

#: Bytes of context at most.
DEPTH = 5
#: Contexts of a model that is bounded on demand: the most frequent ones (512 bytes each). None: every context that occurs.
FEWEST: int | None = None
#: Ends a text in the model; the byte never occurs in UTF-8.
END = b"\xff"
#: Bytes of text whose contexts a task sorts at once, and bytes of text of a chunk on average, which asks for a cell once.
TRAIN_CHUNK, CHUNK = 4 << 20, 16 << 20
#: Texts of less than CHUNK for each core make smaller chunks, so that all cores work; no smaller than this.
LEAST_CHUNK = 1 << 20
#: Contexts of this depth are the stems: all longer contexts of a stem meet in a task; shorter ones are so few that they are broadcast.
STEM = 3
#: Cells that a task weighs at once, if that is more than one stem's.
STEM_CELLS = 1 << 18
#: Words whose counts are broadcast; all other words are looked up by a join.
FREQUENT = 200_000


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, next bytes and starts of all texts in one row of arrays, each text with its end.

    A context is the last DEPTH bytes as one number, the nearest byte on top, so that the last d bytes are its top d bytes.
    Before a text stand zeros.
    """
    gap = bytes(DEPTH)
    data = np.frombuffer(gap + (END + gap).join(texts) + END, np.uint8)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(texts)) + 1) * DEPTH, sizes)
    context = np.zeros(len(data), np.uint64)
    for k in range(1, DEPTH + 1):
        context[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * (DEPTH - k))
    return context[at], data[at], starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0: Stirling's series, moved up by 8."""
    y = x + 8.0
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def bit_counts(counts: np.ndarray) -> np.ndarray:
    """n x 256 counts of next bytes -> n x 255 x 2 counts at the binary nodes of a byte, level by level."""
    n = len(counts)
    return np.concatenate([counts.reshape(n, 1 << k, 2, 128 >> k).sum(-1) for k in range(8)], axis=1)


def ones(own: np.ndarray) -> np.ndarray:
    return (own[..., 1] + 0.5) / (own[..., 0] + own[..., 1] + 1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """n x 255 probabilities of a one -> n x 256 log10 probabilities of a byte."""
    one = np.clip(one, 1e-9, 1 - 1e-9)
    logs, total = np.log10(np.stack([1 - one, one], -1)), np.zeros((len(one), 256))
    for k in range(8):
        level = logs[:, (1 << k) - 1 : (2 << k) - 1].reshape(len(one), 2 << k)
        total += np.repeat(level, 128 >> k, axis=1)
    return total


class Branch:
    """The tree below one nearest byte, as one array of contexts for each depth.

    A context's children are the kept contexts one byte longer; all others that occur are one more child, the rest. A
    node's weighted probability is half its own KT estimate and half the product of its children's.
    """

    def __init__(self, contexts: list[np.ndarray], counts: list[np.ndarray]):
        """contexts[d]: sorted numbers of depth d + 1; counts[d]: their n x 256 counts."""
        self.contexts, self.own, self.rest, self.parent, self.share = contexts, [bit_counts(c) for c in counts], [], [], []
        for d, known in enumerate(contexts):
            self.parent.append(np.searchsorted(contexts[d - 1], known >> np.uint64(8)) if d else np.zeros(len(known), np.int64))
        below = None
        for d in reversed(range(len(contexts))):
            rest, inner = self.own[d].copy(), np.zeros(self.own[d].shape[:2])
            if below is not None:
                np.subtract.at(rest, self.parent[d + 1], self.own[d + 1])
                np.add.at(inner, self.parent[d + 1], below)
            leaf = ~np.isin(np.arange(len(rest)), self.parent[d + 1]) if below is not None else np.ones(len(rest), bool)
            kt = log_kt(self.own[d][..., 0], self.own[d][..., 1])
            inner += log_kt(rest[..., 0], rest[..., 1])
            inner[leaf] = kt[leaf]
            self.rest.insert(0, rest)
            self.share.insert(0, np.where(leaf[:, None], 1.0, 1 / (1 + np.exp(np.clip(inner - kt, -700, 700)))))
            below = np.where(leaf[:, None], kt, np.logaddexp(kt, inner) - np.log(2))
        self.weighted = below.sum(0)

    def rows(self, share0: np.ndarray, one0: np.ndarray) -> list[np.ndarray]:
        """Per depth: log10 probabilities of the next byte after each context whose next longer one is not kept.

        From the root down, a node's estimate takes its share of what is left. Where the longer context never met a
        binary node, the shorter one takes all that is left.
        """
        out = []
        for d, own in enumerate(self.own):
            up = self.parent[d]
            if d == 0:
                done, left, share, one = np.zeros(own.shape[:2]), np.ones(own.shape[:2]), share0[None], one0[None]
            else:
                done, left, share, one = done[up], left[up], self.share[d - 1][up], ones(self.own[d - 1])[up]
            met = own.sum(-1) > 0
            part = np.where(met, share, 1.0)
            done, left = done + left * part * one, left * (1 - part)
            rest, mine = self.rest[d], ones(own)
            tail = np.where(rest.sum(-1) > 0, self.share[d] * mine + (1 - self.share[d]) * ones(rest), mine)
            out.append(byte_logs(done + left * tail))
        return out


def tree_model(depth: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (see lookup_key) and rows of log10 probabilities (float16) of all kept contexts; row 0 is the root.

    depth, context, byte, n: counts of the kept contexts; every shorter form of a kept context is kept. Branches are
    weighted one after the other, so memory is bounded by the largest.
    """
    near = context >> (8 * np.maximum(depth, 1) - 8).astype(np.uint64)
    order = np.lexsort((byte, context, depth, near))
    root = np.zeros((1, 256))
    root[0, byte[depth == 0]] = n[depth == 0]
    order = order[depth[order] > 0]
    near, depth, context, byte, n = near[order], depth[order], context[order], byte[order], n[order]

    def branch(c: int) -> Branch:
        known, counts = [], []
        lo, hi = np.searchsorted(near, (c, c + np.uint64(1)))
        for d in range(1, DEPTH + 1):
            a, b = lo + np.searchsorted(depth[lo:hi], (d, d + 1))
            keys, at = np.unique(context[a:b], return_inverse=True)
            if not len(keys):
                break
            dense = np.zeros((len(keys), 256))
            dense[at, byte[a:b]] = n[a:b]
            known.append(keys)
            counts.append(dense)
        return Branch(known, counts)

    heads = np.unique(near)
    own0 = bit_counts(root)[0]
    rest0, inner = own0.copy(), np.zeros(255)
    for c in heads:
        b = branch(c)
        inner += b.weighted
        rest0 -= b.own[0].sum(0)
    kt0 = log_kt(own0[:, 0], own0[:, 1])
    inner += log_kt(rest0[:, 0], rest0[:, 1])
    share0, one0 = 1 / (1 + np.exp(np.clip(inner - kt0, -700, 700))), ones(own0)
    if not len(heads):
        share0 = np.ones(255)
    tail = np.where(rest0.sum(-1) > 0, share0 * one0 + (1 - share0) * ones(rest0), one0)
    keys, out = [np.zeros(1, np.uint64)], [byte_logs(tail[None]).astype(np.float16)]
    for c in heads:
        b = branch(c)
        for d, made in enumerate(b.rows(share0, one0), 1):
            keys.append(lookup_key(b.contexts[d - 1], d))
            out.append(made.astype(np.float16))
    return np.concatenate(keys), np.concatenate(out)


def lookup_key(context: np.ndarray, depth: int) -> np.ndarray:
    """A context of some depth as one number."""
    return context << np.uint64(8) | np.uint64(depth)


def lookup_tables(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Hash tables (key, row) without chains: keys whose slot is taken go to the next table, by another hash."""
    tables, rows = [], np.arange(len(keys))
    while len(rows):
        bits = max(8, int(len(rows)).bit_length() + 2)
        slot = mix(keys[rows] + np.uint64(len(tables))) >> np.uint64(64 - bits)
        table, row = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.int32)
        table[slot], row[slot] = keys[rows], rows
        tables.append((table, row, bits))
        rows = rows[table[slot] != keys[rows]]
    return tables


def context_rows(context: np.ndarray, tables) -> np.ndarray:
    """The row of the longest kept context at every position."""
    found = np.zeros(len(context), np.int32)
    open_ = np.arange(len(context))
    for d in range(DEPTH, 0, -1):
        key = lookup_key(context[open_] >> np.uint64(8 * (DEPTH - d)), d)
        hit = np.zeros(len(open_), bool)
        for t, (table, row, bits) in enumerate(tables):
            slot = mix(key + np.uint64(t)) >> np.uint64(64 - bits)
            here = table[slot] == key
            found[open_[here]] = row[slot[here]]
            hit |= here
        open_ = open_[~hit]
        if not len(open_):
            break
    return found


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def to_chunks(docs: DataFrame, held_out_of: int, n: int) -> DataFrame:
    """All texts: chunk (below n), rid, doc_id, held_out, bytes.

    A row's chunk comes from its id and text alone, so that the texts need not be stored: whoever reads them again finds the same
    chunks, in whatever order the rows come. rid tells rows apart within one reading only.
    """
    data = F.encode(text_of(), "utf-8")
    return docs.select(
        F.pmod(F.xxhash64("doc_id", data), F.lit(n)).cast("int").alias("chunk"),
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        (bucket(F.col("doc_id"), held_out_of) == 0).alias("held_out"),
        data.alias("bytes"),
    )


def gather(texts: DataFrame) -> DataFrame:
    """What the chunks' texts hold, each chunk being a partition of its own: training words (word, n) and, once a chunk, every cell
    (context << 8 | next byte) with its count in training texts, which may be 0. Of a chunk that is far larger than the others,
    cells come more than once."""
    types = {"chunk": pa.int32(), "word": pa.binary(), "cell": pa.int64(), "n": pa.int64()}

    def made(size: int, **given) -> pa.RecordBatch:
        return pa.record_batch([pa.array(given[k], t) if k in given else pa.nulls(size, t) for k, t in types.items()], names=list(types))

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.add.reduceat(n, starts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts, held, runs, chunk, size = [], 0, [], None, 0

        def sort_part():
            # the lowest bit says that the text is held out
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            runs.append(summed(keys >> np.uint64(1), np.where(keys & np.uint64(1), 0, n)))
            parts.clear()

        def flush_cells():
            if parts:
                sort_part()
            cells, n = np.concatenate([c for c, _ in runs]), np.concatenate([n for _, n in runs])
            order = np.argsort(cells, kind="stable")
            cells, n = summed(cells[order], n[order])
            runs.clear()
            for i in range(0, len(cells), 1 << 18):
                part = cells[i : i + (1 << 18)]
                yield made(len(part), chunk=np.full(len(part), chunk, np.int32), cell=part.view(np.int64), n=n[i : i + (1 << 18)])

        for part in rows(batches):
            chunk = part["chunk"][0]
            for text, out in zip(part["bytes"], part["held_out"], strict=True):
                if not out:
                    words.update(text.lower().split())
            context, byte, starts = joined(part["bytes"])
            out = np.repeat(np.array(part["held_out"], np.uint64), np.diff(np.r_[starts, len(byte)]))
            parts.append((context << np.uint64(8) | byte) << np.uint64(1) | out)
            held, size = held + len(byte), size + len(byte)
            if held >= TRAIN_CHUNK:
                held = 0
                sort_part()
            if size >= 2 * CHUNK:
                yield from flush_cells()
                size, held = 0, 0
            if len(words) > 300_000:
                yield made(len(words), word=list(words), n=list(words.values()))
                words.clear()
        if size:
            yield from flush_cells()
        if words:
            yield made(len(words), word=list(words), n=list(words.values()))

    return texts.select("chunk", "held_out", "bytes").mapInArrow(count, "chunk int, word binary, cell long, n long")


def by_stem(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted cells and their counts, in pieces of whole stems."""
    shift = np.uint64(8 * (DEPTH - STEM + 1))
    cells, counts, size = [], [], 0
    for batch in batches:
        cells.append(batch.column("cell").to_numpy().astype(np.uint64))
        counts.append(batch.column("n").to_numpy().astype(np.float64))
        size += batch.num_rows
        if size >= STEM_CELLS:
            every, n = np.concatenate(cells), np.concatenate(counts)
            cut = np.searchsorted(every, every[-1] >> shift << shift)
            if cut:
                yield every[:cut], n[:cut]
            cells, counts, size = [every[cut:]], [n[cut:]], len(every) - cut
    if size:
        yield np.concatenate(cells), np.concatenate(counts)


class Level:
    """The nodes of one bit of a byte (k bits above it) below some stems: per depth, from DEPTH up to STEM, sorted keys
    (context << k | bits above), counts of zeros and ones and the nodes' own share against their longer contexts."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, k: int):
        """cells: sorted, each with a count above 0."""
        self.k, self.keys, self.own, self.share = k, {}, {}, {}
        bit = (cells >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
        keys = cells >> np.uint64(8 - k)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, own = keys[starts], [np.add.reduceat(n * x, starts) if len(starts) else np.zeros(0) for x in (1 - bit, bit)]
        self.weighted = log_kt(*own)
        self.keys[DEPTH], self.own[DEPTH] = keys, own
        for d in range(DEPTH - 1, STEM - 1, -1):
            keys, own, inner = self.above()
            self.weighted, self.share[d] = weigh(own, inner)
            self.keys[d], self.own[d] = keys, own

    def above(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Keys, counts and sums of weighted logs of the next shorter contexts."""
        d = min(self.keys)
        keys, at = np.unique(shorter(self.keys[d], 1, self.k), return_inverse=True)
        return keys, [np.bincount(at, x, len(keys)) for x in self.own[d]], np.bincount(at, self.weighted, len(keys))


def shorter(keys: np.ndarray, by: int, k: int) -> np.ndarray:
    """The keys (context << k | k bits) of the contexts that are `by` bytes shorter."""
    return keys >> np.uint64(k + 8 * by) << np.uint64(k) | keys & np.uint64((1 << k) - 1)


def weigh(own: list[np.ndarray], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted log and its own share, from its counts and the sum of its longer contexts' weighted logs."""
    kt = log_kt(*own)
    return np.logaddexp(kt, inner) - np.log(2), 1 / (1 + np.exp(np.clip(inner - kt, -700, 700)))


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def stem_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the contexts just shorter than the stems: key (context << 8 | node), n0, n1, inner, to be summed by key."""
    for cells, n in by_stem(batches):
        cells, n = cells[n > 0], n[n > 0]
        for k in range(8):
            keys, own, inner = Level(cells, n, k).above()
            node = np.uint64(1 << k) | keys & np.uint64((1 << k) - 1)
            key = keys >> np.uint64(k) << np.uint64(8) | node
            yield pa.record_batch([pa.array(key.astype(np.int64)), *[pa.array(x) for x in (*own, inner)]], names=["key", "n0", "n1", "inner"])


def upper_tree(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, inner: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per depth below STEM: sorted keys (context << 8 | node), the probability of a one if the next longer context never met
    the node, and what is done and left for the next longer context if it did."""
    order = np.argsort(key)
    levels = [(key[order], [n0[order], n1[order]], inner[order])]
    for _ in range(STEM - 1):
        key, own, inner = levels[0]
        keys, at = np.unique(shorter(key, 1, 8), return_inverse=True)
        levels.insert(0, (keys, [np.bincount(at, x, len(keys)) for x in own], np.bincount(at, weigh(own, inner)[0], len(keys))))
    out = []
    for d, (key, own, inner) in enumerate(levels):
        share, one = weigh(own, inner)[1], (own[1] + 0.5) / (own[0] + own[1] + 1)
        if d:
            at, _ = find(out[-1][0], shorter(key, 1, 8))
            done, left = out[-1][2][at], out[-1][3][at]
        else:
            done, left = np.zeros(len(key)), np.ones(len(key))
        out.append((key, done + left * one, done + left * share * one, left * (1 - share)))
    return out


def stem_logs(cells: np.ndarray, n: np.ndarray, upper: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 probabilities of whole stems' sorted cells, those with a count of 0 included.

    From the root down, a node's estimate takes its share of what is left. Where the longer context never met a binary
    node, the shorter one takes all that is left.
    """
    logs, known = np.zeros(len(cells)), n > 0
    for k in range(8):
        level = Level(cells[known], n[known], k)
        asked, back = cells >> np.uint64(8 - k), None
        first = np.r_[True, asked[1:] != asked[:-1]]
        asked, back = asked[first], np.cumsum(first) - 1
        node = np.uint64(1 << k) | asked & np.uint64((1 << k) - 1)
        one, done, left, open_ = np.full(len(asked), 0.5), np.zeros(len(asked)), np.ones(len(asked)), np.ones(len(asked), bool)
        for d, (keys, stop, go, rest) in enumerate(upper):
            at, met = find(keys, asked >> np.uint64(k + 8 * (DEPTH - d)) << np.uint64(8) | node)
            open_ &= met
            at = at[open_]
            one[open_], done[open_], left[open_] = stop[at], go[at], rest[at]
        for d in range(STEM, DEPTH + 1):
            at, met = find(level.keys[d], shorter(asked, DEPTH - d, k))
            open_ &= met
            at = at[open_]
            n0, n1 = (x[at] for x in level.own[d])
            mine = (n1 + 0.5) / (n0 + n1 + 1)
            one[open_] = done[open_] + left[open_] * mine
            if d < DEPTH:
                share = level.share[d][at]
                done[open_] += left[open_] * share * mine
                left[open_] *= 1 - share
        one = np.clip(one, 1e-9, 1 - 1e-9)
        bit = (cells >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        logs += np.where(bit, np.log10(one)[back], np.log10(1 - one)[back])
    return logs


def cell_logs(cells: DataFrame) -> DataFrame:
    """cell, log: log10 probability of the byte after the context, in the tree of every context that occurs in training texts.

    The contexts of a stem meet in a task, which sums up what the shorter contexts need; these, at most one per node and
    pair of bytes however long the texts are, are weighed in the driver and broadcast; then every stem is read downwards.
    """
    spark = cells.sparkSession
    dealt = cells.repartition(F.shiftrightunsigned("cell", 8 * (DEPTH - STEM + 1))).sortWithinPartitions("cell")
    sums = dealt.mapInArrow(stem_sums, "key long, n0 double, n1 double, inner double").groupBy("key")
    sums = sums.agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "inner")]).toArrow()
    upper = upper_tree(sums["key"].to_numpy().astype(np.uint64), *[sums[x].to_numpy() for x in ("n0", "n1", "inner")])
    shared = spark.sparkContext.broadcast(upper)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n in by_stem(batches):
            made = stem_logs(part, n, shared.value).astype(np.float32)
            yield pa.record_batch([pa.array(part.view(np.int64)), pa.array(made)], names=["cell", "log"])

    return dealt.mapInArrow(logs, "cell long, log float")


def bounded_cell_logs(cells: DataFrame, most: int) -> DataFrame:
    """cell_logs() of the tree of the `most` most frequent contexts, weighed in the driver and broadcast."""
    seen = kept_counts(cells.where("n > 0"), most).toArrow()
    keys, model = tree_model(*[seen[c].to_numpy().astype(t) for c, t in (("depth", np.int8), ("context", np.uint64), ("byte", np.uint8), ("n", np.int64))])
    shared = cells.sparkSession.sparkContext.broadcast((lookup_tables(keys), model))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = shared.value
        for batch in batches:
            part = batch.column("cell").to_numpy().astype(np.uint64)
            made = model[context_rows(part >> np.uint64(8), tables), (part & np.uint64(255)).astype(np.int64)].astype(np.float32)
            yield pa.record_batch([batch.column("cell"), pa.array(made)], names=["cell", "log"])

    return cells.select("cell").mapInArrow(logs, "cell long, log float")


def log_at(cells: np.ndarray, tables, logs: np.ndarray) -> np.ndarray:
    """The logs of cells that are all in the tables."""
    found, open_ = np.zeros(len(cells), np.int32), np.arange(len(cells))
    for t, (table, row, bits) in enumerate(tables):
        slot = mix(cells[open_] + np.uint64(t)) >> np.uint64(64 - bits)
        here = table[slot] == cells[open_]
        found[open_[here]] = row[slot[here]]
        open_ = open_[~here]
        if not len(open_):
            break
    if len(open_):
        raise ValueError("a chunk has other texts than when its cells were gathered: the input must be the same each time it is read")
    return logs[found]


def kept_counts(cells: DataFrame, most: int) -> DataFrame:
    """depth, context, byte, n of the `most` most frequent contexts of any depth, shorter ones first of equals.

    A context is never more frequent than its shorter form, so all shorter forms of a kept context are kept.
    """
    depth, long = F.col("depth"), F.shiftrightunsigned("cell", 8)
    cut = F.expr(f"shiftrightunsigned(long, 8 * ({DEPTH} - depth))")
    every = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    totals = cells.groupBy(long.alias("long")).agg(F.sum("n").alias("n")).select("long", "n", every).select("depth", cut.alias("context"), "n")
    top = totals.groupBy("depth", "context").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), depth, "context").limit(most)
    top = shared_table(top.select("depth", "context"), "contexts")  # at most `most` rows, so it may be broadcast
    spread = cells.select(long.alias("long"), (F.col("cell").bitwiseAND(255)).alias("byte"), "n", every).select("depth", cut.alias("context"), "byte", "n")
    return spread.join(F.broadcast(top), ["depth", "context"]).groupBy("depth", "context", "byte").agg(F.sum("n").alias("n"))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (chunk, cell, log) as one row a chunk and task: differences of the cells, byte by byte, and the logs."""
    held, size = [], 0

    def flush():
        chunk, cell, log = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(chunk, kind="stable")
        chunk, cell, log = chunk[order], cell[order], log[order]
        ends = np.flatnonzero(np.r_[chunk[1:] != chunk[:-1], True]) + 1
        parts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        cells = [np.diff(cell[x], prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for x in parts]
        held.clear()
        yield pa.record_batch([pa.array(chunk[ends - 1]), pa.array(cells, pa.binary()), pa.array([log[x].tobytes() for x in parts], pa.binary())], names=["chunk", "cells", "logs"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(x).to_numpy() for x in ("chunk", "cell", "log")])
            size += batch.num_rows
        if size >= TRAIN_CHUNK:
            size = 0
            yield from flush()
    if held:
        yield from flush()


def unpack(cells: bytes, logs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(cells, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(logs, np.float32)


def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | dict]:
    """Rows of one chunk at a time: answers as (chunk, cells, logs), texts as small dicts of lists."""
    for batch in batches:
        chunk, is_text = batch.column("chunk").to_numpy(), batch.column("rid").is_valid().to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.r_[(chunk[1:] != chunk[:-1]) | (is_text[1:] != is_text[:-1]), True]) + 1 if len(chunk) else []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            part = batch.slice(a, b - a)
            if is_text[a]:
                yield from rows(iter([part.select(["rid", "doc_id", "held_out", "bytes"])]))
            else:
                for cells, logs in zip(part.column("cells").to_pylist(), part.column("logs").to_pylist(), strict=True):
                    yield chunk[a], *unpack(cells, logs)


def lm_scores(docs: DataFrame, held_out_of: int = 10, frequent: int = FREQUENT, contexts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training texts are those whose id's crc32 is not divisible by `held_out_of`. base_score: add-0.1 unigram log10
    probability of the lower-cased words and one end. score: the context tree's log10 probability of the text's bytes
    and its end; bits_per_byte is its code length over the same bytes.

    The input is read three times, so that no copy of the texts is stored: for their size; dealt to chunks, for word counts and counts
    of cells (last DEPTH bytes, next byte); dealt to the same chunks once more, to be scored. The model holds
    every context of all depths up to DEPTH that occurs in training texts; context-tree weighting mixes the KT estimates
    of all depths on a context's path. It gives each cell that any text asks for its log10 probability; a shuffle join brings
    these to the chunks, once a chunk and distinct cell, and the chunks are scored there. `contexts`, if given (or FEWEST), bounds the
    model to the most frequent contexts. The `frequent` most frequent words are a bounded table and are broadcast; words outside it
    meet the full counts in a shuffle join, one row per text and distinct word, then a sum per text.

    Null text counts as empty (one end token). A null id counts as the empty string, which is held out. Rows are
    told apart by position, so repeated ids and rows are scored one by one. An empty table gives an empty result; with
    no training text all words are unknown and every bit has probability 1/2.
    """
    spark = docs.sparkSession
    ship(spark)
    train = bucket(F.col("doc_id"), held_out_of) != 0
    n_bytes, n_ends = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0)), F.count_if(train)).first()
    cores = spark.sparkContext.defaultParallelism
    n_chunks = max(1, -(-n_bytes // CHUNK), min(cores, n_bytes // LEAST_CHUNK))
    texts = to_chunks(docs, held_out_of, n_chunks)
    gathered = shared_table(gather(texts.repartitionById(n_chunks, "chunk")), "lm-chunks")
    vocabulary = shared_table(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("count")), "lm-words")
    cells = shared_table(gathered.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells")
    summed = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    total, distinct = summed[0] + n_ends, summed[1] + (n_ends > 0)
    norm = total + 0.1 * (distinct + 1)
    top = vocabulary.orderBy(F.desc("count"), "word").limit(frequent).toArrow()
    place = {w: i for i, w in enumerate(top["word"].to_pylist())}
    logs = np.log10((top["count"].to_numpy() + 0.1) / norm)
    end_score = float(np.log10((n_ends + 0.1) / norm))
    bound = contexts or FEWEST
    logs_of = shared_table(bounded_cell_logs(cells, bound) if bound else cell_logs(cells), "lm-logs")
    asked = gathered.where("cell is not null").select("chunk", "cell").join(logs_of, "cell").select("chunk", "cell", "log")
    answers = shared_table(asked.mapInArrow(pack, "chunk int, cells binary, logs binary"), "lm-answers")
    release(gathered, cells, logs_of)

    shared = spark.sparkContext.broadcast((place, logs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, logs = shared.value
        answers, chunk, tables, values = [], None, None, None
        for part in of_chunks(batches):
            if isinstance(part, tuple):
                # a chunk's answers come before its texts
                if chunk != part[0]:
                    chunk, answers = part[0], []
                answers.append(part[1:])
                tables = None
                continue
            if tables is None:
                values = np.concatenate([x for _, x in answers])
                tables = lookup_tables(np.concatenate([x for x, _ in answers]))
                answers = []
            out = {k: [] for k in ("rid", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", "score", "n_bytes")}

            def put(*values):
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)

            context, byte, starts = joined(part["bytes"])
            model_logs = np.add.reduceat(log_at(context << np.uint64(8) | byte, tables, values).astype(np.float64), starts)
            for rid, doc_id, held_out, text, log10 in zip(part["rid"], part["doc_id"], part["held_out"], part["bytes"], model_logs.tolist(), strict=True):
                words = text.lower().split()
                ids = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
                known = ids[ids >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(ids < 0))
                # the text's own row: its key holds a space, so no word equals it
                put(rid, doc_id, held_out, b" %d" % rid, 0, len(words) + 1, len(known) + (n_ends > 0), float(logs[known].sum()) + end_score, log10, len(text))
                for word, n in rare.items():
                    put(rid, None, None, word, n, 0, 0, 0.0, 0.0, 0)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    both = texts.unionByName(answers, allowMissingColumns=True).repartitionById(n_chunks, "chunk").sortWithinPartitions("chunk", F.asc_nulls_first("rid"))
    parts = both.mapInArrow(
        score, "rid long, doc_id long, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, score double, n_bytes long"
    )
    count = F.coalesce(F.col("count"), F.lit(0))
    scored = (
        parts.join(vocabulary, "word", "left")
        .groupBy("rid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(count > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.col("n") * F.log10((count + 0.1) / F.lit(norm))).alias("base_score"),
            F.sum("score").alias("score"),
            F.sum("n_bytes").alias("n_bytes"),
        )
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
