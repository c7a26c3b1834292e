"""Phrase collocations by prefix-free parsing: distinct chunks are counted once, weighted by how often they occur."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.llm.common import shared_table, ship, text_of
from adloom.llm.decontaminate import FACTORS
from adloom.llm.near_dup import packed_filter, passes
from adloom.llm.textbytes import BASE, mix

#: Characters that end a piece (the last four are LF, VT, FF, CR), and those between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Longest phrase, in words. Neighbouring chunks share one word less.
MOST = 4
SHARED = MOST - 1
#: One window of SHARED words in so many ends a chunk; a chunk without such a window ends after LONGEST words.
PERIOD, LONGEST = 32, 8192
#: Bytes of text that a task parses at once, as far as a piece ends there.
SEGMENT = 1 << 20


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(BLANKS)] = 32
    table[list(BREAKS)] = 10
    return table


TABLE = _table()
_BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")


@cache
def _powers(size: int) -> np.ndarray:
    up = np.full(size, BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up)


class Words:
    """The words of a text: hashes, the piece each belongs to, and where each lies in `joined`, the words with one blank
    between them."""

    def __init__(self, text: bytes):
        data = TABLE[np.frombuffer(text, np.uint8)]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != 32) & (data != 10)
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.cumsum(data == 10)[starts] if len(starts) else starts
        letters = data[inside[1:-1] == 1]
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        longest = int(sizes.max()) if len(sizes) else 1
        powers = _powers(1 << max(8, longest.bit_length()))
        offset = np.arange(len(letters)) - np.repeat(first, sizes)
        sums = np.add.reduceat((letters + np.uint64(1)) * powers[offset], first) if len(first) else np.zeros(0, np.uint64)
        self.hash = mix(sums + sizes.astype(np.uint64))
        self.start = first + np.arange(len(sizes))
        self.end = self.start + sizes
        self.joined = np.full(len(letters) + len(sizes), 32, np.uint8)
        self.joined[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters

    def __len__(self) -> int:
        return len(self.hash)

    def grams(self, k: int, salt: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
        """A hash of the k words from every word on, without regard to pieces. salt: one number, or one for every word."""
        size = max(0, len(self) - k + 1)
        total = np.full(size, k, np.uint64)
        for j in range(k):
            total += self.hash[j : j + size] * FACTORS[j]
        return mix(total + (salt[:size] if np.ndim(salt) else salt))


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut where a piece ends."""
    at = 0
    while len(text) - at > size:
        found = _BREAK.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def chunks(words: Words, period: int = PERIOD, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first word, last word and number of words that each chunk owns.

    A chunk ends with a window of SHARED words whose hash is a multiple of `period` (or after `longest` words), and the
    next one begins with that window; pieces begin and end chunks. A chunk owns the words before the next chunk's first.
    A phrase of up to MOST words lies inside the chunk that owns its first word, so it is counted once.
    """
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    begins = np.ones(n, bool)
    begins[1:] = words.piece[1:] != words.piece[:-1]
    heads = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    cut = begins.copy()
    if n >= SHARED:
        whole = words.piece[SHARED - 1 :] == words.piece[: n - SHARED + 1]
        cut[: n - SHARED + 1] |= whole & ((words.grams(SHARED) % np.uint64(period) == 0) | (place[: n - SHARED + 1] % longest == 0))
    first = np.flatnonzero(cut)
    after = np.append(first[1:], n)
    goes_on = np.append(~begins[first[1:]], False)
    return first, np.where(goes_on, after + SHARED - 1, after - 1), after - first


def language_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.array([language_salt(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def parse_chunks(texts: DataFrame) -> DataFrame:
    """lang, chunk (words with single blanks), own (words it owns), n: the distinct chunks of (lang, bytes) and how often the
    parse uses each."""
    ship(texts.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(lang: str, waiting: list[bytes]) -> pa.RecordBatch:
            words = Words(b"\n".join(waiting))
            first, last, own = chunks(words)
            joined = words.joined.tobytes()
            found = [joined[a:b] for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)]
            return pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(own.astype(np.int32))], names=["lang", "chunk", "own"])

        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            held: dict[str, int] = {}
            for lang, text in zip(batch["lang"], batch["bytes"], strict=True):
                key = lang.as_py()
                for part in segments(text.as_py()):
                    waiting.setdefault(key, []).append(part)
                    held[key] = held.get(key, 0) + len(part)
                    if held[key] >= SEGMENT:
                        yield emit(key, waiting.pop(key))
                        held[key] = 0
            for key, parts in waiting.items():
                yield emit(key, parts)

    return texts.mapInArrow(parse, "lang string, chunk binary, own int").groupBy("lang", "chunk", "own").agg(F.count("*").alias("n"))


def _sums(parsed: DataFrame, k: int, below) -> DataFrame:
    """lang, phrase, f: how often each phrase of k words occurs. `below`: a broadcast filter that holds the frequent phrases of
    k - 1 words; phrases with a part that it lacks are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(b"\n".join(batch["chunk"].to_pylist()))
            chunk = words.piece
            head = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            end = np.append(head[1:], len(words))  # of every chunk
            salt = _salts(batch["lang"])[chunk]
            size = len(words) - k + 1
            if size <= 0:
                continue
            at = np.arange(size)
            fits = (at < (head + batch["own"].to_numpy())[chunk[:size]]) & (at + k <= end[chunk[:size]])
            if below is not None:
                parts = passes(below.value, words.grams(k - 1, salt).view(np.int64))
                fits &= parts[:size] & parts[1 : size + 1]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            found = words.grams(k, salt)[at]
            order = np.argsort(found, kind="stable")
            firsts = np.flatnonzero(np.append(True, np.diff(found[order]) != 0))
            weight = batch["n"].to_numpy()[chunk[at]]
            sums = np.add.reduceat(weight[order], firsts)
            one = at[order[firsts]]
            joined = words.joined.tobytes()
            phrases = [joined[a:b] for a, b in zip(words.start[one].tolist(), words.end[one + k - 1].tolist(), strict=True)]
            yield pa.record_batch([batch["lang"].take(pa.array(chunk[one])), pa.array(phrases, pa.binary()), pa.array(sums, pa.int64())], names=["lang", "phrase", "f"])

    return parsed.mapInArrow(count, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _hashes(frequent: DataFrame, k: int) -> DataFrame:
    """The hashes that tasks give the phrases of a table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = Words(b"\n".join(batch["phrase"].to_pylist()))
                yield pa.record_batch([pa.array(words.grams(k, np.repeat(_salts(batch["lang"]), k))[::k].view(np.int64))], names=["h"])

    return frequent.select("lang", "phrase").mapInArrow(hashed, "h long")


def mine_phrases(docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to MOST words of every language.

    Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words. Phrases that occur
    `least` times are candidates. Cutting a candidate in two gives its parts' counts l and r and the score
    floor(2000000 a / (l + r)); the lowest-scoring cut counts, the earliest of equals. A candidate goes if a longer one
    holds it and has at least `inside` percent of its occurrences. Ranks are by score, then a (both descending), then
    phrase (byte order).

    Prefix-free parsing: windows of three words with a given hash cut pieces into chunks that overlap by that window.
    Equal chunks, of copies and of repeated passages, become one row with the number of times the parse uses it, and
    all counting reads that table; a phrase belongs to the chunk that owns its first word, so overlaps count once.
    Phrases of k words are only counted where both parts of k - 1 words are frequent; a filter of fixed size says so (a
    full filter lets more through, and counts stay exact). Within a batch equal 64-bit hashes stand for equal phrases;
    between batches the words themselves are the key. Sums are 64-bit, products 38-digit decimals.

    A null lang is 'und', a null text empty; empty texts and texts without words add nothing; repeated rows count each.
    A text of any length is parsed in parts that end with a piece. An empty table gives an empty result; other columns,
    doc_id included, are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode(text_of(), "utf-8").alias("bytes"))
    parsed = shared_table(parse_chunks(texts), "chunks")
    levels, bits = [], None
    for k in range(1, MOST + 1):
        found = shared_table(_sums(parsed, k, bits).where(F.col("f") >= least), f"phrases-{k}")
        levels.append(found)
        if bits is not None:
            bits.unpersist()
        bits = spark.sparkContext.broadcast(packed_filter(_hashes(found, k))) if k < MOST else None
    counted = reduce(DataFrame.unionByName, [x.select("lang", F.col("phrase").cast("string").alias("phrase"), "f", F.lit(k + 1).alias("size")) for k, x in enumerate(levels)])
    words = F.split("phrase", " ")
    joined = lambda at, size: F.array_join(F.slice(words, at, size), " ")
    candidates = counted.where("size > 1")

    # the lowest-scoring cut
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, count: counted.where(f"size < {MOST}").select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("product", wide(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("parts", wide(F.col("l")) + wide(F.col("r")))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("product div parts").alias("score"), "k", "a", "l", "r")).alias("cut"))

    # the most frequent longer candidate that holds a phrase
    spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> named_struct('i', i, 'n', n))))")
    holders = counted.where("size > 2").select("lang", "phrase", "f", F.explode(spans).alias("span")).select("lang", joined(F.col("span.i"), F.col("span.n")).alias("phrase"), "f")
    held = holders.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.select("lang", "phrase", "cut.*").join(held, ["lang", "phrase"], "left")
    kept = kept.where(~F.coalesce(wide(F.col("longer")) * 100 >= wide(F.col("a")) * inside, F.lit(False)))

    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    totals = parsed.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
