"""Language identification with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adloom.llm.common import release, shared_table, ship, text_of
from adloom.llm.language_model import bucket

#: Longest n-gram, in characters. All lengths up to it count.
LONGEST = 4
#: Bounds of the fit: labelled documents, landmarks among them, and n-grams of landmarks that the kernel knows.
SAMPLE, LANDMARKS, GRAMS = 2048, 128, 16_384
#: Weight of the ridge, per document.
RIDGE = 1e-3
#: Slots of the table of n-grams; one n-gram a slot.
SLOTS = 1 << 20
#: Documents whose presence rows are one matrix, and characters that are hashed at once.
ROWS, CHARS = 64, 1 << 20
#: How steeply outputs turn into a score.
STEEP = 4.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Model(NamedTuple):
    langs: list[str]
    #: Known n-grams: hash of each, and slot -> place among them (-1: none).
    keys: np.ndarray
    slots: np.ndarray
    #: n-grams x landmarks: 1 where the landmark has the n-gram.
    presence: np.ndarray
    #: landmarks x languages.
    weights: np.ndarray


@cache
def letters() -> np.ndarray:
    """code point -> its lower-case letter, or a blank if it is no letter; for code points below 0x20000."""
    low = [c.lower() if c.isalpha() else " " for c in map(chr, range(0x20000))]
    return np.array([ord(x) if len(x) == 1 else ord(x[0]) for x in low], np.uint32)


def characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words (runs of letters) with one blank around each; empty without a letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letters()
    if len(codes) and int(codes.max()) >= len(table):
        high = codes >= len(table)
        rare = {c: ord(chr(c)) if chr(c).isalpha() else 32 for c in np.unique(codes[high]).tolist()}
        out = table[np.where(high, 32, codes)]
        out[high] = [rare[c] for c in codes[high].tolist()]
    else:
        out = table[codes]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    kept = np.append(True, (out[1:] != 32) | (out[:-1] != 32))
    out = out[kept]
    return out if len(out) > 1 else out[:0]


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of all n-grams, n from 1 to LONGEST, in slices of CHARS places. Code 0 belongs to no n-gram: it separates
    texts."""
    for at in range(0, len(codes), CHARS):
        own = codes[at : at + CHARS + LONGEST - 1].astype(np.uint64)
        h, sound = np.zeros(len(own), np.uint64), np.ones(len(own), bool)
        for n in range(1, LONGEST + 1):
            size = min(CHARS, len(own) - n + 1)
            if size <= 0:
                break
            last = own[n - 1 : n - 1 + size]
            h, sound = (h[:size] + last + np.uint64(n)) * _A, sound[:size] & (last != 0)
            h ^= h >> np.uint64(29)
            places = np.flatnonzero(sound)
            yield places + at, h[places]


def slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _B) >> np.uint64(44)).astype(np.int64)


def presences(texts: list[np.ndarray], keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """texts x known n-grams: 1 where the text has the n-gram. Whole texts, whatever their length."""
    out = np.zeros((len(texts), len(keys)), np.float32)
    gap = np.zeros(LONGEST - 1, np.uint32)
    joined = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    for places, h in grams(joined):
        known = slots[slot(h)]
        at = np.flatnonzero(known >= 0)
        at = at[keys[known[at]] == h[at]]
        out[np.searchsorted(ends, places[at], "right"), known[at]] = 1
    return out


def kernel(texts: list[np.ndarray], keys: np.ndarray, slots: np.ndarray, presence: np.ndarray) -> np.ndarray:
    """texts x landmarks: shared n-grams over the roots of both numbers of n-grams; one matrix product a batch of texts. The
    product counts, so it is exact, whatever the batch."""
    out, root = [], np.sqrt(np.maximum(presence.sum(0, dtype=np.float64), 1))
    for at in range(0, len(texts), ROWS):
        own = presences(texts[at : at + ROWS], keys, slots)
        size = np.sqrt(np.maximum(own.sum(1, keepdims=True, dtype=np.float64), 1))
        out.append((own @ presence) / (size * root))
    return np.concatenate(out) if out else np.zeros((0, presence.shape[1]))


def fit(docs: DataFrame, held_out_of: int = 4, held_out: int = 2, sample: int = SAMPLE, landmarks: int = LANDMARKS, most_grams: int = GRAMS, seed: int = 11) -> Model | None:
    """The model of the training rows' languages, or None if there are no such rows.

    Every language gives the same number of documents to the sample, and of these the same number of landmarks (at least
    one), first in a seeded order; `sample` and `landmarks` bound both in all. The kernel knows the `most_grams` n-grams
    that most landmarks have. Ridge regression on kernel values with the landmarks, one output a language.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (bucket(F.col("doc_id"), held_out_of) != held_out))
    known = known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("text").alias("mark"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    share, own = max(1, sample // len(langs)), max(1, landmarks // len(langs))
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id", "mark"]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = known.select("doc_id", "lang", "mark").distinct().withColumn("place", place).where(F.col("place") <= share)
    # at most `sample` short rows, or one a language: a bounded broadcast
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang", "mark"]).dropDuplicates(["lang", "place"]).select("lang", "place", "text")
    rows = shared_table(rows, "language-sample")

    def landmark_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [np.unique(h) for _, h in grams(characters(batch["text"][k].as_py()))]
                h = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(len(h), batch["no"][k].as_py(), np.int32))], names=["gram", "no"])

    numbered = rows.where(F.col("place") <= own).select((F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) * own + F.col("place")).alias("no"), "text")
    shared = numbered.mapInArrow(landmark_grams, "gram long, no int").groupBy("gram").agg(F.count("*").alias("n"), F.collect_set("no").alias("nos"))
    frequent = shared.orderBy(F.desc("n"), "gram").limit(most_grams).toArrow()  # most_grams rows of at most `landmarks` numbers
    keys, nos = frequent["gram"].to_numpy().view(np.uint64), frequent["nos"].to_pylist()
    places = slot(keys)
    first = np.sort(np.unique(places, return_index=True)[1])  # of n-grams with one slot, the most frequent
    keys, nos, places = keys[first], [nos[i] for i in first], places[first]
    slots = np.full(SLOTS, -1, np.int32)
    slots[places] = np.arange(len(keys))
    columns = {no: i for i, no in enumerate(sorted({no for found in nos for no in found}))}
    presence = np.zeros((len(keys), max(1, len(columns))), np.float32)
    for i, found in enumerate(nos):
        presence[i, [columns[no] for no in found]] = 1
    spread = spark.sparkContext.broadcast((keys, slots, presence))

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kernel([characters(x) for x in batch["text"].to_pylist()], *spread.value)
            yield pa.record_batch([batch["lang"], batch["place"], pa.array(list(found), pa.list_(pa.float64()))], names=["lang", "place", "row"])

    found = rows.mapInArrow(kernel_rows, "lang string, place int, row array<double>").orderBy("lang", "place").toArrow()  # `sample` rows
    spread.unpersist()
    release(rows)
    near = np.array(found["row"].to_pylist())
    target = np.array([[1.0 if x == lang else -1.0 for lang in langs] for x in found["lang"].to_pylist()])
    root = np.sqrt(np.maximum(presence.sum(0, dtype=np.float64), 1))
    own_kernel = (presence.T @ presence) / np.outer(root, root)
    weights = np.linalg.solve(near.T @ near + RIDGE * len(near) * own_kernel + 1e-6 * np.eye(len(own_kernel)), near.T @ target)
    return Model(langs, keys, slots, presence, weights)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; 'und' and 0 where a text has no letter or nothing was learned."""
    codes = [characters(x) for x in texts]
    langs, out = ["und"] * len(texts), np.zeros(len(texts))
    there = [i for i, c in enumerate(codes) if len(c)]
    if model and there:
        value = kernel([codes[i] for i in there], model.keys, model.slots, model.presence) @ model.weights
        share = np.exp(STEEP * (value - value.max(1, keepdims=True)))
        best = value.argmax(1)
        out[there] = 1 / share.sum(1)
        for i, k in zip(there, best, strict=True):
            langs[i] = model.langs[k]
    return langs, out


def identify_languages(docs: DataFrame, held_out_of: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1, the winner's share of all outputs).

    Learned from the text and lang of rows whose id's crc32 modulo `held_out_of` is not `held_out`, at most `sample` of them
    (see `fit`); a prediction only reads the text. The kernel of two texts counts the n-grams of up to four letters,
    word ends included, that both have, over the roots of how many each has of those that landmarks have.

    A text that is null, empty or without a letter is 'und' with score 0; so is every text if no row can be learned from.
    Rows without an id or a lang are not learned from, but get a prediction; a null id counts as empty text. Repeated rows
    get equal rows. Of languages with equal outputs the one with more training rows wins, so a text of letters that no
    landmark has gets the most frequent one, with an even score. Long texts are read whole, in slices. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = fit(docs, held_out_of, held_out, sample)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                langs, score = predict(part["text"].to_pylist(), shared.value)
                yield pa.record_batch([part["doc_id"], part["held_out"], pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(F.col("doc_id"), held_out_of) == held_out).alias("held_out"), text_of().alias("text"))
    return texts.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
