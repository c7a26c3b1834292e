"""Quality classifier: a Bradley-Terry ranking learned from all preference pairs of the labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from adloom.llm.common import shared_table, ship, text_of
from adloom.llm.language_model import bucket
from adloom.llm.textbytes import arrays

#: Width of a bin of utilities in standard deviations, and bins on either side of the mean.
STEP, BINS = 0.04, 250
#: Ridge on the mean loss of a pair; Newton rounds, and halvings in one, at most.
RIDGE, ROUNDS = 1e-4, 40
NAMES = (
    "log_words", "word_chars", "long_words", "distinct", "repeats", "upper", "digits", "stops", "marks", "symbols",
    "bars", "spaces", "lines", "other_bytes", "markup_words", "top_byte",
)


def groups() -> np.ndarray:
    """256 x 9: the byte groups whose shares are features."""
    out = np.zeros((256, 9))
    for k, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?\"'()-", b"#$%&*@^~=+<>_\\/{}[]", b"|`", b" \t\x0b\x0c\r", b"\n")):
        out[list(members), k] = 1
    out[128:, 8] = 1
    return out


def features(text: bytes, table: np.ndarray) -> np.ndarray:
    """len(NAMES) numbers, all within a few units; shares enter as square roots, so that small ones count."""
    words = text.split()
    n, size = len(words), len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256)
    share = np.sqrt(histogram @ table / max(size, 1))
    distinct = len(set(words)) / n if n else 0.0
    return np.array(
        [
            math.log1p(n) / 5,
            min(size / n, 30) / 10 if n else 0.0,
            math.sqrt(sum(len(w) > 20 for w in words) / n) if n else 0.0,
            distinct * math.sqrt(math.log1p(n)) / 2,
            math.sqrt(sum(map(eq, words, words[1:])) / n) if n else 0.0,
            share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8],
            math.sqrt(sum(w[-1] in b"#$%&*!|" for w in words) / n) if n else 0.0,
            math.sqrt(histogram.max() / size) if size else 0.0,
        ]
    )


def feature_column(text: Column) -> Column:
    """The features of a text, as array<double>."""
    ship(SparkSession.active())

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = groups()
        for texts in batches:
            yield pd.Series([features(x, table) for x in texts])

    return run(F.encode(text_of(text), "utf-8"))


def score_column(text: Column, model: tuple[np.ndarray, float] | None) -> Column:
    """The score of a text under a model of fit(); 0.5 without one."""
    ship(SparkSession.active())
    weights, shift = model or (np.zeros(len(NAMES)), 0.0)

    @pandas_udf("double")
    def utility(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = groups()
        for texts in batches:
            yield pd.Series([float(features(x, table) @ weights) + shift for x in texts], dtype="float64")

    return 1 / (1 + F.exp(-utility(F.encode(text_of(text), "utf-8"))))


def utility_of(value: Column, weights: np.ndarray) -> Column:
    return sum((F.get(value, F.lit(i)) * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def bin_width(weights: np.ndarray, spread: np.ndarray, step: float) -> float:
    return max(math.sqrt(max(float(weights @ spread @ weights), 0.0)), 1e-9) * step


def bin_sums(rated: DataFrame, weights: np.ndarray, middle: float, width: float) -> list:
    """Rows (label and bin as one number, sums): rows, utilities, features and products of two features, summed over all
    rows of the bin. Tasks sum before anything moves; the outermost bins are open."""
    upper, schema = np.triu_indices(len(weights)), "key int, sums array<double>"

    def merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.add.reduceat(sums[order], starts)

    def reduced(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, sums = None, None
        for k, x in parts:
            keys, sums = merged(k, x) if keys is None else merged(np.r_[keys, k], np.concatenate([sums, x]))
        if keys is not None:
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["key", "sums"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                if batch.num_rows:
                    x = np.array(arrays(batch.column("value")))
                    u = x @ weights
                    at = np.clip(np.rint((u - middle) / width), -BINS, BINS).astype(np.int64) + BINS
                    label = batch.column("quality").to_numpy().astype(np.int64)
                    yield merged(label * (2 * BINS + 1) + at, np.column_stack([np.ones(len(u)), u, x, x[:, upper[0]] * x[:, upper[1]]]))

        return reduced(parts())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced((x.column("key").to_numpy().astype(np.int64), np.array(arrays(x.column("sums")))) for x in batches if x.num_rows)

    ship(rated.sparkSession)
    return rated.select("quality", "value").mapInArrow(local, schema).repartition("key").mapInArrow(whole, schema).collect()


class PairSums:
    """The Bradley-Terry loss of all pairs of a row labelled 1 and a row labelled 0, from sums over bins of the utility.

    A pair's loss depends on the two utilities only. Rows of one label whose utilities lie within STEP of the utility's
    standard deviation count with their mean utility; numbers of rows and first and second moments of the features are
    summed over all rows, so every row meets every row of the other label and the work stays linear in the rows.
    """

    def __init__(self, rated: DataFrame, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        """rated: quality, value. mean, spread: the features' means and covariances, which only set the bins."""
        d = len(weights)
        found = sorted(bin_sums(rated, weights, float(weights @ mean), bin_width(weights, spread, STEP)))
        i, j = np.triu_indices(d)
        self.n, self.u, self.first, self.second = [], [], [], []
        for label in (0, 1):
            made = np.array([r["sums"] for r in found if r["key"] // (2 * BINS + 1) == label]).reshape(-1, 2 + d + len(i))
            second = np.zeros((len(made), d, d))
            second[:, i, j] = second[:, j, i] = made[:, 2 + d :]
            self.n.append(made[:, 0])
            self.u.append(made[:, 1] / made[:, 0])
            self.first.append(made[:, 2 : 2 + d])
            self.second.append(second)
        self.rows = [int(x.sum()) for x in self.n]
        if total := sum(self.rows):
            self.mean = sum(x.sum(0) for x in self.first) / total
            self.spread = sum(x.sum(0) for x in self.second) / total - np.outer(self.mean, self.mean)

    def loss(self) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean loss of the pairs with its gradient and second derivatives."""
        (n0, n1), (x0, x1), (s0, s1) = self.n, self.first, self.second
        pairs = self.rows[0] * self.rows[1]
        gap = self.u[1][:, None] - self.u[0][None, :]
        wrong = np.exp(-np.logaddexp(0, gap))
        turn = wrong * (1 - wrong)
        loss = n1 @ np.logaddexp(0, -gap) @ n0
        slope = (wrong.T @ n1) @ x0 - (wrong @ n0) @ x1
        cross = x1.T @ turn @ x0
        curve = np.tensordot(turn @ n0, s1, 1) + np.tensordot(turn.T @ n1, s0, 1) - cross - cross.T
        return loss / pairs, slope / pairs, curve / pairs


def learn(values: DataFrame, labels: DataFrame, held_out_of: int = 5, cut: float = 0.3) -> tuple[np.ndarray, float] | None:
    """fit(), for documents given as doc_id and value (their features)."""
    known = (
        labels.where((bucket(F.col("doc_id"), held_out_of) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    rated = shared_table(values.join(known, "doc_id").select("quality", "value"), "rated")
    weights = np.zeros(len(NAMES))
    sums = PairSums(rated, weights, weights, np.eye(len(NAMES)))
    if not all(sums.rows):
        return None
    mean, spread = sums.mean, sums.spread
    best, slope, curve = sums.loss()
    for _ in range(ROUNDS):
        slope, curve = slope + RIDGE * weights, curve + RIDGE * np.eye(len(weights))
        step = -np.linalg.solve(curve, slope)
        if -step @ slope < 1e-9:
            break
        for _ in range(ROUNDS):
            loss, slope, curve = PairSums(rated, weights + step, mean, spread).loss()
            loss += RIDGE / 2 * float((weights + step) @ (weights + step))
            if loss <= best + 1e-9:
                break
            step = step / 2
        best, weights = loss, weights + step

    number = F.round((F.col("u") - float(weights @ mean)) / bin_width(weights, spread, STEP / 20))
    number = F.greatest(F.least(number, F.lit(20 * BINS)), F.lit(-20 * BINS)).cast("int")
    counts = rated.select("quality", utility_of(F.col("value"), weights).alias("u")).groupBy(number.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("quality").alias("n1"), F.min("u").alias("low"), F.max("u").alias("high")
    ).orderBy("bin").toPandas()
    below, below1 = counts["n"].cumsum().to_numpy(), counts["n1"].cumsum().to_numpy()
    share = sums.rows[0] / sum(sums.rows)
    levels = [min(0.99, share * x / 10) for x in range(4, 17)]
    ends = sorted({min(int(np.searchsorted(below, x * below[-1])), len(below) - 1) for x in levels})
    right = [(below[i] - below1[i]) / sums.rows[0] + (sums.rows[1] - below1[i]) / sums.rows[1] for i in ends]
    at = ends[int(np.argmax(right))]
    above = counts["low"][at + 1] if at + 1 < len(below) else counts["high"][at]
    return weights, math.log(cut / (1 - cut)) - (counts["high"][at] + above) / 2


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, cut: float = 0.3) -> tuple[np.ndarray, float] | None:
    """Weights and shift of the utility, or None if the labelled rows lack one of the two labels.

    Every labelled row outside the held-out fold takes part. Each row labelled 1 is preferred to each row labelled 0; the
    weights have the least Bradley-Terry loss over all these pairs (no intercept, a ridge of RIDGE), found by Newton's
    method on the sums of PairSums, one aggregation a round. The threshold lies between two bins of all rows' utilities,
    at one of the levels around the share of label 0, where the balanced accuracy is best; the shift puts it at the score `cut`.
    """
    return learn(docs.where(bucket(F.col("doc_id"), held_out_of) != 0).select("doc_id", feature_column(F.col("text")).alias("value")), labels, held_out_of, cut)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, cut: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= cut).

    One map over all texts stores 16 numbers about bytes and words, the only inputs. The fit uses every labelled row
    whose id's crc32 is not divisible by `held_out_of`.

    Null text counts as empty and gets the score of an empty text. A null id counts as the empty string (held out).
    Repeated rows get equal rows. Labels other than 0 and 1, and of unknown ids, are ignored; several labels of one id
    count as their largest. Without labels of both kinds every score is 0.5. An empty table gives an empty result.
    """
    values = shared_table(docs.select("doc_id", feature_column(F.col("text")).alias("value")), "features")
    weights, shift = learn(values, labels, held_out_of, cut) or (np.zeros(len(NAMES)), 0.0)
    utility = utility_of(F.col("value"), weights) + float(shift)
    return values.select(
        "doc_id",
        (bucket(F.col("doc_id"), held_out_of) == 0).alias("held_out"),
        (1 / (1 + F.exp(-utility))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= cut).cast("int"))
