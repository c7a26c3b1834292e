"""Token counts by a two-tier lookup of pre-token lengths, without any shuffle."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from adloom.llm.common import ship, text_of

#: Entries of one generation of a worker's cache; there are two, some 100 MB when full.
CACHE = 400_000
#: Pieces that are encoded as one text.
JOINED = 2_000
CONTROLS = re.compile("[\x1c-\x1f]")
#: Texts within these code points are cut into pre-tokens here; letters and numbers of this range are long settled.
LATIN = 0x250


def latin_pattern() -> re.Pattern:
    """The vocabulary's pre-token pattern with letters and numbers spelled out for code points below LATIN."""
    letters = "".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


def word_suffix(tokenizer) -> str:
    """What the vocabulary appends to the last token of a pre-token; empty if nothing."""
    return json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""


def frequent_lengths(path: str) -> dict[str, int]:
    """Tier one: the number of tokens of every word that the vocabulary itself has in one piece.

    The vocabulary bounds its size. Lengths come from the library, so they hold whatever the merge order is.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = word_suffix(tokenizer)
    words = [w.removesuffix(suffix) for w in tokenizer.get_vocab() if suffix and w.endswith(suffix)]
    words = [w for w in words if re.fullmatch(r"[a-z]+|[!-/:-@\[-`{-~]+", w)]
    codes = tokenizer.encode_batch(words, add_special_tokens=False)
    return {w: len(c.ids) for w, c in zip(words, codes, strict=True)}


class Counter:
    """Counts the tokens of texts in one worker: frequent table first, then the worker's cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.frequent, self.young, self.old = frequent, {}, {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = word_suffix(self.tokenizer)
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.ends = np.zeros(size, bool) if suffix else None
        for token, code in self.tokenizer.get_vocab().items():
            if suffix and token.endswith(suffix):
                self.ends[code] = True
        self.latin, self.beyond = latin_pattern(), re.compile(f"[^\x00-{chr(LATIN - 1)}]")

    def encode(self, pieces: list[str], whole: bool) -> list[int]:
        """Tokens of each piece. Pieces are encoded as one text with spaces between. If every piece is one pre-token, the
        tokens that end a word end a piece; else a token belongs to the piece that its first character lies in."""
        text = " ".join(pieces)
        if whole and self.ends is not None:
            code = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            last = np.flatnonzero(self.ends[np.array(code.ids, np.int64)])
            if len(last) == len(pieces):
                return np.diff(last, prepend=-1).tolist()
        code = self.tokenizer.encode(text, add_special_tokens=False)
        starts = np.fromiter((o[0] for o in code.offsets), np.int64, len(code.ids))
        ends = np.cumsum([len(p) + 1 for p in pieces])
        return np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(pieces)).tolist()

    def learn(self, pieces: set[str], whole: bool) -> None:
        """Puts pieces into the young generation, from the old one or from the library."""
        missing = []
        for piece in pieces:
            known = self.old.get(piece)
            if known is None:
                missing.append(piece)
            else:
                self.young[piece] = known
        for i in range(0, len(missing), JOINED):
            part = missing[i : i + JOINED]
            self.young.update(zip(part, self.encode(part, whole), strict=True))

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """A text's pieces, and whether each is one pre-token."""
        plain = not self.beyond.search(text) and unicodedata.is_normalized("NFC", text)
        if plain and not any(special in text for special in self.specials):
            return self.latin.findall(text.lower()), True
        return text.split(), False

    def counts(self, texts: list[str]) -> list[int]:
        """A text's tokens are the sum over its pre-tokens. Latin texts are cut into pre-tokens here; others into
        white-space pieces, which no pre-token and no composition of characters crosses. Python's white space has four
        control characters that the library's has not; texts with one of those are encoded whole."""
        out = []
        for text in texts:
            if len(self.young) > CACHE:  # a full generation becomes the old one
                self.young, self.old = {}, self.young
            if CONTROLS.search(text):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            words, whole = self.pieces(text)
            frequent, young = self.frequent, self.young
            new = {w for w in words if w not in frequent and w not in young}
            if new:
                self.learn(new, whole)
            out.append(sum(frequent[w] if w in frequent else young[w] for w in words))
        return out


#: One counter per worker process and vocabulary; a worker keeps it over its tasks.
COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Map-side only: the frequent table is broadcast (at most the vocabulary), everything else is encoded once per worker
    and cached. Special tokens inside a text are counted as the library does by default.

    Null text counts as empty: no bytes, no tokens. Ids may be null or repeat. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    frequent = spark.sparkContext.broadcast(frequent_lengths(path))

    @pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = COUNTERS.get(path) or COUNTERS.setdefault(path, Counter(path, frequent.value))
        for texts in batches:
            yield pd.Series(counter.counts(texts.tolist()), dtype="int64")

    return (
        docs.select("doc_id", text_of().alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
