"""Byte-level text helpers for Arrow tasks. Bytes split and lower-case exactly as the contracts say: ASCII only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: An odd number: words are polynomials in it modulo 2 ** 64, and it has an inverse there.
BASE = 0x9E3779B97F4A7C15
SPACES = b" \t\n\x0b\x0c\r"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def lower_table(separators: bytes = SPACES) -> np.ndarray:
    """byte -> byte: A-Z lower-cased, separators as a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 32
    return table


WORDS, BARE_WORDS = lower_table(), lower_table(SPACES + PUNCTUATION)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse, up to size."""
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: bytes, table: np.ndarray = WORDS) -> np.ndarray:
    """One 64-bit hash a word, words being what the table's separators leave. All of a text's words in a few array steps:
    a word's polynomial is a difference of running sums, moved to power 0."""
    data = table[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(1 << max(12, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[dict[str, list]]:
    """Batches as small dicts of Python lists, so that long texts are not all held as objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size).to_pydict()


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of arrays without nulls, as views of one buffer."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
