"""Vectorised helpers over the bytes of many texts at once.

The functions work on one slice of an Arrow batch: ``data`` holds the UTF-8
bytes of its texts end to end, ``bounds`` the n + 1 offsets between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
"""Texts are handled in slices of about this size; a longer text is a slice of its own."""

# Multipliers of the splitmix64 and murmur3 finalisers.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX_A
    x ^= x >> np.uint64(33)
    x *= MIX_B
    x ^= x >> np.uint64(33)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit integers that depend on the seed only."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * GOLDEN)


BYTE_HASH = seeded(256, 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    data, bounds = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``blank``, and the text of each; no run crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes, after mapping them by ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    chars = data[inside]
    values = BYTE_HASH[chars if fold is None else fold[chars]]
    values *= powers(ODD, int(lengths.max()))[inside - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the index of the first word of each."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n & n - 1:
        out = hashes[:m].copy()
        for j in range(1, n):
            out = out * ODD + hashes[j : m + j]
    else:
        # Runs of twice as many words from two that follow each other.
        out, have = hashes, 1
        while have < n:
            out = out[:-have] * np.uint64(pow(int(ODD), have, 1 << 64)) + out[have:]
            have *= 2
    at = np.flatnonzero(texts[:m] == texts[n - 1 :])
    return mix(out[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    """Reinterpret 64 unsigned bits as Spark's long."""
    return x.view(np.int64)
