"""Quality rules over word and line repeats, and bands of compression ratios."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import slices, windows, word_hashes, word_spans
from furlong.llm.store import keep_rows, map_batches

WINDOW = 8
CHUNK = 4096
"""Bytes in a chunk that is compressed by itself."""
BANDS = ((128, 0.0, 1.7), (512, 0.8, 2.2), (1024, 1.05, 2.5), (4096, 1.25, 3.05), (16384, 1.35, 3.6), (65536, 1.4, 4.25), (None, 1.4, 4.7))
"""Up to so many bytes: least and greatest ratio of size to compressed size.  The greatest
is about 1.4 times the median ratio of ordinary English prose of that length: 1.19, 1.58,
1.80, 2.18, 2.58 and 3.05 at the bands' ends and 3.38 at 256 KB, measured with level 3 on
3.2 MB of manuals and licenses.  Words stuttered five times have 2.9 at 128 bytes, 4.3 at
512 and 5.2 or more from 1 KB on."""
BAD_CHUNKS = 0.3
"""Share of a document's chunks that may lie outside the band of their size."""
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def limits(size: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if most is None or size <= most)


@lru_cache(maxsize=4)
def compressor(level: int):
    """One compressor for each Python worker and level."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress


def ratio_verdict(compress, text: bytes) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks out of band, and whether both are within limits."""
    if not text:
        return 0.0, 0.0, True
    ratio = len(text) / len(compress(text))
    low, high = limits(len(text))
    chunks = [text[i : i + CHUNK] for i in range(0, len(text) - CHUNK + 1, CHUNK)]
    if chunks and len(text) % CHUNK:
        # The tail is checked as the last full chunk's length of text, whose band is the same.
        chunks.append(text[-CHUNK:])
    low_chunk, high_chunk = limits(CHUNK)
    bad = sum(not low_chunk <= CHUNK / len(compress(x)) <= high_chunk for x in chunks)
    share = bad / len(chunks) if chunks else 0.0
    return ratio, share, bool(low <= ratio <= high and share <= BAD_CHUNKS)


def repeated_words(hashes: np.ndarray, texts: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a window of words which the text has twice or more."""
    found, at = windows(hashes, texts, WINDOW)
    order = np.lexsort((found, texts[at]))
    found, at = found[order], at[order]
    twice = np.zeros(len(found), bool)
    if len(found) > 1:
        same = (found[1:] == found[:-1]) & (texts[at[1:]] == texts[at[:-1]])
        twice[1:] |= same
        twice[:-1] |= same
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(texts, covered, minlength=n_texts).astype(np.int64)


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Rule values and verdict of each document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, ratio, bad_chunks, base_failed, kept.  A document fails the
    base rules with fewer than 20 words, or if more than 30 % of its words are
    repeats.  The others are kept if the zstandard ratios of the whole text and
    of its chunks lie within the bands for their sizes.

    Null and empty texts have no words and fail.  Every row is judged by itself
    and its whole text, however long: null ids stay, repeated rows get equal
    results, an empty table gives none, and other columns are not read, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        compress = compressor(level)
        for part, data, bounds in slices(batch, "text"):
            n = part.num_rows
            starts, ends, texts = word_spans(data, bounds)
            n_words = np.bincount(texts, minlength=n)
            letters = (data & 0xC0) != 0x80
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            # Two words that touch at the end of a text cancel out there, as they should.
            in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            repeats = repeated_words(word_hashes(data, starts, ends, None), texts, n)
            base_failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            ratios = [ratio_verdict(compress, data[i:j].tobytes()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield {
                "doc_id": part.column("doc_id"), "n_words": n_words, "word_chars": sums(letters & in_word, bounds), "n_symbols": sums(SYMBOLS[data], bounds),
                "n_dup_lines": [repeated_lines(x) if x else 0 for x in part.column("text").to_pylist()], "n_repeat_words": repeats,
                "ratio": [r for r, _, _ in ratios], "bad_chunks": [b for _, b, _ in ratios], "base_failed": base_failed, "kept": ~base_failed & np.array([k for _, _, k in ratios], bool),
            }

    return map_batches(rows, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", level: int = 3) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns, which may have any names.

    Null and empty texts go.  Rows are filtered where they are, by the same
    rules, so nothing is joined; equal rows stay or go together; an empty table
    stays empty.
    """

    def good(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        compress = compressor(level)
        starts, ends, texts = word_spans(data, bounds)
        n_words = np.bincount(texts, minlength=len(bounds) - 1)
        repeats = repeated_words(word_hashes(data, starts, ends, None), texts, len(bounds) - 1)
        good = (n_words >= 20) & (100 * repeats <= 30 * n_words)
        for i in np.flatnonzero(good):
            good[i] = ratio_verdict(compress, data[bounds[i] : bounds[i + 1]].tobytes())[2]
        return good

    return keep_rows(docs, text_col, good)
