"""Find test items in training documents: BM25 with block-max WAND, then overlap checks.

The test items form the inverted index.  Every passage of every document is a
query; its score for an item is the BM25 sum over their common terms, divided
by the item's score for its own text, so one threshold serves short and long
items.  All items above it are retrieved, and each must share the word runs of
its question and of its answer with the passage.

For each item the rarest terms that hold most of its score have postings, the
rest is charged in full.  Postings refer to blocks of items and hold the
greatest score of the term in the block.  As in WAND, the terms of a passage are
put in the order of their greatest scores: those before the pivot cannot reach
the threshold together, so a passage without a pivot is skipped, and no list is
read for it.  For the others the block maxima are added up, and only blocks
that can reach the threshold are opened and scored.  This is done for thousands
of passages at a time; nothing that could reach the threshold is skipped.

A passage is twice as long as the longest item of its index, so that every item
that stands in a text stands whole in one of its passages.  So the passages of
all items are wider if one item is long: what is found whole is found as before,
but the number of passages an item is found in, and the overlaps of items that
are found in scattered pieces, may be others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import LOWER, ODD, mix, signed, slices, word_hashes, word_spans
from furlong.llm.store import drop, keep_rows, map_batches, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.5
REST = 0.2
"""Share of an item's own score that its terms without postings hold at most."""
BLOCK = 8
GRAM = 3
OVERLAP = 0.6
"""Share of the word runs of the question, and of the answer, that the passage must have."""
INDEX_BYTES = 16 << 20
"""Test items with more text than this are indexed in parts, one after the other; statistics are those of all items."""
LEAST_PASSAGE = 64
POSTINGS_AT_ONCE = 2_000_000
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True
SENTENCE_END = re.compile(r"(?<=[.!?:])\s+|\n+")


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, for ASCII and the Latin letters of two bytes that begin with C3."""
    data = LOWER[data]
    if len(data):
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        data[after] += 0x20
    return data


def terms(text: str) -> np.ndarray:
    """Hashes of the words of one text."""
    data = plain(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), PUNCTUATION)
    return word_hashes(data, starts, ends, None)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    out = words[: max(0, len(words) - n + 1)].copy()
    for j in range(1, n):
        out = out * ODD + words[j : j + len(out)]
    return mix(out)


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, what comes before it the question.

    A text of one sentence has its last quarter of words as answer.
    """
    text = text.strip()
    cuts = [m for m in SENTENCE_END.finditer(text) if text[m.end() :].strip()]
    if cuts:
        return text[: cuts[-1].start()], text[cuts[-1].end() :]
    words = text.split()
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number, mean and greatest number of words, and the number of items that have each term."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


@dataclass(frozen=True)
class Runs:
    """Distinct word runs of the questions, or answers, of all items, end to end."""

    n: np.ndarray
    runs: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Runs":
        words = [terms(t) for t in texts]
        n = np.array([min(GRAM, max(1, len(w) // 2)) for w in words], np.int64)
        runs = [np.unique(grams(w, k)) for w, k in zip(words, n.tolist(), strict=True)]
        return cls(n, np.concatenate(runs or [np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int64))

    def overlap(self, i: int, passage: dict[int, np.ndarray]) -> float:
        """Share of item i's runs among the passage's runs of as many words."""
        own = self.runs[self.bounds[i] : self.bounds[i + 1]]
        return float(np.isin(own, passage[int(self.n[i])], assume_unique=True).mean()) if len(own) else 1.0


@dataclass(frozen=True)
class Index:
    ids: list
    vocabulary: np.ndarray
    # Terms of each item, end to end, and their shares of its score.
    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    questions: Runs
    answers: Runs
    # Postings: where those of each term begin, the blocks, their maxima; the greatest of each term.
    first: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    greatest: np.ndarray
    rest: np.ndarray
    stride: int


def build(items: list[tuple], statistics: Statistics) -> Index:
    """Index of (id, text) pairs; items without a word are left out."""
    items = [(i, t, w) for i, t in items if t and len(w := terms(t))]
    counted = [np.unique(w, return_counts=True) for _, _, w in items]
    vocabulary = np.unique(np.concatenate([t for t, _ in counted])) if items else np.zeros(0, np.uint64)
    df = statistics.df[np.searchsorted(statistics.terms, vocabulary)].astype(float)
    idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
    item_terms, item_weights, bounds = [], [], [0]
    rest = np.zeros(max(1, -(-len(items) // BLOCK)))
    posted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, ((_, _, w), (t, tf)) in enumerate(zip(items, counted, strict=True)):
        t = np.searchsorted(vocabulary, t)
        score = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / statistics.mean))
        score = score / score.sum()
        item_terms.append(t)
        item_weights.append(score)
        bounds.append(bounds[-1] + len(t))
        order = np.argsort(df[t], kind="stable")
        n = int(np.searchsorted(np.cumsum(score[order]), 1 - REST)) + 1
        posted.append((t[order[:n]], np.full(n, i // BLOCK), score[order[:n]]))
        rest[i // BLOCK] = max(rest[i // BLOCK], float(score[order[n:]].sum()))
    term, block, score = (np.concatenate([p[k] for p in posted]) if posted else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, float)))
    order = np.lexsort((block, term))
    term, block, score = term[order], block[order], score[order]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
    maxima = np.maximum.reduceat(score, new) if len(new) else np.zeros(0)
    greatest = np.zeros(len(vocabulary))
    np.maximum.at(greatest, term[new], maxima)
    halves = [question_answer(t) for _, t, _ in items]
    none = np.zeros(0)
    return Index(
        [i for i, _, _ in items], vocabulary, np.array(bounds), np.concatenate(item_terms or [none.astype(np.int64)]), np.concatenate(item_weights or [none]), Runs.of([q for q, _ in halves]), Runs.of([a for _, a in halves]),
        np.searchsorted(term[new], np.arange(len(vocabulary) + 1)), block[new], maxima, greatest, rest, max(LEAST_PASSAGE, statistics.longest),
    )


def open_blocks(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Passages and blocks whose block maxima can reach the threshold, from distinct (passage, term) rows in order of passages."""
    most_rest = float(index.rest.max())
    # Terms of each passage from the least to the greatest possible score; the pivot is where the sum can reach the threshold.
    order = np.lexsort((index.greatest[term], passage))
    passage, term = passage[order], term[order]
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    sums = np.add.reduceat(index.greatest[term], starts)
    pivoted = sums + most_rest >= threshold - 1e-9
    lengths = np.diff(np.append(starts, len(passage)))
    keep = np.repeat(pivoted, lengths)
    passage, term = passage[keep], term[keep]
    # The lists of whole passages, so many postings at a time.
    many = index.first[term + 1] - index.first[term]
    begin = 0
    total = np.cumsum(many)
    while begin < len(passage):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + POSTINGS_AT_ONCE, "right"))
        end = len(passage) if end >= len(passage) else max(int(np.searchsorted(passage, passage[end])), int(np.searchsorted(passage, passage[begin], "right")))
        some = many[begin:end]
        posting = np.repeat(index.first[term[begin:end]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        cell = np.repeat(passage[begin:end], some) * len(index.rest) + index.blocks[posting]
        order = np.argsort(cell, kind="stable")
        cell, score = cell[order], index.maxima[posting][order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        if len(first):
            block = cell[first] % len(index.rest)
            live = np.add.reduceat(score, first) + index.rest[block] >= threshold - 1e-9
            yield from zip((cell[first][live] // len(index.rest)).tolist(), block[live].tolist(), strict=True)
        begin = end


def search(index: Index, data: np.ndarray, bounds: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, float, float, float]]:
    """Text, item, first word of the passage, score, overlap of question and answer, for all that pass.

    A passage is two strides of words; a stride has the words of the longest
    item, so an item in a text is whole in some passage.
    """
    if not index.ids:
        return
    data = plain(data)
    starts, ends, texts = word_spans(data, bounds, PUNCTUATION)
    if not len(starts):
        return
    hashes = word_hashes(data, starts, ends, None)
    found = np.searchsorted(index.vocabulary, hashes).clip(max=len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[found] == hashes)
    term = found[known]
    # Strides: numbered through all texts, each text beginning a new one; a passage has the number of its first.
    n_words = np.bincount(texts, minlength=len(bounds) - 1)
    word_base = np.cumsum(n_words) - n_words
    n_strides = -(-n_words // index.stride)
    stride_base = np.cumsum(n_strides) - n_strides
    stride_text = np.repeat(np.arange(len(n_words)), n_strides)
    # The last stride of a text is a passage only if it is the only one.
    single = (n_strides == 1)[stride_text]
    last = np.append(stride_text[1:] != stride_text[:-1], True)
    posted = index.greatest[term] > 0
    stride = stride_base[texts[known[posted]]] + (known[posted] - word_base[texts[known[posted]]]) // index.stride
    second = stride > stride_base[stride_text[stride]]
    passage = np.concatenate((stride, stride[second] - 1))
    posted_term = np.concatenate((term[posted], term[posted][second]))
    whole = ~last[passage] | single[passage]
    rows = np.unique(passage[whole] * len(index.vocabulary) + posted_term[whole])
    if not len(rows):
        return
    at, have, runs = -1, None, None
    for p, b in open_blocks(index, rows // len(index.vocabulary), rows % len(index.vocabulary), threshold):
        if p != at:
            at, runs = p, None
            first = word_base[stride_text[p]] + (p - stride_base[stride_text[p]]) * index.stride
            end = min(first + 2 * index.stride, word_base[stride_text[p]] + n_words[stride_text[p]])
            have = np.zeros(len(index.vocabulary), bool) if have is None else have
            mine = term[np.searchsorted(known, first) : np.searchsorted(known, end)]
        have[mine] = True
        for i in range(b * BLOCK, min((b + 1) * BLOCK, len(index.ids))):
            own = slice(index.bounds[i], index.bounds[i + 1])
            score = float(index.weights[own][have[index.terms[own]]].sum())
            if score >= threshold:
                if runs is None:
                    runs = {n: np.unique(grams(hashes[first:end], n)) for n in range(1, GRAM + 1)}
                question, answer = index.questions.overlap(i, runs), index.answers.overlap(i, runs)
                if question >= OVERLAP and answer >= OVERLAP:
                    yield int(stride_text[p]), i, int(first - word_base[stride_text[p]]), score, question, answer
        have[mine] = False


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = INDEX_BYTES) -> Iterator[Index]:
    """One index, or several if the items have more text than ``limit`` bytes; each fits in memory.

    Numbers of items and words, and of items that have a term, are counted over
    all items, so scores do not depend on the parts.
    """
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        words = [terms(t) for t in batch.column("text").to_pylist()]
        yield {"id": batch.column("id"), "text": batch.column("text"), "n": [len(w) for w in words], "terms": [signed(np.unique(w)) for w in words]}

    counted = stored(map_batches(rows, count, "id long, text string, n long, terms array<long>").where("n > 0"), "test-items")
    all_items = counted.agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.sum(F.octet_length("text")).alias("size")).first()
    n = max(1, -(-(all_items["size"] or 0) // limit))
    df = stored(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    for k in range(n):
        some = counted if n == 1 else counted.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        # Both hold no more than the text of one part.
        known = (df if n == 1 else df.join(some.select(F.explode("terms").alias("term")).distinct(), "term")).toPandas()
        names = known["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(names)
        statistics = Statistics(all_items["n"], (all_items["words"] or 0) / max(1, all_items["n"]), all_items["longest"] or 0, names[order], known["df"].to_numpy(np.int64)[order])
        yield build([(r["id"], r["text"]) for r in some.select("id", "text").orderBy("id", "text").collect()], statistics)
    drop(counted, df)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """Test items found in documents: doc_id, item_id, passages, score, question_overlap, answer_overlap.

    One row for each document and item, with the number of passages and their
    best values.  Whole texts of any length are searched.  Null texts, null items
    and items without words match nothing; rows that repeat an id are searched
    each, and counted together; empty tables give no rows; other columns are not
    read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in indexes(items, limit=limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            for part, data, bounds in slices(batch, "text"):
                found = list(search(shared.value, data, bounds, threshold))
                ids = part.column("doc_id").to_pylist()
                yield {
                    "doc_id": [ids[f[0]] for f in found], "item_id": [shared.value.ids[f[1]] for f in found], "first_word": [f[2] for f in found],
                    "score": [f[3] for f in found], "question_overlap": [f[4] for f in found], "answer_overlap": [f[5] for f in found],
                }

        some = map_batches(rows, run, "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double")
        out = some if out is None else out.union(some)
    return out.groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """The documents in which no test item is found, with all their columns, which may have any names; rows are filtered where they are.

    Null and empty texts, and texts without words, hold no item and stay; texts
    of any length are searched whole; each row, repeated ones and null ids too,
    is judged by itself; an empty table stays empty, and without items all stay.
    """
    for index in indexes(items, limit=limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(data: np.ndarray, bounds: np.ndarray, shared=shared) -> np.ndarray:
            good = np.ones(len(bounds) - 1, bool)
            good[[f[0] for f in search(shared.value, data, bounds, threshold)]] = False
            return good

        docs = keep_rows(docs, text_col, clean)
    return docs
