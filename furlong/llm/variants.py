"""Spelling variants of words, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by one
up, one down, or one of each, so near words lie within an L1 distance of two.
Words are held by length: those of one length in the leaves of a k-d tree, whose
upper part (fitted on a bounded sample, and applied to every word) deals them to
cells that tasks take one at a time, and whose lower part is built in the task.
Searches run for the pairs of lengths (L, L) and (L, L - 1); boxes that would
take more than one letter up or down are left out, and the order of letters is
verified in the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.store import drop, map_batches, stored

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
LETTERS = 26 + 64
"""a to z, and U+00C0 to U+00FF; a word has the Latin-1 bytes of its letters."""
CELL = 32_768
"""Words of a cell, about."""
LEAF = 32
SAMPLE = 200_000
"""Words on which the upper trees are fitted at most, of all lengths together."""
DIM = np.zeros(256, np.int64)
DIM[97:123] = np.arange(26)
DIM[192:256] = 26 + np.arange(64)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of each letter in words of one length, given as rows of bytes."""
    n = len(letters)
    at = np.arange(n)[:, None] * LETTERS + DIM[letters]
    return np.bincount(at.ravel(), minlength=n * LETTERS).reshape(n, LETTERS).astype(np.int32)


def letters_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


@dataclass
class Node:
    """A split (counts of letter ``dim`` up to ``most`` go left), or a leaf with its rows."""

    dim: int = -1
    most: int = 0
    left: Node | None = None
    right: Node | None = None
    rows: np.ndarray | None = None
    leaf: int = -1
    only: np.ndarray | None = None
    """The one vector of a leaf that is too large and can't be split."""
    parts: int = 1


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """Letter and count that part vectors most evenly; none if they are equal."""
    low, high = vectors.min(0), vectors.max(0)
    if (low == high).all():
        return None
    best = (-1.0, 0, 0)
    for t in range(int(low.min()), min(int(high.max()), int(low.min()) + 4)):
        share = (vectors > t).mean(0)
        even = np.minimum(share, 1 - share)
        if even.max() > best[0]:
            best = (float(even.max()), int(even.argmax()), t)
    if best[0] > 0.02:
        return best[1:]
    dim = int((high - low).argmax())
    return dim, min(int(np.median(vectors[:, dim])), int(high[dim]) - 1)


def grow(vectors: np.ndarray, size: float, weight: float = 1.0) -> Node:
    """A tree whose leaves have about ``size`` vectors, each of which stands for ``weight``."""
    root = Node(rows=np.arange(len(vectors)))
    stack, leaves = [root], 0
    while stack:
        node = stack.pop()
        split = best_split(vectors[node.rows]) if len(node.rows) * weight > size else None
        if split is None:
            node.leaf, leaves = leaves, leaves + 1
            if len(node.rows) * weight > 2 * size:
                node.only, node.parts = vectors[node.rows[0]], math.ceil(len(node.rows) * weight / size)
            continue
        node.dim, node.most = split
        right = vectors[node.rows, node.dim] > node.most
        node.left, node.right = Node(rows=node.rows[~right]), Node(rows=node.rows[right])
        node.rows = None
        stack += [node.right, node.left]
    return root


def search(root: Node, queries: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves whose boxes can be reached from some queries, by at most so many letters up and down, with those queries."""
    none = np.zeros(len(queries), np.int32)
    stack = [(root, np.arange(len(queries)), none, none, {})]
    while stack:
        node, rows, ups, downs, box = stack.pop()
        if node.left is None:
            yield node, rows
            continue
        low, high = box.get(node.dim, (0, 1 << 30))
        q = queries[rows, node.dim]
        for child, edge in ((node.left, (low, min(high, node.most))), (node.right, (max(low, node.most + 1), high))):
            u = ups - np.maximum(low - q, 0) + np.maximum(edge[0] - q, 0)
            d = downs - np.maximum(q - high, 0) + np.maximum(q - edge[1], 0)
            at = np.flatnonzero((u <= up[rows]) & (d <= down[rows]))
            if len(at):
                stack.append((child, rows[at], u[at], d[at], {**box, node.dim: edge}))


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of a and b (equal lengths), which differ in one letter."""
    return (a[:, None] != b[None]).sum(2, dtype=np.int32) == 1


def shortened(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of a and b (shorter by one), which become equal by deleting a letter."""
    start = np.logical_and.accumulate(a[:, None, :-1] == b[None], axis=2).sum(2, dtype=np.int32)
    end = np.logical_and.accumulate((a[:, None, 1:] == b[None])[:, :, ::-1], axis=2).sum(2, dtype=np.int32)
    return start + end >= b.shape[1]


def candidates(word: bytes, change: np.ndarray) -> set[bytes]:
    """What one edit makes of a word, given by how much each letter's count changes: one letter less, or one for another."""
    fewer, more = np.flatnonzero(change < 0), np.flatnonzero(change > 0)
    if len(fewer) != 1 or len(more) > 1 or change[fewer[0]] != -1 or len(more) and change[more[0]] != 1:
        return set()
    byte = lambda dim: bytes([97 + dim if dim < 26 else 166 + dim])
    old, new = byte(int(fewer[0])), byte(int(more[0])) if len(more) else b""
    return {word[:i] + new + word[i + 1 :] for i in range(len(word)) if word[i : i + 1] == old}


def near_pairs(points: list[bytes], same: list[bytes], longer: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in same + longer, place in points) of near words; points have one length, longer words one letter more."""
    none = np.zeros(0, np.int64)
    if not points or not same and not longer:
        return none, none
    p = letters_of(points)
    vectors = letter_counts(p)
    root = grow(vectors, LEAF)
    sides = [letters_of(side) if side else None for side in (same, longer)]
    queries = np.concatenate([letter_counts(x) for x in sides if x is not None])
    is_longer = np.arange(len(queries)) >= len(same)
    words = [*same, *longer]
    left, right = [none], [none]
    for node, rows in search(root, queries, np.where(is_longer, 0, 1), np.ones(len(queries), np.int64)):
        if node.only is not None:
            # All have the same letters: the query's letters tell which one goes and which one comes.
            names = {points[i]: i for i in node.rows}
            found = [(q, names[w]) for q in rows.tolist() for w in candidates(words[q], node.only - queries[q]) if w in names]
            if found:
                left.append(np.array([x for x, _ in found]))
                right.append(np.array([x for _, x in found]))
            continue
        for side, verify, first in ((0, replaced, 0), (1, shortened, len(same))):
            mine = rows[is_longer[rows] == bool(side)]
            step = max(1, (4 << 20) // (len(node.rows) * p.shape[1]))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                a, b = np.nonzero(verify(sides[side][part - first], p[node.rows]))
                if len(a):
                    left.append(part[a])
                    right.append(node.rows[b])
    return np.concatenate(left), np.concatenate(right)


def best_of(owner: np.ndarray, near: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner the number of its near words and the one of largest n, of equals the first in rank."""
    order = np.lexsort((rank[near], -n[near], owner))
    owner, near = owner[order], near[order]
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return owner[start], np.diff(np.append(start, len(owner))), near[start]


@dataclass
class Dealer:
    """Upper trees by length; a length without one has a single cell."""

    trees: dict[int, Node] = field(default_factory=dict)

    def cells(self, words: list[bytes], length: int, searching: bool) -> Iterator[tuple[int, int, list[int]]]:
        """Cell, part and words: where words of one length lie, or where those near them of the given length may lie."""
        tree = self.trees.get(length)
        if tree is None:
            yield 0, 0, list(range(len(words)))
            return
        vectors = letter_counts(letters_of(words))
        reach = np.zeros(len(words), np.int64)
        up = reach + (searching and len(words[0]) == length)
        for node, rows in search(tree, vectors, up, reach + searching):
            if node.only is None:
                yield node.leaf, 0, rows.tolist()
                continue
            # Words of one vector are dealt to parts by a hash, and searched where their candidates would lie.
            parts: dict[int, list[int]] = {}
            for i in rows.tolist():
                if searching:
                    to = {0} | {part_of(w, node.parts) for w in candidates(words[i], node.only - vectors[i])}
                else:
                    to = {part_of(words[i], node.parts) if (vectors[i] == node.only).all() else 0}
                for part in to:
                    parts.setdefault(part, []).append(i)
            for part, members in parts.items():
                yield node.leaf, part, members


def part_of(word: bytes, parts: int) -> int:
    """Part 1 to ``parts`` of a word among those with the same letters."""
    h = 0
    for b in word:
        h = (h * 1_000_003 + b + 1) & 0xFFFFFFFFFFFF
    return 1 + h % parts


def fit(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> Dealer:
    """Upper trees for the lengths with more than ``cell`` words, from at most about ``sample`` words of them."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}
    if not sizes:
        return Dealer()
    share = min(1.0, sample / sum(sizes.values()))
    taken = words.where(F.length("word").isin(*sizes)).where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    by_length: dict[int, list[bytes]] = {}
    for row in taken.select("word").collect():
        by_length.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
    return Dealer({n: grow(letter_counts(letters_of(sorted(w))), cell, sizes[n] / len(w)) for n, w in by_length.items()})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: int = LEAST_COUNT) -> DataFrame:
    """Words of the texts and how often they occur: word, n; see ``variants``."""
    # The letters A to Z that are lower-cased.
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, upper.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    rows = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, spoilt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """Number of near words of each word that has any, and the one of largest n: word, n_near, near, near_n.

    words: word (of the letters above, in lower case), n; each word once.
    """
    shared = words.sparkSession.sparkContext.broadcast(fit(words, cell))

    def deal(batch: pa.RecordBatch) -> Iterator[dict]:
        dealer = shared.value
        raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        n = batch.column("n").to_numpy()
        lengths = np.array([len(w) for w in raw])
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            mine = [raw[i] for i in at]
            for of, searching in ((length, False), (length, True), (length - 1, True)):
                for leaf, part, members in dealer.cells(mine, of, searching):
                    k = len(members)
                    yield {
                        "length": np.full(k, of, np.int32), "leaf": np.full(k, leaf, np.int32), "part": np.full(k, part, np.int32), "side": np.full(k, 0 if not searching else 1 if of == length else 2, np.int32),
                        "word": [mine[i] for i in members], "n": n[at[members]],
                    }

    dealt = map_batches(words.select("word", "n"), deal, "length int, leaf int, part int, side int, word binary, n long")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        raw, n, side = table.column("word").to_pylist(), table.column("n").to_numpy(), side[order]
        first, second = np.searchsorted(side, [1, 2])
        q, p = near_pairs(raw[:first], raw[first:second], raw[second:])
        q = q + first
        # A pair of equal lengths is found from either word, one of two lengths from the longer one only.
        back = q >= second
        owner, near = np.concatenate((q, p[back])), np.concatenate((p, q[back]))
        rank = np.empty(len(raw), np.int64)
        rank[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
        who, k, best = best_of(owner, near, n, rank)
        text = lambda rows: pa.array([raw[i].decode("latin-1") for i in rows], pa.string())
        return pa.table({"word": text(who), "n_near": pa.array(k, pa.int64()), "near": text(best), "near_n": pa.array(n[best], pa.int64())})

    parts = dealt.groupBy("length", "leaf", "part").applyInArrow(compare, "word string, n_near long, near string, near_n long")
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("b"))
    return found.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.rank")).alias("near_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, cell: int = CELL) -> DataFrame:
    """Words with their forms: word, form, root, n, n_near, form_n.

    A word is a run of letters a to z and U+00C0 to U+00FF in a text whose A to Z
    are lower-cased, some of them spoilt by a missing letter (by a checksum of id
    and run), if it has at least ``LEAST_LENGTH`` letters and occurs twice.  Its
    form is the near word of largest n, the first of equals, if that occurs
    ``times`` as often.  root follows forms to the last one.

    Null texts have no words, a null id counts as empty text; repeated rows count
    each; texts and words of any length are taken whole; an empty table gives no
    rows; other columns are not read.
    """
    words = stored(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, cell)
    ok = F.col("near_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("near")).alias("form"), F.when(ok, F.col("near_n")).alias("form_n"))
    rows = stored(rows, "forms")
    drop(words)
    # Each step multiplies n, so chains are short, and each join doubles what has been followed.
    most = rows.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = max(1, math.floor(math.log(most, times) + 1e-9))
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    links = roots
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
