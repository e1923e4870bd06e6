"""Remove long byte strings that occurred before, by sorting sampled suffixes.

Sorting the suffix at every byte would move the corpus many times over, so the
suffixes are sampled by content.  Of the k-grams in a string of ``length``
bytes, the one with the least hash is its anchor; equal strings have equal
anchors.  Consecutive strings with one anchor form a block, and the suffix that
starts there is known by two leading tokens: the hash of the anchor and the
hash of all bytes that the block's strings cover.

1.  The suffixes are range-partitioned by their leading tokens (Spark samples
    the splitters), each bucket is sorted by multikey quicksort, and
    neighbours are compared, also across the boundaries of buckets.  A block
    equal to an earlier one is a repeat as a whole.
2. Where blocks share an anchor but differ, strings of one may still occur in
    another: only these few blocks are looked at string by string.

Equality is that of hashes: of two independent ones of 64 bits for strings, of
one for blocks with the same anchor.  Of m different blocks of an anchor two
are taken for equal with a chance of m * m / 2 ** 65: of a million one in 40
million, and a corpus has few anchors with so many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import BYTE_HASH, ODD, mix, powers, seeded, signed, slices
from furlong.llm.store import drop, map_batches, stored

GRAM = 24
"""Bytes in a k-gram; at most the length of a string that counts as a repeat."""
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
BUCKET_ROWS = 400_000
"""Suffixes aimed at for a bucket; sets the number of buckets, not their contents."""
LOCAL_BLOCKS = 2_000
"""Differing blocks with one anchor that a single task compares; larger groups are sorted over all buckets."""


OTHER_HASH = seeded(256, 2)
"""Byte values of a second hash, independent of the first."""


class RunningHash:
    """Hashes of substrings of one byte array, from sums of its prefixes."""

    def __init__(self, data: np.ndarray, letters: np.ndarray = BYTE_HASH):
        values = letters[data]
        values *= powers(ODD, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def all_of(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.back[: len(out)]
        return mix(out)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def blocks(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, block hash, text, start in the text and number of strings of each block."""
    gram = min(GRAM, length)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    running = RunningHash(data)
    grams = running.all_of(gram)
    least = sliding_least(grams, length - gram + 1)
    change = np.zeros(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    # Where the leftmost least k-gram drops out of sight, an equal one further on is another anchor.
    change[1:] |= grams[: len(least)] == least
    change[0] = change[-1] = True
    # A string may not cross texts: cut where texts begin and where their last string has begun.
    sizes = np.diff(bounds)
    change[bounds[bounds <= len(least)]] = True
    change[(bounds[:-1] + np.maximum(sizes - length + 1, 0)).clip(max=len(least))] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    texts = np.searchsorted(bounds, starts, "right") - 1
    whole = starts + length <= bounds[texts + 1]
    starts, ends, texts = starts[whole], ends[whole], texts[whole]
    return signed(least[starts]), signed(running.of(starts, ends + length - 1)), texts, starts - bounds[texts], ends - starts


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """Order of rows by several columns: quicksort by the first, then only the ties by the next, and so on."""
    order = np.argsort(columns[0], kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = columns[0][order[1:]] == columns[0][order[:-1]]
    for column in columns[1:]:
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            break
        rows = order[at]
        run = np.cumsum(~tied[at])
        rows = rows[np.lexsort((column[rows], run))]
        order[at] = rows
        same = np.zeros(len(at), bool)
        same[1:] = (column[rows[1:]] == column[rows[:-1]]) & tied[at[1:]]
        tied[at] = same
    return order


SORTED = "bucket int, head long, rest long, doc_id long, start int, n int, again boolean, mixed boolean, edge boolean"


def sorted_suffixes(suffixes: DataFrame) -> DataFrame:
    """Sort suffixes (head, rest, doc_id, start, n) and mark them: again, mixed.

    again: an earlier suffix (smaller doc_id, or start) has the same two
    tokens.  mixed: suffixes with this head differ in rest.  Rows whose head
    occurs once are left out, but for some at the ends of buckets.
    """
    from pyspark import TaskContext

    n = max(1, -(-suffixes.count() // BUCKET_ROWS))
    placed = suffixes.repartitionByRange(n, "head", "rest", "doc_id", "start")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        head, rest, doc, start, size = (table.column(c).to_numpy() for c in ("head", "rest", "doc_id", "start", "n"))
        at = multikey_order(head, rest, doc, start)
        head, rest, doc, start, size = head[at], rest[at], doc[at], start[at], size[at]
        new_head = np.concatenate(([True], head[1:] != head[:-1]))
        new_block = new_head | np.concatenate(([True], rest[1:] != rest[:-1]))
        first = np.flatnonzero(new_block)[np.cumsum(new_block) - 1]
        again = ~new_block & ((doc != doc[first]) | (start != start[first]))
        group = np.cumsum(new_head) - 1
        mixed = (np.bincount(group, new_block) > 1)[group]
        keep = (np.bincount(group) > 1)[group] | (group == 0) | (group == group[-1])
        # The first row, and that of the last block, are compared with other buckets.
        edge = np.zeros(len(head), bool)
        edge[0] = edge[first[-1]] = True
        bucket = np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, head[keep], rest[keep], doc[keep], start[keep].astype(np.int32), size[keep].astype(np.int32), again[keep], mixed[keep], edge[keep])], [x.split()[0] for x in SORTED.split(", ")])

    return across_boundaries(stored(placed.mapInArrow(order, SORTED), "sorted-suffixes"))


def across_boundaries(table: DataFrame) -> DataFrame:
    """Correct again and mixed by what other buckets hold of the first and last heads and blocks of each.

    A block that lies in several buckets is the first or the last of each, so the
    earliest of its edge rows is the earliest of all; a head is mixed if it is in
    any bucket or if its edge rows differ in rest.
    """
    edges = table.where("edge").select("bucket", "head", "rest", "doc_id", "start", "mixed")
    heads = edges.groupBy("head").agg((F.max("mixed") | (F.min("rest") < F.max("rest"))).alias("any_mixed"), (F.min("bucket") < F.max("bucket")).alias("wide")).where("wide").drop("wide")
    blocks = edges.groupBy("head", "rest").agg(F.min(F.struct("doc_id", "start")).alias("origin"), (F.min("bucket") < F.max("bucket")).alias("wide")).where("wide").drop("wide")
    ends = edges.groupBy("bucket").agg(F.min(F.struct("head", "rest")).alias("f"), F.max("head").alias("l_head")).select("bucket", F.col("f.head").alias("f_head"), F.col("f.rest").alias("f_rest"), "l_head")
    fixes = ends.join(heads.select(F.col("head").alias("f_head"), F.col("any_mixed").alias("f_mixed")), "f_head", "left").join(heads.select(F.col("head").alias("l_head"), F.col("any_mixed").alias("l_mixed")), "l_head", "left")
    fixes = fixes.join(blocks.select(F.col("head").alias("f_head"), F.col("rest").alias("f_rest"), "origin"), ["f_head", "f_rest"], "left").where("f_mixed or l_mixed or origin is not null")
    fixed = table.join(stored(fixes, "boundaries"), "bucket", "left")
    no = F.lit(False)
    first = (F.col("head") == F.col("f_head")) & (F.col("rest") == F.col("f_rest")) & (F.struct("doc_id", "start") > F.col("origin"))
    mixed = (F.col("f_mixed") & (F.col("head") == F.col("f_head"))) | (F.col("l_mixed") & (F.col("head") == F.col("l_head")))
    return fixed.select("bucket", "head", "rest", "doc_id", "start", "n", (F.col("again") | F.coalesce(first, no)).alias("again"), (F.col("mixed") | F.coalesce(mixed, no)).alias("mixed"))


def repeated_strings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Starts of all strings of ``length`` bytes that also start earlier: doc_id, start, n (n starts in a row).

    Earlier means in a document of a smaller id, or before in the same one.
    Null ids are left out; rows that repeat an id are the same document, so
    bytes at one place of theirs are no repeats of each other.  Null and short
    texts have none, texts of any length are read whole; an empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def sample(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, data, bounds in slices(batch, "text", 1 << 20):
            head, rest, texts, starts, n = blocks(data, bounds, length)
            yield {"head": head, "rest": rest, "doc_id": part.column("doc_id").to_numpy()[texts], "start": starts, "n": n}

    suffixes = stored(map_batches(rows, sample, "head long, rest long, doc_id long, start int, n int"), "suffixes")
    marked = sorted_suffixes(suffixes)
    whole = stored(marked.where("again").select("doc_id", "start", "n"), "repeated-blocks")
    open_blocks = stored(marked.where("mixed and not again").select("head", "doc_id", "start", "n"), "open-blocks")
    drop(suffixes)

    # The bytes of blocks that share an anchor with a different block.
    asked = open_blocks.groupBy("doc_id").agg(F.collect_list(F.struct("head", "start", "n")).alias("asked"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            text = memoryview(text.as_buffer()) if text.is_valid else b""
            yield {"head": [a["head"] for a in asked], "doc_id": [doc] * len(asked), "start": [a["start"] for a in asked], "n": [a["n"] for a in asked], "bytes": pa.array([bytes(text[a["start"] : a["start"] + a["n"] + length - 1]) for a in asked], pa.binary())}

    taken = stored(map_batches(rows.join(asked, "doc_id").select("doc_id", "text", "asked"), cut, "head long, doc_id long, start int, n int, bytes binary"), "block-bytes")
    crowded = stored(taken.groupBy("head").agg(F.count("*").alias("many")).where(F.col("many") > LOCAL_BLOCKS).select("head"), "crowded")

    def strings(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Two hashes, document and place of every string of these blocks."""
        data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
        n = rows.column("n").to_numpy().astype(np.int64)
        base = np.concatenate(([0], np.cumsum(n + length - 1)[:-1]))
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(base, n) + inner
        one, two = (signed(RunningHash(data, letters).of(at, at + length)) for letters in (BYTE_HASH, OTHER_HASH))
        return one, two, np.repeat(rows.column("doc_id").to_numpy(), n), np.repeat(rows.column("start").to_numpy(), n) + inner

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by head: groups are taken together until there is enough to do."""

        def compare(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            one, two, doc, start = strings(pa.concat_batches(some))
            at = multikey_order(one, two, doc, start)
            one, two, doc, start = one[at], two[at], doc[at], start[at]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ((doc != doc[first]) | (start != start[first]))
            doc, start = doc[again], start[again]
            at = np.lexsort((start, doc))
            doc, start = doc[at], start[at]
            cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1), [True])) if len(doc) else np.zeros(1, bool)
            at = np.flatnonzero(cut[:-1])
            last = np.flatnonzero(cut[1:])
            return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(start[at].astype(np.int32)), pa.array((start[last] - start[at] + 1).astype(np.int32))], ["doc_id", "start", "n"])

        held, size = [], 0
        for batch in batches:
            heads = batch.column("head").to_numpy()
            edges = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1), len(heads)]
            if held and len(heads) and held[-1].column("head")[-1].as_py() != heads[0] and size > 50_000:
                yield compare(held)
                held, size = [], 0
            begin = 0
            strings_to = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy().astype(np.int64))))
            for edge in edges[1:-1]:
                if size + strings_to[edge] - strings_to[begin] > 500_000:
                    held.append(batch.slice(begin, edge - begin))
                    yield compare(held)
                    held, size, begin = [], 0, edge
            if begin < len(heads):
                held.append(batch.slice(begin))
                size += int(strings_to[-1] - strings_to[begin])
        if held:
            yield compare(held)

    few = taken.join(F.broadcast(crowded), "head", "left_anti") if crowded.count() <= 100_000 else taken.join(crowded, "head", "left_anti")
    parts = few.repartition("head").sortWithinPartitions("head").mapInArrow(locally, "doc_id long, start int, n int")

    def spread(batch: pa.RecordBatch) -> Iterator[dict]:
        for first in range(0, batch.num_rows, 2_000):
            one, two, doc, start = strings(batch.slice(first, 2_000))
            yield {"head": one, "rest": two, "doc_id": doc, "start": start, "n": np.ones(len(one), np.int32)}

    many = taken.join(crowded, "head", "left_semi")
    hot = stored(map_batches(many, spread, "head long, rest long, doc_id long, start int, n int"), "crowded-strings")
    found = stored(whole.union(parts).union(sorted_suffixes(hot).where("again").select("doc_id", "start", "n")), "repeats")
    drop(whole, open_blocks, taken, hot)
    return found


def remove_repeats(docs: DataFrame, length: int = 100, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every byte covered by a string of ``length`` bytes that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and
    end of each run removed) and, if asked for, kept (the remaining bytes, which
    may begin or end inside a character).  Null texts count as empty; a text
    shorter than ``length`` loses nothing; rows with a null id lose nothing.
    Equal texts of different ids lose all but the first; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    found = repeated_strings(docs, length, id_col, text_col)
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
            text = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            spans = merge(found, length, len(text))
            kept = b"".join(text[i:j] for i, j in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True)) if spans else bytes(text)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
            out["kept"].append(kept)
        yield out | {"doc_id": batch.column("doc_id")}

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: int, end: int>>, kept binary" * keep
    return map_batches(rows.join(lists, "doc_id", "left").select("doc_id", "text", "found"), cut, kind)


def merge(found: pa.Scalar, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start at these places."""
    if not found.is_valid or not len(found.values):
        return []
    start, n = (np.asarray(x).astype(np.int64) for x in found.values.flatten())
    order = np.argsort(start, kind="stable")
    start = start[order]
    end = np.minimum(np.maximum.accumulate(start + n[order] + length - 1), size)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:], [True]))].tolist(), strict=True))
