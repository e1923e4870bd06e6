"""Links inside buckets, and connected components, with no pass over all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.store import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """Component of each end of the given edges (a, b): a stored table of id, component (its smallest id).

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    joins a node's neighbours to the least of them, first the larger ones, then
    the smaller ones, until every tree is a star.  Minima are taken by partial
    aggregates.  The joins have one row for a node on their other side, so Spark
    can split the rows of a node with very many neighbours between tasks.  Loops
    and null ends are dropped; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    while True:
        both = now.union(now.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")), "large-star")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        small = stored(small.where("x <> y").distinct(), "small-star")
        drop(now, large)
        now = small
        ends = now.select(F.col("x").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(now.select("y", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child > 1 or child = 1 and root = 1").limit(1).count():
            break
    roots = now.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    out = stored(now.select(F.col("x").alias("id"), F.col("y").alias("component")).union(roots), "components")
    drop(now)
    return out


MEMBERS = "bucket long, id long, sig long, head long, head_sig long"


SMALL = 64
"""Rows of a bucket that are compared with each other while it is read."""
WIDER = 32
SPARSE = 4
"""Near pairs for each id up to which those of a bucket of medium size are returned as they are."""


def pairs_in_buckets(members: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], small: int = SMALL, least: bool = True) -> DataFrame:
    """Pairs of ids with near sigs that share a bucket: bucket, id, sig, head, head_sig, first, big.

    Rows (bucket, id, sig) are sorted by bucket and read as a stream.  In buckets
    of up to ``SMALL`` ids all pairs are compared, and head is the other id of a
    near one; first marks one near pair for each id, which are enough to connect
    a group of ids that are all near each other.  So they are in buckets of up to
    ``small``, if no more than ``SPARSE`` pairs for each id are near.  All members of other buckets
    are returned, with big set and the bucket's least id as head, for
    ``bucket_links``.  Rows that repeat a bucket and an id count once.  Without
    ``least``, rows are sorted by their bucket alone, which Spark does by its
    digits; in large buckets head is any one id then, and rows may be repeated.
    """
    names = ["bucket", "id", "sig", "head", "head_sig", "first", "big"]

    def out(columns: list[np.ndarray], first: np.ndarray, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(first), pa.array(np.full(len(first), big))], names)

    def small_pairs(bucket: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        alone = np.ones(len(ids), bool)
        # From the farthest on, so that the first pair of an id leads to the least one and groups are stars rather than chains.
        longest = int(np.diff(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))).max())
        for k in range(longest - 1, 0, -1):
            at = np.flatnonzero(bucket[k:] == bucket[:-k])
            at = at[near(sig[at], sig[at + k])]
            if len(at):
                yield out([bucket[at], ids[at + k], sig[at + k], ids[at], sig[at]], alone[at + k], False)
                alone[at + k] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        head = None  # bucket, id and sig of the head of a large bucket that goes on
        for batch in _with_end(batches):
            bucket, ids, sig = held if batch is None else (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, names, strict=False))
            if not len(bucket):
                continue
            # Most rows are alone in their bucket; the last bucket may go on, and the first be the rest of a large one.
            met = np.append(bucket[1:] == bucket[:-1], True)
            met[1:] |= met[:-1]
            met[0] |= head is not None and head[0] == bucket[0]
            bucket, ids, sig = bucket[met], ids[met], sig[met]
            order = np.lexsort((ids, bucket))
            bucket, ids, sig = bucket[order], ids[order], sig[order]
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])
            bucket, ids, sig = bucket[new], ids[new], sig[new]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            lengths = np.diff(np.append(starts, len(bucket)))
            large = lengths > small
            large[0] |= head is not None and head[0] == bucket[0]
            heads = [x[starts] for x in (ids, sig)]
            if head is not None and head[0] == bucket[0]:
                heads[0][0], heads[1][0] = head[1:]
            # The last bucket may go on in the next batch.
            goes_on = large[-1]
            open_end = batch is not None and not goes_on
            end = starts[-1] if open_end else len(bucket)
            # Of buckets of medium size those with few near pairs are done with; the others are large.
            sparse = np.zeros(len(starts), bool)
            for k in np.flatnonzero((lengths > SMALL) & ~large & (starts < end)):
                i, j = starts[k], starts[k] + lengths[k]
                later, before = np.nonzero(np.tril(near(sig[i:j, None], sig[None, i:j]), -1))
                sparse[k] = len(later) <= SPARSE * lengths[k]
                if sparse[k] and len(later):
                    yield out([bucket[i + later], ids[i + later], sig[i + later], ids[i + before], sig[i + before]], np.diff(later, prepend=-1) > 0, False)
            large[: len(starts) - open_end] |= (lengths > SMALL)[: len(starts) - open_end]
            big = np.repeat(large & ~sparse, lengths)
            at = np.flatnonzero(big[:end])
            if len(at):
                group = np.repeat(np.arange(len(starts)), lengths)[at]
                yield out([bucket[at], ids[at], sig[at], heads[0][group], heads[1][group]], np.zeros(len(at), bool), True)
            at = np.flatnonzero((~big & np.repeat((lengths > 1) & ~sparse, lengths))[:end])
            if len(at):
                yield from small_pairs(bucket[at], ids[at], sig[at])
            head = (bucket[-1], heads[0][-1], heads[1][-1]) if goes_on else None
            held = [x[end:] for x in (bucket, ids, sig)]

    placed = members.select("bucket", "id", "sig").repartition("bucket").sortWithinPartitions(*["bucket", "id"][: 1 + least])
    return placed.mapInArrow(run, MEMBERS + ", first boolean, big boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def colliding(members: DataFrame) -> DataFrame:
    """Members (bucket, id, sig) of buckets with two rows or more, with the least id of the bucket as head.

    Rows are sorted by bucket and read as a stream, whatever a bucket's size.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = head_sig = None
        before = 0
        for batch in batches:
            bucket, ids, sig = (batch.column(c).to_numpy() for c in ("bucket", "id", "sig"))
            if not len(bucket):
                continue
            new = np.concatenate(([bucket[0] != last], bucket[1:] != bucket[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), -1))
            carried = first < 0
            place = np.where(carried, before + np.arange(len(bucket)), np.arange(len(bucket)) - first)
            heads, head_sigs = ids[first], sig[first]
            if carried.any():
                heads[carried], head_sigs[carried] = head, head_sig
            at = np.concatenate((np.flatnonzero(place > 0), second := np.flatnonzero(place == 1)))
            if len(at):
                out = [bucket[at], ids[at], sig[at], heads[at], head_sigs[at]]
                # The heads themselves, each with its second row.
                n = len(at) - len(second)
                out[1][n:], out[2][n:] = heads[second], head_sigs[second]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["bucket", "id", "sig", "head", "head_sig"])
            last, head, head_sig, before = bucket[-1], heads[-1], head_sigs[-1], int(place[-1]) + 1

    placed = members.select("bucket", "id", F.col("sig").cast("long").alias("sig")).repartition("bucket").sortWithinPartitions("bucket", "id")
    return placed.mapInArrow(keep, MEMBERS)


def bucket_links(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], screen: Callable[[Column, Column], Column], finish: Callable[[DataFrame], DataFrame] | None = None, sure: bool = False) -> DataFrame:
    """True links that connect all ids which any true link inside a bucket connects.

    members: a stored result of ``colliding``.  screen: a cheap condition on two
    sigs.  confirm: from pairs (a, b) to those truly linked.

    First every bucket's head is compared with its other members, then the
    member whose buckets hold most rows, since the text that others were copied
    from meets each of them most often: a group of copies is joined by then.
    Members of one component are not compared again.  What is still open goes
    to ``finish``, where an exact way is known that leaves out pairs which cannot
    be linked: from the open buckets' rows (bucket, id, sig, comp) to pairs (id, b),
    among them links that connect whatever true links between components connect; if ``sure``,
    all of them are true links and are not confirmed again.  Without it, each round compares
    ``WIDER`` times as many members of a bucket as the one before with those that
    are in other components, until no pair is open: every pair of a bucket that
    lies in two components is compared in the end, in as many rounds as the
    logarithm of the bucket's size.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), "pairs")
        new = stored(confirm(pairs), "links")
        drop(pairs)
        return new

    others = members.where("id <> head")
    links = linked(others.where(screen(F.col("sig"), F.col("head_sig"))).withColumnRenamed("head", "b"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    degree = stored(members.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("degree")), "degrees")
    others = stored(others.select("bucket", "id", "sig").join(degree, "id"), "others")
    drop(degree)
    number, many = 0, 1
    while True:
        # Buckets of two are done with; so are those that lie in one component.
        comp = components(links)
        now = placed = stored(others.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "placed")
        state = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
        now = stored(now.join(state, "bucket", "left_semi"), "open")
        drop(comp, others, placed)
        if not now.limit(1).count():
            drop(now)
            return links
        number += 1
        if finish is not None and number > 1:
            new = finish(now.select("bucket", "id", "sig", "comp"))
            new = new.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")) if sure else linked(new)
            drop(now)
            return links.union(new)
        # The most met member, later some by hash.
        rank = F.struct(-F.col("degree"), F.col("id")) if number == 1 else F.struct(F.xxhash64("id", F.lit(number)), F.col("id"))
        slot = F.pmod(F.xxhash64("id"), F.lit(many)).alias("slot")
        best = F.min_by(F.struct(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("comp").alias("comp_b")), rank).alias("h")
        heads = stored(now.groupBy("bucket", slot).agg(best).select("bucket", "h.*"), "pivots")
        links = links.union(linked(now.join(heads, "bucket").where("comp <> comp_b").where(screen(F.col("sig"), F.col("sig_b")))))
        others = stored(now.drop("comp").join(heads.select("bucket", F.col("b").alias("id")), ["bucket", "id"], "left_anti"), "others")
        drop(now, heads)
        many *= WIDER
