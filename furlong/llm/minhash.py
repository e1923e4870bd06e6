"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import GOLDEN, mix, seeded, signed, slices, windows, word_hashes, word_spans
from furlong.llm.components import bucket_links, colliding, components
from furlong.llm.store import drop, map_batches, stored


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashed, sorted) of each text, end to end, and their bounds."""
    starts, ends, texts = word_spans(data, bounds)
    hashes = word_hashes(data, starts, ends)
    n_texts = len(bounds) - 1
    found, at = windows(hashes, texts, words)
    owner = texts[at]
    counts = np.bincount(texts, minlength=n_texts)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(texts, short)
        whole = np.array([_sequence(hashes[i : i + n]) for i, n in zip(first, counts[short], strict=True)], np.uint64)
        found, owner = np.concatenate((found, whole)), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(n_texts + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a text of too few words for a shingle; apart from those of shingles."""
    out = np.array([len(hashes)], np.uint64) * GOLDEN
    for h in hashes:
        out = mix(out + h)
    return out[0]


LOW = np.uint64(2**32 - 1)


def sketches(items: np.ndarray, bounds: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Fast similarity sketches (Dahlgaard, Knudsen, Thorup 2017), a row of ``size`` values for each set.

    Round i hashes every item of a set to a bin and a value, and a bin keeps
    its least (round, value).  In the first ``size`` rounds the bin is random,
    in the next ``size`` rounds round i fills bin i, so every bin of a set that
    isn't empty is filled; a set leaves as soon as it has no empty bin.  Rows of
    empty sets hold the greatest integer.
    """
    n = len(bounds) - 1
    top = np.uint64(2**64 - 1)
    out = np.full(n * size, top, np.uint64)
    keys = seeded(2 * size, seed)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    # Places of the sets' first bins.
    place = owner * size
    for i in range(2 * size):
        if not len(items):
            break
        h = mix(items ^ keys[i])
        if i < size:
            at = h & LOW
            at *= np.uint64(size)
            at >>= np.uint64(32)
            at = at.view(np.int64)
            at += place
        else:
            at = place + (i - size)
        h >>= np.uint64(16)
        h |= np.uint64(i) << np.uint64(48)
        np.minimum.at(out, at, h)
        if i < 4 or i % 8 == 0 or i >= size:
            full = (out.reshape(n, size) != top).all(axis=1)
            stay = np.flatnonzero(~full[owner])
            items, owner, place = items[stay], owner[stay], place[stay]
    return out.reshape(n, size)


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """Hash of each band of each sketch; the band's number is part of it."""
    n, size = rows.shape
    width = size // bands
    parts = rows.reshape(n, bands, width)
    out = np.broadcast_to(seeded(bands, 11), (n, bands)).copy()
    for j in range(width):
        out = mix(out ^ (parts[:, :, j] * GOLDEN))
    return out


PARITIES = 8
"""64-bit words of parities of a set."""


def parities(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of bits for each set, each the parity of the items that are hashed to it.

    Two sets differ in at least as many items as their rows in bits.
    """
    n = len(bounds) - 1
    out = np.zeros(n * PARITIES, np.uint64)
    at = np.repeat(np.arange(n) * PARITIES, np.diff(bounds)) + (items % np.uint64(PARITIES)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (items >> np.uint64(8)) % np.uint64(64))
    return out.reshape(n, PARITIES)


def prefix_pairs(documents: DataFrame, sets: DataFrame, ratio: int) -> DataFrame:
    """Pairs (id, b) that share one of their rarest shingles, by prefix filtering.

    documents: id, sig (size of the set), comp.  If x is no larger than y and
    they are similar enough, then in an order of all shingles, here by the
    number of documents that have them, one of the first n - ceil(2t / (1 + t) n)
    + 1 of x is among the first n - ceil(t n) + 1 of y.  Shingles of a single
    document come first and can't be shared, so they are counted, not joined.
    Pairs of one component are left out, and so are those whose sets must differ
    in too many shingles by their parities (column bits of sets): in a group of
    copies with many changes each this is nearly all of its pairs.
    """

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            n = [len(x) for x in items]
            yield {"token": np.concatenate(items) if items else [], "id": np.repeat(part.column("id").to_numpy(), n)}

    rows = map_batches(sets.join(documents.select("id"), "id", "left_semi").select("id", "items"), each, "token long, id long")
    tokens = stored(rows, "open-shingles")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    lists = tokens.join(common, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    docs = documents.join(lists, "id").join(sets.select("id", "bits"), "id")
    n = F.col("sig")
    single = n - F.size("shared")
    probe = n - F.ceil(n * ratio / 100) + 1 - single
    index = n - F.ceil(n * (2 * ratio) / (100 + ratio)) + 1 - single
    cut = lambda most: F.slice("shared", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))
    docs = stored(docs.select("id", "sig", "comp", F.struct(*(F.col("bits")[i].alias(f"w{i}") for i in range(PARITIES))).alias("bits"), F.size("shared").alias("have"), cut(index).alias("index"), cut(probe).alias("probe")), "prefixes")
    small = docs.select("id", "sig", "comp", "bits", "have", F.posexplode("index.token").alias("at", "token"))
    large = docs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("comp").alias("comp_b"), F.col("bits").alias("bits_b"), F.col("have").alias("have_b"), F.posexplode("probe.token").alias("at_b", "token"))
    drop(tokens)
    # What two documents share is at most what stands before and after the shingle in both lists.
    most = F.least("at", "at_b") + 1 + F.least(F.col("have") - F.col("at") - 1, F.col("have_b") - F.col("at_b") - 1)
    enough = most * (100 + ratio) >= (F.col("sig") + F.col("sig_b")) * ratio
    differ = sum((F.bit_count(F.col(f"bits.w{i}").bitwiseXOR(F.col(f"bits_b.w{i}"))) for i in range(PARITIES)), F.lit(0))
    enough &= differ * (100 + ratio) <= (F.col("sig") + F.col("sig_b")) * (100 - ratio)
    return small.join(large, "token").where(f"id <> b and comp <> comp_b and sig <= sig_b and 100 * sig >= {ratio} * sig_b").where(enough).select("id", "b").distinct()


def grouped(docs: DataFrame, threshold: float = 0.75, words: int = 5, size: int = 128, bands: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, mark (a hash of the text), n_shingles, group, component_id, a row for each row with an id.

    group tells groups apart, null for texts without words; component_id is its
    smallest doc_id, which two groups share if rows of one id have different texts.

    Documents are linked if intersection / union of their sets of word shingles
    is at least ``threshold``.  First, documents of one and the same set become
    one class, named by its smallest id: sets are taken for the same if their
    sizes and two 64-bit sums over their shingles are, which happens to two
    different ones with a probability of about 2 ** -128.  The sketches of the
    classes' first documents are banded (32 bands of 4 values: at a similarity of
    0.75 a pair meets in no band with probability 6e-6), buckets are compared by
    ``bucket_links``, and every link is confirmed on the full sets.

    A text without words has an empty set and is linked with nothing; one of
    fewer words than a shingle's has its whole sequence as the only shingle.
    Null texts count as empty; texts of any length are read whole.  Rows with a
    null id are left out; rows that repeat an id are judged each by its own text.
    Columns other than the two are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").withColumn("mark", F.xxhash64("text"))

    def sign(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, data, bounds in slices(batch, "text", 2 << 20):
            sets, at = shingle_sets(data, bounds, words)
            n = np.diff(at)
            total = np.concatenate(([np.uint64(0)], np.cumsum(sets, dtype=np.uint64)))
            other = np.concatenate(([np.uint64(0)], np.cumsum(mix(sets * GOLDEN), dtype=np.uint64)))
            keys = np.ascontiguousarray(band_keys(sketches(sets, at, size), bands))
            yield {
                "doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_shingles": n, "set_a": signed(total[at[1:]] - total[at[:-1]]), "set_b": signed(other[at[1:]] - other[at[:-1]]),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(signed(keys.ravel()))),
            }

    signed_docs = stored(map_batches(rows, sign, "doc_id long, mark long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketches")
    same = ["n_shingles", "set_a", "set_b"]
    first = F.struct("doc_id", "mark")
    classes = stored(signed_docs.where("n_shingles > 0").groupBy(*same).agg(F.min(first).alias("first"), F.min_by("bands", first).alias("bands")).withColumn("id", F.col("first.doc_id")), "classes")
    shared = stored(classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared-ids")
    repeated = shared.limit(1).count() > 0
    if repeated:
        # Classes of different texts with one id get numbers below zero instead.
        own = F.when(F.col("shared"), -F.shiftright(F.xxhash64("set_a", "set_b"), 1).bitwiseAND(F.lit((1 << 62) - 1)) - 1).otherwise(F.col("id"))
        wide, classes = classes, stored(classes.join(shared.withColumn("shared", F.lit(True)), "id", "left").withColumn("id", own).drop("shared"), "classes")
        drop(wide)
    members = stored(colliding(classes.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("sig"))), "colliding")
    wanted = classes.select("id", "first.*").join(members.select("id").distinct(), "id", "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part, data, bounds in slices(batch, "text", 2 << 20):
                ids = part.column("id").to_numpy()
                # Rows that repeat an id and a text follow one another.
                new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
                last = ids[-1]
                sets, at = shingle_sets(data, bounds, words)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * PARITIES, pa.int32()), pa.array(signed(parities(sets, at).ravel())))
                items = pa.array([sets[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), items, bits], ["id", "items", "bits"]).filter(pa.array(new))

    texts = rows.join(wanted.hint("merge"), ["doc_id", "mark"]).select("id", "text")
    sets = stored(texts.mapInArrow(gather, "id long, items binary, bits array<long>"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        def compare(batch: pa.RecordBatch) -> Iterator[dict]:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= round(100 * threshold) * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        return map_batches(full.select("a", "b", "x", "y"), compare, "a long, b long")

    ratio = round(100 * threshold)

    def rare_pairs(rows: DataFrame) -> DataFrame:
        return prefix_pairs(rows.select("id", "sig", "comp").distinct(), sets, ratio)

    links = bucket_links(members, confirm, lambda x, y: 100 * F.least(x, y) >= ratio * F.greatest(x, y), rare_pairs)
    labels = components(links)
    drop(members, sets)
    group = classes.select(*same, "id", F.col("first.doc_id").alias("least")).join(labels, "id", "left").select(*same, F.coalesce("component", "id").alias("group"), "least")
    if repeated:
        group = group.join(group.groupBy("group").agg(F.min("least").alias("low")), "group")
    else:
        group = group.withColumn("low", F.col("group"))
    out = signed_docs.select("doc_id", "mark", *same).join(group.select(*same, "group", "low"), same, "left")
    return out.select("doc_id", "mark", "n_shingles", "group", F.coalesce("low", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept (doc_id is the group's smallest); see ``grouped``."""
    return grouped(docs, **options).select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group, with all its columns, which may have any names.

    It is the row of the smallest id, then of the smallest hash of its text; of
    rows equal in both any one stays.  Rows without a word or without an id are
    linked with nothing and stay.  An empty table stays empty.
    """
    keys = ["doc_id", "mark"]
    groups = stored(grouped(docs, id_col=id_col, text_col=text_col, **options).where("n_shingles > 0").select("group", *keys), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct(*keys)).alias("first")).select("first.*")
    seen = groups.groupBy(*keys).agg(F.count("*").alias("n"))
    gone = stored(seen.join(first.withColumn("stays", F.lit(True)), keys, "left").select(*keys, "n", F.coalesce("stays", F.lit(False)).alias("stays")).where("n > 1 or not stays"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    out = rows.join(gone, keys, "left_anti")
    again = gone.where("stays").select(*keys)
    if again.limit(1).count():
        out = out.unionByName(rows.join(again, keys, "left_semi").dropDuplicates(keys))
    drop(groups)
    return out.select("row.*")
