"""Near-duplicate lines over the whole corpus: sketches of grams, banding, edit similarity.

SimHash was tried first, and could not find the lines: pigeonhole blocks that
part many lines need 20 bits or more each, so 64 bits allow for two or three
blocks that differ, but lines of an edit similarity of 0.9 have SimHashes (over
words, pairs of words or grams) that differ in 4 to 12 bits.  Blocks of a
min-wise sketch keep what pigeonhole blocks are for, keys of which similar
lines have one in common, and each of their values is as good as many bits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import BYTE_HASH, ODD, mix, signed, slices, windows
from furlong.llm.components import bucket_links, components, pairs_in_buckets
from furlong.llm.edits import codes, within
from furlong.llm.minhash import band_keys, parities, sketches
from furlong.llm.store import drop, map_batches, stored

WORDS = re.compile(r"\w+")
FOREIGN = re.compile(r"[^\x00-\x7f\w]")
DIGITS = str.maketrans("123456789", "000000000")
PLAIN = bytes(c if c >= 0x80 or WORDS.match(chr(c)) else 0x20 for c in range(128)).translate(bytes.maketrans(b"123456789", b"000000000")) + bytes(range(128, 256))
PLAIN_LINES = np.frombuffer(PLAIN.lower(), np.uint8).copy()
PLAIN_LINES[10] = 10
EDIT_SIMILARITY = 0.9
SKETCH, BANDS, WIDTH = 28, 8, 3
"""Values of a sketch, blocks and values in each: lines with 60 % of their grams in common have one alike with probability 0.86, with 70 % 0.97, with 80 % 0.997."""
SHORT = 64
SHORT_GRAM, GRAM = 3, 8
"""Bytes in a gram of lines of up to ``SHORT`` characters and of longer ones; of the latter every other gram counts, by its hash."""
CELLS, FAR, CLOSE = 28, 11, 4
"""Cells of two bits in a signature, and how many may differ: of lines with 70 % of their grams in common one in 70 differs in more, of unlike lines one in 10,000 in no more.  Pairs with few are compared first."""
ODD_BITS = 0x0055555555555555
LENGTHS = 7
"""Steps of a signature's length for a factor e."""
SLICE_BYTES = 1 << 18
PAIR_BYTES = 24 << 20
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
"""Lines of a crowded bucket that are compared with each other in one place: so many, or as many as have these bytes."""
CROWD = 256
"""Lines of a bucket whose signatures are compared with each other while it is read; lines of larger ones, and of those with many near pairs, are compared in blocks."""
ROWS, PAIRS = 128, 1 << 14
"""Rows of a block whose signatures are compared, and pairs whose texts are compared, at a time."""


def normalise(line: str) -> str:
    """Lower case, digits as 0, punctuation and blanks as single spaces."""
    line = line.lower()
    if not line.isascii() and FOREIGN.search(line):
        return " ".join(WORDS.findall(line.translate(DIGITS)))
    return b" ".join(line.encode().translate(PLAIN).split()).decode()


class Lines:
    """The normalised lines of several texts that have a word: bytes end to end, a line feed after each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        data, bounds = _known_letters(data, bounds)
        # Texts end in a line feed, so no line goes on in the next.
        x = np.insert(PLAIN_LINES[data], bounds[1:], np.uint8(10))
        after = np.flatnonzero(x[:-1] == 0xC3) + 1
        after = after[(x[after] >= 0x80) & (x[after] <= 0x9E) & (x[after] != 0x97)]
        x[after] += 0x20
        feeds = np.flatnonzero(x == 10)
        inside = (x != 0x20) & (x != 10)
        turn = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = turn[::2], turn[1::2]
        line = np.searchsorted(feeds, starts)
        new = np.append(True, line[1:] != line[:-1])[: len(line)]
        x[ends] = np.where(np.append(new[1:], True), 10, 0x20)[: len(ends)]
        inside[ends] = True
        self.data = x[inside]
        self.ends = np.flatnonzero(self.data == 10)
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(self.ends)]
        first = np.searchsorted(feeds, bounds + np.arange(len(bounds)))
        self.texts = np.searchsorted(first, line[new], "right") - 1
        self.numbers = line[new] - first[self.texts]
        later = np.flatnonzero((self.data & 0xC0) == 0x80)
        self.chars = self.ends - self.starts - np.searchsorted(later, self.ends) + np.searchsorted(later, self.starts)

    def hashes(self) -> np.ndarray:
        import xxhash

        view = memoryview(self.data)
        return np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(self.starts.tolist(), self.ends.tolist(), strict=True)), np.uint64, len(self.starts))


def _known_letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with characters other than ASCII and Latin letters of two bytes after C3 are normalised one by one."""
    lead = data == 0xC3
    second = np.concatenate(([False], lead[:-1])) & (data != 0x97) & (data != 0xB7)
    odd = np.flatnonzero((data >= 0x80) & ~lead & ~second)
    if not len(odd):
        return data, bounds
    odd = set((np.searchsorted(bounds, odd, "right") - 1).tolist())
    parts = []
    for i, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        text = data[first:last]
        parts.append(np.frombuffer("\n".join(map(normalise, str(text.data, "utf-8").split("\n"))).encode(), np.uint8) if i in odd else text)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def long_grams(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of about every other gram of ``GRAM`` bytes of each line, chosen by their bytes, and the lines' bounds in them."""
    none = np.zeros(0, np.uint64)
    if len(lines.data) < GRAM:
        return none, np.zeros(len(lines.starts) + 1, np.int64)
    grams = np.ndarray(len(lines.data) - GRAM + 1, np.uint64, lines.data, strides=(1,)) * ODD
    good = grams < np.uint64(1 << 63)
    # A gram may not reach over the end of its line.
    over = (lines.ends[:, None] - np.arange(GRAM)).ravel()
    good[over[(over >= 0) & (over < len(good))]] = False
    at = np.flatnonzero(good)
    return mix(grams[at]), np.searchsorted(at, np.append(lines.starts, len(lines.data)))


def short_grams(lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of ``SHORT_GRAM`` bytes of some lines, and the lines' bounds in them."""
    starts, lengths = lines.starts[chosen], lines.ends[chosen] - lines.starts[chosen]
    owner = np.repeat(np.arange(len(chosen)), lengths)
    inside = np.arange(len(owner)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    grams, at = windows(BYTE_HASH[lines.data[inside]], owner, SHORT_GRAM)
    return grams, np.searchsorted(owner[at], np.arange(len(chosen) + 1))


def signatures(grams: np.ndarray, bounds: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks (a row of 64-bit numbers) and signature of each line, from its grams.

    A signature has the line's length on a logarithmic scale above ``CELLS`` cells of its sketch.
    """
    rows = sketches(grams, bounds, SKETCH)
    bits = (rows[:, :CELLS] & np.uint64(3)) << (2 * np.arange(CELLS, dtype=np.uint64))
    sizes = np.rint(LENGTHS * np.log(chars)).astype(np.int64)
    return band_keys(rows[:, : BANDS * WIDTH], BANDS), np.bitwise_or.reduce(bits, axis=1).view(np.int64) | sizes << 2 * CELLS


def block_keys(lines: Lines, hashes: np.ndarray, similarity: float) -> dict:
    """Columns keys, sig, short_sig of the lines: null for those too short, and where a line is not the first of equal ones.

    Two similar lines have the keys of one gram at least in common: short ones those of
    ``SHORT_GRAM``, and a longer one has no similar line that is too short for ``GRAM``.
    Lines that have both have those of ``GRAM`` first, with sig, and the others' signature in short_sig.
    """
    first = np.unique(hashes, return_index=True)[1]
    n = lines.chars[first]
    # A line that is too short for any edit can only be equal to another.
    short = np.sort(first[(n <= SHORT) & (((n + 1) * (1 - similarity) + 1e-9).astype(np.int64) > 0)])
    long = np.sort(first[n >= int(SHORT * similarity)])
    count, sigs = np.zeros(len(hashes), np.int64), np.zeros((2, len(hashes)), np.int64)
    parts = []
    for chosen, grams, step in ((long, lambda: (x[long] for x in signatures(*long_grams(lines), lines.chars)), 0), (short, lambda: signatures(*short_grams(lines, short), lines.chars[short]), 1)):
        if len(chosen):
            keys, sig = grams()
            sigs[count[chosen], chosen] = sig
            parts.append((count[chosen], chosen, keys + np.uint64(step)))
            count[chosen] += 1
    ends = np.append(0, np.cumsum(count))
    keys = np.zeros((ends[-1], BANDS), np.uint64)
    for before, chosen, own in parts:
        keys[ends[chosen] + before] = own
    lists = pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), pa.array(signed(keys.ravel())), mask=pa.array(count == 0))
    return {"keys": lists, "sig": pa.array(sigs[0], mask=count == 0), "short_sig": pa.array(sigs[1], mask=count < 2)}


def near_signatures(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    differ = (x ^ y).view(np.uint64)
    differ = (differ | differ >> np.uint64(1)) & np.uint64(ODD_BITS)
    return (np.bitwise_count(differ) <= FAR) & (abs((x >> 2 * CELLS) - (y >> 2 * CELLS)) <= steps)


def different_cells(x: Column, y: Column) -> Column:
    differ = x.bitwiseXOR(y)
    return F.bit_count(differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(ODD_BITS)))


def near_columns(x: Column, y: Column, steps: int) -> Column:
    return (different_cells(x, y) <= FAR) & (F.abs(F.shiftright(x, 2 * CELLS) - F.shiftright(y, 2 * CELLS)) <= steps)


def allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that two lines may be apart, by the longer one's length."""
    return (n * (1 - similarity) + 1e-9).astype(np.int64)


def trigram_parities(texts: list[str]) -> np.ndarray:
    """Parities of the three-letter grams of each text; an edit changes at most six of them."""
    letters, bounds = codes(texts)
    x = letters.astype(np.uint64)
    grams, at = windows(mix(x + np.uint64(1)), np.repeat(np.arange(len(texts)), np.diff(bounds)), 3)
    return parities(grams, np.searchsorted(at, bounds))


def block_links(block: pa.RecordBatch, similarity: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that connect all those that its true links connect.

    Rows: bucket, part, low, high, id, sig, comp, buckets, plain, block, own.
    Pairs of which no row is ``own``, or that are not of the blocks low and high,
    or that have an earlier bucket in common, are compared elsewhere.  Pairs that
    lengths or parities show to be too far apart are left out, which loses none,
    and so are those that links found before have connected.
    """
    bucket, low, high = (block.column(c)[0].as_py() for c in ("bucket", "low", "high"))
    ids, sig, comp, own, place = (block.column(c).to_numpy(zero_copy_only=False) for c in ("id", "sig", "comp", "own", "block"))
    texts = block.column("plain").to_pylist()
    n = np.array([len(x) for x in texts])
    found = []
    for first in range(0, len(ids), ROWS):
        a = np.arange(first, min(first + ROWS, len(ids)))[:, None]
        b = np.arange(first, len(ids))[None, :]
        good = (a < b) & (own[a] | own[b]) & (comp[a] != comp[b]) & (np.minimum(place[a], place[b]) == low) & (np.maximum(place[a], place[b]) == high)
        good &= abs(n[a] - n[b]) <= allowed(np.maximum(n[a], n[b]), similarity)
        i, j = np.nonzero(good)
        i, j = i + first, j + first
        near = near_signatures(sig[i], sig[j], steps)
        found.append(np.stack((i[near], j[near])))
    a, b = np.concatenate(found, axis=1)
    lists = block.column("buckets")
    bounds = lists.offsets.to_numpy()
    others = np.full((len(ids), int(np.diff(bounds).max())), bucket)
    # Buckets before this one; each row's others are filled with this one, which both have.
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    others[owner, np.arange(len(owner)) - (bounds[:-1] - bounds[0])[owner]] = lists.flatten().to_numpy()
    bits = trigram_parities(texts)
    keep = np.zeros(len(a), bool)
    for first in range(0, len(a), PAIRS):
        i, j = a[first : first + PAIRS], b[first : first + PAIRS]
        before = ((others[i][:, :, None] == others[j][:, None, :]) & (others[i] < bucket)[:, :, None]).any(axis=(1, 2))
        # Lines with buckets of short and of long grams have two signatures, so each bucket is looked at.
        before &= (np.maximum(n[i], n[j]) > SHORT) | (np.minimum(n[i], n[j]) < int(SHORT * similarity))
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        keep[first : first + PAIRS] = ~before & (differ <= 6 * allowed(np.maximum(n[i], n[j]), similarity))
    a, b = a[keep], b[keep]
    # Those that differ least first: they connect most.
    differ = (sig[a] ^ sig[b]).view(np.uint64)
    order = np.argsort(np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(ODD_BITS)), kind="stable")
    a, b = a[order], b[order]
    up = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    links = []
    first, size = 0, PAIRS >> 4
    while first < len(a):
        roots = {c: root(c) for c in up}
        top = np.array([roots[c] for c in comp.tolist()])
        i, j = a[first:], b[first:]
        open_pairs = np.flatnonzero(top[i] != top[j])[:size]
        if not len(open_pairs):
            break
        first += int(open_pairs[-1]) + 1
        i, j = i[open_pairs], j[open_pairs]
        true = within([texts[k] for k in i], [texts[k] for k in j], allowed(np.maximum(n[i], n[j]), similarity))
        for x, y in zip(i[true].tolist(), j[true].tolist(), strict=True):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                links.append((x, y))
        size = PAIRS
    x, y = np.array(links, np.int64).reshape(-1, 2).T
    return ids[x], ids[y]


def crowd_links(rows: DataFrame, plain: DataFrame, similarity: float, steps: int) -> DataFrame:
    """Links (id, b) between the components of crowded buckets' rows (bucket, id, sig, comp).

    A line's text goes once to the lines of its bucket of about its length and
    once to those that are somewhat longer; where these are too many for one
    place, they are dealt to blocks, of which any two meet.  So no pair of lines
    is a row, and what a task holds is bounded.
    """
    unit = max(-1.001 * math.log(similarity), 0.001)
    rows = stored(rows, "crowd")
    buckets = rows.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    texts = rows.join(buckets, "id").join(plain.withColumnRenamed("line", "id"), "id").withColumn("size", F.floor(F.log(F.length("plain")) / unit))
    texts = stored(texts, "crowd-texts")
    both = F.explode(F.array(F.struct(F.col("size").alias("part"), F.lit(True).alias("own")), F.struct((F.col("size") + 1).alias("part"), F.lit(False).alias("own")))).alias("p")
    parts = texts.select("bucket", "comp", both).groupBy("bucket", F.col("p.part").alias("part")).agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("p.own").alias("any"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / F.exp(F.col("part") * unit))))
    parts = parts.where("any and least <> most").select("bucket", "part", F.ceil(F.col("n") / most).alias("blocks"))
    placed = texts.select("bucket", "id", "sig", "comp", "buckets", "plain", both).select("*", "p.part", "p.own").drop("p").join(parts, ["bucket", "part"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = ["bucket", "part", "low", "high"]
    placed = placed.select("bucket", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "sig", "comp", "buckets", "plain", "block", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked() -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in held) > 1:
                x, y = block_links(pa.concat_batches(held), similarity, steps)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["id", "b"])
            held.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in place])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
            for i, j in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                if held and tuple(keys[:, i]) != last:
                    yield from linked()
                held.append(batch.slice(i, j - i))
                last = tuple(keys[:, i])
        yield from linked()

    links = stored(placed.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "id long, b long"), "crowd-links")
    drop(rows, texts)
    return links


def repeated_lines(docs: DataFrame, similarity: float = EDIT_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop from each document: doc_id, mark, dropped (numbers of lines from 0).

    Lines are linked if they are equal after normalising, or if they meet in a
    block of their sketches and their edit similarity, 1 - edits / the longer
    length, is at least ``similarity``.  Of each connected group the first
    occurrence stays (by document id, then text, then line).  mark is a hash of
    the text: rows of one id with different texts are different documents, rows
    that repeat an id and a text are one.  Null and empty texts, lines without a
    word and documents without an id are left alone; lines of any length and
    texts of any length are read whole.  Documents that lose nothing have no row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("mark", F.xxhash64("text"))
    steps = math.floor(1 - LENGTHS * math.log(similarity))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, data, bounds in slices(batch, "text", SLICE_BYTES):
            found = Lines(data, bounds)
            hashes = found.hashes()
            at = pa.array(found.texts)
            yield {"line": signed(hashes), "doc_id": part.column("doc_id").take(at), "mark": part.column("mark").take(at), "number": found.numbers} | block_keys(found, hashes, similarity)

    lines = stored(map_batches(rows, cut, "line long, doc_id long, mark long, number int, keys array<long>, sig long, short_sig long"), "lines", dictionary=False)
    members = lines.select(F.posexplode("keys").alias("at", "bucket"), F.col("line").alias("id"), "sig", "short_sig").select("bucket", "id", F.when(F.col("at") < BANDS, F.col("sig")).otherwise(F.col("short_sig")).alias("sig"))
    near = stored(pairs_in_buckets(members, lambda x, y: near_signatures(x, y, steps), CROWD, least=False), "near-lines", dictionary=False)
    asked = near.select(F.explode(F.array("id", "head")).alias("line")).distinct().withColumn("asked", F.lit(True))
    # A line that is there once and meets no near one stays.
    distinct = lines.groupBy("line").agg(F.min(F.struct("doc_id", "mark", "number")).alias("first"), F.count("*").alias("n"))
    distinct = stored(distinct.join(asked, "line", "left").where("n > 1 or asked"), "distinct-lines")
    # The texts of lines that meet a near one are fetched once.
    places = distinct.where("asked").groupBy("first.doc_id", "first.mark").agg(F.collect_list(F.struct("line", "first.number")).alias("asked"))

    def fetch(batch: pa.RecordBatch) -> Iterator[dict]:
        asked = batch.column("asked")
        line, number = asked.flatten().flatten()
        number, bounds = number.to_pylist(), asked.offsets.to_pylist()
        plain: list[str] = []
        for text, i, j in zip(batch.column("text"), bounds[:-1], bounds[1:], strict=True):
            own = text.as_py().split("\n")
            plain += [normalise(own[k]) for k in number[i - bounds[0] : j - bounds[0]]]
        yield {"line": line, "plain": plain}

    # The texts need no sorting.
    found = rows.join(places.hint("shuffle_hash"), ["doc_id", "mark"]).select("text", "asked")
    plain = stored(map_batches(found, fetch, "line long, plain string").dropDuplicates(["line"]), "line-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        def verdict(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            x, y = rows.column("x").to_pylist(), rows.column("y").to_pylist()
            most = allowed(np.array([max(len(a), len(b)) for a, b in zip(x, y, strict=True)]), similarity)
            return rows.select(["a", "b"]).filter(pa.array(within(x, y, most)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Some megabytes at a time, so that many pairs of about one length come together.
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size > PAIR_BYTES:
                    yield verdict(held)
                    held, size = [], 0
            if held:
                yield verdict(held)

        full = pairs.join(plain.select(F.col("line").alias("a"), F.col("plain").alias("x")), "a").join(plain.select(F.col("line").alias("b"), F.col("plain").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    # Most groups are stars of pairs of lines that differ little, one for each line; other pairs count only where these do not lead both lines to one.
    pairs = near.where("not big").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"), (F.col("first") & (different_cells(F.col("sig"), F.col("head_sig")) <= CLOSE)).alias("close"))
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("close").alias("close")), "near-pairs")
    links = stored(confirm(pairs.where("close")), "links")
    star = stored(links.groupBy("b").agg(F.min("a").alias("least")), "stars")
    rest = pairs.where("not close").join(star.select(F.col("b").alias("a"), F.col("least").alias("x")), "a", "left").join(star.select("b", F.col("least").alias("y")), "b", "left")
    links = links.union(stored(confirm(rest.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")), "links"))
    drop(star, pairs)
    crowds = stored(near.where("big").drop("first", "big").distinct(), "crowded-lines")
    if crowds.limit(1).count():
        links = links.union(bucket_links(crowds, confirm, lambda x, y: near_columns(x, y, steps), lambda rows: crowd_links(rows, plain, similarity, steps), True))
    groups = components(links)
    # A line that is there once and has no near one stays.
    known = distinct.join(groups.withColumnRenamed("id", "line"), "line", "left").where("n > 1 or component is not null")
    known = stored(known.select("line", "first", F.coalesce("component", "line").alias("component")), "known-lines")
    keepers = known.groupBy("component").agg(F.min("first").alias("keep"))
    again = stored(known.join(keepers, "component").select("line", "keep"), "repeated-lines")
    dropped = lines.select("line", "doc_id", "mark", "number").join(again, "line").where(F.struct("doc_id", "mark", "number") != F.col("keep"))
    out = stored(dropped.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("number")).alias("dropped")), "dropped-lines")
    drop(lines, near, distinct, plain, crowds, groups, known, again)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, length_col: str | None = None) -> DataFrame:
    """Documents without their repeated lines: all columns, and if asked for n_lines and n_dropped.

    A document all of whose lines are dropped is gone; null and empty texts and
    rows with a null id stay as they are.  Of rows that repeat an id and a text
    none loses a line to another.  A column ``length_col`` gets the length of the
    text where lines were dropped.  Columns may have any names; given columns
    n_lines and n_dropped are replaced if counts are asked for.  An empty table
    stays empty.
    """
    lost = repeated_lines(docs, id_col=id_col, text_col=text_col)
    # Names that no given column can take; the text goes with its row once.
    others = {c: f"column {i}" for i, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in others.items()), F.col(f"`{text_col}`").cast("string").alias("whole"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    rows = rows.withColumn("mark", F.xxhash64("whole"))
    gone = F.coalesce(F.size("dropped"), F.lit(0))
    left = F.array_join(F.filter(F.split("whole", "\n", -1), lambda line, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    # A row of its own, so that Spark makes the text once for the result and the condition.
    text = F.explode(F.array(F.when(gone > 0, left).otherwise(F.col("whole"))))
    bare = F.ltrim(F.col("text"), F.lit(" \t\n\r\x0b\x0c")) == ""
    n_lines = F.coalesce(F.octet_length("whole") - F.octet_length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    joined = rows.join(lost.hint("shuffle_hash"), ["doc_id", "mark"], "left").select(*others.values(), text.alias("text"), *([n_lines.alias("n_lines")] if counts else []), gone.alias("n_dropped"))
    joined = joined.where((F.col("n_dropped") == 0) | ~bare)
    own = {c: F.col(name) for c, name in others.items()} | {text_col: F.col("text")}
    if length_col in docs.columns:
        own[length_col] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(own[length_col]).cast(docs.schema[length_col].dataType)
    added = ("n_lines", "n_dropped") if counts else ()
    return joined.select(*(own[c].alias(c) for c in docs.columns if c not in added), *added)
