"""WARC archives with a two-level index of captures.

Pages are range-partitioned by their key, the URL with its host reversed
(``com,example,www)/path``).  Each partition writes three files in that order:
the archive (a gzip member for each record), the index (lines of key, page,
type, digest, payload's length, offset and length, in gzip blocks of ``BLOCK``
lines), and the directory (first key, offset and length of each block).  To find a URL, the
shard is found by binary search in the shards' first keys, of which many are kept
in files of a tree, the block by binary search in the directory, the line by binary search in the block; then one range is read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import store
from furlong.llm.store import drop, new_path, stored

BLOCK = 300
SHARD_BYTES = 64 << 20
ARCHIVE = ".warc.gz"
NODES = 16
"""Files of the tree over the shards that a task holds.  They are asked for in order of keys."""
LOOKUPS = 5000
"""URLs that a task looks up.  Their rows are few bytes, but each has a record to read, so tasks are not merged by bytes."""
SHARDS = "shard int, archive string, index string, directory string, first string, n_records long"
RECORDS = "page_id long, url string, surt string, payload_bytes long, payload_digest string, record_type string, refers_to long"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
URL_PORT = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]*(:\d+)"
SITE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*")
URL_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def surt(url: Column) -> Column:
    """Sort key of a URL: reversed host with its port, then path and query; scheme and fragment are dropped, null is empty."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, URL_HOST, 1))
    rest = F.regexp_extract(url, URL_REST, 1)
    return F.when(host == "", F.concat(F.lit(")"), url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(url, URL_PORT, 1), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def without_fragment(url: str) -> str:
    """What a URL is found by: scheme and host in lower case, no fragment."""
    url = url.partition("#")[0]
    site = SITE.match(url)
    return site[0].lower() + url[site.end() :] if site else url


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, payload_bytes: int) -> dict:
    """Fields and payload of one record; ValueError if its payload does not match its digest.

    payload_bytes: from the index, since a revisit has no payload.
    """
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload and digest differ")
    number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": json.loads(f'"{fields["WARC-Target-URI"]}"'), "payload_bytes": payload_bytes, "date": fields["WARC-Date"],
        "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload,
    }


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, shard_bytes: int = SHARD_BYTES, date: datetime | None = None) -> DataFrame:
    """Write a record for each page; returns the table of shards, as many as the pages have ``shard_bytes`` if their number isn't given.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the largest id is a response and the others, of smaller ids, revisit it.
    Null html is an empty payload, a null URL an empty one; a null id counts as
    less than any other; rows that repeat an id are all written.  Pages of any
    length are written whole.  An empty table has no shards; other columns are not
    read.  date: of all records, by default the time of the call.
    """
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.select(surt(F.col("url")).alias("surt"), "page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), "url", "html")
    n = shards or max(1, -(-(rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // shard_bytes))
    facts = stored(rows.where(F.octet_length("html") >= least_bytes).select("surt", "page_id", "digest"), "digests")
    repeated = facts.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    # The last copy of each payload joins only its digest's rows, none of which holds a text.
    revisits = stored(facts.join(repeated, "digest").where("page_id is null or page_id < last").select("surt", "page_id", "digest", "last").distinct(), "revisits")
    marks = revisits.select("surt", "page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "last")
    mixed = rows.withColumn("last", F.lit(None).cast("long")).union(marks)
    # A mark has the key of its page, so it is in the same partition and sorts right before it.
    placed = mixed.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id", "digest", F.col("last").desc_nulls_last())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{path}/{shard:06d}-{uuid.uuid4().hex[:8]}"
        files, at, index_at, count, first, mark = None, 0, 0, 0, None, None
        lines: list[str] = []
        directory: list[str] = []

        def close_block() -> None:
            nonlocal index_at
            block = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            files[1].write(block)
            directory.append("\t".join((*lines[0].split("\t")[:2], str(index_at), str(len(block)))))
            index_at += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["surt"], row["page_id"], row["digest"])
                if row["html"] is None:
                    mark = (key, row["last"])
                    continue
                if files is None:
                    fs, base = pafs.FileSystem.from_uri(path)
                    fs.create_dir(base, recursive=True)
                    files = [fs.open_output_stream(pafs.FileSystem.from_uri(f"{name}.{kind}")[1], compression=None) for kind in ("warc.gz", "index", "directory")]
                    first = row["surt"]
                refers = mark[1] if mark and mark[0] == key else None
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                record = gzip.compress(record_bytes(row["page_id"], row["url"], payload := row["html"].encode(), digest, refers, stamp), 4, mtime=0)
                files[0].write(record)
                lines.append("\t".join((json.dumps(row["surt"])[1:-1], "" if row["page_id"] is None else str(row["page_id"]), "response" if refers is None else "revisit", digest, str(len(payload)), str(at), str(len(record)))))
                at += len(record)
                count += 1
                if len(lines) == BLOCK:
                    close_block()
        if files is not None:
            if lines:
                close_block()
            files[2].write("\n".join(directory).encode())
            for f in files:
                f.close()
            one = [[shard], [f"{name}.warc.gz"], [f"{name}.index"], [f"{name}.directory"], [first], [count]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["shard", "archive", "index", "directory", "first", "n_records"])

    out = stored(placed.mapInArrow(write, SHARDS), "archive-shards")
    drop(facts, revisits)
    return out


def _open(uri: str):
    fs, base = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(base)


def read_directory(uri: str) -> list[tuple[str, int, int]]:
    """First key, offset and length of each block of an index."""
    with _open(uri) as f:
        rows = [line.split("\t") for line in f.read().decode().split("\n") if line]
    return [(json.loads(f'"{r[0]}"'), int(r[2]), int(r[3])) for r in rows]


def read_block(f, offset: int, length: int) -> list[tuple[str, int, int, int]]:
    """Key, payload's length, offset and length of each record of an index block."""
    rows = [line.split("\t") for line in gzip.decompress(f.read_at(length, offset)).decode().split("\n")]
    return [(json.loads(f'"{r[0]}"'), int(r[4]), int(r[5]), int(r[6])) for r in rows]


def find(name: str, keys: list[str]) -> Iterator[tuple[str, int, int, int]]:
    """Records of one shard, by the name of its files, with these keys, in order: key, payload's length, offset, length."""
    directory = read_directory(f"{name}.directory")
    starts = [d[0] for d in directory]
    held, block = -1, []
    with _open(f"{name}.index") as f:
        for key in keys:
            # A key may run over several blocks, and may begin at the end of the one before.
            i = max(0, bisect.bisect_left(starts, key) - 1)
            while i < len(directory) and starts[i] <= key:
                if i != held:
                    held, block = i, read_block(f, *directory[i][1:])
                yield from block[bisect.bisect_left(block, key, key=lambda b: b[0]) : bisect.bisect_right(block, key, key=lambda b: b[0])]
                i += 1


def _rows(records: Iterator[dict], payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("surt", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)
    held: list[dict] = []
    size = 0
    for r in records:
        held.append({k: r[k] for k in schema.names})
        size += r["payload_bytes"] if payload else 0
        if len(held) == 2000 or size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(shards: DataFrame, payload: bool = True) -> DataFrame:
    """All records in the order of the index, without a search."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            for batch in batches:
                for shard in batch.to_pylist():
                    with _open(shard["index"]) as index, _open(shard["archive"]) as archive:
                        for _, offset, length in read_directory(shard["directory"]):
                            for key, payload_bytes, at, size in read_block(index, offset, length):
                                yield parse_record(gzip.decompress(archive.read_at(size, at)), payload_bytes) | {"surt": key}

        return _rows(records(), payload)

    n = max(1, shards.count())
    return shards.repartition(n, F.col("shard")).mapInArrow(read, RECORDS + ", payload binary" * payload)


def upper_levels(shards: DataFrame, path: str) -> tuple[int, list[tuple[int, str, str]]]:
    """Tree over the first keys of the shards: its depth, and its root of at most ``store.FAN`` rows (number, first key, name of the files).

    While a level has more rows than a root may have, each ``store.FAN`` of them are
    written as a file, which is a row of the next level.
    """
    level = shards.select(F.col("shard").cast("long").alias("number"), "first", F.expr(f"left(archive, length(archive) - {len(ARCHIVE)})").alias("name"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                name = f"{path}/{row['number']:06d}-{uuid.uuid4().hex[:8]}"
                children = [(c["number"], c["first"], c["name"]) for c in row["children"]]
                with fs.open_output_stream(pafs.FileSystem.from_uri(name)[1], compression=None) as f:
                    f.write(gzip.compress(json.dumps(children).encode(), 6, mtime=0))
                rows.append({"number": row["number"], "first": children[0][1], "name": name})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("number", pa.int64()), ("first", pa.string()), ("name", pa.string())]))

    depth = 0
    while level.count() > store.FAN:
        nodes = level.groupBy(F.floor(F.col("number") / store.FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("number", "first", "name"))).alias("children"))
        level = stored(nodes.select(F.col("node").alias("number"), "children").mapInArrow(write, "number long, first string, name string"), "archive-nodes")
        depth += 1
    return depth, sorted((r["number"], r["first"], r["name"]) for r in level.collect())


def read_node(name: str) -> list[tuple[int, str, str]]:
    with _open(name) as f:
        return [tuple(row) for row in json.loads(gzip.decompress(f.read()))]


def shards_of(key: str, rows: list[tuple[int, str, str]], depth: int, children: Callable[[str], list[tuple[int, str, str]]]) -> Iterator[tuple[int, str]]:
    """Number and name of the shards that may have a key: it may begin at the end of one and run over several."""
    first = max(0, bisect.bisect_left(rows, key, key=lambda r: r[1]) - 1)
    for number, _, name in rows[first : bisect.bisect_right(rows, key, key=lambda r: r[1])]:
        if depth:
            yield from shards_of(key, children(name), depth - 1, children)
        else:
            yield number, name


def lookup(shards: DataFrame, urls: DataFrame, url_col: str = "url", payload: bool = True) -> DataFrame:
    """Records of the given URLs (distinct ones); URLs without a capture give no row, null ones none.

    URLs are the same if they differ in nothing but their fragments and the case
    of scheme and host; a key that several URLs share is searched once.

    The shard is found in ``upper_levels``, the block in its directory, and the
    records in the block, by binary search.  A task takes the keys of its shards in
    order, so a block is read once.
    """
    depth, root = upper_levels(shards, new_path(shards.sparkSession, "archive-tree"))
    given = urls.where(F.col(url_col).isNotNull())
    keys = given.select(surt(F.col(url_col)).alias("surt"), F.col(url_col).alias("url")).distinct()
    tasks = max(1, -(-given.count() // LOOKUPS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        children = lru_cache(NODES)(read_node)
        for batch in batches:
            # Keys in order, so that they ask for the same nodes one after the other.
            asked = sorted(zip(batch.column("surt").to_pylist(), batch.column("url").to_pylist(), strict=True))
            out = [(k, u, *shard) for k, u in asked for shard in shards_of(k, root, depth, children)]
            yield pa.RecordBatch.from_pylist([{"surt": k, "url": u, "place": i, "name": name} for k, u, i, name in out], pa.schema([("surt", pa.string()), ("url", pa.string()), ("place", pa.int64()), ("name", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            rows = ((r["name"], r["surt"], r["url"]) for batch in batches for r in batch.to_pylist())
            for name, of_shard in groupby(rows, key=lambda r: r[0]):
                asked = ((key, {without_fragment(r[2]) for r in same}) for key, same in groupby(of_shard, key=lambda r: r[1]))
                with _open(f"{name}{ARCHIVE}") as archive:
                    while wanted := dict(islice(asked, 2000)):
                        for key, payload_bytes, at, size in find(name, list(wanted)):
                            record = parse_record(gzip.decompress(archive.read_at(size, at)), payload_bytes)
                            if without_fragment(record["url"]) in wanted[key]:
                                yield record | {"surt": key}

        return _rows(records(), payload)

    routed = keys.mapInArrow(route, "surt string, url string, place long, name string").repartitionByRange(tasks, "place", "surt").sortWithinPartitions("place", "surt")
    return routed.mapInArrow(read, RECORDS + ", payload binary" * payload)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, look each one's URL up in the index, return the facts of each record."""
    shards = write_archives(pages, new_path(pages.sparkSession, "archives"))
    return lookup(shards, pages.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")), payload=False)
