"""Token ids as length-delimited binary records with a separate offset index.

A record file holds, for each document, a frame of four parts::

    length of the payload            8 bytes, little-endian
    masked checksum of the length    4 bytes
    payload
    masked checksum of the payload   4 bytes

The payload is the document's id (8 bytes), a byte 1 if that id is present, the
width of a token in bytes (2 or 4), and the token ids.  A checksum is the
CRC-32 of zlib, rotated right by 15 bits plus a constant, so that data which
hold checksums themselves are safe to check.  The index file beside it has one
entry of 24 bytes for each record: document id, offset of the frame, number of
tokens; a reader may take records in any order by it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.arrays import slices
from furlong.llm.store import new_path, running_before, stored
from furlong.llm.tokens import SLICE_BYTES, encoder, ended

# Fixed value: the constant added by the mask.
MASK_DELTA = 0xA282EAD8
INDEX_ENTRY = "<qqq"
PAYLOAD_HEAD = "<qBB"
SHARD_BYTES = 64 << 20
SHARDS = "shard int, data string, index string, n_records long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload of a file, or None at its end; ValueError if a checksum is wrong."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode documents and write them as record files in ascending order of id.

    Returns the table of shards: shard, data, index, n_records, n_tokens; the
    shards' numbers ascend with the ids.  There are as many as the texts have
    ``shard_bytes``, if their number isn't given.  A null text is empty (the end
    id alone); rows with a null id come first; rows with the same id are all
    written, side by side, in the order of a hash of their texts; a text of any length is
    one record; an empty table has no shards.  Other columns are not read,
    whatever their names.  A task that is run again writes files of another
    name, and the table names those of the run that counted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = shards or max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    # One id may hold any share of the rows, so their texts part them too.
    order = "id", F.xxhash64("text"), "text"
    placed = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder, files, name = encoder(vocabulary), None, f"{shard:06d}-{uuid.uuid4().hex[:8]}"
        at = n_records = n_tokens = 0
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE_BYTES):
                if files is None:
                    fs, base = pafs.FileSystem.from_uri(path)
                    fs.create_dir(base, recursive=True)
                    files = fs.open_output_stream(f"{base}/{name}.records"), fs.open_output_stream(f"{base}/{name}.index")
                frames, entries = [], []
                ids, bounds = ended(*coder.encode(part.column("text")), end_id)
                width = 2 if ids.max() < 1 << 16 else 4
                view = memoryview(ids.astype(f"<u{width}")).cast("B")
                bounds = bounds.tolist()
                for doc, i, j in zip(part.column("id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    record = frame(struct.pack(PAYLOAD_HEAD, doc or 0, doc is not None, width) + view[width * i : width * j])
                    entries.append(struct.pack(INDEX_ENTRY, doc or 0, at, j - i))
                    frames.append(record)
                    at += len(record)
                    n_records += 1
                    n_tokens += j - i
                files[0].write(b"".join(frames))
                files[1].write(b"".join(entries))
        if files is not None:
            for f in files:
                f.close()
            one = [[shard], [f"{path}/{name}.records"], [f"{path}/{name}.index"], [n_records], [n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "data", "index", "n_records", "n_tokens"])

    return stored(placed.mapInArrow(write, SHARDS), "record-shards")


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, present, width = struct.unpack_from(PAYLOAD_HEAD, payload)
    return (doc if present else None), np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(PAYLOAD_HEAD))


def read_at(data: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file in the order of the given offsets (as its index lists them)."""
    fs, base = pafs.FileSystem.from_uri(data)
    with fs.open_input_file(base) as f:
        for offset in offsets:
            f.seek(offset)
            yield read_payload(unframe(f.read))


def read_index(index: str) -> np.ndarray:
    """Entries of an index file: columns id, offset, number of tokens."""
    fs, base = pafs.FileSystem.from_uri(index)
    with fs.open_input_stream(base) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def read_records(shards: DataFrame, ids: bool = True, seed: int | None = None) -> DataFrame:
    """Read record files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all records before this one, over all shards in
    order.  With a seed each shard is read through its index in shuffled order.
    Shards are summed up in groups and groups of groups, one task reads a shard.
    """
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                index = read_index(file["index"])
                starts = file["before"] + np.concatenate(([0], np.cumsum(index[:, 2])[:-1]))
                order = np.arange(len(index)) if seed is None else np.random.default_rng((seed, file["shard"])).permutation(len(index))
                rows = []
                for i, (doc, tokens) in zip(order, read_at(file["data"], index[order, 1].tolist()), strict=True):
                    row = {"doc_id": doc, "start": int(starts[i]), "n_tokens": len(tokens), "ids_crc32": zlib.crc32(tokens.astype("<u4").tobytes())}
                    rows.append(row | {"ids": tokens.astype("i4")} if ids else row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)
    listed = running_before(shards, "shard", "n_tokens", "before").select("shard", "data", "index", "before")
    return listed.repartitionByRange(max(1, shards.count()), "shard").mapInArrow(read, kind)


def token_records(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write documents as records in the shared folder, read them back, return a digest of each."""
    return read_records(write_records(docs, new_path(spark, "token-records"), vocabulary, end_id), ids=False)
