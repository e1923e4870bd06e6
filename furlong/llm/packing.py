"""Pack token ids into sequences of power-of-two lengths, none of which holds two documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.arrays import slices
from furlong.llm.tokens import SLICE_BYTES, encoder, ended

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch long"
BATCH_TOKENS = 1 << 17


def binary_lengths(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each total as a sum of powers of two, none above ``longest`` (itself one), largest first.

    Returns the lengths, end to end, and the number of the total that each belongs to.
    """
    powers = np.array([1 << k for k in reversed(range(longest.bit_length()))], np.int64)
    times = np.concatenate((totals[:, None] // longest, (totals[:, None] & powers[1:]) > 0), axis=1).astype(np.int64)
    return np.repeat(np.tile(powers, len(totals)), times.ravel()), np.repeat(np.arange(len(totals)), times.sum(axis=1))


class Buckets:
    """Deal the sequences of one partition to batches of equal lengths: ``tokens`` ids to a batch, the last of a bucket may have fewer."""

    def __init__(self, partition: int, tokens: int):
        self.first, self.tokens = partition << 40, tokens
        self.filled: dict[int, int] = {}

    def deal(self, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bucket), np.int64)
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            number = self.filled.get(b, 0) + np.arange(len(at))
            self.filled[b] = int(number[-1]) + 1
            out[at] = self.first + (b << 34) + number // max(1, self.tokens >> b)
        return out


def pack(docs: DataFrame, vocabulary: str, longest: int = 2048, end_id: int = 1, ids: bool = True, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids, with the end id, into pieces of power-of-two lengths.

    Every piece is a sequence of its own: no padding, and no sequence crosses
    documents.  Pieces of one length form a bucket (its binary logarithm), from
    which batches of about ``batch_tokens`` ids are drawn: all sequences of a
    batch have one length.  Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset (0), bucket, batch and, if asked for, ids.

    A null or empty text is the end id alone; a null id stays null; repeated
    rows are packed each; an empty table gives no rows; a text of any length is
    encoded whole; other columns are not read, whatever their names.  Numbers of
    sequences and batches are made of the partition's number and a count inside
    it, so a partition that is computed again gets the same ones.
    """
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        coder, buckets, number = encoder(vocabulary), Buckets(partition, batch_tokens), partition << 40
        for batch in batches:
            for part, _, _ in slices(batch, "text", SLICE_BYTES):
                tokens, bounds = ended(*coder.encode(part.column("text")), end_id)
                totals = np.diff(bounds)
                lengths, owner = binary_lengths(totals, longest)
                ends = np.cumsum(lengths)
                view = memoryview(tokens).cast("B")
                edges = [0, *(4 * ends).tolist()]
                crc = np.fromiter((zlib.crc32(view[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)), np.int64, len(lengths))
                bucket = np.frexp(lengths)[1].astype(np.int32) - 1
                columns = [part.column("id").take(pa.array(owner)), ends - lengths - bounds[owner], lengths, crc, totals[owner], number + np.arange(len(lengths)), np.zeros(len(lengths), np.int64), bucket, buckets.deal(bucket)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(tokens.view(np.int32))))
                number += len(lengths)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * ids)
