"""Counts of keys over all documents, asked for by blocks of documents and answered by ranges of keys.

A block of texts sends its distinct keys in order, cut at the ranges' starts and compressed, with how
often it holds each. A range adds up what all blocks sent and answers each in the order it asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null

#: Characters of a block, and keys that a block should send to a range, at least.
BLOCK_CHARS, PIECE_KEYS = 12_000_000, 64

ASKED = "bucket long, block long, keys binary, counts binary"
ANSWERED = "block long, bucket long, sums binary"


def block_count(docs: DataFrame, block_chars: int | None = None) -> int:
    """How many blocks of about block_chars characters the texts make. Blocks grow with the root of the
    input, from BLOCK_CHARS on, since every block asks every range."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    if block_chars is None:
        block_chars = max(BLOCK_CHARS, int(math.sqrt(6 * PIECE_KEYS * total)))
    return max(-(-total // block_chars), 1)


def bucket_count(docs: DataFrame, blocks: int) -> int:
    return max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, block, packed: texts compressed, dealt to blocks by hash; null ones are empty. Repeated
    rows are alike but for the partition they are read in, and go to as many blocks as that gives."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", blank_if_null("text").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [z.compress(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "block", "packed"])

    return rows.mapInArrow(pack, f"doc_id {kind}, block long, packed binary")


def texts_of(table: pa.Table) -> Iterator[str]:
    z = zstandard.ZstdDecompressor()
    return (z.decompress(x.as_py()).decode() for x in table.column("packed"))


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes, the lowest first."""
    values = values.astype("<u8", copy=False)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def starts_of(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each bucket, a range of `bits`-bit keys, begins in sorted keys, and at last where they end."""
    starts = np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def ask(block: int, keys: np.ndarray, counts: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows of ASKED for the buckets that a block has keys of."""
    used = np.flatnonzero(np.diff(at))
    return pa.table(
        {
            "bucket": pa.array(used, pa.int64()),
            "block": pa.array(np.full(len(used), block), pa.int64()),
            "keys": pa.array([pack_numbers(np.diff(keys[at[b] : at[b + 1]], prepend=np.uint64(0))) for b in used], pa.binary()),
            "counts": pa.array([pack_numbers(counts[at[b] : at[b + 1]]) for b in used], pa.binary()),
        }
    )


def answer(table: pa.Table) -> pa.Table:
    """Rows of ANSWERED for one bucket's rows of ASKED."""
    parts = [np.cumsum(unpack_numbers(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
    counts = np.concatenate([unpack_numbers(x.as_py()) for x in table.column("counts")])
    ends = np.cumsum([0, *map(len, parts)])
    _, where = np.unique(np.concatenate(parts), return_inverse=True)
    del parts
    sums = np.bincount(where, counts)[where]
    packed = [pack_numbers(sums[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "sums": pa.array(packed, pa.binary())})


def answers_of(pieces: Iterable[tuple[int, bytes]], at: np.ndarray) -> np.ndarray:
    """The sums of a block's keys, in their order, from its answers (bucket, sums); 0 where none came."""
    sums = np.zeros(at[-1], np.float64)
    for b, packed in pieces:
        sums[at[b] : at[b + 1]] = unpack_numbers(packed)
    return sums
