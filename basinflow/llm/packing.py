"""Token ids packed into rows of one length: best fit decreasing with a tree over free room."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Encoder, Vocabulary, pack_ranks
from .common import blank_if_null, keeps, make_room, small_batches


class FreeRoom:
    """Bins by free room, as a segment tree that finds the least room that holds a piece."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node //= 2

    def put(self, room: int, bin_: int) -> None:
        if room:
            self.bins[room].append(bin_)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a bin of the least room of at least `need` and returns it with its room."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            # Up to the first ancestor whose right neighbour holds a bin, then down to the least.
            while node > 1 and (node % 2 or not count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        bin_ = self.bins[room].pop()
        self._add(room, -1)
        return bin_, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Pieces of 1 to `length` tokens, largest first, each to the fullest bin that still holds it."""
    room, bins = FreeRoom(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[piece])
        if found is None:
            bins.append([piece])
            room.put(length - sizes[piece], len(bins) - 1)
        else:
            bins[found[0]].append(piece)
            room.put(found[1] - sizes[piece], found[0])
    return bins


def split(n: int, length: int) -> list[tuple[int, int]]:
    """A document's pieces: whole rows, then what is left."""
    return [(a, min(a + length, n)) for a in range(0, n, length)]


_RUN = re.compile(r"\s{4096}")


@lru_cache(maxsize=2)
def _worker_tokenizer(packed: bytes, pattern: str):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.split(b"\n") if x)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow: list[Encoder] = []

    def ids(text: str) -> np.ndarray:
        if _RUN.search(text):  # the library's matcher gives up on very long runs of white space
            slow[:] = slow or [Encoder(Vocabulary(ranks), pattern)]
            return np.array(slow[0].encode(text), np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


keeps("packing", _worker_tokenizer.cache_clear)


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, length: int = 2048, pad: int | None = None, buffer_tokens: int = 2_000_000) -> DataFrame:
    """Tokenizes every whole text and packs the ids into rows of `length`.

    docs: doc_id, text; more columns are ignored. Documents longer than a row are split; nothing
    is dropped. Each input partition is a shard that packs by itself, in buffers of about
    buffer_tokens ids, so nothing is shuffled and memory is bounded; a lost task is redone alone.

    Returns a row for each packed row: shard, row, n_tokens, ids (little-endian, `length` of 2
    bytes if all ids and pad fit, of 4 otherwise, padded at the end), cu_seqlens (0, then the
    cumulative segment lengths), position_ids (likewise `length` of 4 bytes; from 0 in each segment
    and 0 in the padding), doc_ids and doc_starts of the segments (the place of a segment's first
    id in its document).

    Null and empty texts have no ids and appear in no row; null ids are kept as null; rows that
    repeat a doc_id are segments of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    packed = spark.sparkContext.broadcast(pack_ranks(ranks))  # as large as the vocabulary
    fill = max(ranks.values()) + 1 if pad is None else pad
    kind = np.dtype("<u2") if max(max(ranks.values()), fill) < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("packing")
        tokenize = _worker_tokenizer(packed.value, pattern)
        shard, row = TaskContext.get().partitionId(), 0

        def rows(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal row
            pieces = [(d, a, ids[a:b]) for d, ids in held for a, b in split(len(ids), length)]
            bins = best_fit([len(p[2]) for p in pieces], length)
            for at in range(0, len(bins), 1024):
                out: dict[str, list] = {k: [] for k in ("shard", "row", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts")}
                for chosen in bins[at : at + 1024]:
                    segments = [pieces[i] for i in chosen]
                    line, places = np.full(length, fill, kind), np.zeros(length, "<u4")
                    ends = np.cumsum([0, *(len(s[2]) for s in segments)])
                    for (_, _, ids), start, stop in zip(segments, ends, ends[1:], strict=False):
                        line[start:stop] = ids
                        places[start:stop] = np.arange(stop - start)
                    for k, v in zip(out, (shard, row, int(ends[-1]), line.tobytes(), ends.tolist(), places.tobytes(), [s[0] for s in segments], [s[1] for s in segments]), strict=True):
                        out[k].append(v)
                    row += 1
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

        held, tokens = [], 0
        for batch in batches:
            for d, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokenize(text.as_py())
                held.append((d.as_py(), ids))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from rows(held)
                    held, tokens = [], 0
        if held:
            yield from rows(held)

    rows = docs.select("doc_id", blank_if_null("text").alias("text"))
    return rows.mapInArrow(run, "shard int, row long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>")


def matrix(rows: list[bytes], length: int, width: int = 2) -> np.ndarray:
    """Packed rows as an id matrix."""
    return np.frombuffer(b"".join(rows), f"<u{width}").reshape(-1, length)
