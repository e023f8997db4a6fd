"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage_table


class SortedLists:
    """The vectors of a block with, for every dimension, its rows from the least to the greatest value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, query: np.ndarray, k: int, own: int | None = None, floor: int | None = None, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k highest products, ties to smaller ids, without the id `own` and
        those below `floor`, a score that k rows elsewhere reach.

        Every list is read from the end that the query's sign favours, in rounds of growing depth;
        rows met first are scored in full at once. No row unseen so far can score above the sum of
        the products at the current depth: when the k-th score is greater than that, it ends. Equal
        isn't enough, since an unseen row may tie and have a smaller id. It also ends when that sum
        is below the floor, or when every row has been met.
        """
        n = len(self.ids)
        live = np.flatnonzero(query)
        q, up = query[live], query[live] > 0
        seen = np.zeros(n, bool)
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step = 0, first
        while depth < n:
            stop = min(n, depth + step)
            if len(live):
                near = np.concatenate([self.lists[n - stop : n - depth, live[up]].ravel(), self.lists[depth:stop, live[~up]].ravel()])
            else:
                near, stop = np.arange(n), n  # all score 0
            fresh = np.zeros(n, bool)
            fresh[near] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            if own is not None:
                rows = rows[self.ids[rows] != own]
            best_rows, best = np.concatenate([best_rows, rows]), np.concatenate([best, self.vectors[rows] @ query])
            if len(best) > k:
                # Rows lie by id, so a stable order on rows settles ties.
                keep = np.lexsort((best_rows, -best))[:k]
                best_rows, best = best_rows[keep], best[keep]
            depth, step = stop, step * 2
            if seen.all():
                break  # every row is scored
            if depth < n and (len(best) >= k or floor is not None):
                edge = np.where(up, self.values[n - depth, live], self.values[depth - 1, live]) @ q
                if floor is not None and edge < floor or len(best) >= k and best.min() > edge:
                    break
        if floor is not None:
            best_rows, best = best_rows[best >= floor], best[best >= floor]
        keep = np.lexsort((best_rows, -best))[:k]
        return self.ids[best_rows[keep]], best[keep]


def whole_numbers(vector: Column | str, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def finite(vector: Column | str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def search(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """The k highest integer inner products of every query with all other vectors.

    vectors: vec_id, embedding; more columns are ignored. Components count as floor(64 x). Returns
    query_id, rank, vec_id and score; all candidates if there are fewer than k.

    Blocks of queries meet blocks of candidates; each pair of blocks is searched by itself
    (SortedLists) and gives k rows a query at most, of which the best k are kept. The first block of
    candidates is searched before the others: the k-th score there is a floor that every query
    takes along, so that others stop sooner and give only rows that may count.

    Rows whose vector is null or holds null or non-finite components take no part. Empty vectors
    score 0; missing components of shorter vectors count as 0. Rows that share the query's vec_id
    count as its own. Rows that repeat a vec_id are candidates each by itself; as queries they are
    one, with the least of their vectors in array order. Products are exact integers; above 2^53
    they are worked out without floating point. An empty table gives no rows.
    """
    good = vectors.filter(finite("embedding")).select("vec_id", F.coalesce(is_query, F.lit(False)).alias("asks"), whole_numbers("embedding").alias("v"))
    good = stage_table(good.filter("vec_id is not null"), "topk-vectors")
    sizes = good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    blocks, asks = max(-(-sizes["n"] // block_rows), 1), max(-(-(sizes["q"] or 0) // block_queries), 1)

    def numbers(first: int, last: int) -> Column:
        return F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))

    no_floor = F.lit(None).cast("long").alias("floor")
    # A hot vec_id's rows are spread by their vectors.
    rows = good.select("vec_id", "v", F.lit(False).alias("asks"), no_floor, F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), numbers(0, asks - 1).alias("part"))
    queries = good.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(asks)))

    def run(table: pa.Table) -> pa.Table:
        ids, asks, vs = table.column("vec_id").to_numpy(), np.array(table.column("asks").to_pylist(), bool), table.column("v").combine_chunks()
        lengths = np.diff(vs.offsets.to_numpy())
        flat = vs.flatten().to_numpy()
        width = max(lengths.max(initial=0), 1)
        m = np.zeros((len(ids), width), np.int64)
        m[np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(flat) else np.zeros(0, np.int64)] = flat
        most = float(np.abs(m.astype(np.float64)).max(initial=0))
        m = m.astype(np.float64) if most * most * width < 2**53 else m.astype(object)
        lists = SortedLists(ids[~asks], m[~asks])
        floors = [f for f, a in zip(table.column("floor").to_pylist(), asks, strict=True) if a]
        out = [(i, *lists.top(v, k, i, f)) for i, v, f in zip(ids[asks], m[asks], floors, strict=True)]
        query = np.concatenate([np.full(len(found), i, np.int64) for i, found, _ in out]) if out else np.zeros(0, np.int64)
        found = np.concatenate([f for _, f, _ in out]) if out else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in out]) if out else np.zeros(0)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array([int(s) for s in scores], pa.int64())})

    def searched(some_rows: DataFrame, some_queries: DataFrame) -> DataFrame:
        both = some_rows.unionByName(some_queries.select("vec_id", "v", F.lit(True).alias("asks"), "floor", "block", "part"))
        return both.groupBy("block", "part").applyInArrow(run, "query_id long, vec_id long, score long")

    cells = searched(rows.filter("block = 0"), queries.select("*", F.lit(0).cast("long").alias("block"), no_floor))
    if blocks > 1:
        cells = stage_table(cells, "topk-first")
        floors = cells.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).drop("n")
        asked = queries.join(floors, "vec_id", "left").withColumn("block", numbers(1, blocks - 1))
        cells = cells.unionByName(searched(rows.filter("block > 0"), asked))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
