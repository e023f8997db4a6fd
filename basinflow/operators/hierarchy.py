"""Merge sequences: spanning trees, pair counts, correlation clustering and cuts.

The sequence of merges is inherently ordered, so it runs in Python per image; images run in
parallel and one image's graph must fit in one task. For one large graph take boruvka(), which
joins and aggregates in rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components, dropped, written
from .watershed import IMAGE, best_edge, follow


class Sets:
    """Disjoint sets that keep, for each set, how many vertices bear each label."""

    def __init__(self, labels: dict[int, int] | None = None):
        self.parent: dict[int, int] = {}
        self.labels = labels or {}
        self.count: dict[int, dict[int, int]] = {}
        self.size: dict[int, int] = {}

    def root(self, v: int) -> int:
        if v not in self.parent:
            self.parent[v], self.size[v] = v, 1
            self.count[v] = {self.labels.get(v, v): 1}
            return v
        path = []
        while self.parent[v] != v:
            path.append(v)
            v = self.parent[v]
        for p in path:
            self.parent[p] = v
        return v

    def merge(self, a: int, b: int) -> tuple[int, int]:
        """Merges two roots; the numbers of pairs of vertices between them with the same label and with different ones."""
        if len(self.count[a]) < len(self.count[b]):
            a, b = b, a
        big, small = self.count[a], self.count.pop(b)
        same = sum(n * big.get(label, 0) for label, n in small.items())
        for label, n in small.items():
            big[label] = big.get(label, 0) + n
        pairs = self.size[a] * self.size[b]
        self.parent[b] = a
        self.size[a] += self.size[b]
        return same, pairs - same


def in_order(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges by w descending, then u, v."""
    return np.lexsort((v, u, -w))


def _grouped(f, schema: str, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    if extra is None:
        return edges.groupBy(IMAGE).applyInArrow(f, schema)
    return edges.groupBy(IMAGE).cogroup(extra.groupBy(IMAGE)).applyInArrow(f, schema)


def _edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v = (table.column(c).to_numpy().astype(np.int64) for c in ("u", "v"))
    w = table.column("w").to_numpy().astype(np.float64)
    order = in_order(u, v, w)
    return u[order], v[order], w[order]


def merges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The maximum spanning forest in merge order, with pair counts by label.

    labels: image_id, v, label. Returns image_id, step (from 1), u, v, w, same, diff: how many
    pairs of vertices with equal, and with different, labels the merge puts together.
    """

    def run(e: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if e.num_rows:
            sets = Sets(dict(zip(given.column("v").to_pylist(), given.column("label").to_pylist(), strict=True)))
            for a, b, w in zip(*(x.tolist() for x in _edges(e)), strict=True):
                ra, rb = sets.root(a), sets.root(b)
                if ra != rb:
                    out.append((len(out) + 1, a, b, w, *sets.merge(ra, rb)))
        image = e.column(IMAGE)[0].as_py() if e.num_rows else 0
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({IMAGE: pa.array([image] * len(out), pa.int64())} | {n: pa.array(c, t) for n, c, t in zip(("step", "u", "v", "w", "same", "diff"), columns, types, strict=True)})

    schema = "image_id long, step int, u long, v long, w double, same long, diff long"
    return _grouped(run, schema, edges.select(IMAGE, "u", "v", "w"), labels.select(IMAGE, "v", F.col("label").cast("long").alias("label")))


def mst_edges(edges: DataFrame) -> DataFrame:
    """image_id, u, v, w of the maximum spanning forest, per image."""
    ends = edges.select(IMAGE, F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("label", F.lit(0))
    return merges(edges, ends).select(IMAGE, "u", "v", "w")


def boruvka(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest by rounds of joins, for graphs of any size.

    Each round every component takes its best edge out of it, and components that these edges
    tie together become one: in a total order of the edges best edges only lead to better ones, so
    following them finds what they tie. Then between two components the best edge alone is kept.
    This is the forest of merges().
    """
    alive = written(edges.filter("u != v").select(IMAGE, "u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")))
    rounds: list[DataFrame] = []
    order = F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"), "cu", "cv")
    while not alive.isEmpty():
        ends = F.explode(F.array("cu", "cv")).alias("c")
        best = alive.select("*", ends).groupBy(IMAGE, "c").agg(F.max(order).alias("b"))
        to = F.when(F.col("c") == F.col("b.cu"), F.col("b.cv")).otherwise(F.col("b.cu"))
        best = written(best.select(IMAGE, F.col("c").alias("n"), to.alias("to"), (-F.col("b.nu")).alias("u"), (-F.col("b.nv")).alias("v"), "b.w"))
        rounds.append(best)
        comps = follow(best.drop("w"))
        after = alive
        for side in ("cu", "cv"):
            after = after.join(comps.select(IMAGE, F.col("n").alias(side), F.col("root").alias(f"_{side}")), [IMAGE, side])
        # Of several edges between two components only the first of the order can be a best one again.
        after = after.filter("_cu != _cv").groupBy(IMAGE, F.least("_cu", "_cv").alias("cu"), F.greatest("_cu", "_cv").alias("cv")).agg(F.max(F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"))).alias("b"))
        after = written(after.select(IMAGE, (-F.col("b.nu")).alias("u"), (-F.col("b.nv")).alias("v"), "b.w", "cu", "cv"))
        dropped(alive, comps)
        alive = after
    dropped(alive)
    if not rounds:
        return edges.select(IMAGE, "u", "v", "w").limit(0)
    tree = rounds[0].select(IMAGE, "u", "v", "w")
    for one in rounds[1:]:
        tree = tree.union(one.select(IMAGE, "u", "v", "w"))
    return tree.distinct()


def merge_rank(edges: DataFrame) -> DataFrame:
    """image_id, u, v, w, rank: the merge, in order, at which each edge's ends are first connected."""

    def run(e: pa.Table) -> pa.Table:
        u, v, w = _edges(e)
        sets, rank = Sets(), {}
        waiting: dict[int, set[int]] = {}
        for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            for x in (a, b):
                waiting.setdefault(x, set()).add(i)
        step = 0
        for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            ra, rb = sets.root(a), sets.root(b)
            if ra == rb:
                continue
            step += 1
            sets.merge(ra, rb)
            # Edges that left both sets now lie inside.
            small, large = sorted((waiting.pop(ra), waiting.pop(rb)), key=len)
            for j in small & large:
                rank[j] = step
            waiting[sets.root(a)] = large ^ small
        n = len(u)
        return pa.table({IMAGE: pa.array([e.column(IMAGE)[0].as_py()] * n, pa.int64()), "u": u, "v": v, "w": w, "rank": pa.array([rank[i] for i in range(n)], pa.int32())})

    return _grouped(run, "image_id long, u long, v long, w double, rank int", edges.select(IMAGE, "u", "v", "w"))


def offset_threshold(edges: DataFrame, offset: float) -> DataFrame:
    """image_id, theta: the weight at place floor(n * offset), from 0, of the weights in descending order."""
    from .components import order_statistic

    return order_statistic(edges, offset, "w", descending=True).withColumnRenamed("threshold", "theta")


def energy_curve(edges: DataFrame, theta: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """Correlation-clustering energy after each merge: image_id, rank (0 for none), w, energy.

    Energy is what the weights less theta, of edges between clusters, add up to. An edge leaves
    the sum at its merge rank, so the curve is one cumulative sum.
    """
    rows = merge_rank(edges) if ranked is None else ranked
    if theta is not None:
        rows = rows.join(theta, IMAGE).withColumn("w", F.col("w") - F.col("theta")).drop("theta")
    steps = rows.groupBy(IMAGE, "rank").agg(F.sum("w").alias("_gone"), F.max("w").alias("w"))
    start = rows.groupBy(IMAGE).agg(F.sum("w").alias("_all"), F.max("w").alias("_top"))
    zero = start.select(IMAGE, F.lit(0).alias("rank"), F.lit(0.0).alias("_gone"), F.lit(None).cast("double").alias("w"))
    order = W.partitionBy(IMAGE).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    curve = steps.unionByName(zero).join(start.select(IMAGE, "_all"), IMAGE)
    return curve.select(IMAGE, "rank", "w", (F.col("_all") - F.sum("_gone").over(order)).alias("energy"))


def min_energy_threshold(curve: DataFrame, include: bool = False) -> DataFrame:
    """image_id, energy, threshold: where the curve is lowest, first of equals.

    The threshold lies midway between the weight of the merge that reached the minimum and the one
    before (1000 above the first), so it leaves that merge out; with `include` just under its weight.
    If no merge lowers the energy the threshold is 1000 above the first weight.
    """
    order = W.partitionBy(IMAGE).orderBy("rank")
    first = F.first(F.when(F.col("rank") == 1, F.col("w")), ignorenulls=True).over(W.partitionBy(IMAGE))
    before = F.coalesce(F.lag("w").over(order), first + 1000.0)
    rows = curve.select(IMAGE, "rank", "energy", "w", before.alias("_before"), first.alias("_first"))
    at = rows.groupBy(IMAGE).agg(F.min(F.struct("energy", "rank", "w", "_before", "_first")).alias("b"))
    cut = (F.col("b.w") - 1e-12) if include else (F.col("b.w") + F.col("b._before")) / 2
    return at.select(IMAGE, F.col("b.energy").alias("energy"), F.when(F.col("b.rank") == 0, F.col("b._first") + 1000.0).otherwise(cut).alias("threshold"))


def cut_labels(edges: DataFrame, threshold: DataFrame, vertices: DataFrame, by_image: bool = False) -> DataFrame:
    """image_id, v, comp: components of the edges with w >= threshold. threshold: image_id, threshold;
    by_image as for components()."""
    kept = edges.join(threshold.select(IMAGE, "threshold"), IMAGE).filter(F.col("w") >= F.col("threshold"))
    return components(kept, vertices, by_image)


@dataclass(frozen=True)
class Scored:
    """What a scored pass gives: the image's totals, and its scored edges in order."""

    totals: DataFrame
    edges: DataFrame


def scored_pass(edges: DataFrame, labels: DataFrame, offset: float | list[float] = 0.75) -> Scored:
    """The hierarchy over an image and its labels: watershed, then clustering of its basins, with
    the pair counts of every merge. Of several offsets an image takes that at its number modulo theirs.

    totals: image_id, n_basins, threshold, energy, pos, neg, false_neg, false_pos, rand_error.
    edges: image_id, layer (0 watershed, 1 clustering), seq, basin, u, v, w, same, diff, kept. seq
    orders the watershed's merges by basin, then by weight, then the clustering's by weight.
    """

    offsets = offset if isinstance(offset, list) else [offset]

    def run(e: pa.Table, given: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        image = e.column(IMAGE)[0].as_py() if e.num_rows else 0
        offset = offsets[image % len(offsets)]
        if e.num_rows:
            rows = [(image, *r) for r in _score(*(x.tolist() for x in _edges(e)), dict(zip(given.column("v").to_pylist(), given.column("label").to_pylist(), strict=True)), offset)]
        names = ("image_id", "layer", "seq", "basin", "u", "v", "w", "same", "diff", "kept", "n_basins", "threshold", "energy")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    schema = "image_id long, layer int, seq int, basin int, u long, v long, w double, same long, diff long, kept boolean, n_basins int, threshold double, energy double"
    all_rows = written(_grouped(run, schema, edges.select(IMAGE, "u", "v", "w"), labels.select(IMAGE, "v", F.col("label").cast("long").alias("label"))))
    pos, neg = F.sum("same"), F.sum("diff")
    fn, fp = F.sum(F.when(~F.col("kept"), F.col("same")).otherwise(0)), F.sum(F.when(F.col("kept"), F.col("diff")).otherwise(0))
    totals = all_rows.groupBy(IMAGE).agg(F.max("n_basins").alias("n_basins"), F.max("threshold").alias("threshold"), F.max("energy").alias("energy"), pos.alias("pos"), neg.alias("neg"), fn.alias("false_neg"), fp.alias("false_pos"), ((fn + fp) / (pos + neg)).alias("rand_error"))
    return Scored(totals, all_rows.drop("n_basins", "threshold", "energy"))


def _score(us: list[int], vs: list[int], ws: list[float], labels: dict[int, int], offset: float) -> list[tuple]:
    """The rows of scored_pass() for one image, edges in order."""
    sets, basin_of, weight, tree = Sets(labels), {}, [], []
    crossing: dict[tuple[int, int], tuple[float, int, int, float]] = {}
    for u, v, w in zip(us, vs, ws, strict=True):
        bu, bv = basin_of.get(u), basin_of.get(v)
        if bu is not None and bv is not None:
            if bu != bv:
                crossing.setdefault((min(bu, bv), max(bu, bv)), (w - max(weight[bu], weight[bv]), u, v, w))
            continue
        if bu is None and bv is None:
            weight.append(w)
        basin = bv if bv is not None else bu if bu is not None else len(weight) - 1
        basin_of[u] = basin_of[v] = basin
        tree.append((basin, u, v, w, *sets.merge(sets.root(u), sets.root(v))))
    tree.sort(key=lambda r: r[0])
    n = len(weight)
    out = [(0, i + 1, b + 1, u, v, w, same, diff, True) for i, (b, u, v, w, same, diff) in enumerate(tree)]
    if not crossing:
        return [(*r, n, 0.0, 0.0) for r in out]

    deep = sorted((-d, pair, u, v, w) for pair, (d, u, v, w) in crossing.items())
    theta = -deep[min(int(len(deep) * offset), len(deep) - 1)][0]
    # A cluster of basins keeps its outgoing depths by cluster, so a merge costs the smaller side.
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for minus, (a, b), *_ in deep:
        near[a][b] = near[b][a] = -minus - theta
    energy = sum(-m - theta for m, *_ in deep)
    low, cut, before = energy, -deep[0][0] - theta + 1e3, -deep[0][0] - theta + 1e3
    home = list(range(n))

    def root(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    for minus, (a, b), *_ in deep:
        ra, rb = root(a), root(b)
        if ra == rb:
            continue
        if len(near[ra]) < len(near[rb]):
            ra, rb = rb, ra
        energy -= near[ra].pop(rb)
        near[rb].pop(ra)
        for c, x in near[rb].items():
            near[ra][c] = near[ra].get(c, 0.0) + x
            near[c].pop(rb)
            near[c][ra] = near[ra][c]
        home[rb] = ra
        if energy < low:
            low, cut = energy, (before - minus - theta) / 2
        before = -minus - theta
    for minus, _, u, v, w in deep:
        ru, rv = sets.root(u), sets.root(v)
        if ru != rv:
            out.append((1, len(out) + 1, 0, u, v, w, *sets.merge(ru, rv), -minus - theta - cut >= 0))
    return [(*r, n, theta + cut, low) for r in out]


def small_optimum(edges: DataFrame, most: int = 9) -> DataFrame:
    """image_id, v, cluster of the partition of least energy, by trying all: for at most `most` vertices."""

    def run(e: pa.Table) -> pa.Table:
        u, v, w = _edges(e)
        nodes = sorted({*u.tolist(), *v.tolist()})
        if len(nodes) > most:
            raise ValueError(f"{len(nodes)} vertices are too many for trying all partitions")
        at = {x: i for i, x in enumerate(nodes)}
        pairs = [(at[a], at[b], x) for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True)]
        best = min(partitions(len(nodes)), key=lambda p: (round(sum(x for a, b, x in pairs if p[a] != p[b]), 9), p))
        return pa.table({IMAGE: pa.array([e.column(IMAGE)[0].as_py()] * len(nodes), pa.int64()), "v": pa.array(nodes, pa.int64()), "cluster": pa.array(best, pa.int32())})

    return _grouped(run, "image_id long, v long, cluster int", edges.select(IMAGE, "u", "v", "w"))


def partitions(n: int):
    """All set partitions of n things, as the number of each thing's block in order of first sight."""
    stack = [(0,)] if n else [()]
    while stack:
        p = stack.pop()
        if len(p) == n:
            yield p
        else:
            stack += [(*p, b) for b in range(max(p) + 2)]


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """image_id, v, cluster: merges the two clusters of greatest joint weight while it is positive."""

    def run(e: pa.Table) -> pa.Table:
        u, v, w = _edges(e)
        nodes = sorted({*u.tolist(), *v.tolist()})
        near: dict[int, dict[int, float]] = {x: {} for x in nodes}
        for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + x
        home = {x: x for x in nodes}
        while True:
            x, a, b = max(((x, -a, -b) for a in near for b, x in near[a].items() if a < b), default=(0.0, 0, 0))
            if x <= 0:
                break
            a, b = -a, -b
            for c, y in near.pop(b).items():
                near[c].pop(b)
                if c != a:
                    near[a][c] = near[c][a] = near[a].get(c, 0.0) + y
            home = {k: a if h == b else h for k, h in home.items()}
        return pa.table({IMAGE: pa.array([e.column(IMAGE)[0].as_py()] * len(nodes), pa.int64()), "v": pa.array(nodes, pa.int64()), "cluster": pa.array([home[k] for k in nodes], pa.int64())})

    return _grouped(run, "image_id long, v long, cluster long", edges.select(IMAGE, "u", "v", "w"))


def singleton_forest(edges: DataFrame) -> DataFrame:
    """Every edge with mark: 1 if it is some vertex's best, else -1 if its ends lie in different
    basins; edges inside a basin keep their weight."""
    from .watershed import basin_roots

    roots = written(basin_roots(edges))
    best = best_edge(edges).select(IMAGE, "u", "v").distinct().withColumn("_best", F.lit(True))
    joined = edges.join(best, [IMAGE, "u", "v"], "left")
    joined = joined.join(roots.select(IMAGE, F.col("n").alias("u"), F.col("root").alias("_a")), [IMAGE, "u"]).join(roots.select(IMAGE, F.col("n").alias("v"), F.col("root").alias("_b")), [IMAGE, "v"])
    mark: Column = F.when(F.col("_best"), 1.0).when(F.col("_a") != F.col("_b"), -1.0).otherwise(F.col("w"))
    return joined.select(IMAGE, "u", "v", "w", mark.alias("mark"))


def marker_watershed(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """image_id, v, marker: each vertex takes the marker that it meets first when edges are added
    in order and clusters with different markers stay apart; 0 where none is met.

    markers: image_id, v, marker > 0.
    """

    def run(e: pa.Table, given: pa.Table) -> pa.Table:
        if not e.num_rows:
            return pa.table({IMAGE: pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "marker": pa.array([], pa.int64())})
        mark = {v: m for v, m in zip(given.column("v").to_pylist(), given.column("marker").to_pylist(), strict=True) if m is not None and m > 0}
        u, v, _ = _edges(e)
        parent = {x: x for x in [*u.tolist(), *v.tolist()]}
        own = {x: mark.get(x, 0) for x in parent}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb and not (own[ra] and own[rb] and own[ra] != own[rb]):
                parent[rb] = ra
                own[ra] = own[ra] or own[rb]
        nodes = sorted(parent)
        return pa.table({IMAGE: pa.array([e.column(IMAGE)[0].as_py()] * len(nodes), pa.int64()), "v": pa.array(nodes, pa.int64()), "marker": pa.array([own[root(x)] for x in nodes], pa.int64())})

    return _grouped(run, "image_id long, v long, marker long", edges.select(IMAGE, "u", "v", "w"), markers.select(IMAGE, "v", F.col("marker").cast("long").alias("marker")))
