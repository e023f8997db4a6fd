"""Watersheds on edge tables, order-free: every vertex follows its best edge.

Edges are in a total order: w descending, then u, v ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import dropped, written

IMAGE = "image_id"


def _incident(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: image_id, n, other, w, u, v; one explode, no union."""
    ends = F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("other")), F.struct(F.col("v").alias("n"), F.col("u").alias("other")))
    return edges.select(IMAGE, "u", "v", "w", F.explode(ends).alias("_e")).select(IMAGE, "_e.n", "_e.other", "w", "u", "v")


def _rank(w: str = "w", u: str = "u", v: str = "v") -> Column:
    """Greatest for the first edge of the order."""
    return F.struct(F.col(w).alias("w"), (-F.col(u)).alias("nu"), (-F.col(v)).alias("nv"))


def best_edge(edges: DataFrame) -> DataFrame:
    """image_id, n, u, v, w: each vertex's first edge; pre-aggregated before the shuffle."""
    best = _incident(edges).groupBy(IMAGE, "n").agg(F.max(_rank()).alias("b"))
    return best.select(IMAGE, "n", (-F.col("b.nu")).alias("u"), (-F.col("b.nv")).alias("v"), F.col("b.w").alias("w"))


def minmax_edges(edges: DataFrame) -> DataFrame:
    """w' = w - min(best other weight at u, best other weight at v), -infinity for a lone edge; the
    end that gave the minimum (`winner`, u on ties) and its best other edge (wu, wv, ww; null if none).

    Two best edges a vertex suffice: the other end's best is the second where the edge itself is first.
    """
    order = W.partitionBy(IMAGE, "n").orderBy(F.col("w").desc(), "u", "v")
    top = _incident(edges).withColumn("_i", F.row_number().over(order)).filter("_i <= 2")
    two = top.groupBy(IMAGE, "n").agg(*[F.max(F.when(F.col("_i") == i, F.struct("u", "v", "w"))).alias(f"_{i}") for i in (1, 2)])

    def other(side: str) -> DataFrame:
        return two.select(IMAGE, F.col("n").alias(side), F.col("_1").alias(f"_1{side}"), F.col("_2").alias(f"_2{side}"))

    def rest(side: str) -> Column:
        own = (F.col(f"_1{side}.u") == F.col("u")) & (F.col(f"_1{side}.v") == F.col("v"))
        return F.when(own, F.col(f"_2{side}")).otherwise(F.col(f"_1{side}"))

    joined = edges.join(other("u"), [IMAGE, "u"]).join(other("v"), [IMAGE, "v"])
    joined = joined.withColumns({"_a": rest("u"), "_b": rest("v")})
    a, b = (F.coalesce(F.col(f"{x}.w"), F.lit(float("-inf"))) for x in ("_a", "_b"))
    joined = joined.withColumn("_e", F.when(a <= b, F.col("_a")).otherwise(F.col("_b")))
    return joined.select(
        IMAGE,
        "u",
        "v",
        "w",
        (F.col("w") - F.least(a, b)).alias("cut"),
        F.when(a <= b, F.col("u")).otherwise(F.col("v")).alias("winner"),
        *[F.col(f"_e.{c}").alias(f"w{c}") for c in ("u", "v", "w")],
    )


def minmax_cut(edges: DataFrame) -> DataFrame:
    """image_id, u, v, w, cut and winner of minmax_edges()."""
    return minmax_edges(edges).select(IMAGE, "u", "v", "w", "cut", "winner")


def maxmin_cut(edges: DataFrame) -> DataFrame:
    """The cut where low weights are alike: w - max(least other weight at u, least other weight at v),
    infinity for a lone edge; the same as minmax_cut of the negated weights, negated."""
    turned = minmax_cut(edges.select(IMAGE, "u", "v", (-F.col("w")).alias("w")))
    return turned.select(IMAGE, "u", "v", (-F.col("w")).alias("w"), (-F.col("cut")).alias("cut"), "winner")


def gather_cut(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """image_id, u, v, cut: outputs (image_id, u, v, w) of a network less its output at the edge that
    sets the minimum of the cut of `edges`; lone edges keep their output."""
    where = minmax_edges(edges).select(IMAGE, "u", "v", "wu", "wv")
    other = outputs.select(IMAGE, F.col("u").alias("wu"), F.col("v").alias("wv"), F.col("w").alias("_other"))
    joined = outputs.select(IMAGE, "u", "v", "w").join(where, [IMAGE, "u", "v"]).join(other, [IMAGE, "wu", "wv"], "left")
    return joined.select(IMAGE, "u", "v", (F.col("w") - F.coalesce("_other", F.lit(0.0))).alias("cut"))


def best_forest(edges: DataFrame) -> DataFrame:
    """The edges that are some vertex's best: exactly those with cut > 0, the watershed's forest."""
    return best_edge(edges).select(IMAGE, "u", "v", "w").distinct()


def follow(hop: DataFrame, rounds: int | None = None) -> DataFrame:
    """image_id, n, root of best neighbours (image_id, n, to, u, v, the edge): where they lead. Of two
    that lead to each other by one edge the smaller is the root.

    Pointer jumping takes four times the distance each round, until nothing changes; with `rounds`,
    4^rounds steps are taken in one plan without any action.
    """
    back = hop.select(IMAGE, F.col("n").alias("to"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    mutual = (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))
    start = hop.join(back, [IMAGE, "to"]).select(IMAGE, "n", F.when(mutual, F.least("n", "to")).otherwise(F.col("to")).alias("root"))
    at, done = written(start), 0
    while rounds is None or done < rounds:
        jump = at.select(IMAGE, F.col("n").alias("root"), F.col("root").alias("_next"))
        after = at.withColumn("_old", F.col("root"))
        for _ in range(2):
            after = after.join(jump, [IMAGE, "root"]).select(IMAGE, "n", F.col("_next").alias("root"), "_old")
        if rounds is None:
            after = written(after)
            dropped(at)
            if after.filter("root != _old").isEmpty():
                return after.drop("_old")
        at, done = after.drop("_old"), done + 1
    return at


def basin_roots(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """image_id, n, root: the mutual best edge's smaller end that following best edges leads to (see follow)."""
    other = F.when(F.col("n") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    return follow(best_edge(edges).select(IMAGE, "n", other.alias("to"), "u", "v"), rounds)


def basins(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """image_id, root, basin, weight: basins numbered from 1 in the order of their first edges,
    whose weight is the basin's."""
    first = best_edge(edges).join(roots.filter("n = root").select(IMAGE, "n", "root"), [IMAGE, "n"])
    number = F.row_number().over(W.partitionBy(IMAGE).orderBy(F.col("w").desc(), "u", "v"))
    return first.select(IMAGE, "root", number.alias("basin"), F.col("w").alias("weight"))


def watershed(edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The labels (image_id, v, label) and the basins (image_id, basin, weight)."""
    roots = written(basin_roots(edges, rounds))
    found = written(basins(edges, roots))
    labels = roots.join(found, [IMAGE, "root"]).select(IMAGE, F.col("n").alias("v"), F.col("basin").alias("label"))
    return labels, found.select(IMAGE, "basin", "weight")


def super_edges(edges: DataFrame, labels: DataFrame, found: DataFrame, waterfall: bool = False) -> DataFrame:
    """image_id, b1, b2, depth, u, v: of each two basins the best crossing edge, and how deep it
    lies under the higher basin; with `waterfall` its own weight instead."""
    a = labels.select(IMAGE, F.col("v").alias("u"), F.col("label").alias("_a"))
    b = labels.select(IMAGE, "v", F.col("label").alias("_b"))
    crossing = edges.join(a, [IMAGE, "u"]).join(b, [IMAGE, "v"]).filter("_a != _b")
    best = crossing.groupBy(IMAGE, F.least("_a", "_b").alias("b1"), F.greatest("_a", "_b").alias("b2")).agg(F.max(_rank()).alias("_e"))
    w1 = found.select(IMAGE, F.col("basin").alias("b1"), F.col("weight").alias("_w1"))
    w2 = found.select(IMAGE, F.col("basin").alias("b2"), F.col("weight").alias("_w2"))
    joined = best.join(w1, [IMAGE, "b1"]).join(w2, [IMAGE, "b2"])
    depth = F.col("_e.w") if waterfall else F.col("_e.w") - F.greatest("_w1", "_w2")
    return joined.select(IMAGE, "b1", "b2", depth.alias("depth"), (-F.col("_e.nu")).alias("u"), (-F.col("_e.nv")).alias("v"))


def waterfall_level(edges: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame:
    """The next level: basins of the region graph, image_id, basin, label; lone basins keep 1."""
    return waterfall_of(super_edges(edges, labels, found, waterfall=True), found)


def waterfall_of(supers: DataFrame, found: DataFrame) -> DataFrame:
    """The same from super-edges with their own weights."""
    regions = written(supers.select(IMAGE, F.col("b1").alias("u"), F.col("b2").alias("v"), F.col("depth").alias("w")))
    up, _ = watershed(regions)
    return found.join(up.withColumnRenamed("v", "basin"), [IMAGE, "basin"], "left").select(IMAGE, "basin", F.coalesce("label", F.lit(1)).alias("label"))


def basins_from_gray(raster: DataFrame, width: int) -> DataFrame:
    """image_id, v, label: the watershed's basins of a gray raster, edges weighed by minus their difference."""
    from .graph import ABSDIFF, grid_edges

    return watershed(written(grid_edges(raster, width, ABSDIFF)))[0]


def label_image(labels: DataFrame, width: int, add: int = 1) -> DataFrame:
    """image_id, x, y, value: labels of vertices (basins, markers, clusters) as a raster, raised by `add`
    so that 0 is free for none."""
    return labels.select(IMAGE, (F.col("v") % width).cast("int").alias("x"), F.floor(F.col("v") / width).cast("int").alias("y"), (F.col("label") + add).cast("long").alias("value"))


def compact_basins(compact: DataFrame, width: int, kind: str = "mean", values: str = "values", pixels: int = 1 << 14) -> DataFrame:
    """image_id, values, labels, weights: the watershed of compact rasters in one projection, without a
    shuffle. labels holds each pixel's basin from 1, weights each basin's.

    For images of up to `pixels` pixels, which a row holds anyway: pointers are followed by array
    index, and a pixel looks its basin's number up among the image's basins. Larger images go by
    their edges (watershed).
    """
    from .graph import affinity

    rounds = max(1, (pixels - 1).bit_length())
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    a = F.col(values)
    n = F.size(a)

    def edge(ok: Column, u: Column, v: Column, other: Column) -> Column:
        w = affinity(F.get(a, u).cast("double"), F.get(a, v).cast("double"), kind)
        return F.when(ok, F.struct(w.alias("w"), (-u).alias("nu"), (-v).alias("nv"), other.alias("to")))

    def first(i: Column) -> Column:
        return F.array_max(
            F.array(
                edge(((i + 1) % width != 0) & (i + 1 < n), i, i + 1, i + 1),
                edge(i % width != 0, i - 1, i, i - 1),
                edge(i + width < n, i, i + width, i + width),
                edge(i >= width, i - width, i, i - width),
            )
        )

    def roots(best: Column) -> Column:
        to = lambda i: F.get(best, i)["to"]
        at = F.transform(best, lambda x, i: F.when((to(x["to"]) == i) & (i < x["to"]), i).otherwise(x["to"]))
        for _ in range(rounds):
            at = once(at, lambda p: F.transform(p, lambda x: F.get(p, x)))
        return once(at, lambda p: numbered(best, p))

    def numbered(best: Column, at: Column) -> Column:
        own = F.filter(F.transform(at, lambda r, i: F.when(r == i, F.struct((-F.get(best, i)["w"]).alias("o"), (-F.get(best, i)["nu"]).alias("u"), (-F.get(best, i)["nv"]).alias("v"), i.alias("root")))), lambda x: x.isNotNull())

        def labelled(order: Column) -> Column:
            names = F.transform(order, lambda x: x["root"])
            labels = once(names, lambda k: F.transform(at, lambda r: F.array_position(k, r).cast("int")))
            return F.struct(labels.alias("labels"), F.transform(order, lambda x: -x["o"]).alias("weights"))

        return once(F.array_sort(own), labelled)

    found = once(F.transform(F.sequence(F.lit(0), n - 1), first), roots)
    rows = compact.filter(n > 1).select(IMAGE, a.alias("values"), found.alias("_f"))
    return rows.select(IMAGE, "values", "_f.labels", "_f.weights")


def compact_watershed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels and basins, as watershed() gives them, of compact_basins()."""
    labels = found.select(IMAGE, F.posexplode("labels").alias("v", "label"))
    return labels, found.select(IMAGE, F.posexplode("weights").alias("_i", "weight")).select(IMAGE, (F.col("_i") + 1).alias("basin"), "weight")


def compact_super_edges(found: DataFrame, width: int, kind: str = "mean", waterfall: bool = False) -> DataFrame:
    """super_edges() of compact_basins(): ends look their basins up by index, so there is one shuffle."""
    from .graph import affinity

    rows = found.select("*", F.posexplode("values").alias("u", "_a"))
    steps = F.array(F.when((F.col("u") + 1) % width != 0, F.lit(1)), F.lit(width))
    rows = rows.withColumn("_s", F.explode(steps)).withColumn("v", F.col("u") + F.col("_s")).filter("v < size(values)")
    rows = rows.withColumns({"_la": F.get("labels", F.col("u")), "_lb": F.get("labels", F.col("v"))}).filter("_la != _lb")
    w = affinity(F.col("_a").cast("double"), F.get("values", F.col("v")).cast("double"), kind)
    high = F.greatest(F.get("weights", F.col("_la") - 1), F.get("weights", F.col("_lb") - 1))
    rows = rows.select(IMAGE, "u", "v", w.alias("w"), F.least("_la", "_lb").alias("b1"), F.greatest("_la", "_lb").alias("b2"), high.alias("_h"))
    best = rows.groupBy(IMAGE, "b1", "b2").agg(F.max(_rank()).alias("_e"), F.max("_h").alias("_h"))
    depth = F.col("_e.w") if waterfall else F.col("_e.w") - F.col("_h")
    return best.select(IMAGE, "b1", "b2", depth.alias("depth"), (-F.col("_e.nu")).alias("u"), (-F.col("_e.nv")).alias("v"))
