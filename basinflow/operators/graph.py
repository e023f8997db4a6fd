"""Graphs of pixels and regions: edges (image_id, u, v, w), u < v, higher w for more alike.

A pixel's vertex number is y * width + x.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL, neighbours

MEAN = "mean"
ABSDIFF = "absdiff"
SUM = "sum"
NEAR = "near"


def affinity(a: Column, b: Column, kind: str) -> Column:
    if kind == MEAN:
        return (a + b) / 2
    if kind == ABSDIFF:
        return -F.abs(a - b)
    if kind == SUM:
        return a + b
    if kind == NEAR:  # of image graphs: 20 - |a - b| + 0.5
        return 20.5 - F.abs(a - b)
    raise ValueError(f"unknown affinity {kind}")


def grid_edges_compact(compact: DataFrame, width: int, kind: str = MEAN, values: str = "values", invert: bool = False) -> DataFrame:
    """4-neighbour edges of compact rasters, by index within the array: no shuffle at all."""
    rows = compact.select("image_id", F.col(values).alias("_a"), F.posexplode(values).alias("u", "_v"))
    steps = F.array(F.struct(F.lit(1).alias("step"), ((F.col("u") + 1) % width != 0).alias("ok")), F.struct(F.lit(width).alias("step"), (F.col("u") + width < F.size("_a")).alias("ok")))
    rows = rows.select("*", F.explode(steps).alias("_s")).filter("_s.ok and u + _s.step < size(_a)")
    other = F.get(F.col("_a"), F.col("u") + F.col("_s.step")).cast("double")
    w = affinity(F.col("_v").cast("double"), other, kind)
    return rows.select("image_id", "u", (F.col("u") + F.col("_s.step")).alias("v"), (-w if invert else w).alias("w"))


def grid_edges(raster: DataFrame, width: int, kind: str = MEAN, offsets: Sequence[tuple[int, int]] = ((1, 0), (0, 1))) -> DataFrame:
    """Edges of rasters in rows: each pixel is joined with the pixel at each offset.

    Offsets from one half-plane give each pair once; see radius_offsets.
    """
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    left = raster.select("image_id", "x", "y", F.col("value").alias("_a"), F.explode(steps).alias("_o"))
    left = left.select("image_id", (F.col("y") * width + F.col("x")).alias("_i"), "_a", (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    joined = left.join(raster.select(*PIXEL, F.col("value").alias("_b")), PIXEL)
    j = F.col("y") * width + F.col("x")
    return joined.select("image_id", F.least("_i", j).alias("u"), F.greatest("_i", j).alias("v"), affinity(F.col("_a"), F.col("_b"), kind).alias("w"))


def grid_edges_two_bands(bands: DataFrame, width: int, height: int) -> DataFrame:
    """Edges from two affinity bands (columns band0, band1), by the first endpoint: band0 to the right, band1 downwards."""
    u = F.col("y") * width + F.col("x")
    steps = F.array(
        F.struct((u + 1).alias("v"), F.col("band0").alias("w"), (F.col("x") + 1 < width).alias("ok")),
        F.struct((u + width).alias("v"), F.col("band1").alias("w"), (F.col("y") + 1 < height).alias("ok")),
    )
    return bands.select("image_id", u.alias("u"), F.explode(steps).alias("_s")).filter("_s.ok").select("image_id", "u", "_s.v", "_s.w")


def radius_offsets(radii: Sequence[int]) -> list[tuple[int, int]]:
    """The 8 neighbours at each radius, one of each opposite pair."""
    found = [(dx * r, dy * r) for r in radii for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))]
    return list(dict.fromkeys(found))


def edge_gt_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds gt: 1 where both ends have the same label, else -1. labels: image_id, v, label."""
    a = labels.select("image_id", F.col("v").alias("u"), F.col("label").alias("_la"))
    b = labels.select("image_id", "v", F.col("label").alias("_lb"))
    joined = edges.join(a, ["image_id", "u"]).join(b, ["image_id", "v"])
    return joined.withColumn("gt", F.when(F.abs(F.col("_la") - F.col("_lb")) < 1, 1).otherwise(-1)).drop("_la", "_lb")


def edge_census(labelled_edges: DataFrame) -> DataFrame:
    same, n = F.count_if(F.col("gt") == 1), F.count(F.lit(1))
    return labelled_edges.groupBy("image_id").agg((same / n).alias("frac_same"), same.alias("n_same"), F.count_if(F.col("gt") == -1).alias("n_diff"))


def threshold_ge(edges: DataFrame, theta: float, feature: str = "w") -> DataFrame:
    return edges.filter(F.col(feature) >= theta)


def threshold_le(edges: DataFrame, theta: float, feature: str = "w") -> DataFrame:
    return edges.filter(F.col(feature) <= theta)


def subgraph(edges: DataFrame, width: int, x0: int, y0: int, size: int) -> DataFrame:
    """Edges inside a square, with vertex numbers of the square."""

    def place(c: str) -> tuple[Column, Column]:
        return F.col(c) % width - x0, F.floor(F.col(c) / width).cast("int") - y0

    (ux, uy), (vx, vy) = place("u"), place("v")
    inside = (ux >= 0) & (ux < size) & (uy >= 0) & (uy < size) & (vx >= 0) & (vx < size) & (vy >= 0) & (vy < size)
    return edges.filter(inside).select("image_id", (uy * size + ux).alias("u"), (vy * size + vx).alias("v"), "w")


def edges_to_images(edges: DataFrame, width: int, feature: str = "w") -> DataFrame:
    """The feature at its edge's first endpoint, one band for edges to the right and one downwards."""
    band = F.when(F.col("v") - F.col("u") == 1, 0).otherwise(1)
    return edges.select("image_id", (F.col("u") % width).alias("x"), F.floor(F.col("u") / width).cast("int").alias("y"), band.alias("band"), F.col(feature).alias("value"))


def edges_to_boundary(edges: DataFrame, width: int, feature: str = "w") -> DataFrame:
    """Each pixel's greatest feature of its edges to the right and downwards; the image's least where it has none."""
    shown = edges_to_images(edges, width, feature).groupBy(*PIXEL).agg(F.max("value").alias("value"))
    low = edges.groupBy("image_id").agg(F.min(feature).alias("_low"))
    ends = edges.select("image_id", F.explode(F.array("u", "v")).alias("_p")).distinct()
    pixels = ends.select("image_id", (F.col("_p") % width).alias("x"), F.floor(F.col("_p") / width).cast("int").alias("y"))
    return pixels.join(shown, PIXEL, "left").join(low, "image_id").select(*PIXEL, F.coalesce("value", "_low").alias("value"))


def region_graph(labels: DataFrame) -> DataFrame:
    """Adjacent labels of a label raster, each pair once, with the length of their border.

    The label of each pixel meets those to the right and below; pairs are counted before the shuffle.
    """
    sent = neighbours(labels.withColumnRenamed("label", "value"), [(0, 0), (1, 0), (0, 1)])
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("value")))
    own = sent.groupBy(*PIXEL).agg(at(0, 0).alias("_a"), at(1, 0).alias("_r"), at(0, 1).alias("_d")).filter("_a is not null")
    pairs = own.select("image_id", "_a", F.explode(F.array("_r", "_d")).alias("_b")).filter("_b is not null and _a != _b")
    return pairs.groupBy("image_id", F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).agg(F.count(F.lit(1)).alias("n_border"))


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels: (image_id, u, v) of labels with the number, sum, least and greatest w of their edges."""
    a = labels.select("image_id", F.col("v").alias("u"), F.col("label").alias("_a"))
    b = labels.select("image_id", "v", F.col("label").alias("_b"))
    joined = edges.join(a, ["image_id", "u"]).join(b, ["image_id", "v"]).filter("_a != _b")
    keys = [F.col("image_id"), F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("sum_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))


def intra_label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    return edge_gt_labels(edges, labels).filter("gt = 1").drop("gt")


def random_non_edges(edges: DataFrame, vertices: DataFrame, per_vertex: int, seed: int) -> DataFrame:
    """Seeded vertex pairs of an image that are not edges, about per_vertex for each vertex.

    vertices: image_id, v, numbered 0 to n - 1. Partners are drawn by hash, so reruns agree.
    """
    n = vertices.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    drawn = vertices.join(n, "image_id").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_vertex))))
    other = F.pmod(F.xxhash64(F.lit(seed), "image_id", "v", "_k"), F.col("_n"))
    pairs = drawn.select("image_id", F.least("v", other).alias("u"), F.greatest("v", other).alias("v")).filter("u != v").distinct()
    return pairs.join(edges.select("image_id", "u", "v"), ["image_id", "u", "v"], "left_anti")


def contrast_copy(edges: DataFrame, shift: int, between: DataFrame) -> DataFrame:
    """A graph, its copy with vertices shifted, and edges between both (image_id, u, v, w)."""
    copy = edges.select("image_id", (F.col("u") + shift).alias("u"), (F.col("v") + shift).alias("v"), "w")
    return edges.select("image_id", "u", "v", "w").union(copy).unionByName(between.select("image_id", "u", "v", "w"))


def vector_edges(bands: DataFrame, width: int, offsets: Sequence[tuple[int, int]] = ((1, 0), (0, 1))) -> DataFrame:
    """Edges of rasters whose pixels hold a vector (column `values`): image_id, u, v, a and b (both
    ends' vectors) and w, minus their distance."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    left = bands.select("image_id", "x", "y", F.col("values").alias("a"), F.explode(steps).alias("_o"))
    left = left.select("image_id", (F.col("y") * width + F.col("x")).alias("u"), "a", (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))
    joined = left.join(bands.select(*PIXEL, F.col("values").alias("b")), PIXEL)
    apart = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, d: acc + d)
    return joined.select("image_id", "u", (F.col("y") * width + F.col("x")).alias("v"), "a", "b", (-F.sqrt(apart)).alias("w"))


def marker_vertices(vertices: DataFrame, markers: DataFrame) -> DataFrame:
    """image_id, v, marker: every vertex with its marker, 0 where it has none or one of 0 or less."""
    marked = markers.filter("marker > 0").groupBy("image_id", "v").agg(F.min("marker").cast("long").alias("_m"))
    return vertices.select("image_id", "v").join(marked, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("_m", F.lit(0).cast("long")).alias("marker"))


def contrast_labels(vertices: DataFrame, shift: int, width: int | None = None, block: int | None = None) -> DataFrame:
    """Labels of a contrast copy: 0 for the graph and 1 for its shifted copy; with `block` the squares of
    that size, numbered by row, in place of 0, and the same after them for the copy."""
    first = F.lit(0).cast("long")
    if block:
        across = -(-width // block)
        first = (F.floor(F.floor(F.col("v") / width) / block) * across + F.floor((F.col("v") % width) / block)).cast("long")
    rows = vertices.select("image_id", "v", first.alias("label"))
    top = F.lit(1).cast("long")
    if block:
        top = rows.groupBy("image_id").agg((F.max("label") + 1).alias("_top"))
        return rows.unionByName(rows.join(top, "image_id").select("image_id", (F.col("v") + shift).alias("v"), (F.col("label") + F.col("_top")).alias("label")))
    return rows.unionByName(rows.select("image_id", (F.col("v") + shift).alias("v"), top.alias("label")))
