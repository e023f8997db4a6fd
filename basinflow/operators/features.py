"""Features pooled over regions and over the borders between them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL, neighbours
from .watershed import IMAGE


def pool_sum(pixels: DataFrame, region: str = "label", band: str | None = None) -> DataFrame:
    """Sums, not means, of a region's values, by band if there is one."""
    return pixels.groupBy(IMAGE, region, *([band] if band else [])).agg(F.sum("value").alias("total"))


def pool_moments(pixels: DataFrame, region: str = "label") -> DataFrame:
    return pixels.groupBy(IMAGE, region).agg(F.avg("value").alias("mean"), (F.avg(F.col("value") * F.col("value")) - F.avg("value") * F.avg("value")).alias("variance"), F.count(F.lit(1)).alias("n"))


def pool_histogram(binned: DataFrame, region: str = "label") -> DataFrame:
    """Magnitude by region and orientation bin over the region's pixels. binned: bin1, bin2, weight1, weight2, magnitude."""
    parts = F.explode(F.array(F.struct(F.col("bin1").alias("bin"), F.col("weight1").alias("w")), F.struct(F.col("bin2").alias("bin"), F.col("weight2").alias("w"))))
    rows = binned.select(IMAGE, region, "magnitude", parts.alias("_p"))
    sums = rows.groupBy(IMAGE, region, F.col("_p.bin").alias("bin")).agg(F.sum(F.col("magnitude") * F.col("_p.w")).alias("_s"))
    n = binned.groupBy(IMAGE, region).agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(n, [IMAGE, region]).select(IMAGE, region, "bin", (F.col("_s") / F.col("_n")).alias("share"))


def edge_from_regions(pairs: DataFrame, pooled: DataFrame, feature: str, squared: bool = False, region: str = "label") -> DataFrame:
    """|f1 - f2|, or its square, of the regions at both ends."""
    a = pooled.select(IMAGE, F.col(region).alias("u"), F.col(feature).alias("_a"))
    b = pooled.select(IMAGE, F.col(region).alias("v"), F.col(feature).alias("_b"))
    diff = F.col("_a") - F.col("_b")
    return pairs.join(a, [IMAGE, "u"]).join(b, [IMAGE, "v"]).select(*pairs.columns, (diff * diff if squared else F.abs(diff)).alias(feature))


def histogram_distance(pairs: DataFrame, histogram: DataFrame, region: str = "label") -> DataFrame:
    """Sum of absolute and of squared differences of two regions' histograms; missing bins count as 0.

    Every pair meets both regions' bins, and the two sides are subtracted in one aggregation.
    """
    sides = F.explode(F.array(F.struct(F.col("u").alias("r"), F.lit(1.0).alias("s")), F.struct(F.col("v").alias("r"), F.lit(-1.0).alias("s"))))
    rows = pairs.select(IMAGE, "u", "v", sides.alias("_x")).select(IMAGE, "u", "v", F.col("_x.r").alias(region), F.col("_x.s").alias("_s"))
    bins = rows.join(histogram, [IMAGE, region]).groupBy(IMAGE, "u", "v", "bin").agg(F.sum(F.col("_s") * F.col("share")).alias("_d"))
    return bins.groupBy(IMAGE, "u", "v").agg(F.sum(F.abs("_d")).alias("l1"), F.sum(F.col("_d") * F.col("_d")).alias("l2"))


def border_pixels(pixels: DataFrame) -> DataFrame:
    """4-neighbour pixel pairs across a border: image_id, u, v (labels, u < v), a, b (values of both), dx, dy, swap."""
    sent = neighbours(pixels.withColumn("value", F.struct("label", "value")), [(0, 0), (1, 0), (0, 1)])
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("value")))
    own = sent.groupBy(*PIXEL).agg(at(0, 0).alias("_o"), at(1, 0).alias("_r"), at(0, 1).alias("_d")).filter("_o is not null")
    sides = F.explode(F.array(F.struct(F.col("_r").alias("n"), F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.col("_d").alias("n"), F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    rows = own.select(IMAGE, "_o", sides.alias("_s")).filter("_s.n is not null and _o.label != _s.n.label")
    swap = F.col("_o.label") > F.col("_s.n.label")
    return rows.select(
        IMAGE,
        F.least("_o.label", "_s.n.label").alias("u"),
        F.greatest("_o.label", "_s.n.label").alias("v"),
        F.col("_o.value").alias("a"),
        F.col("_s.n.value").alias("b"),
        F.col("_s.dx").alias("dx"),
        F.col("_s.dy").alias("dy"),
        swap.alias("swap"),
    )


def pool_boundary(pixels: DataFrame) -> DataFrame:
    """Least and greatest pair minimum and the length of each border."""
    low = F.least("a", "b")
    return border_pixels(pixels).groupBy(IMAGE, "u", "v").agg(F.min(low).alias("low"), F.max(low).alias("high"), F.count(F.lit(1)).alias("length"))


def pool_boundary_bands(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """The same for several value columns, each from its own band on both sides."""
    out = None
    for band in bands:
        one = pool_boundary(pixels.select(*PIXEL, "label", F.col(band).alias("value")))
        one = one.select(IMAGE, "u", "v", *[F.col(c).alias(f"{band}_{c}") for c in ("low", "high")], *(["length"] if out is None else []))
        out = one if out is None else out.join(one, [IMAGE, "u", "v"])
    return out


def boundary_shape(border: DataFrame, regions: DataFrame) -> DataFrame:
    """Depth, volume and aspect of each border: how far it lies over the lower of the regions'
    minima, that times its length, and its length over the smaller region's perimeter scale.

    border: of pool_boundary(); regions: image_id, label, low, n.
    """
    a = regions.select(IMAGE, F.col("label").alias("u"), F.col("low").alias("_la"), F.col("n").alias("_na"))
    b = regions.select(IMAGE, F.col("label").alias("v"), F.col("low").alias("_lb"), F.col("n").alias("_nb"))
    depth = F.col("low") - F.greatest("_la", "_lb")
    return border.join(a, [IMAGE, "u"]).join(b, [IMAGE, "v"]).select(IMAGE, "u", "v", "length", depth.alias("depth"), (depth * F.col("length")).alias("volume"), (F.col("length") / F.sqrt(F.least("_na", "_nb"))).alias("aspect"))


def boundary_directions(pixels: DataFrame, bins: int = 9) -> DataFrame:
    """Soft direction bins of each border's mean normal, from the first region to the second."""
    from .raster import linear_bins

    sign = F.when(F.col("swap"), -1.0).otherwise(1.0)
    mean = border_pixels(pixels).groupBy(IMAGE, "u", "v").agg(F.sum(sign * F.col("dx")).alias("nx"), F.sum(sign * F.col("dy")).alias("ny"), F.count(F.lit(1)).alias("length"))
    turn = F.pmod(F.atan2("ny", "nx") / 6.283185307179586, F.lit(1.0))
    return linear_bins(mean, turn, bins)


def smooth_triangles(pairs: DataFrame, feature: str, share: float = 0.5) -> DataFrame:
    """Mixes each pair's feature with the mean of the pairs that make a triangle with it.

    Triangles are found from each pair's two regions: the join is on the shared third region's
    edges, by key, and counted once.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("r"), F.col("v").alias("o")), F.struct(F.col("v").alias("r"), F.col("u").alias("o"))))
    sides = pairs.select(IMAGE, F.col(feature).alias("_f"), ends.alias("_e")).select(IMAGE, F.col("_e.r").alias("_r"), F.col("_e.o").alias("_o"), "_f")
    first = pairs.join(sides.withColumnRenamed("_r", "u"), [IMAGE, "u"]).filter(F.col("_o") != F.col("v"))
    third = first.join(sides.select(IMAGE, F.col("_r").alias("v"), "_o", F.col("_f").alias("_g")), [IMAGE, "v", "_o"])
    mean = third.groupBy(IMAGE, "u", "v").agg(F.avg((F.col("_f") + F.col("_g")) / 2).alias("_m"))
    joined = pairs.join(mean, [IMAGE, "u", "v"], "left")
    return joined.withColumn(feature, F.coalesce((1 - share) * F.col(feature) + share * F.col("_m"), F.col(feature))).drop("_m")


def merge_vertex_features(features: DataFrame, parents: DataFrame, feature: str) -> DataFrame:
    """Means over the children of each parent. parents: image_id, label, parent."""
    return features.join(parents, [IMAGE, "label"]).groupBy(IMAGE, "parent").agg(F.avg(feature).alias(feature), F.count(F.lit(1)).alias("n_children"))


def merge_edge_features(edges: DataFrame, parents: DataFrame, feature: str) -> DataFrame:
    """Least and greatest of the child edges between two parents."""
    a = parents.select(IMAGE, F.col("label").alias("u"), F.col("parent").alias("_a"))
    b = parents.select(IMAGE, F.col("label").alias("v"), F.col("parent").alias("_b"))
    rows = edges.join(a, [IMAGE, "u"]).join(b, [IMAGE, "v"]).filter("_a != _b")
    return rows.groupBy(IMAGE, F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).agg(F.min(feature).alias("low"), F.max(feature).alias("high"))


def split_features(features: DataFrame, feature: str, label: str) -> DataFrame:
    """|f - mean of its label|; the mean is joined back, so no label is held by one task."""
    mean = features.groupBy(IMAGE, label).agg(F.avg(feature).alias("_m"))
    return features.join(mean, [IMAGE, label]).withColumn(feature, F.abs(F.col(feature) - F.col("_m"))).drop("_m")


def bbox_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy(IMAGE, "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n_pixels"))


def changed_window(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, x0, y0, x1, y1: the box around pixels whose label changed and their 4-neighbours."""
    changed = before.join(after.select(*PIXEL, F.col("label").alias("_b")), PIXEL).filter(F.abs(F.col("label") - F.col("_b")) > 0.5)
    touched = neighbours(changed.withColumn("value", F.lit(1)), [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]).select(*PIXEL).distinct()
    inside = touched.join(before.select(*PIXEL), PIXEL, "left_semi")
    return inside.groupBy(IMAGE).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def contours(labels: DataFrame) -> DataFrame:
    """image_id, label, ring: each segment's outer contour along pixel corners, closed.

    One segment at a time is traced in Python; its border pixels must fit in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        cells = set(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))
        step: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for x, y in cells:
            # Corners are walked with the segment on the right.
            for gone, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
                if gone not in cells:
                    step.setdefault(a, []).append(b)
        start = min(step, key=lambda p: (p[1], p[0]))
        ring, at, came = [start], start, (1, 0)
        while True:
            # At a corner where two parts touch turn right, so that each stays outside the other.
            turn = lambda b: (came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0]))  # noqa: E731, B023
            nxt = max(step[at], key=turn)
            step[at].remove(nxt)
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            ring.append(at)
            if at == start:
                break
        corners = [p for i, p in enumerate(ring[:-1]) if (ring[i - 1 if i else -2][0] - p[0]) * (ring[i + 1][1] - p[1]) != (ring[i - 1 if i else -2][1] - p[1]) * (ring[i + 1][0] - p[0])]
        closed = [list(p) for p in [*corners, corners[0]]]
        return pa.table({IMAGE: table.column(IMAGE)[:1], "label": table.column("label")[:1], "ring": pa.array([closed], pa.list_(pa.list_(pa.int32())))})

    rows = labels.select(F.col(IMAGE).cast("long").alias(IMAGE), F.col("label").cast("long").alias("label"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return rows.groupBy(IMAGE, "label").applyInArrow(run, "image_id long, label long, ring array<array<int>>")


def geojson(rings: DataFrame, scale: float = 1.0) -> DataFrame:
    """One FeatureCollection of polygons per image."""
    ring = F.transform("ring", lambda p: F.transform(p, lambda c: c * scale))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("label").alias("properties"))
    rows = rings.select(IMAGE, F.struct("label", feature.alias("f")).alias("s"))
    return rows.groupBy(IMAGE).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"]).alias("features"))).alias("geojson"))


#: Feature names to how they are pooled from (image_id, x, y, label, value).
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw": pool_sum,
    "moments": pool_moments,
    "edge": pool_boundary,
    "vecEdges": boundary_directions,
}


def pool_named(pixels: DataFrame, names: str) -> dict[str, DataFrame]:
    """The features of a comma-separated list."""
    return {n: REGISTRY[n](pixels) for n in (x.strip() for x in names.split(",")) if n}


def population_code(rows: DataFrame, value: Column, centres: list[float], sigma: float) -> DataFrame:
    """One row per centre with the Gaussian response to the value."""
    c = F.explode(F.array(*map(F.lit, centres)))
    return rows.select("*", value.alias("_v"), c.alias("centre")).withColumn("response", F.exp(-F.pow(F.col("_v") - F.col("centre"), 2) / (2 * sigma * sigma))).drop("_v")
