"""Queries over rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import features, raster

from .catalog import register
from .tables import PX, compact, pixels, quadrant, sign_labels


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})  # + 0.0: no negative zeros


def _kernel(name: str, kernel: dict) -> str:
    """SQL of a zero-padded correlation over px."""
    rows = ", ".join(f"({dx}, {dy}, {w}::DOUBLE)" for (dx, dy), w in kernel.items())
    return f"{name} AS (SELECT a.image_id, a.x, a.y, coalesce(sum(b.value * k.w), 0) AS value FROM px a CROSS JOIN (VALUES {rows}) AS k(dx, dy, w) LEFT JOIN px b ON b.image_id = a.image_id AND b.x = a.x + k.dx AND b.y = a.y + k.dy GROUP BY ALL)"


@register("raster_explode", f"WITH {PX} SELECT image_id, x, y, value FROM px")
def raster_explode(spark, sf):
    return pixels(spark, sf)


@register("raster_header", f"WITH {PX} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n_pixels FROM px GROUP BY image_id")
def raster_header(spark, sf):
    return raster.header(pixels(spark, sf))


@register("raster_stats", f"WITH {PX} SELECT image_id, count(value) AS n, min(value) AS low, max(value) AS high FROM px GROUP BY image_id")
def raster_stats(spark, sf):
    return raster.stats(pixels(spark, sf))


@register("raster_compact", "SELECT vec_id AS image_id, round(embedding[1]::DOUBLE + 2 * embedding[10]::DOUBLE + 3 * embedding[64]::DOUBLE, 6) AS probe FROM embeddings")
def raster_compact(spark, sf):
    found = raster.compact_raster(pixels(spark, sf))
    return found.select("image_id", F.round(F.get("values", F.lit(0)) + 2 * F.get("values", F.lit(9)) + 3 * F.get("values", F.lit(63)), 6).alias("probe"))


@register("raster_window_read", f"WITH {PX} SELECT image_id, x - 2 AS x, y - 1 AS y, value FROM px WHERE x >= 2 AND x < 6 AND y >= 1 AND y < 7")
def raster_window_read(spark, sf):
    return raster.window_read(pixels(spark, sf), 2, 1, 6, 7)


_MM = f"WITH {PX}, r AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM px GROUP BY image_id)"


@register("minmax_scale", f"{_MM} SELECT image_id, x, y, CASE WHEN hi - lo > 1e-4 THEN (value - lo) / (hi - lo) * 1.0::DOUBLE ELSE value - lo END AS value FROM px JOIN r USING (image_id)")
def minmax_scale(spark, sf):
    return raster.minmax_scale(pixels(spark, sf))


@register("float_to_byte", f"{_MM} SELECT image_id, x, y, floor(CASE WHEN hi - lo > 1e-4 THEN (value - lo) / (hi - lo) * 255.0::DOUBLE ELSE value - lo END)::INT AS value FROM px JOIN r USING (image_id)")
def float_to_byte(spark, sf):
    return raster.to_byte(pixels(spark, sf))


@register("stride_crop", f"WITH {PX} SELECT image_id, (x // 2 - 1)::INT AS x, (y // 2)::INT AS y, value FROM px WHERE x % 2 = 0 AND y % 2 = 0 AND x // 2 BETWEEN 1 AND 3 AND y // 2 < 3")
def stride_crop(spark, sf):
    return raster.stride_crop(pixels(spark, sf), 2, 1, 0, 3, 3)


@register("tile_keys", f"WITH {PX} SELECT image_id, value, (y // 4)::INT AS tile_row, (x // 4)::INT AS tile_col, (x % 4)::INT AS x, (y % 4)::INT AS y FROM px")
def tile_keys(spark, sf):
    return raster.tile_keys(pixels(spark, sf), 4, 4)


@register("centre_trim", f"WITH {PX} SELECT image_id, x - 1 AS x, y - 1 AS y, value FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
def centre_trim(spark, sf):
    return raster.centre_trim(pixels(spark, sf), 3)


@register(
    "stack_bands",
    f"""WITH {PX}, st AS (SELECT image_id // 10 AS image_id, (image_id % 10)::INT AS z, x, y, value FROM px)
SELECT b.image_id, b.z, b.x, b.y, a.value AS band0, b.value AS band1, c.value AS band2 FROM st b
JOIN st a ON a.image_id = b.image_id AND a.z = b.z - 1 AND a.x = b.x AND a.y = b.y JOIN st c ON c.image_id = b.image_id AND c.z = b.z + 1 AND c.x = b.x AND c.y = b.y""",
)
def stack_bands(spark, sf):
    p = pixels(spark, sf).select(F.floor(F.col("image_id") / 10).alias("image_id"), (F.col("image_id") % 10).cast("int").alias("z"), "x", "y", "value")
    return raster.stack_bands(p)


@register("rotate90", f"WITH {PX} SELECT image_id, 7 - y AS x, x AS y, value FROM px")
def rotate90(spark, sf):
    return raster.rotate90(pixels(spark, sf), 8, 8)


@register("rotate270", f"WITH {PX} SELECT image_id, y AS x, 7 - x AS y, value FROM px")
def rotate270(spark, sf):
    return raster.rotate90(pixels(spark, sf), 8, 8, 3)


@register("flip_h", f"WITH {PX} SELECT image_id, 7 - x AS x, y, value FROM px")
def flip_h(spark, sf):
    return raster.flip_h(pixels(spark, sf), 8)


@register("mosaic", f"WITH {PX} SELECT (x + image_id % 5 * 8)::INT AS x, (y + image_id // 5 * 8)::INT AS y, value FROM px")
def mosaic(spark, sf):
    return raster.mosaic(pixels(spark, sf), 8, 8, 5)


@register("box_sum", f"WITH {PX}, {_kernel('k', raster.BOX3)} SELECT image_id, x, y, round(value, 6) AS value FROM k")
def box_sum(spark, sf):
    return _r(raster.box_sum(pixels(spark, sf)), "value")


@register("laplacian", f"WITH {PX}, {_kernel('k', raster.LAPLACE)} SELECT image_id, x, y, round(value, 6) AS value FROM k")
def laplacian(spark, sf):
    return _r(raster.laplacian(pixels(spark, sf)), "value")


@register("scharr", f"WITH {PX}, {_kernel('kx', raster.SCHARR_X)}, {_kernel('ky', raster.SCHARR_Y)} SELECT image_id, x, y, round(sqrt(kx.value * kx.value + ky.value * ky.value), 6) AS value FROM kx JOIN ky USING (image_id, x, y)")
def scharr(spark, sf):
    return _r(raster.scharr(pixels(spark, sf)), "value")


@register(
    "sobel",
    f"""WITH {PX.replace("px AS", "raw AS", 1)}, {_kernel("px", raster.BOX3).replace("px a", "raw a").replace("px b", "raw b")}, {_kernel("kx", raster.SOBEL_X)}, {_kernel("ky", raster.SOBEL_Y)}
SELECT image_id, x, y, round(-kx.value * kx.value, 6) + 0 AS gx, round(-ky.value * ky.value, 6) + 0 AS gy, round(-sqrt(pow(kx.value, 4) + pow(ky.value, 4)), 6) + 0 AS magnitude FROM kx JOIN ky USING (image_id, x, y)""",
)
def sobel(spark, sf):
    return _r(raster.sobel(pixels(spark, sf)), "gx", "gy", "magnitude")


@register(
    "sobel_plain",
    f"""WITH {PX}, {_kernel("kx", raster.SOBEL_X)}, {_kernel("ky", raster.SOBEL_Y)}
SELECT image_id, x, y, round(kx.value * kx.value, 6) AS gx, round(ky.value * ky.value, 6) AS gy, round(sqrt(pow(kx.value, 4) + pow(ky.value, 4)), 6) AS magnitude FROM kx JOIN ky USING (image_id, x, y)""",
)
def sobel_plain(spark, sf):
    return _r(raster.sobel(pixels(spark, sf), smooth=False, sign=1.0), "gx", "gy", "magnitude")


_NEXT = f"WITH {PX}, n AS (SELECT a.*, coalesce(r.value, 0) AS vr, coalesce(d.value, 0) AS vd FROM px a LEFT JOIN px r ON r.image_id = a.image_id AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN px d ON d.image_id = a.image_id AND d.x = a.x AND d.y = a.y + 1)"


@register("diravg", f"{_NEXT} SELECT image_id, x, y, round(0.5 * value + 0.5 * vr, 6) + 0 AS avg_x, round(0.5 * value + 0.5 * vd, 6) + 0 AS avg_y FROM n")
def diravg(spark, sf):
    return _r(raster.dir_avg(pixels(spark, sf)), "avg_x", "avg_y")


@register("dirgrad_maxpool", f"{_NEXT} SELECT image_id, (x // 2)::INT AS x, (y // 2)::INT AS y, round(max(abs(vr - value)), 6) AS gx, round(max(abs(vd - value)), 6) AS gy FROM n GROUP BY ALL")
def dirgrad_maxpool(spark, sf):
    return _r(raster.dir_grad_maxpool(pixels(spark, sf)), "gx", "gy")


@register("block_mean", f"WITH {PX} SELECT image_id, (x // 4)::INT AS x, (y // 4)::INT AS y, round(avg(value), 6) AS value FROM px GROUP BY ALL")
def block_mean(spark, sf):
    return _r(raster.block_mean(pixels(spark, sf), 4), "value")


_LEARNED = [0.1, -0.2, 0.3, 0.0, 1.0, 0.5, -0.1, 0.2, -0.3]
_LEARNED_KERNEL = {(i % 3 - 1, i // 3 - 1): w for i, w in enumerate(_LEARNED)}


@register("linear_filter", f"WITH {PX}, {_kernel('k', _LEARNED_KERNEL)} SELECT image_id, x, y, round(value + 0.25, 6) AS value FROM k")
def linear_filter(spark, sf):
    return _r(raster.linear_filter(pixels(spark, sf), _LEARNED, 0.25), "value")


@register(
    "patches",
    f"""WITH {PX} SELECT a.image_id, a.x, a.y, round(sum(b.value * (1 + (b.y - a.y + 1) * 3 + (b.x - a.x + 1))), 6) AS probe
FROM px a JOIN px b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY ALL""",
)
def patches(spark, sf):
    p = raster.patches(pixels(spark, sf))
    return p.select("image_id", "x", "y", F.round(F.aggregate(F.transform("patch", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("probe"))


_CROSS = "FROM px a JOIN px b ON b.image_id = a.image_id AND abs(b.x - a.x) + abs(b.y - a.y) <= 1 GROUP BY ALL"


@register("morph_gradient", f"WITH {PX} SELECT a.image_id, a.x, a.y, max(b.value) - min(b.value) AS value {_CROSS}")
def morph_gradient(spark, sf):
    return raster.morph_gradient(pixels(spark, sf))


@register("opening", f"WITH {PX.replace('px AS', 'raw AS', 1)}, px AS (SELECT a.image_id, a.x, a.y, min(b.value) AS value {_CROSS.replace('px', 'raw')}) SELECT a.image_id, a.x, a.y, max(b.value) AS value {_CROSS}")
def opening(spark, sf):
    return raster.opening(pixels(spark, sf))


@register("closing", f"WITH {PX.replace('px AS', 'raw AS', 1)}, px AS (SELECT a.image_id, a.x, a.y, max(b.value) AS value {_CROSS.replace('px', 'raw')}) SELECT a.image_id, a.x, a.y, min(b.value) AS value {_CROSS}")
def closing(spark, sf):
    return raster.closing(pixels(spark, sf))


_NEAR1 = "px a JOIN px b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1"
_D2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"


@register("gaussian", f"WITH {PX} SELECT a.image_id, a.x, a.y, round(sum(b.value * exp(-{_D2} / 2.0::DOUBLE)) / sum(exp(-{_D2} / 2.0::DOUBLE)), 6) AS value FROM {_NEAR1} GROUP BY ALL")
def gaussian(spark, sf):
    return _r(raster.gaussian(pixels(spark, sf)), "value")


_BW = f"exp(-{_D2} / 2.0::DOUBLE - pow(b.value - a.value, 2) / 0.5::DOUBLE)"


@register("bilateral", f"WITH {PX} SELECT a.image_id, a.x, a.y, round(sum(b.value * {_BW}) / sum({_BW}), 6) AS value FROM {_NEAR1} GROUP BY ALL")
def bilateral(spark, sf):
    return _r(raster.bilateral(pixels(spark, sf), 1, 1.0, 0.5), "value")


@register(
    "resample",
    f"""WITH {PX}, g AS (SELECT DISTINCT image_id, x, y FROM px WHERE x < 4 AND y < 4),
c AS (SELECT *, unnest([0, 1]) AS i FROM g), cc AS (SELECT *, unnest([0, 1]) AS j FROM c)
SELECT cc.image_id, cc.x, cc.y, round(sum(px.value * 0.25), 6) AS value FROM cc JOIN px ON px.image_id = cc.image_id AND px.x = 2 * cc.x + i AND px.y = 2 * cc.y + j GROUP BY ALL""",
)
def resample(spark, sf):
    return _r(raster.resample(pixels(spark, sf), 8, 8, 4, 4), "value")


@register(
    "gradient_bins",
    f"""WITH {PX}, {_kernel("kx", {(-1, 0): -1.0, (1, 0): 1.0})}, {_kernel("ky", {(0, -1): -1.0, (0, 1): 1.0})},
t AS (SELECT image_id, x, y, sqrt(kx.value * kx.value + ky.value * ky.value) AS magnitude, fmod(fmod(atan2(ky.value, kx.value), pi()) + pi(), pi()) / pi() * 9 - 0.5 AS pos FROM kx JOIN ky USING (image_id, x, y))
SELECT image_id, x, y, round(magnitude, 6) AS magnitude, ((floor(pos)::INT + 9) % 9)::INT AS bin1, ((floor(pos)::INT + 10) % 9)::INT AS bin2, round(1 - (pos - floor(pos)), 6) AS weight1, round(pos - floor(pos), 6) AS weight2 FROM t""",
)
def gradient_bins(spark, sf):
    return _r(raster.gradient_bins(pixels(spark, sf), gamma=False), "magnitude", "weight1", "weight2")


@register(
    "linear_bins",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 9.0::DOUBLE - 0.5 AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, ((floor(pos)::INT + 9) % 9)::INT AS bin1, ((floor(pos)::INT + 10) % 9)::INT AS bin2, round(1 - (pos - floor(pos)), 9) AS weight1, round(pos - floor(pos), 9) AS weight2 FROM t""",
)
def linear_bins(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount")
    return _r(raster.linear_bins(rows, F.col("l_discount"), 9).drop("l_discount"), "weight1", "weight2", digits=9)


@register(
    "lab_convert",
    f"""WITH {PX}, c AS (SELECT image_id, x, y, (x + 1) / 8.0::DOUBLE AS r, (y + 1) / 8.0::DOUBLE AS g, (x + y) / 14.0::DOUBLE AS b FROM px),
lin AS (SELECT image_id, x, y, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS r, CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS g, CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS b FROM c),
xyz AS (SELECT image_id, x, y, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.950456 AS tx, r * 0.2126729 + g * 0.7151522 + b * 0.0721750 AS ty, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.088754 AS tz FROM lin),
f AS (SELECT image_id, x, y, CASE WHEN tx > 0.008856 THEN pow(tx, 1 / 3.0::DOUBLE) ELSE (903.3 * tx + 16) / 116 END AS fx, CASE WHEN ty > 0.008856 THEN pow(ty, 1 / 3.0::DOUBLE) ELSE (903.3 * ty + 16) / 116 END AS fy, CASE WHEN tz > 0.008856 THEN pow(tz, 1 / 3.0::DOUBLE) ELSE (903.3 * tz + 16) / 116 END AS fz FROM xyz)
SELECT image_id, x, y, round(116 * fy - 16, 5) AS l, round(500 * (fx - fy), 5) AS a, round(200 * (fy - fz), 5) AS b FROM f""",
)
def lab_convert(spark, sf):
    rgb = pixels(spark, sf).select("image_id", "x", "y", ((F.col("x") + 1) / 8.0).alias("r"), ((F.col("y") + 1) / 8.0).alias("g"), ((F.col("x") + F.col("y")) / 14.0).alias("b"))
    return _r(raster.lab_convert(rgb), "l", "a", "b", digits=5)


@register(
    "boundary_mask",
    f"""WITH {PX} SELECT a.image_id, a.x, a.y, CASE WHEN max(b.sign) > min(b.sign) THEN 255 ELSE 0 END AS mask {_CROSS}""",
)
def boundary_mask(spark, sf):
    return raster.boundary_mask(sign_labels(spark, sf).select("image_id", "x", "y", "label"))


@register("boundary_overlay", f"""WITH {PX} SELECT a.image_id, a.x, a.y, CASE WHEN max(b.sign) > min(b.sign) THEN 255.0::DOUBLE ELSE a.value END AS value {_CROSS.replace("GROUP BY ALL", "GROUP BY a.image_id, a.x, a.y, a.value")}""")
def boundary_overlay(spark, sf):
    s = sign_labels(spark, sf)
    return raster.boundary_overlay(s.select("image_id", "x", "y", "value"), s.select("image_id", "x", "y", "label"))


@register("binarise_labels", f"WITH {PX} SELECT image_id, x, y, CASE WHEN quad > 0 THEN 1 ELSE 0 END AS label FROM px")
def binarise_labels(spark, sf):
    return raster.binarise(pixels(spark, sf).select("image_id", "x", "y", quadrant().alias("label")))


@register("mask_other", f"WITH {PX} SELECT image_id, x, y, CASE WHEN sign = 1 THEN quad ELSE -1 END AS label FROM px")
def mask_other(spark, sf):
    s = sign_labels(spark, sf)
    return raster.mask_other(s.select("image_id", "x", "y", quadrant().alias("label")), s.select("image_id", "x", "y", "label"), 1)


@register(
    "mask_corners",
    f"""WITH {PX} SELECT a.image_id, a.x, a.y FROM px a JOIN px b ON b.image_id = a.image_id AND abs(b.x - a.x) = 1 AND abs(b.y - a.y) = 1 WHERE b.value > 0 GROUP BY ALL HAVING count(*) = 4""",
)
def mask_corners(spark, sf):
    return raster.mask_corners(pixels(spark, sf), 1)


@register("train_valid_split", "SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) % 2 = 1 THEN 'train' ELSE 'valid' END AS part FROM embeddings")
def train_valid_split(spark, sf):
    return raster.row_number_split(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), F.col("vec_id"), "label")


_LABELLED = "WITH " + PX


@register("pool_sum", f"{_LABELLED} SELECT image_id, quad AS label, round(sum(value), 6) AS total FROM px GROUP BY ALL")
def pool_sum(spark, sf):
    return _r(features.pool_sum(pixels(spark, sf).withColumn("label", quadrant())), "total")


@register("pool_moments", f"{_LABELLED} SELECT image_id, quad AS label, round(avg(value), 6) AS mean, round(avg(value * value) - avg(value) * avg(value), 6) AS variance, count(*) AS n FROM px GROUP BY ALL")
def pool_moments(spark, sf):
    return _r(features.pool_moments(pixels(spark, sf).withColumn("label", quadrant())), "mean", "variance")


@register("bbox_stats", f"{_LABELLED} SELECT image_id, sign AS label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n_pixels FROM px GROUP BY ALL")
def bbox_stats(spark, sf):
    return features.bbox_stats(sign_labels(spark, sf))


@register("split_features", f"{_LABELLED} SELECT image_id, x, y, quad AS label, round(abs(value - avg(value) OVER (PARTITION BY image_id, quad)), 6) AS value FROM px")
def split_features(spark, sf):
    return _r(features.split_features(pixels(spark, sf).withColumn("label", quadrant()), "value", "label").select("image_id", "x", "y", "label", "value"), "value")


BORDER = f"""{_LABELLED}, nb AS (SELECT a.image_id, least(a.quad, b.quad) AS u, greatest(a.quad, b.quad) AS v, a.value AS a, b.value AS b, b.x - a.x AS dx, b.y - a.y AS dy, a.quad > b.quad AS swap
FROM px a JOIN px b ON b.image_id = a.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) WHERE a.quad <> b.quad)"""


@register("pool_boundary", f"{BORDER} SELECT image_id, u, v, min(least(a, b)) AS low, max(least(a, b)) AS high, count(*) AS length FROM nb GROUP BY ALL")
def pool_boundary(spark, sf):
    return features.pool_boundary(pixels(spark, sf).withColumn("label", quadrant()))


@register(
    "pool_boundary_bands",
    f"{BORDER.replace('a.value AS a, b.value AS b', 'a.value AS a, b.value AS b, -a.value AS a2, -b.value AS b2')} SELECT image_id, u, v, min(least(a, b)) AS p_low, max(least(a, b)) AS p_high, min(least(a2, b2)) AS q_low, max(least(a2, b2)) AS q_high, count(*) AS length FROM nb GROUP BY ALL",
)
def pool_boundary_bands(spark, sf):
    p = pixels(spark, sf).select("image_id", "x", "y", quadrant().alias("label"), F.col("value").alias("p"), (-F.col("value")).alias("q"))
    return features.pool_boundary_bands(p, ["p", "q"])


@register(
    "boundary_directions",
    f"""{BORDER}, m AS (SELECT image_id, u, v, sum(CASE WHEN swap THEN -1.0::DOUBLE ELSE 1 END * dx) AS nx, sum(CASE WHEN swap THEN -1.0::DOUBLE ELSE 1 END * dy) AS ny, count(*) AS length FROM nb GROUP BY ALL),
t AS (SELECT *, fmod(atan2(ny, nx) / (2 * pi()) + 1, 1) * 9 - 0.5 AS pos FROM m)
SELECT image_id, u, v, nx, ny, length, ((floor(pos)::INT + 9) % 9)::INT AS bin1, ((floor(pos)::INT + 10) % 9)::INT AS bin2, round(1 - (pos - floor(pos)), 6) AS weight1, round(pos - floor(pos), 6) AS weight2 FROM t""",
)
def boundary_directions(spark, sf):
    return _r(features.boundary_directions(pixels(spark, sf).withColumn("label", quadrant())), "weight1", "weight2")


@register(
    "pool_edge_distance",
    f"""{BORDER}, m AS (SELECT image_id, quad, avg(value) AS mean FROM px GROUP BY ALL)
SELECT n.image_id, n.u, n.v, round((a.mean - b.mean) * (a.mean - b.mean), 6) AS mean FROM (SELECT DISTINCT image_id, u, v FROM nb) n JOIN m a ON a.image_id = n.image_id AND a.quad = n.u JOIN m b ON b.image_id = n.image_id AND b.quad = n.v""",
)
def pool_edge_distance(spark, sf):
    p = pixels(spark, sf).withColumn("label", quadrant())
    pairs = features.border_pixels(p).select("image_id", "u", "v").distinct()
    return _r(features.edge_from_regions(pairs, features.pool_moments(p), "mean", squared=True), "mean")


@register(
    "changed_window",
    f"""{_LABELLED}, c AS (SELECT image_id, x, y FROM px WHERE sign = 1 AND quad = 0), t AS (SELECT DISTINCT a.image_id, a.x, a.y FROM px a JOIN c ON c.image_id = a.image_id AND abs(c.x - a.x) + abs(c.y - a.y) <= 1)
SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM t GROUP BY image_id""",
)
def changed_window(spark, sf):
    s = sign_labels(spark, sf)
    before = s.select("image_id", "x", "y", quadrant().alias("label"))
    after = s.select("image_id", "x", "y", F.when((F.col("label") == 1) & (quadrant() == 0), 9).otherwise(quadrant()).alias("label"))
    return features.changed_window(before, after)


_SHARES = f"""WITH {PX.replace("px AS", "raw AS")}, px AS (SELECT * REPLACE (sqrt(greatest(value, 0)) AS value) FROM raw), {_kernel("kx", {(-1, 0): -1.0, (1, 0): 1.0})}, {_kernel("ky", {(0, -1): -1.0, (0, 1): 1.0})},
t AS (SELECT image_id, 2 * (y // 4) + x // 4 AS label, sqrt(kx.value * kx.value + ky.value * ky.value) AS magnitude, fmod(fmod(atan2(ky.value, kx.value), pi()) + pi(), pi()) / pi() * 9 - 0.5 AS pos FROM kx JOIN ky USING (image_id, x, y)),
parts AS (SELECT image_id, label::BIGINT AS label, ((floor(pos)::INT + 9) % 9)::INT AS bin, magnitude * (1 - (pos - floor(pos))) AS m FROM t UNION ALL SELECT image_id, label, ((floor(pos)::INT + 10) % 9)::INT, magnitude * (pos - floor(pos)) FROM t),
shares AS (SELECT image_id, label, bin, sum(m) / 16 AS share FROM parts GROUP BY ALL)"""


@register("pool_histogram", f"{_SHARES} SELECT image_id, label, bin, round(share, 6) + 0 AS share FROM shares")
def pool_histogram(spark, sf):
    binned = raster.gradient_bins(pixels(spark, sf)).withColumn("label", quadrant())
    return _r(features.pool_histogram(binned), "share")


@register(
    "histogram_distance",
    f"""{_SHARES}, ends AS (SELECT DISTINCT image_id, u, v FROM raw, (VALUES (0, 1), (0, 2), (1, 3), (2, 3)) AS t(u, v)),
d AS (SELECT e.image_id, u, v, bin, sum(CASE WHEN label = u THEN share ELSE -share END) AS d FROM ends e JOIN shares s ON s.image_id = e.image_id AND s.label IN (u, v) GROUP BY ALL)
SELECT image_id, u, v, round(sum(abs(d)), 6) + 0 AS l1, round(sum(d * d), 6) + 0 AS l2 FROM d GROUP BY ALL""",
)
def histogram_distance(spark, sf):
    binned = raster.gradient_bins(pixels(spark, sf)).withColumn("label", quadrant())
    pairs = features.border_pixels(pixels(spark, sf).withColumn("label", quadrant())).select("image_id", "u", "v").distinct()
    return _r(features.histogram_distance(pairs, features.pool_histogram(binned)), "l1", "l2")


@register("contours_geojson")
def contours_geojson(spark, sf):
    labels = compact(spark, sf).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    labels = labels.select("image_id", (F.col("v") % 8).cast("int").alias("x"), F.floor(F.col("v") / 8).cast("int").alias("y"))
    return features.geojson(features.contours(labels.withColumn("label", quadrant())))


@register("popcode", "SELECT o_orderkey, c AS centre, round(exp(-pow(o_totalprice / 100000 - c, 2) / 0.5::DOUBLE), 9) AS response FROM (SELECT *, unnest([0.0::DOUBLE, 1.0, 2.0, 3.0]) AS c FROM orders)")
def popcode(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    found = features.population_code(orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice") / 100000, [0.0, 1.0, 2.0, 3.0], 0.5)
    return _r(found.drop("o_totalprice"), "response", digits=9)
