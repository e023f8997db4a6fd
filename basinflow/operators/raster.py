"""Rasters as rows: reshaping, projections and neighbourhood filters.

A raster is (image_id, x, y, value), with a band or z column for stacks; a compact raster is one
row per image with an array `values` of w * h numbers, row by row. Operators on compact rasters
need no shuffle; operators on rows join or group within image_id and coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIXEL = ["image_id", "x", "y"]


def explode_raster(compact: DataFrame, width: int, values: str = "values") -> DataFrame:
    """Compact rasters to rows."""
    rows = compact.select("image_id", F.posexplode(values).alias("p", "value"))
    return rows.select("image_id", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), F.col("value").cast("double").alias("value"))


def compact_raster(raster: DataFrame) -> DataFrame:
    """Rows to compact rasters, in row order. An image must fit in one task."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "value")))
    return raster.groupBy("image_id").agg(F.transform(ordered, lambda s: s["value"]).alias("values"))


def header(raster: DataFrame) -> DataFrame:
    """Width, height and number of pixels of each image."""
    return raster.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("n_pixels"))


def stats(raster: DataFrame) -> DataFrame:
    return raster.groupBy("image_id").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def window_read(raster: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The pixels with x0 <= x < x1 and y0 <= y < y1, with coordinates from the corner."""
    inside = raster.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def minmax_scale(raster: DataFrame, top: float = 1.0, flat: float = 1e-4) -> DataFrame:
    """Shifts each image to start at 0 and, unless its range is at most `flat`, scales it to `top`.

    The range is an aggregate joined back, so a large image isn't sorted or held by one task.
    """
    ranges = raster.groupBy("image_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    span = F.col("_high") - F.col("_low")
    value = F.when(span > flat, (F.col("value") - F.col("_low")) / span * top).otherwise(F.col("value") - F.col("_low"))
    return raster.join(ranges, "image_id").withColumn("value", value).drop("_low", "_high")


def to_byte(raster: DataFrame) -> DataFrame:
    """Min-max scaled to 0 ... 255."""
    return minmax_scale(raster, 255.0).withColumn("value", F.floor("value").cast("int"))


def binarise(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.withColumn(label, F.when(F.col(label) > 0, 1).otherwise(0))


def mask_other(labels: DataFrame, reference: DataFrame, keep: float) -> DataFrame:
    """Labels, -1 where the reference's label isn't `keep`."""
    joined = labels.join(reference.select(*PIXEL, F.col("label").alias("_r")), PIXEL)
    return joined.withColumn("label", F.when(F.abs(F.col("_r") - keep) > 0.1, -1).otherwise(F.col("label"))).drop("_r")


def stride_crop(raster: DataFrame, stride: int, x0: int = 0, y0: int = 0, width: int | None = None, height: int | None = None) -> DataFrame:
    """Every stride-th pixel, then a crop of the result."""
    small = raster.filter((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    small = small.withColumns({"x": F.floor(F.col("x") / stride).cast("int"), "y": F.floor(F.col("y") / stride).cast("int")})
    return window_read(small, x0, y0, x0 + (width or 1 << 30), y0 + (height or 1 << 30))


def tile_keys(raster: DataFrame, width: int, height: int) -> DataFrame:
    """Adds tile_row and tile_col and makes coordinates relative to the tile."""
    return raster.select(
        *[c for c in raster.columns if c not in ("x", "y")],
        F.floor(F.col("y") / height).cast("int").alias("tile_row"),
        F.floor(F.col("x") / width).cast("int").alias("tile_col"),
        (F.col("x") % width).cast("int").alias("x"),
        (F.col("y") % height).cast("int").alias("y"),
    )


def centre_trim(raster: DataFrame, tile: int) -> DataFrame:
    """Trims each image evenly at both ends so that its sides are multiples of `tile`."""
    sized = raster.join(header(raster).select("image_id", "width", "height"), "image_id")
    left, top = F.floor((F.col("width") % tile) / 2).cast("int"), F.floor((F.col("height") % tile) / 2).cast("int")
    w, h = F.col("width") - F.col("width") % tile, F.col("height") - F.col("height") % tile
    inside = sized.filter((F.col("x") >= left) & (F.col("x") < left + w) & (F.col("y") >= top) & (F.col("y") < top + h))
    return inside.withColumns({"x": F.col("x") - left, "y": F.col("y") - top}).drop("width", "height")


def stack_bands(stack: DataFrame, offsets: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """(image_id, z, x, y, value) to rows with the values of neighbouring slices; edges repeat none.

    A slice is sent to each slice that shows it, so nothing is sorted along z.
    """
    sent = stack.select("image_id", "x", "y", "value", F.col("z").alias("_z"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    sent = sent.withColumn("z", (F.col("_z") - F.col("_o")).cast("int"))
    wide = sent.groupBy("image_id", "z", "x", "y").agg(*[F.max(F.when(F.col("_o") == o, F.col("value"))).alias(f"band{i}") for i, o in enumerate(offsets)])
    whole = F.lit(True)
    for i in range(len(offsets)):
        whole = whole & F.col(f"band{i}").isNotNull()
    return wide.filter(whole)


def rotate90(raster: DataFrame, width: int, height: int, k: int = 1) -> DataFrame:
    """k quarter turns; x, y -> height - 1 - y, x for one."""
    x, y = F.col("x"), F.col("y")
    for _ in range(k % 4):
        x, y, width, height = height - 1 - y, x, height, width
    return raster.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def flip_h(raster: DataFrame, width: int) -> DataFrame:
    return raster.withColumn("x", (width - 1 - F.col("x")).cast("int"))


def mosaic(raster: DataFrame, width: int, height: int, columns: int) -> DataFrame:
    """Images in order of id side by side on a grid; the order is that of a dense id 0 ... n-1."""
    i = F.col("image_id")
    return raster.select((F.col("x") + (i % columns) * width).cast("int").alias("x"), (F.col("y") + F.floor(i / columns) * height).cast("int").alias("y"), "value")


def neighbours(raster: DataFrame, kernel: Sequence[tuple[int, int]]) -> DataFrame:
    """Every pixel's value sent to the pixels at -(dx, dy): (image_id, x, y, dx, dy, value).

    The offsets are a literal array, so one shuffle by target pixel follows and no join.
    """
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in kernel])
    sent = raster.select("image_id", "x", "y", "value", F.explode(offsets).alias("_o"))
    return sent.select("image_id", (F.col("x") - F.col("_o.dx")).alias("x"), (F.col("y") - F.col("_o.dy")).alias("y"), F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"), "value")


def _inside(found: DataFrame, marker: str = "_own") -> DataFrame:
    return found.filter(F.col(marker) > 0).drop(marker)


def _weight(kernel: dict[tuple[int, int], float]) -> Column:
    """A sent value's weight by its offset, 0 outside the kernel."""
    weight = F.lit(0.0)
    for (dx, dy), w in kernel.items():
        weight = F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.lit(float(w))).otherwise(weight)
    return weight


def convolve(raster: DataFrame, kernels: dict[str, dict[tuple[int, int], float]]) -> DataFrame:
    """Correlations with zero padding: for each kernel the sum of value(x+dx, y+dy) * weight."""
    places = sorted({(0, 0), *(p for k in kernels.values() for p in k)})
    sent = neighbours(raster, places)
    sums = [F.sum(F.col("value") * _weight(kernel)).alias(name) for name, kernel in kernels.items()]
    return _inside(sent.groupBy(*PIXEL).agg(*sums, F.count(F.when((F.col("dx") == 0) & (F.col("dy") == 0), 1)).alias("_own")))


BOX3 = {(dx, dy): 1.0 for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
#: The Sobel and Scharr operators.
SOBEL_X = {(-1, -1): -1.0, (1, -1): 1.0, (-1, 0): -2.0, (1, 0): 2.0, (-1, 1): -1.0, (1, 1): 1.0}
SOBEL_Y = {(y, x): w for (x, y), w in SOBEL_X.items()}
SCHARR_X = {(-1, -1): -3.0, (1, -1): 3.0, (-1, 0): -10.0, (1, 0): 10.0, (-1, 1): -3.0, (1, 1): 3.0}
SCHARR_Y = {(y, x): w for (x, y), w in SCHARR_X.items()}
LAPLACE = {(0, 0): -4.0, (-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0}


def box_sum(raster: DataFrame) -> DataFrame:
    return convolve(raster, {"value": BOX3})


def sobel(raster: DataFrame, smooth: bool = True, sign: float = -1.0) -> DataFrame:
    """gx, gy and magnitude of the squared gradients after a 3x3 sum: sign * (Gx^2, Gy^2, sqrt(Gx^4 + Gy^4))."""
    base = box_sum(raster) if smooth else raster
    both = convolve(base, {"_x": SOBEL_X, "_y": SOBEL_Y})
    gx, gy = F.col("_x") * F.col("_x"), F.col("_y") * F.col("_y")
    return both.select(*PIXEL, (sign * gx).alias("gx"), (sign * gy).alias("gy"), (sign * F.sqrt(gx * gx + gy * gy)).alias("magnitude"))


def scharr(raster: DataFrame) -> DataFrame:
    both = convolve(raster, {"_x": SCHARR_X, "_y": SCHARR_Y})
    return both.select(*PIXEL, F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("value"))


def laplacian(raster: DataFrame) -> DataFrame:
    return convolve(raster, {"value": LAPLACE})


def gaussian(raster: DataFrame, radius: int = 1, sigma: float = 1.0) -> DataFrame:
    """Weights normalised over the pixels that exist."""
    import math

    kernel = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}
    weight = _weight(kernel)
    sent = neighbours(raster.dropna(subset=PIXEL), list(kernel))
    own = F.count(F.when((F.col("dx") == 0) & (F.col("dy") == 0), 1))
    return _inside(sent.groupBy(*PIXEL).agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"), own.alias("_own")))


def bilateral(raster: DataFrame, radius: int, sigma_space: float, sigma_value: float) -> DataFrame:
    """Neighbours weigh by distance and by likeness to the pixel's own value."""
    offsets = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    sent = neighbours(raster, offsets).join(raster.select(*PIXEL, F.col("value").alias("_own")), PIXEL)
    space = -(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * sigma_space**2)
    tone = -F.pow(F.col("value") - F.col("_own"), 2) / (2 * sigma_value**2)
    weight = F.exp(space + tone)
    return sent.groupBy(*PIXEL).agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))


def dilate(raster: DataFrame, element: Sequence[tuple[int, int]]) -> DataFrame:
    sent = neighbours(raster, element)
    found = sent.groupBy(*PIXEL).agg(F.max("value").alias("value"))
    return found.join(raster.select(*PIXEL), PIXEL, "left_semi")


def erode(raster: DataFrame, element: Sequence[tuple[int, int]]) -> DataFrame:
    sent = neighbours(raster, element)
    found = sent.groupBy(*PIXEL).agg(F.min("value").alias("value"))
    return found.join(raster.select(*PIXEL), PIXEL, "left_semi")


CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def ellipse(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def morph_gradient(raster: DataFrame, element: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    own = (F.col("dx") == 0) & (F.col("dy") == 0)
    shown = F.lit(True) if (0, 0) in element else ~own
    value = F.when(shown, F.col("value"))
    sent = neighbours(raster.dropna(subset=PIXEL), sorted({(0, 0), *element}))
    both = F.least(F.count(F.when(own, 1)), F.count(F.when(shown, 1)))
    return _inside(sent.groupBy(*PIXEL).agg((F.max(value) - F.min(value)).alias("value"), both.alias("_own")))


def opening(raster: DataFrame, element: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    return dilate(erode(raster, element), element)


def closing(raster: DataFrame, element: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    return erode(dilate(raster, element), element)


def dir_avg(raster: DataFrame) -> DataFrame:
    """Means with the next pixel to the right (avg_x) and below (avg_y); beyond the border is 0."""
    found = convolve(raster, {"avg_x": {(0, 0): 0.5, (1, 0): 0.5}, "avg_y": {(0, 0): 0.5, (0, 1): 0.5}})
    return found


def dir_grad_maxpool(raster: DataFrame) -> DataFrame:
    """Absolute forward differences, then the maximum over 2x2 blocks; beyond the border is 0."""
    found = convolve(raster, {"_x": {(0, 0): -1.0, (1, 0): 1.0}, "_y": {(0, 0): -1.0, (0, 1): 1.0}})
    block = found.withColumns({"x": F.floor(F.col("x") / 2).cast("int"), "y": F.floor(F.col("y") / 2).cast("int")})
    return block.groupBy(*PIXEL).agg(F.max(F.abs("_x")).alias("gx"), F.max(F.abs("_y")).alias("gy"))


def block_mean(raster: DataFrame, size: int) -> DataFrame:
    block = raster.withColumns({"x": F.floor(F.col("x") / size).cast("int"), "y": F.floor(F.col("y") / size).cast("int")})
    return block.groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def patches(raster: DataFrame, radius: int = 1) -> DataFrame:
    """The (2 radius + 1)^2 values around each pixel, row by row, 0 beyond the border."""
    offsets = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    sent = neighbours(raster, offsets)
    columns = [F.coalesce(F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("value"))), F.lit(0.0)) for dx, dy in offsets]
    found = sent.groupBy(*PIXEL).agg(F.array(*columns).alias("patch"), F.count(F.when((F.col("dx") == 0) & (F.col("dy") == 0), 1)).alias("_own"))
    return _inside(found)


def linear_filter(raster: DataFrame, weights: Sequence[float], bias: float = 0.0) -> DataFrame:
    """The forward pass of a learned filter over the patches, weights row by row."""
    radius = (int(len(weights) ** 0.5) - 1) // 2
    kernel = {(i % (2 * radius + 1) - radius, i // (2 * radius + 1) - radius): w for i, w in enumerate(weights)}
    return convolve(raster, {"_v": kernel}).select(*PIXEL, (F.col("_v") + bias).alias("value"))


def gradient_bins(raster: DataFrame, bins: int = 9, gamma: bool = True) -> DataFrame:
    """Magnitude and the two orientation bins, with weights, of the central differences."""
    base = raster.withColumn("value", F.sqrt(F.greatest("value", F.lit(0.0)))) if gamma else raster
    both = convolve(base, {"gx": {(-1, 0): -1.0, (1, 0): 1.0}, "gy": {(0, -1): -1.0, (0, 1): 1.0}})
    angle = F.pmod(F.atan2("gy", "gx"), F.lit(3.141592653589793)) / 3.141592653589793
    return linear_bins(both.select(*PIXEL, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("magnitude"), angle.alias("turn")), F.col("turn"), bins).drop("turn")


def linear_bins(rows: DataFrame, turn: Column, bins: int) -> DataFrame:
    """Shares a value in [0, 1) among the two nearest of `bins` bins on a circle."""
    at = turn * bins - 0.5
    low = F.floor(at)
    return rows.select("*", F.pmod(low, F.lit(bins)).cast("int").alias("bin1"), F.pmod(low + 1, F.lit(bins)).cast("int").alias("bin2"), (1 - (at - low)).alias("weight1"), (at - low).alias("weight2"))


def lab_convert(rgb: DataFrame) -> DataFrame:
    """RGB in [0, 1] (columns r, g, b) to CIE L, a, b under D65."""

    def linear(c: str) -> Column:
        return F.when(F.col(c) > 0.04045, F.pow((F.col(c) + 0.055) / 1.055, 2.4)).otherwise(F.col(c) / 12.92)

    r, g, b = linear("r"), linear("g"), linear("b")

    # The sRGB primaries and the D65 white point.
    x = (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.950456
    y = r * 0.2126729 + g * 0.7151522 + b * 0.0721750
    z = (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.088754

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise((903.3 * t + 16) / 116)

    kept = [c for c in rgb.columns if c not in ("r", "g", "b")]
    wide = rgb.select(*kept, f(x).alias("_x"), f(y).alias("_y"), f(z).alias("_z"))
    return wide.select(*kept, (116 * F.col("_y") - 16).alias("l"), (500 * (F.col("_x") - F.col("_y"))).alias("a"), (200 * (F.col("_y") - F.col("_z"))).alias("b"))


def _cubic(d: Column, a: float = -0.75) -> Column:
    """The weight of a pixel at distance d in cubic convolution."""
    d = F.abs(d)
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    return F.when(d <= 1, near).when(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a).otherwise(0.0)


def _sent_to(rows: DataFrame, c: str, size: int, new_size: int, cubic: bool) -> DataFrame:
    """Every row once for each new place on axis `c` that its pixel weighs at: adds the place _c and the weight _wc."""
    scale, reach, at = size / new_size, 2 if cubic else 1, F.col(c)
    rows = rows.filter(at.between(0, size - 1))
    if cubic:
        # A pixel at an edge also stands for the two beyond it that are reached.
        first, last = F.when(at == 0, -2).otherwise(at), F.when(at == size - 1, size + 1).otherwise(at)
        rows = rows.withColumn("_at", F.explode(F.sequence(first, last)))
        at = F.col("_at")
    low, high = F.floor((at - reach + 0.5) / scale - 0.5), F.ceil((at + reach + 0.5) / scale - 0.5)
    if not cubic:
        low, high = F.when(at > 0, low).otherwise(0), F.when(at < size - 1, high).otherwise(new_size - 1)
    low, high = (F.greatest(F.lit(0), F.least(F.lit(new_size - 1), e)).cast("int") for e in (low, high))
    rows = rows.withColumn(f"_{c}", F.explode(F.sequence(low, high)))
    g = (F.col(f"_{c}") + 0.5) * scale - 0.5
    distance = at - (g if cubic else F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), g)))
    weight = _cubic(distance) if cubic else F.greatest(F.lit(0.0), 1 - F.abs(distance))
    return rows.withColumn(f"_w{c}", weight).filter(f"_w{c} != 0").drop("_at")


def resample(raster: DataFrame, width: int, height: int, new_width: int, new_height: int, cubic: bool = False) -> DataFrame:
    """Scaling: each new pixel gathers its nearest 2 x 2 pixels by their weights, or 4 x 4 if cubic.
    Pixels over the edge are those at it.

    A pixel's place tells the new pixels that gather it, so it is sent to them and no grid is joined.
    """
    rows = raster.filter(F.col("image_id").isNotNull()).select(*PIXEL, "value")
    rows = _sent_to(_sent_to(rows, "x", width, new_width, cubic), "y", height, new_height, cubic)
    return rows.groupBy("image_id", F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.sum(F.col("value") * (F.col("_wx") * F.col("_wy"))).alias("value"))


#: Scales of the gradient bank.
SCALES = (1.0, 0.75, 0.66, 0.5)
#: Pixels of an image up to which it is one task's.
TOGETHER = 1 << 14


def gradient_bank_settings() -> list[tuple[int, str, int, float]]:
    """The bank's settings: smoothing before (0 none, else a box's or median's size), the gradient,
    the size of the smoothing after, and the scale."""
    sizes = [0, 1, 3]
    return [(before, kind, after, scale) for before in sizes for kind in ("morphological", "scharr") for after in sizes for scale in SCALES]


def gradient_bank(raster: DataFrame, width: int, height: int, settings: list[tuple[int, str, int, float]] | None = None) -> DataFrame:
    """image_id, variant, x, y, value: gradient images of a raster under every setting, scaled back to its size.

    Small images are brought together once, so that no step of a setting shuffles again; of large ones each step does.
    """
    if width * height <= TOGETHER:
        # With a number, as Spark would make few partitions of what is small before the settings multiply it.
        raster = raster.repartition(int(raster.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    out = None
    for variant, (before, kind, after, scale) in enumerate(gradient_bank_settings() if settings is None else settings):
        w, h = max(1, round(width * scale)), max(1, round(height * scale))
        rows = raster if scale == 1.0 else resample(raster, width, height, w, h, cubic=True)
        rows = gaussian(rows, before // 2) if before > 1 else rows
        rows = scharr(rows) if kind == "scharr" else morph_gradient(rows)
        rows = gaussian(rows, after // 2) if after > 1 else rows
        rows = rows if scale == 1.0 else resample(rows, w, h, width, height, cubic=True)
        rows = rows.select("image_id", F.lit(variant).alias("variant"), "x", "y", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def boundary_mask(labels: DataFrame) -> DataFrame:
    """255 where any 4-neighbour has another label, else 0."""
    sent = neighbours(labels.withColumnRenamed("label", "value"), CROSS)
    found = sent.groupBy(*PIXEL).agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"), F.count(F.when((F.col("dx") == 0) & (F.col("dy") == 0), 1)).alias("_own"))
    return _inside(found).select(*PIXEL, F.when(F.col("_hi") > F.col("_lo"), 255).otherwise(0).alias("mask"))


def boundary_overlay(raster: DataFrame, labels: DataFrame, ink: float = 255.0) -> DataFrame:
    joined = raster.join(boundary_mask(labels), PIXEL)
    return joined.select(*PIXEL, F.when(F.col("mask") > 0, ink).otherwise(F.col("value")).alias("value"))


def mask_corners(mask: DataFrame, half: int) -> DataFrame:
    """Pixels whose four window corners at distance `half` all lie in the mask (value > 0)."""
    sent = neighbours(mask, [(-half, -half), (half, -half), (-half, half), (half, half)])
    good = sent.filter("value > 0").groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4").select(*PIXEL)
    return good.join(mask.select(*PIXEL), PIXEL, "left_semi")


def row_number_split(rows: DataFrame, by: Column, key: str) -> DataFrame:
    """Adds `part`: train or valid, alternating in the order `by` within key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(by))
    return rows.withColumn("part", F.when(nth % 2 == 1, "train").otherwise("valid"))


def quadrant_chips(raster: DataFrame, width: int, height: int, quadrants: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The named quarters of each image (0 left top, 1 right top, 2 left bottom, 3 right bottom) as images
    of their own, numbered image_id * len(quadrants) + place, in the chip's pixels; more columns stay."""
    w, h, n = width // 2, height // 2, len(quadrants)
    inside = (F.col("x") < 2 * w) & (F.col("y") < 2 * h)
    place = F.array_position(F.array(*map(F.lit, quadrants)), (F.floor(F.col("y") / h) * 2 + F.floor(F.col("x") / w)).cast("int")) - 1
    rows = raster.filter(inside).withColumn("_p", place).filter("_p >= 0")
    return rows.withColumns({"image_id": F.col("image_id") * n + F.col("_p"), "x": (F.col("x") % w).cast("int"), "y": (F.col("y") % h).cast("int")}).drop("_p")


def train_valid_products(raster: DataFrame, width: int, height: int, seed: int, quadrants: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Chips of the images in seeded order, alternately for training and validation: `part` is added.
    Bands are columns of the raster (see stack_bands), so products of 1, 2 or 4 bands are one call."""
    chips = quadrant_chips(raster, width, height, quadrants)
    order = chips.select("image_id").distinct().select("image_id", F.xxhash64(F.lit(seed), "image_id").alias("_o"))
    # Every second chip in order: the place is counted over hash ranges, so no task orders all chips.
    order = order.withColumn("_r", F.shiftright("_o", 54))
    counts = order.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    nth = F.row_number().over(W.partitionBy("_r").orderBy("_o", "image_id")) + F.col("_b")
    parts = order.join(before, "_r").select("image_id", F.when(nth % 2 == 1, "train").otherwise("valid").alias("part"))
    return chips.join(parts, "image_id")
