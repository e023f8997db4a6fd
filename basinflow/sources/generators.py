"""Synthetic scenes, graphs and samples, made on the executors from ids and seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(spark: SparkSession, width: int, height: int, images: int = 1) -> DataFrame:
    p = F.col("id") % (width * height)
    rows = spark.range(images * width * height)
    return rows.select(F.floor(F.col("id") / (width * height)).alias("image_id"), (p % width).cast("int").alias("x"), F.floor(p / width).cast("int").alias("y"))


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *columns: str) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *columns))) * F.cos(2 * 3.141592653589793 * uniform(seed + 7919, *columns))


def ramp_square(spark: SparkSession, size: int = 256, at: int = 64, side: int = 127) -> DataFrame:
    """Zeros with a square ramp x - at + 10."""
    inside = F.col("x").between(at, at + side - 1) & F.col("y").between(at, at + side - 1)
    return _grid(spark, size, size).withColumn("value", F.when(inside, F.col("x") - at + 10.0).otherwise(0.0))


def ramp_two_squares(spark: SparkSession, size: int = 64, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """A sloping plane with noise and two bright 10 x 10 squares, over 256."""
    plane = (F.col("y") * 128 + F.col("x") * 127) / (size - 1) + (2 * uniform(seed, "x", "y") - 1) * noise
    a = F.col("x").between(10, 19) & F.col("y").between(10, 19)
    b = F.col("x").between(40, 49) & F.col("y").between(30, 39)
    return _grid(spark, size, size).withColumn("value", (plane + F.when(a | b, 50.0).otherwise(0.0)) / 256)


def _grid_graph(spark: SparkSession, width: int, images: int = 1, periodic: bool = False) -> DataFrame:
    rows = _grid(spark, width, width, images)
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))]))
    rows = rows.select("*", steps.alias("_s"))
    x2, y2 = F.col("x") + F.col("_s.dx"), F.col("y") + F.col("_s.dy")
    if periodic:
        x2, y2 = x2 % width, y2 % width
    rows = rows.select("image_id", "x", "y", x2.alias("x2"), y2.alias("y2")).filter((F.col("x2") < width) & (F.col("y2") < width))
    a, b = F.col("y") * width + F.col("x"), F.col("y2") * width + F.col("x2")
    return rows.select("image_id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.greatest("x", "y", "x2", "y2").alias("reach"))


def simple_block(spark: SparkSession, width: int = 4, seed: int = 1) -> DataFrame:
    """One 2 x 2 cluster: weights near +1 inside, near -1 elsewhere."""
    g = _grid_graph(spark, width)
    return g.select("image_id", "u", "v", (F.when(F.col("reach") < 2, 1.0).otherwise(-1.0) + (2 * uniform(seed, "u", "v") - 1) * 0.1).alias("w"))


def random_graph(spark: SparkSession, width: int, images: int = 1, top: float = 10.0, whole: bool = False, periodic: bool = False, seed: int = 1) -> DataFrame:
    w = (2 * uniform(seed, "image_id", "u", "v") - 1) * top
    return _grid_graph(spark, width, images, periodic).select("image_id", "u", "v", (F.round(w) if whole else w).alias("w"))


def twisted_graph(spark: SparkSession, width: int, sigma: float = 1.0, dead: float = 0.5, seed: int = 1) -> DataFrame:
    """Normal weights; those within dead * sigma of 0 become 0.001."""
    g = _grid_graph(spark, width).select("image_id", "u", "v", (normal(seed, "u", "v") * sigma).alias("w"))
    return g.withColumn("w", F.when(F.abs("w") < dead * sigma, 0.001).otherwise(F.col("w")))


def affinity_graph(spark: SparkSession, affinities: dict[tuple[int, int], float], image_id: int = 0) -> DataFrame:
    rows = [(image_id, min(u, v), max(u, v), float(w)) for (u, v), w in affinities.items()]
    return spark.createDataFrame(rows, "image_id long, u long, v long, w double")


def gaussian_samples(spark: SparkSession, n: int, mean: list[float], covariance: list[list[float]], seed: int = 1) -> DataFrame:
    """id and x0 ... of a multivariate normal, through the Cholesky factor of the covariance."""
    factor = np.linalg.cholesky(np.array(covariance))
    rows = spark.range(n).select("id", *[normal(seed + 104729 * i, "id").alias(f"_z{i}") for i in range(len(mean))])
    out = []
    for i, m in enumerate(mean):
        x = F.lit(float(m))
        for j in range(i + 1):
            x = x + F.col(f"_z{j}") * float(factor[i, j])
        out.append(x.alias(f"x{i}"))
    return rows.select("id", *out)


def two_classes(spark: SparkSession, n: int = 100, means: tuple[float, float] = (1.0, 3.0), variance: float = 1.5, d: int = 2, seed: int = 1) -> DataFrame:
    """id, label (0 and 1 in turn) and d features around the class's mean."""
    label = F.col("id") % 2
    spread = variance**0.5
    return spark.range(n).select("id", label.cast("int").alias("label"), *[(F.when(label == 0, means[0]).otherwise(means[1]) + spread * normal(seed + 31 * i, "id")).alias(f"x{i}") for i in range(d)])
