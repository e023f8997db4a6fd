"""Grayscale reconstruction: a marker grows under a mask until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import dropped, written
from .raster import CROSS, PIXEL, neighbours


#: Dilations a round.
STEPS = 4


def reconstruct(marker: DataFrame, mask: DataFrame, above: bool = False) -> DataFrame:
    """The greatest raster under the mask that the marker reaches by 4-neighbour dilation; with
    `above` the least one over it by erosion. Each round takes STEPS dilations and is written; it
    ends when no pixel changes."""
    sign = -1.0 if above else 1.0
    limit = written(mask.select(*PIXEL, (F.col("value") * sign).alias("_m")))
    start = marker.select(*PIXEL, (F.col("value") * sign).alias("value")).join(limit, PIXEL)
    at = written(start.select(*PIXEL, F.least("value", "_m").alias("value")))
    while True:
        after = at
        for _ in range(STEPS):
            grown = neighbours(after, CROSS).groupBy(*PIXEL).agg(F.max("value").alias("_g"))
            after = grown.join(limit, PIXEL).select(*PIXEL, F.least("_g", "_m").alias("value"))
        after = written(after.join(at.withColumnRenamed("value", "_old"), PIXEL))
        dropped(at)
        at = after.drop("_old")
        if after.filter("value != _old").isEmpty():
            dropped(limit)
            return at.select(*PIXEL, (F.col("value") * sign).alias("value"))


def opening_by_reconstruction(raster: DataFrame, element=CROSS) -> DataFrame:
    from .raster import erode

    return reconstruct(erode(raster, element), raster)


def closing_by_reconstruction(raster: DataFrame, element=CROSS) -> DataFrame:
    from .raster import dilate

    return reconstruct(dilate(raster, element), raster, above=True)
