"""Labels and weights for training from pair counts, and losses of predictions against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL
from .watershed import IMAGE

PURITY, EQUAL, ERROR = "purity", "equal", "error"


def edge_targets(scored_edges: DataFrame, totals: DataFrame | None, kind: str, pos: str = "same", neg: str = "diff", flip: bool = False) -> DataFrame:
    """Adds label and weight to edges with pair counts.

    purity: the majority's sign (+1 on ties), weight |pos - neg| / (pos + neg); equal: weight 1;
    error: an edge with pairs of one kind keeps their number, any other is pushed against the sign
    of its weight w by the number that this sign gets wrong. Weights are times the image's
    rand_error where totals (image_id, rand_error) are given. flip: ties count as -1 and all signs are turned.
    """
    p, n = F.col(pos).cast("double"), F.col(neg).cast("double")
    sign = F.when(p > n, -1.0).otherwise(1.0) if flip else F.when(p >= n, 1.0).otherwise(-1.0)
    if kind == PURITY:
        label, weight = sign, F.abs(p - n) / (p + n)
    elif kind == EQUAL:
        label, weight = sign, F.lit(1.0)
    elif kind == ERROR:
        against = F.when(F.col("w") >= 0, F.struct(F.lit(-1.0).alias("l"), n.alias("x"))).otherwise(F.struct(F.lit(1.0).alias("l"), p.alias("x")))
        pick = F.when(n < 0.1, F.struct(F.lit(1.0).alias("l"), p.alias("x"))).when(p < 0.1, F.struct(F.lit(-1.0).alias("l"), n.alias("x"))).otherwise(against)
        label, weight = pick["l"], pick["x"]
    else:
        raise ValueError(f"unknown loss {kind}")
    rows = scored_edges.withColumns({"label": label, "weight": weight})
    if totals is None:
        return rows
    return rows.join(totals.select(IMAGE, "rand_error"), IMAGE).withColumn("weight", F.col("weight") * F.col("rand_error")).drop("rand_error")


def scatter_last(edges: DataFrame, width: int, order: Column) -> DataFrame:
    """Pixels' label and weight from their edges; of several the last in order stays."""
    ends = edges.select(IMAGE, order.alias("_o"), "label", "weight", F.explode(F.array("u", "v")).alias("_p"))
    last = ends.groupBy(IMAGE, "_p").agg(F.max(F.struct("_o", "label", "weight")).alias("b"))
    return last.select(IMAGE, (F.col("_p") % width).cast("int").alias("x"), F.floor(F.col("_p") / width).cast("int").alias("y"), F.col("b.label").alias("label"), F.col("b.weight").alias("weight"))


def scatter_direction(edges: DataFrame, width: int, order: Column) -> DataFrame:
    """The same for two channels: an edge to the right writes band 0 of its first pixel, one downwards band 1."""
    rows = edges.select(IMAGE, order.alias("_o"), "label", "weight", F.least("u", "v").alias("_p"), F.when(F.abs(F.col("v") - F.col("u")) == 1, 0).otherwise(1).alias("band"))
    last = rows.groupBy(IMAGE, "_p", "band").agg(F.max(F.struct("_o", "label", "weight")).alias("b"))
    return last.select(IMAGE, (F.col("_p") % width).cast("int").alias("x"), F.floor(F.col("_p") / width).cast("int").alias("y"), "band", F.col("b.label").alias("label"), F.col("b.weight").alias("weight"))


def vertex_purity(merge_table: DataFrame) -> DataFrame:
    """Pair counts added up at the ends of the merges, and the purity of their sum; ties count as -1."""
    ends = merge_table.select(IMAGE, "same", "diff", F.explode(F.array("u", "v")).alias("v"))
    s = ends.groupBy(IMAGE, "v").agg(F.sum("same").alias("pos"), F.sum("diff").alias("neg"))
    p, n = F.col("pos"), F.col("neg")
    return s.withColumns({"label": F.when(p > n, 1.0).otherwise(-1.0), "weight": F.abs(p - n) / (p + n)})


def squared_loss(predictions: DataFrame, targets: DataFrame, threshold: DataFrame | None = None, keys: list[str] = PIXEL) -> DataFrame:
    """image_id, loss: the sum of weight * (value - threshold - label)^2."""
    rows = predictions.join(targets, keys)
    value = F.col("value")
    if threshold is not None:
        rows = rows.join(threshold.select(IMAGE, F.col("threshold").alias("_t")), IMAGE)
        value = value - F.col("_t")
    return rows.groupBy(IMAGE).agg(F.sum(F.col("weight") * F.pow(value - F.col("label"), 2)).alias("loss"))


def hinge_loss(predictions: DataFrame, targets: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    rows = predictions.join(targets, keys)
    return rows.groupBy(IMAGE).agg(F.sum(F.col("weight") * F.greatest(F.lit(0.0), 1 - F.col("value") * F.col("label"))).alias("loss"))


def logistic_loss(rows: DataFrame, margin: Column, keys: list[str], clip: float = 30.0) -> DataFrame:
    """Sum of log(1 + exp(-margin)), margins clipped to +-clip, and the mean of its slope."""
    m = F.greatest(F.lit(-clip), F.least(F.lit(clip), margin))
    return rows.groupBy(*keys).agg(F.sum(F.log1p(F.exp(-m))).alias("loss"), F.avg(-1 / (1 + F.exp(m))).alias("slope"))


def feature_gradient(merge_table: DataFrame, features: DataFrame, margin: float = 1.0) -> DataFrame:
    """Sub-gradient of the clustering hinge on edge features: for each violated merge, minus its
    sign times its share of all pairs times its features, added up by component.

    merge_table: image_id, u, v, w, same, diff; features: image_id, u, v, f (array). Returns
    image_id, component (from 0), gradient.
    """
    total = merge_table.groupBy(IMAGE).agg(F.sum(F.col("same") + F.col("diff")).alias("_all"))
    sign = F.when(F.col("same") >= F.col("diff"), 1.0).otherwise(-1.0)
    rows = merge_table.withColumn("_s", sign).filter(F.col("w") * F.col("_s") < margin).join(total, IMAGE)
    rows = rows.join(features, [IMAGE, "u", "v"])
    share = -F.col("_s") * F.abs(F.col("same") - F.col("diff")) / F.col("_all")
    parts = rows.select(IMAGE, share.alias("_c"), F.posexplode("f").alias("component", "_f"))
    return parts.groupBy(IMAGE, "component").agg(F.sum(F.col("_c") * F.col("_f")).alias("gradient"))


def cut_gradient(cut: DataFrame, targets: DataFrame, features: DataFrame, margin: float = 1.0) -> DataFrame:
    """Sub-gradient through the min-max cut: a violated edge adds its features and takes off those of
    the neighbour that set its minimum, never its own.

    cut: of watershed.minmax_edges(); targets: image_id, u, v, label, weight.
    """
    rows = cut.join(targets, [IMAGE, "u", "v"]).filter(F.col("cut") * F.col("label") < margin)
    c = -F.col("label") * F.col("weight")
    sides = F.array(F.struct("u", "v", c.alias("c")), F.struct(F.col("wu").alias("u"), F.col("wv").alias("v"), (-c).alias("c")))
    parts = rows.select(IMAGE, F.explode(sides).alias("_s")).select(IMAGE, "_s.u", "_s.v", "_s.c")
    summed = parts.groupBy(IMAGE, "u", "v").agg(F.sum("c").alias("c")).join(features, [IMAGE, "u", "v"])
    exploded = summed.select(IMAGE, "c", F.posexplode("f").alias("component", "_f"))
    return exploded.groupBy(IMAGE, "component").agg(F.sum(F.col("c") * F.col("_f")).alias("gradient"))
