"""Agreement of two labelings, thresholds on merge sequences, and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .watershed import IMAGE


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def rand_contingency(pairs: DataFrame, keys: list[str], seg: str = "seg", gt: str = "gt") -> DataFrame:
    """Rand error of two labelings of the same things, from their contingency table.

    One aggregation to the cells, in which all larger grains are added up; no pair is ever built.
    """
    cells = pairs.groupBy(*keys, seg, gt).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    grains = cells.withColumn("_g", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))))
    grains = grains.select(
        *keys,
        "_g",
        F.when(F.col("_g").isin(0, 1), F.col(seg).cast("string")).alias("_s"),
        F.when(F.col("_g").isin(0, 2), F.col(gt).cast("string")).alias("_t"),
        "_n",
    )
    sums = grains.groupBy(*keys, "_g", "_s", "_t").agg(F.sum("_n").alias("_n"))
    total = lambda g: F.sum(F.when(F.col("_g") == g, _pairs(F.col("_n"))).otherwise(0.0))
    found = sums.groupBy(*keys).agg(total(0).alias("both"), total(1).alias("same_seg"), total(2).alias("same_gt"), total(3).alias("n_pairs"))
    error = (F.col("same_seg") + F.col("same_gt") - 2 * F.col("both")) / F.nullif("n_pairs", F.lit(0.0))
    return found.select(*keys, "n_pairs", "both", "same_seg", "same_gt", F.coalesce(error, F.lit(0.0)).alias("rand_error"))


def rand_exhaustive(pairs: DataFrame, keys: list[str], item: str, seg: str = "seg", gt: str = "gt") -> DataFrame:
    """Rand error over all pairs of things of a key: quadratic by design, a test oracle for small groups;
    rand_contingency() is the operator."""
    a = pairs.select(*keys, F.col(item).alias("_i"), F.col(seg).alias("_s"), F.col(gt).alias("_t"))
    b = pairs.select(*keys, F.col(item).alias("_j"), F.col(seg).alias("_s2"), F.col(gt).alias("_t2"))
    joined = a.join(b, keys).filter("_i < _j")
    wrong = F.count_if((F.col("_s") == F.col("_s2")) != (F.col("_t") == F.col("_t2")))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n_pairs"), (wrong / F.count(F.lit(1))).alias("rand_error"))


def rand_sampled(pairs: DataFrame, n: int, seed: int, item: str = "i", seg: str = "seg", gt: str = "gt") -> DataFrame:
    """Rand error over n seeded random pairs of things numbered 0 to count - 1."""
    spark = pairs.sparkSession
    total = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = spark.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), total).alias("_i"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), total).alias("_j"))
    a = pairs.select(F.col(item).alias("_i"), F.col(seg).alias("_s"), F.col(gt).alias("_t"))
    b = pairs.select(F.col(item).alias("_j"), F.col(seg).alias("_s2"), F.col(gt).alias("_t2"))
    joined = drawn.join(a, "_i").join(b, "_j")
    return joined.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(((F.col("_s") == F.col("_s2")) != (F.col("_t") == F.col("_t2"))).cast("double")).alias("rand_error"))


def rand_at_threshold(merge_table: DataFrame, threshold: Column) -> DataFrame:
    """Rand error when the merges with w >= threshold are made."""
    made = F.col("w") >= threshold
    pos, neg = F.sum("same"), F.sum("diff")
    fn, fp = F.sum(F.when(made, 0).otherwise(F.col("same"))), F.sum(F.when(made, F.col("diff")).otherwise(0))
    return merge_table.groupBy(IMAGE).agg(pos.alias("pos"), neg.alias("neg"), fn.alias("false_neg"), fp.alias("false_pos"), ((fn + fp) / (pos + neg)).alias("rand_error"))


def rand_best_threshold(merge_table: DataFrame, weight_pos: float | None = None, weight_neg: float | None = None, tie: float = 1e-8) -> DataFrame:
    """The threshold of least error along the merges of each image: midway to the next weight,
    never between weights closer than `tie`, `tie` beyond the ends. Weights for the two classes
    make the error weighted; without them it is the Rand error."""
    whole = W.partitionBy(IMAGE)
    upto = whole.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    wp, wn = F.lit(1.0 if weight_pos is None else weight_pos), F.lit(1.0 if weight_neg is None else weight_neg)
    pos, neg = F.sum("same").over(whole), F.sum("diff").over(whole)
    scale = wp * pos + wn * neg
    error = (wp * (pos - F.sum("same").over(upto)) + wn * F.sum("diff").over(upto)) / scale
    after = F.lead("w").over(whole.orderBy("step"))
    rows = merge_table.select(IMAGE, "step", "w", error.alias("error"), after.alias("_next"), (wp * pos / scale).alias("_none"))
    usable = rows.filter(F.col("_next").isNull() | (F.col("w") - F.col("_next") >= tie))
    usable = usable.select(IMAGE, "error", "step", F.coalesce((F.col("w") + F.col("_next")) / 2, F.col("w") - tie).alias("threshold"))
    start = rows.filter("step = 1").select(IMAGE, F.col("_none").alias("error"), F.lit(0).alias("step"), (F.col("w") + tie).alias("threshold"))
    best = start.unionByName(usable).groupBy(IMAGE).agg(F.min(F.struct("error", "step", "threshold")).alias("b"))
    return best.select(IMAGE, F.col("b.threshold").alias("threshold"), F.col("b.error").alias("error"), F.col("b.step").alias("n_merges"))


def base_pair_counts(pixels: DataFrame, region: str = "seg", gt: str = "gt") -> DataFrame:
    """Pairs of pixels inside each region with equal (extra_pos) and different (extra_neg) truth; pixels with gt < 0 don't count."""
    cells = pixels.filter(F.col(gt) >= 0).groupBy(IMAGE, region, gt).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    same = F.sum(_pairs(F.col("_n"))).cast("long")
    return cells.groupBy(IMAGE, region).agg(n.alias("n"), same.alias("extra_pos"), (_pairs(n).cast("long") - same).alias("extra_neg"))


def even_weights(counts: DataFrame, pos: str = "extra_pos", neg: str = "extra_neg") -> DataFrame:
    """Class totals of an image and the weights that make both classes count one half."""
    p, n = F.sum(pos), F.sum(neg)
    return counts.groupBy(IMAGE).agg(p.alias("pos"), n.alias("neg"), F.when(p > 0, 0.5 / p).otherwise(0.0).alias("weight_pos"), F.when(n > 0, 0.5 / n).otherwise(0.0).alias("weight_neg"))


def edge_error(labelled_edges: DataFrame, theta: float) -> DataFrame:
    """Share of edges on whose side of theta the truth doesn't lie."""
    wrong = (F.col("w") >= theta) != (F.col("gt") == 1)
    return labelled_edges.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("n_edges"), F.avg(wrong.cast("double")).alias("edge_error"))


def best_cut(rows: DataFrame, keys: list[str], value: str, positive: Column, weight: Column, ranges: int | None = None) -> DataFrame:
    """Weighted stump: the threshold on `value` that best tells positives (at or above it) from the
    others, with its error, detection rate and false-alarm rate. Equal values are never parted."""
    return best_cut_of(rows, keys, value, F.when(positive, weight).otherwise(0.0), F.when(positive, 0.0).otherwise(weight), ranges)


def best_cut_of(rows: DataFrame, keys: list[str], value: str, positive: Column, negative: Column, ranges: int | None = None) -> DataFrame:
    """The same for rows that weigh something on both sides.

    Values are aggregated first, so windows see one row per distinct value. With `ranges` a key's
    values are cut into about so many ranges, whose sums are run through by themselves: for few keys
    with more values than one task should sort. Without it each key is one task's.
    """
    by = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.sum(positive).cast("double").alias("_p"), F.sum(negative).cast("double").alias("_n"))
    if ranges:
        marks = F.approx_percentile("_v", [i / ranges for i in range(1, ranges)], 100 * ranges)
        by = by.join(by.groupBy(*keys).agg(marks.alias("_marks")), keys)
        by = by.withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col("_v")))).drop("_marks")
    else:
        by = by.withColumn("_range", F.lit(0))
    inner = W.partitionBy(*keys, "_range").orderBy(F.col("_v").desc())
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    placed = by.select(*keys, "_range", "_v", "_p", "_n", F.lead("_v").over(inner).alias("_next"), F.sum("_p").over(upto).alias("_h"), F.sum("_n").over(upto).alias("_f"))
    # One row a range: what lies above it, and the greatest value below.
    sums = by.groupBy(*keys, "_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"), F.max("_v").alias("_top"))
    whole = W.partitionBy(*keys)
    outer = whole.orderBy(F.col("_range").desc())
    above = outer.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *keys, "_range",
        F.coalesce(F.sum("_rp").over(above), F.lit(0.0)).alias("_ap"), F.coalesce(F.sum("_rn").over(above), F.lit(0.0)).alias("_an"),
        F.lead("_top").over(outer).alias("_below"), F.sum("_rp").over(whole).alias("_pos"), F.sum("_rn").over(whole).alias("_neg"),
    )
    hit, false, pos, neg = F.col("_h") + F.col("_ap"), F.col("_f") + F.col("_an"), F.col("_pos"), F.col("_neg")
    joined = placed.join(sums, [*keys, "_range"])
    rates = (hit / F.nullif(pos, F.lit(0.0))).alias("_d"), (false / F.nullif(neg, F.lit(0.0))).alias("_fa")
    cuts = joined.select(*keys, "_v", F.coalesce("_next", "_below").alias("_next"), (pos - hit + false).alias("_e"), *rates, (pos + neg).alias("_all"))
    best = cuts.groupBy(*keys).agg(F.min(F.struct("_e", (-F.col("_v")).alias("_o"), "_v", "_next", "_d", "_fa", "_all")).alias("b"))
    cut = F.coalesce((F.col("b._v") + F.col("b._next")) / 2, F.col("b._v") - 1e-8)
    return best.select(*keys, cut.alias("threshold"), (F.col("b._e") / F.col("b._all")).alias("error"), F.col("b._d").alias("detection"), F.col("b._fa").alias("false_alarm"))


def iid_threshold(labelled_edges: DataFrame) -> DataFrame:
    """The stump on edge weights by image, every edge for itself."""
    return best_cut(labelled_edges, [IMAGE], "w", F.col("gt") == 1, F.lit(1.0))


def transfer_counts(pixels: DataFrame, region: str, parent: str, gt: str) -> DataFrame:
    """Pairs of pixels in different regions of a parent region, with equal and with different truth."""
    cells = pixels.filter(F.col(gt) >= 0).groupBy(IMAGE, parent, region, gt).agg(F.count(F.lit(1)).alias("_n"))
    inner = cells.groupBy(IMAGE, parent, region).agg(F.sum("_n").alias("_n"), F.sum(_pairs(F.col("_n"))).alias("_same"))
    inner = inner.groupBy(IMAGE, parent).agg(F.sum("_same").alias("_same"), F.sum(_pairs(F.col("_n"))).alias("_all"))
    outer = cells.groupBy(IMAGE, parent, gt).agg(F.sum("_n").alias("_n"))
    outer = outer.groupBy(IMAGE, parent).agg(F.sum(_pairs(F.col("_n"))).alias("_same2"), F.sum("_n").alias("_m"))
    joined = outer.join(inner, [IMAGE, parent])
    same = (F.col("_same2") - F.col("_same")).cast("long")
    return joined.select(IMAGE, parent, same.alias("cross_pos"), (_pairs(F.col("_m")) - F.col("_all")).cast("long").alias("cross_all")).withColumn("cross_neg", F.col("cross_all") - F.col("cross_pos")).drop("cross_all")


def moving_average(series: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of the n values before each one; null for the first."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-n, -1)
    return series.withColumn("moving", F.avg(value).over(w))


def running_best(series: DataFrame, key: str, order: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """The least value so far. With `ranges`, a key's rows are cut into about so many ranges of the
    first column of the order, each run through by itself after the least of those before it."""
    if not ranges:
        w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return series.withColumn("best", F.min(value).over(w))
    at = F.col(order[0]).cast("double")
    marks = F.approx_percentile(at, [i / ranges for i in range(1, ranges)], 100 * ranges)
    rows = series.join(series.groupBy(key).agg(marks.alias("_marks")), key)
    rows = rows.withColumn("_range", F.size(F.filter("_marks", lambda m: m < at))).drop("_marks")
    lows = rows.groupBy(key, "_range").agg(F.min(value).alias("_low"))
    before = F.min("_low").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    inner = W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.withColumn("_own", F.min(value).over(inner)).join(lows.withColumn("_before", before).drop("_low"), [key, "_range"])
    return joined.select(*series.columns, F.least("_own", "_before").alias("best"))


def mean_std_runs(series: DataFrame, epoch: Column, value: str) -> DataFrame:
    return series.groupBy(epoch.alias("epoch")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def normalise_by_max(series: DataFrame, key: str, value: str) -> DataFrame:
    top = series.groupBy(key).agg(F.max(value).alias("_top"))
    return series.join(top, key).withColumn(value, F.col(value) / F.col("_top")).drop("_top")


def t_test(rows: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Welch's t of two groups and its degrees of freedom."""
    s = rows.filter(F.col(group).isin(a, b)).groupBy().agg(
        *[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select(((F.col("m0") - F.col("m1")) / F.sqrt(va + vb)).alias("t"), (F.pow(va + vb, 2) / (va * va / (F.col("n0") - 1) + vb * vb / (F.col("n1") - 1))).alias("df"))
