"""Queries of trained segmentation, and of operators over whole hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import components, descent, features, graph, hierarchy, loss, metrics, raster, segmenter, watershed

from .catalog import register
from .metric_queries import _BEST_CUT, _COUNTS, _counts, _r
from .tables import BASINS, BEST, EDGES, PX, edges, final_sql, merges_sql, pixels, quadrant, rand_sql, table, truth

#: Edges of the features m (mean) and d (minus the difference).
_FEATURES = f"{EDGES}, f AS (SELECT image_id, u, v, w AS m, -abs(va - vb) AS d FROM e)"


def _cut(name: str, table: str) -> str:
    """CTEs to {name}: the min-max cut of a table of edges; wu, wv, ww are the edge that sets its minimum."""
    return f"""{name}_i AS (SELECT image_id, u AS n, u, v, w FROM {table} UNION ALL SELECT image_id, v, u, v, w FROM {table}),
{name}_s AS (SELECT e.image_id, e.u, e.v, e.w, i.n, i.u AS wu, i.v AS wv, i.w AS ww FROM {table} e JOIN {name}_i i ON i.image_id = e.image_id AND (i.n = e.u OR i.n = e.v) AND NOT (i.u = e.u AND i.v = e.v)
  QUALIFY row_number() OVER (PARTITION BY e.image_id, e.u, e.v, i.n ORDER BY i.w DESC, i.u, i.v) = 1),
{name} AS (SELECT *, w - ww AS cut FROM {name}_s QUALIFY row_number() OVER (PARTITION BY image_id, u, v ORDER BY ww, n <> u) = 1)"""


def _features(spark, sf) -> DataFrame:
    """image_id, u, v, m, d."""
    m, d = edges(spark, sf).withColumnRenamed("w", "m"), edges(spark, sf, graph.ABSDIFF).withColumnRenamed("w", "d")
    return components.written(m.join(d, ["image_id", "u", "v"]))


_MODEL = segmenter.EdgeModel(("m", "d"), (0.7, 0.3), 0.05, segmenter.WS)


@register("model_apply", f"WITH {_FEATURES}, s AS (SELECT image_id, u, v, 0.0::DOUBLE + m * 0.7::DOUBLE + d * 0.3::DOUBLE AS w FROM f), {_cut('c', 's')} SELECT image_id, u, v, round(cut - 0.05::DOUBLE, 9) + 0 AS w FROM c")
def model_apply(spark, sf):
    return _r(segmenter.apply(_features(spark, sf), _MODEL), "w", digits=9)


#: Features and ways of segmenting, each as an image of its own.
_VARIANTS = f"""{_FEATURES}, em AS (SELECT image_id, u, v, m AS w FROM f), ed AS (SELECT image_id, u, v, d AS w FROM f), {_cut('cm', 'em')}, {_cut('cd', 'ed')},
every AS (SELECT image_id * 4 AS image_id, u, v, w FROM em UNION ALL SELECT image_id * 4 + 1, u, v, cut FROM cm UNION ALL SELECT image_id * 4 + 2, u, v, w FROM ed UNION ALL SELECT image_id * 4 + 3, u, v, cut FROM cd),
{merges_sql("every")}"""


@register(
    "inner_stumps",
    f"""WITH RECURSIVE {_VARIANTS}, vals AS (SELECT (image_id % 4)::INT AS variant, w AS v, sum(same) AS p, sum(diff) AS n FROM merges GROUP BY ALL),
run AS (SELECT variant, v, lead(v) OVER o AS nxt, sum(p) OVER a - sum(p) OVER u + sum(n) OVER u AS e, sum(p) OVER u / sum(p) OVER a AS d, sum(n) OVER u / sum(n) OVER a AS fa, sum(p) OVER a + sum(n) OVER a AS total
  FROM vals WINDOW a AS (PARTITION BY variant), o AS (PARTITION BY variant ORDER BY v DESC), u AS (PARTITION BY variant ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
SELECT variant, round(coalesce((v + nxt) / 2, v - 1e-8), 9) + 0 AS threshold, round(e / total, 9) AS error, round(d, 9) AS detection, round(fa, 9) AS false_alarm
FROM run QUALIFY row_number() OVER (PARTITION BY variant ORDER BY e, v DESC) = 1""",
)
def inner_stumps(spark, sf):
    variants = [segmenter.EdgeModel((f,), (1.0,), kind=k) for f in ("m", "d") for k in (segmenter.CC, segmenter.WS)]
    return _r(segmenter.variant_cuts(_features(spark, sf), truth(spark, sf), variants), "threshold", "error", "detection", "false_alarm", digits=9)


@register("linear_training")
def linear_training(spark, sf):
    """One row a step of four."""
    _, _, steps = segmenter.train_linear(_features(spark, sf), truth(spark, sf), ["m", "d"], rounds=4)
    rows = [(i, s.model.threshold, s.error, list(s.model.weights)) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, threshold double, error double, weights array<double>")


@register("segmentation_tree")
def segmentation_tree(spark, sf):
    f, t = _features(spark, sf), truth(spark, sf)
    return segmenter.SegmentTree(["m", "d"], 2).fit(f, t).transform(f, t)


@register("segmentation_forest")
def segmentation_forest(spark, sf):
    f, t = _features(spark, sf), truth(spark, sf)
    return segmenter.SegmentForest(["m", "d"], trees=2, depth=1).fit(f, t).transform(f, t)


@register(
    "batch_report",
    f"""WITH RECURSIVE {_BEST_CUT.format(p=1, n=1).replace("SELECT image_id, threshold, error, step AS n_merges FROM cand", ", own AS (SELECT image_id, threshold, error FROM cand")}),
held AS (SELECT image_id, sum(CASE WHEN w >= 0.1 THEN diff ELSE same END) / sum(same + diff) AS rand_error FROM merges GROUP BY image_id)
SELECT count(*) AS n_images, round(avg(threshold), 9) AS mean_threshold, min(threshold) AS least_threshold, max(threshold) AS greatest_threshold,
  round(avg(error), 9) AS mean_error, min(error) AS least_error, max(error) AS greatest_error, round(avg(rand_error), 9) AS mean_error_at FROM own JOIN held USING (image_id)""",
)
def batch_report(spark, sf):
    return _r(segmenter.batch_report(edges(spark, sf), truth(spark, sf), 0.1), "mean_threshold", "mean_error", "mean_error_at", digits=9)


def _sweep_sql(offset: float) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE {final_sql(offset)}, rows AS (SELECT f.image_id, f.comp AS seg, p.quad AS gt FROM final f JOIN px p ON p.image_id = f.image_id AND p.p = f.v), {rand_sql('rows')}
SELECT 'near' AS setting, {offset}::DOUBLE AS "offset", round(avg(rand_error), 9) AS rand_error, count(*) AS n_images FROM rand)"""


@register("param_grid_search", " UNION ALL ".join(_sweep_sql(o) for o in (0.5, 0.65, 0.75, 0.9)))
def param_grid_search(spark, sf):
    e = components.written(edges(spark, sf))
    return _r(segmenter.offset_sweep({"near": e}, truth(spark, sf), [0.5, 0.65, 0.75, 0.9]), "rand_error", digits=9)


@register("radius_offset_sweep")
def radius_offset_sweep(spark, sf):
    """The hierarchy over edges of several radii, at several offsets: one plan for the whole grid."""
    p = pixels(spark, sf)
    settings = {str(radii): components.written(graph.grid_edges(p, 8, offsets=graph.radius_offsets(radii))) for radii in ([1], [1, 2], [1, 3])}
    return segmenter.offset_sweep(settings, truth(spark, sf), [0.5, 0.75])


@register("maxmin_cut", f"WITH {EDGES}, s AS (SELECT image_id, u, v, -w AS w FROM e), {_cut('c', 's')} SELECT image_id, u, v, -w AS w, -cut AS cut, n AS winner FROM c")
def maxmin_cut(spark, sf):
    return watershed.maxmin_cut(edges(spark, sf))


@register("gather_cut", f"WITH {_FEATURES}, s AS (SELECT image_id, u, v, m AS w FROM f), {_cut('c', 's')} SELECT c.image_id, c.u, c.v, a.d - b.d AS cut FROM c JOIN f a USING (image_id, u, v) JOIN f b ON b.image_id = c.image_id AND b.u = c.wu AND b.v = c.wv")
def gather_cut(spark, sf):
    return watershed.gather_cut(edges(spark, sf), edges(spark, sf, graph.ABSDIFF))


@register("basins_from_gray", f"WITH RECURSIVE {BASINS.replace('(a.value + b.value) / 2 AS w', '-abs(a.value - b.value) AS w')} SELECT image_id, v, label FROM lab")
def basins_from_gray(spark, sf):
    return watershed.basins_from_gray(pixels(spark, sf), 8)


@register("basin_image", f"WITH RECURSIVE {BASINS} SELECT image_id, (v % 8)::INT AS x, (v // 8)::INT AS y, (label + 1)::BIGINT AS value FROM lab")
def basin_image(spark, sf):
    return watershed.label_image(watershed.watershed(edges(spark, sf))[0], 8)


@register("watershed_pair_counts", f"WITH RECURSIVE {BEST}, forest AS (SELECT DISTINCT image_id, u, v, w FROM best), {merges_sql('forest')} SELECT image_id, sum(same)::BIGINT AS same, sum(diff)::BIGINT AS diff FROM merges GROUP BY image_id")
def watershed_pair_counts(spark, sf):
    merged = hierarchy.merges(watershed.best_forest(edges(spark, sf)), truth(spark, sf))
    return merged.groupBy("image_id").agg(F.sum("same").alias("same"), F.sum("diff").alias("diff"))


@register("tree_roots", f"WITH RECURSIVE {BASINS} SELECT DISTINCT image_id, n::BIGINT AS node, root::BIGINT AS root FROM roots")
def tree_roots(spark, sf):
    """Each vertex's best edge leads to its parent; of two that lead to each other the smaller is the root."""
    best = watershed.best_edge(edges(spark, sf)).withColumn("to", F.when(F.col("n") == F.col("u"), F.col("v")).otherwise(F.col("u")))
    back = best.select("image_id", F.col("n").alias("to"), F.col("to").alias("back"))
    parent = F.when((F.col("back") == F.col("n")) & (F.col("n") < F.col("to")), F.col("n")).otherwise(F.col("to"))
    found = components.flatten_tree(best.join(back, ["image_id", "to"]).select("image_id", F.col("n").alias("node"), parent.alias("parent")))
    return found.select("image_id", F.col("node").cast("long").alias("node"), F.col("root").cast("long").alias("root"))


@register("vector_edges", f"WITH {PX}, s AS (SELECT image_id, x, y, p, [value, value * value] AS vec FROM px), o AS (SELECT *, unnest([1, 8]) AS step FROM s) SELECT a.image_id, a.p::BIGINT AS u, b.p::BIGINT AS v, round(-list_distance(a.vec, b.vec), 9) + 0 AS w FROM s a JOIN o b ON b.image_id = a.image_id AND a.p = b.p - b.step WHERE b.step = 8 OR b.x > 0")
def vector_edges(spark, sf):
    p = pixels(spark, sf).select("image_id", "x", "y", F.array(F.col("value"), F.col("value") * F.col("value")).alias("values"))
    rows = graph.vector_edges(p, 8).select("image_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "w")
    return _r(rows, "w", digits=9)


@register("marker_vertices", f"WITH {PX} SELECT image_id, p::BIGINT AS v, CASE WHEN p IN (9, 14, 49, 54) THEN quad + 1 ELSE 0 END::BIGINT AS marker FROM px")
def marker_vertices(spark, sf):
    t = truth(spark, sf)
    found = graph.marker_vertices(t, t.filter("v in (9, 14, 49, 54)").select("image_id", "v", (F.col("label") + 1).alias("marker")))
    return found.withColumn("v", F.col("v").cast("long"))


@register("contrast_labels", f"WITH {PX} SELECT image_id, (p + 64 * c)::BIGINT AS v, (p // 24 * 3 + p % 8 // 3 + 9 * c)::BIGINT AS label FROM px, (VALUES (0), (1)) AS t(c)")
def contrast_labels(spark, sf):
    return graph.contrast_labels(truth(spark, sf), 64, 8, 3).withColumn("v", F.col("v").cast("long"))


@register("purity_flipped", f"WITH {_COUNTS} SELECT image_id, u, v, CASE WHEN same > diff THEN -1.0::DOUBLE ELSE 1.0 END AS label, round(abs(same - diff)::DOUBLE / (same + diff), 9) AS weight FROM c")
def purity_flipped(spark, sf):
    return _r(loss.edge_targets(_counts(spark, sf), None, loss.PURITY, flip=True).select("image_id", "u", "v", "label", "weight"), "weight", digits=9)


@register(
    "resample_cubic",
    f"""WITH {PX}, g AS (SELECT DISTINCT image_id, x, y FROM px WHERE x < 4 AND y < 4), c AS (SELECT *, unnest([-1, 0, 1, 2]) AS i FROM g), cc AS (SELECT *, unnest([-1, 0, 1, 2]) AS j FROM c)
SELECT cc.image_id, cc.x, cc.y, round(sum(px.value * CASE WHEN i IN (0, 1) THEN 0.59375::DOUBLE ELSE -0.09375 END * CASE WHEN j IN (0, 1) THEN 0.59375::DOUBLE ELSE -0.09375 END), 6) + 0 AS value
FROM cc JOIN px ON px.image_id = cc.image_id AND px.x = greatest(0, least(7, 2 * cc.x + i)) AND px.y = greatest(0, least(7, 2 * cc.y + j)) GROUP BY ALL""",
)
def resample_cubic(spark, sf):
    return _r(raster.resample(pixels(spark, sf), 8, 8, 4, 4, cubic=True), "value")


@register("gradient_bank")
def gradient_bank(spark, sf):
    """Eight of the bank's 72 settings, over all images."""
    return raster.gradient_bank(pixels(spark, sf), 8, 8, raster.gradient_bank_settings()[::9])


@register("filter_training")
def filter_training(spark, sf):
    """A filter that tells quadrant 3 from the pixels around: one row an epoch."""
    p = pixels(spark, sf)
    target = p.select("image_id", "x", "y", F.when(quadrant() == 3, 1.0).otherwise(0.0).alias("value"))
    fit = descent.train_filter(p, target, epochs=20, method="adam")
    return spark.createDataFrame([(i, e) for i, e in enumerate(fit.errors)], "epoch int, error double")


@register("sparse_logistic")
def sparse_logistic(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", (F.col("l_quantity") / 50).alias("q"), (F.col("l_linestatus") == "O").alias("open"))
    return descent.sparse_logistic(rows, ["l_discount", "l_tax", "q"], F.col("open"), 0.001, 15).apply(rows).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@register("quadrant_chips", f"WITH {PX} SELECT (image_id * 3 + quad)::BIGINT AS image_id, x % 4 AS x, y % 4 AS y, value FROM px WHERE quad < 3")
def quadrant_chips(spark, sf):
    return raster.quadrant_chips(pixels(spark, sf), 8, 8)


@register("pooled_by_name", f"WITH {PX} SELECT image_id, quad AS label, round(avg(value), 6) + 0 AS mean, round(avg(value * value) - avg(value) * avg(value), 6) + 0 AS variance, count(*) AS n FROM px GROUP BY ALL")
def pooled_by_name(spark, sf):
    found = features.pool_named(pixels(spark, sf).withColumn("label", quadrant()), "moments")
    return _r(found["moments"], "mean", "variance")
