"""Queries over graphs: construction, components, watersheds and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import components, graph, hierarchy, metrics, raster, watershed

from .catalog import register
from .tables import BASINS, BEST, CUT, EDGES, FINAL, MERGES, PX, RANKS, SUPER, compact, edges, pixels, quadrant, rand_sql, sign_labels, table, truth

THETA = 0.25


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@register("grid_edges_mean", f"WITH {EDGES} SELECT image_id, u, v, w FROM e")
def grid_edges_mean(spark, sf):
    return edges(spark, sf)


@register("grid_edges_absdiff", f"WITH {EDGES} SELECT image_id, u, v, -abs(va - vb) AS w FROM e")
def grid_edges_absdiff(spark, sf):
    return edges(spark, sf, graph.ABSDIFF)


@register("grid_edges_sum", f"WITH {EDGES} SELECT image_id, u, v, va + vb AS w FROM e")
def grid_edges_sum(spark, sf):
    return edges(spark, sf, graph.SUM)


@register("grid_edges_near", f"WITH {EDGES} SELECT image_id, u, v, 20.5::DOUBLE - abs(va - vb) AS w FROM e")
def grid_edges_near(spark, sf):
    return graph.grid_edges(pixels(spark, sf), 8, graph.NEAR)


@register(
    "grid_edges_2ch",
    f"""WITH {PX}, b AS (SELECT a.image_id, a.x, a.y, a.p, a.value AS b0, c.value AS b1 FROM px a JOIN px c ON c.image_id = a.image_id + 1 AND c.p = a.p WHERE a.image_id % 2 = 0)
SELECT image_id, p AS u, p + 1 AS v, b0 AS w FROM b WHERE x < 7 UNION ALL SELECT image_id, p, p + 8, b1 FROM b WHERE y < 7""",
)
def grid_edges_2ch(spark, sf):
    p = pixels(spark, sf)
    even = p.filter("image_id % 2 = 0").withColumnRenamed("value", "band0")
    odd = p.filter("image_id % 2 = 1").select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("value").alias("band1"))
    return graph.grid_edges_two_bands(even.join(odd, raster.PIXEL), 8, 8)


@register(
    "radius_edges",
    f"""WITH {PX}, o AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (-1, 1), (3, 0), (0, 3), (3, 3), (-3, 3)) AS t(dx, dy))
SELECT a.image_id, least(a.p, b.p) AS u, greatest(a.p, b.p) AS v, (a.value + b.value) / 2 AS w FROM px a CROSS JOIN o JOIN px b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy""",
)
def radius_edges(spark, sf):
    return graph.grid_edges(pixels(spark, sf), 8, offsets=graph.radius_offsets([1, 3]))


@register("edge_gt_labels", f"WITH {EDGES} SELECT image_id, u, v, w, CASE WHEN qa = qb THEN 1 ELSE -1 END AS gt FROM e")
def edge_gt_labels(spark, sf):
    return graph.edge_gt_labels(edges(spark, sf), truth(spark, sf))


@register("edge_census", f"WITH {EDGES} SELECT image_id, avg(CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE 0 END) AS frac_same, count(*) FILTER (sa = sb) AS n_same, count(*) FILTER (sa <> sb) AS n_diff FROM e GROUP BY image_id")
def edge_census(spark, sf):
    labels = sign_labels(spark, sf).select("image_id", (F.col("y") * 8 + F.col("x")).alias("v"), "label")
    return graph.edge_census(graph.edge_gt_labels(edges(spark, sf), labels))


@register("rag_from_labels", f"WITH {EDGES} SELECT image_id, least(qa, qb) AS u, greatest(qa, qb) AS v, count(*) AS n_border FROM e WHERE qa <> qb GROUP BY ALL")
def rag_from_labels(spark, sf):
    return graph.region_graph(pixels(spark, sf).select("image_id", "x", "y", quadrant().alias("label")))


@register("contract_graph", f"WITH {EDGES} SELECT image_id, least(qa, qb) AS u, greatest(qa, qb) AS v, count(*) AS n_edges, round(sum(w), 6) + 0 AS sum_w, min(w) AS min_w, max(w) AS max_w FROM e WHERE qa <> qb GROUP BY ALL")
def contract_graph(spark, sf):
    return _r(graph.contract(edges(spark, sf), truth(spark, sf)), "sum_w")


@register("intra_label_edges", f"WITH {EDGES} SELECT image_id, u, v, w FROM e WHERE qa = qb")
def intra_label_edges(spark, sf):
    return graph.intra_label_edges(edges(spark, sf), truth(spark, sf))


@register("threshold_filter_ge", f"WITH {EDGES} SELECT image_id, u, v, w FROM e WHERE w >= 0.1")
def threshold_filter_ge(spark, sf):
    return graph.threshold_ge(edges(spark, sf), 0.1)


@register("threshold_filter_le", f"WITH {EDGES} SELECT image_id, u, v, w FROM e WHERE w <= -0.1")
def threshold_filter_le(spark, sf):
    return graph.threshold_le(edges(spark, sf), -0.1)


@register("subgraph_crop", f"WITH {EDGES} SELECT image_id, (u // 8 - 1) * 4 + u % 8 - 2 AS u, (v // 8 - 1) * 4 + v % 8 - 2 AS v, w FROM e WHERE u % 8 BETWEEN 2 AND 5 AND v % 8 BETWEEN 2 AND 5 AND u // 8 BETWEEN 1 AND 4 AND v // 8 BETWEEN 1 AND 4")
def subgraph_crop(spark, sf):
    return graph.subgraph(edges(spark, sf), 8, 2, 1, 4)


@register("edges_to_images", f"WITH {EDGES} SELECT image_id, u % 8 AS x, u // 8 AS y, CASE WHEN v - u = 1 THEN 0 ELSE 1 END AS band, w AS value FROM e")
def edges_to_images(spark, sf):
    return graph.edges_to_images(edges(spark, sf), 8)


@register("edges_to_boundary", f"WITH {EDGES} SELECT p.image_id, p.x, p.y, coalesce(m.w, l.w) AS value FROM px p LEFT JOIN (SELECT image_id, u, max(w) AS w FROM e GROUP BY ALL) m ON m.image_id = p.image_id AND m.u = p.p JOIN (SELECT image_id, min(w) AS w FROM e GROUP BY ALL) l ON l.image_id = p.image_id")
def edges_to_boundary(spark, sf):
    return graph.edges_to_boundary(edges(spark, sf), 8)


@register("random_non_edges")
def random_non_edges(spark, sf):
    return graph.random_non_edges(edges(spark, sf), truth(spark, sf), 2, 7)


@register("contrast_copy")
def contrast_copy(spark, sf):
    e = edges(spark, sf)
    drawn = graph.random_non_edges(e, truth(spark, sf), 1, 11).select("image_id", "u", (F.col("v") + 64).alias("v"), F.lit(-1.0).alias("w"))
    return graph.contrast_copy(e, 64, drawn)


#: Components of a threshold graph: needs WITH RECURSIVE, px and pairs (image_id, a, b) in both directions.
def _flow(nodes: str) -> str:
    return f"flow AS (SELECT image_id, p AS src, p AS node FROM {nodes} UNION SELECT f.image_id, f.src, d.b FROM flow f JOIN pairs d ON d.image_id = f.image_id AND d.a = f.node)"


@register("threshold_components", f"WITH RECURSIVE {EDGES}, pairs AS (SELECT image_id, u AS a, v AS b FROM e WHERE w >= {THETA} UNION ALL SELECT image_id, v, u FROM e WHERE w >= {THETA}), {_flow('px')} SELECT image_id, src AS v, min(node) AS comp FROM flow GROUP BY ALL")
def threshold_components(spark, sf):
    return components.components(graph.threshold_ge(edges(spark, sf), THETA), truth(spark, sf))


_ON = f"""WITH RECURSIVE {PX}, pos AS (SELECT * FROM px WHERE value > {THETA}), pairs AS (SELECT a.image_id, a.p AS a, b.p AS b FROM pos a JOIN pos b ON b.image_id = a.image_id AND abs(b.x - a.x) + abs(b.y - a.y) = 1),
{_flow("pos")}, comps AS (SELECT image_id, src AS p, min(node)::BIGINT AS label FROM flow GROUP BY ALL)"""


@register("binary_cc", f"{_ON} SELECT px.image_id, px.x, px.y, coalesce(label, -1) AS label FROM px LEFT JOIN comps USING (image_id, p)")
def binary_cc(spark, sf):
    return components.binary_components(pixels(spark, sf), 8, THETA)


@register("cc_centroids", f"{_ON} SELECT image_id, label, round(avg(x), 6) + 0 AS cx, round(avg(y), 6) + 0 AS cy, count(*) AS n FROM px JOIN comps USING (image_id, p) GROUP BY ALL")
def cc_centroids(spark, sf):
    labels = components.binary_components(pixels(spark, sf), 8, THETA).filter("label >= 0")
    return _r(components.centroids(labels), "cx", "cy")


@register("cc_weighted_centroids", f"{_ON} SELECT image_id, label, round(sum(x * value) / sum(value), 6) + 0 AS cx, round(sum(y * value) / sum(value), 6) + 0 AS cy, round(avg(value), 6) + 0 AS confidence FROM px JOIN comps USING (image_id, p) GROUP BY ALL")
def cc_weighted_centroids(spark, sf):
    p = pixels(spark, sf)
    labels = components.binary_components(p, 8, THETA).filter("label >= 0").join(p, raster.PIXEL)
    return _r(components.weighted_centroids(labels), "cx", "cy", "confidence")


@register("label_stats", f"{_ON} SELECT image_id, count(DISTINCT coalesce(label, -1)) AS n_labels, min(coalesce(label, -1)) AS low, max(coalesce(label, -1)) AS high FROM px LEFT JOIN comps USING (image_id, p) GROUP BY ALL")
def label_stats(spark, sf):
    return components.label_stats(components.binary_components(pixels(spark, sf), 8, THETA))


@register("label_tally", f"WITH {PX} SELECT image_id, quad AS label, count(*) AS n FROM px GROUP BY ALL")
def label_tally(spark, sf):
    return components.label_tally(truth(spark, sf))


@register(
    "fix_zero_labels",
    f"""WITH RECURSIVE {PX}, zero AS (SELECT * FROM px WHERE sign = 0), pairs AS (SELECT a.image_id, a.p AS a, b.p AS b FROM zero a JOIN zero b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND a.p <> b.p),
{_flow("zero")}, comps AS (SELECT image_id, src AS p, min(node) AS comp FROM flow GROUP BY ALL), named AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY comp) AS k FROM comps),
top AS (SELECT image_id, max(sign) AS t FROM px GROUP BY image_id)
SELECT px.image_id, x, y, coalesce(k + t, sign) AS label FROM px LEFT JOIN named USING (image_id, p) JOIN top ON top.image_id = px.image_id""",
)
def fix_zero_labels(spark, sf):
    return components.relabel_zero(sign_labels(spark, sf).select("image_id", "x", "y", "label"), 8)


@register("order_stat_threshold", f"WITH {EDGES}, o AS (SELECT image_id, w, row_number() OVER (PARTITION BY image_id ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM e) SELECT image_id, w AS threshold FROM o WHERE i = least(floor(0.3::DOUBLE * n)::BIGINT, n - 1)")
def order_stat_threshold(spark, sf):
    return components.order_statistic(edges(spark, sf), 0.3)


@register("best_edge", f"WITH {BEST} SELECT image_id, n, u, v, w FROM best")
def best_edge(spark, sf):
    return watershed.best_edge(edges(spark, sf))


@register(
    "minmax_cut",
    f"""WITH {BEST}, m AS (SELECT e.image_id, e.u, e.v, e.w, max(i.w) FILTER (i.n = e.u AND NOT (i.u = e.u AND i.v = e.v)) AS a, max(i.w) FILTER (i.n = e.v AND NOT (i.u = e.u AND i.v = e.v)) AS b
  FROM e JOIN inc i ON i.image_id = e.image_id AND (i.n = e.u OR i.n = e.v) GROUP BY ALL)
SELECT image_id, u, v, w, w - least(a, b) AS cut, CASE WHEN a <= b THEN u ELSE v END AS winner FROM m""",
)
def minmax_cut(spark, sf):
    return watershed.minmax_cut(edges(spark, sf))


@register("best_forest", f"WITH {BEST} SELECT DISTINCT image_id, u, v, w FROM best")
def best_forest(spark, sf):
    return watershed.best_forest(edges(spark, sf))


def _found(spark, sf) -> DataFrame:
    """The watershed of each raster, in arrays."""
    return watershed.compact_basins(compact(spark, sf), 8, pixels=64)


def _watershed(spark, sf) -> tuple[DataFrame, DataFrame]:
    return watershed.compact_watershed(_found(spark, sf))


@register("watershed_labels", f"WITH RECURSIVE {BASINS} SELECT image_id, v, label FROM lab")
def watershed_labels(spark, sf):
    return _watershed(spark, sf)[0]


@register("watershed_basins", f"WITH RECURSIVE {BASINS} SELECT image_id, basin, weight FROM basins")
def watershed_basins(spark, sf):
    return _watershed(spark, sf)[1]


@register("watershed_by_edges", f"WITH RECURSIVE {BASINS} SELECT image_id, v, label FROM lab")
def watershed_by_edges(spark, sf):
    """The same by rounds over edges, as for rasters that no row holds."""
    return watershed.watershed(edges(spark, sf))[0]


def _super(spark, sf, waterfall: bool = False) -> DataFrame:
    return watershed.compact_super_edges(_found(spark, sf), 8, waterfall=waterfall)


def _regions(spark, sf) -> DataFrame:
    """The region graph of each raster as edges."""
    return components.written(_super(spark, sf).select("image_id", F.col("b1").alias("u"), F.col("b2").alias("v"), F.col("depth").alias("w")))


@register("super_graph_depth", f"WITH RECURSIVE {SUPER} SELECT image_id, b1, b2, depth, u, v FROM se")
def super_graph_depth(spark, sf):
    return _super(spark, sf)


@register(
    "waterfall_level2",
    f"""WITH RECURSIVE {SUPER}, i2 AS (SELECT image_id, b1 AS n, b2 AS o, b1 AS u, b2 AS v, w FROM se UNION ALL SELECT image_id, b2, b1, b1, b2, w FROM se),
best2 AS (SELECT * FROM i2 QUALIFY row_number() OVER (PARTITION BY image_id, n ORDER BY w DESC, u, v) = 1),
ptr2 AS (SELECT a.image_id, a.n, CASE WHEN b.u = a.u AND b.v = a.v THEN least(a.n, a.o) ELSE a.o END AS nxt FROM best2 a JOIN best2 b ON b.image_id = a.image_id AND b.n = a.o),
walk2 AS (SELECT image_id, n, nxt AS r FROM ptr2 UNION SELECT w.image_id, w.n, p.nxt FROM walk2 w JOIN ptr2 p ON p.image_id = w.image_id AND p.n = w.r),
roots2 AS (SELECT DISTINCT w.image_id, w.n, w.r AS root FROM walk2 w JOIN ptr2 p ON p.image_id = w.image_id AND p.n = w.r WHERE p.nxt = w.r),
named2 AS (SELECT b.image_id, r.root, row_number() OVER (PARTITION BY b.image_id ORDER BY b.w DESC, b.u, b.v)::INT AS label FROM best2 b JOIN roots2 r ON r.image_id = b.image_id AND r.n = b.n WHERE r.n = r.root)
SELECT b.image_id, b.basin, coalesce(n.label, 1) AS label FROM basins b LEFT JOIN roots2 r ON r.image_id = b.image_id AND r.n = b.basin LEFT JOIN named2 n ON n.image_id = r.image_id AND n.root = r.root""",
)
def waterfall_level2(spark, sf):
    return watershed.waterfall_of(_super(spark, sf, waterfall=True), _watershed(spark, sf)[1])


@register("singleton_forest", f"WITH RECURSIVE {BASINS} SELECT e.image_id, e.u, e.v, e.w, CASE WHEN f.u IS NOT NULL THEN 1.0::DOUBLE WHEN a.label <> b.label THEN -1.0 ELSE e.w END AS mark FROM e LEFT JOIN (SELECT DISTINCT image_id, u, v FROM best) f ON f.image_id = e.image_id AND f.u = e.u AND f.v = e.v JOIN lab a ON a.image_id = e.image_id AND a.v = e.u JOIN lab b ON b.image_id = e.image_id AND b.v = e.v")
def singleton_forest(spark, sf):
    return hierarchy.singleton_forest(edges(spark, sf))


@register("mst_edges_region", f"WITH RECURSIVE {RANKS} SELECT image_id, b1::BIGINT AS u, b2::BIGINT AS v, depth AS w FROM ranked WHERE depth = bn")
def mst_edges_region(spark, sf):
    return hierarchy.mst_edges(_regions(spark, sf))


@register("mst_boruvka_region", f"WITH RECURSIVE {RANKS} SELECT image_id, b1 AS u, b2 AS v, depth AS w FROM ranked WHERE depth = bn")
def mst_boruvka_region(spark, sf):
    return hierarchy.boruvka(_regions(spark, sf))


@register("merge_rank", f"WITH RECURSIVE {RANKS} SELECT image_id, b1::BIGINT AS u, b2::BIGINT AS v, depth AS w, rank FROM ranked")
def merge_rank(spark, sf):
    return hierarchy.merge_rank(_regions(spark, sf))


@register("cc_offset", f"WITH RECURSIVE {CUT} SELECT image_id, theta FROM theta")
def cc_offset(spark, sf):
    return hierarchy.offset_threshold(_regions(spark, sf), 0.75)


def _curve(spark, sf) -> DataFrame:
    r = _regions(spark, sf)
    return hierarchy.energy_curve(r, hierarchy.offset_threshold(r, 0.75))


@register("cc_energy_curve", f"WITH RECURSIVE {CUT} SELECT image_id, rank, round(w, 6) + 0 AS w, round(energy, 6) + 0 AS energy FROM curve")
def cc_energy_curve(spark, sf):
    return _r(_curve(spark, sf), "w", "energy")


@register("cc_min_energy_threshold", f"WITH RECURSIVE {CUT} SELECT image_id, round(energy, 6) + 0 AS energy, round(cut, 6) + 0 AS threshold FROM lowest")
def cc_min_energy_threshold(spark, sf):
    return _r(hierarchy.min_energy_threshold(_curve(spark, sf)), "energy", "threshold")


def _final(spark, sf) -> DataFrame:
    """image_id, v, comp: the basins' clusters of every pixel."""
    labels, found = _watershed(spark, sf)
    regions = _regions(spark, sf)
    theta = hierarchy.offset_threshold(regions, 0.75)
    low = hierarchy.min_energy_threshold(hierarchy.energy_curve(regions, theta)).join(theta, "image_id")
    shifted = regions.join(theta, "image_id").withColumn("w", F.col("w") - F.col("theta"))
    comps = hierarchy.cut_labels(shifted, low, found.select("image_id", F.col("basin").alias("v")), by_image=True)
    return labels.join(comps.withColumnRenamed("v", "label"), ["image_id", "label"]).select("image_id", "v", "comp")


@register("hierarchical_labels", f"WITH RECURSIVE {FINAL} SELECT image_id, v, comp FROM final")
def hierarchical_labels(spark, sf):
    return _final(spark, sf)


_SCORED = f"WITH RECURSIVE {FINAL}, rows AS (SELECT f.image_id, f.comp AS seg, p.quad AS gt FROM final f JOIN px p ON p.image_id = f.image_id AND p.p = f.v), {rand_sql('rows')}"


@register("scored_rand", f"{_SCORED} SELECT image_id, n_basins::INT AS n_basins, round(rand_error, 9) AS rand_error FROM rand JOIN (SELECT image_id, count(*) AS n_basins FROM basins GROUP BY image_id) USING (image_id)")
def scored_rand(spark, sf):
    s = hierarchy.scored_pass(edges(spark, sf), truth(spark, sf))
    return s.totals.select("image_id", "n_basins", F.round("rand_error", 9).alias("rand_error"))


@register("scored_edges")
def scored_edges(spark, sf):
    return hierarchy.scored_pass(edges(spark, sf), truth(spark, sf)).edges


@register("rand_contingency", f"WITH RECURSIVE {BASINS}, rows AS (SELECT l.image_id, l.label AS seg, p.quad AS gt FROM lab l JOIN px p ON p.image_id = l.image_id AND p.p = l.v), {rand_sql('rows')} SELECT * FROM rand")
def rand_contingency(spark, sf):
    labels = _watershed(spark, sf)[0].select("image_id", "v", F.col("label").alias("seg"))
    return metrics.rand_contingency(labels.withColumn("gt", quadrant(F.col("v") % 8, F.floor(F.col("v") / 8))), ["image_id"])


@register("merge_table", f"WITH RECURSIVE {MERGES} SELECT * FROM merges")
def merge_table(spark, sf):
    return hierarchy.merges(edges(spark, sf), truth(spark, sf))


@register(
    "marker_watershed",
    f"""WITH RECURSIVE {EDGES}, ord AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w DESC, u, v) AS i FROM e),
kr AS (SELECT DISTINCT image_id, 0::BIGINT AS i, range(0, 64) AS lab, list_transform(range(0, 64), lambda p: CASE WHEN p IN (9, 14, 49, 54) THEN 2 * (p // 32) + (p % 8) // 4 + 1 ELSE 0 END) AS mk FROM e
  UNION ALL SELECT image_id, i, CASE WHEN apart THEN lab ELSE list_transform(lab, lambda x: CASE WHEN x = b THEN a ELSE x END) END,
    CASE WHEN apart THEN mk ELSE list_transform(range(1, 65), lambda p: CASE WHEN lab[p] IN (a, b) THEN greatest(ma, mb) ELSE mk[p] END) END
  FROM (SELECT k.image_id, o.i, k.lab, k.mk, k.lab[o.u + 1] AS a, k.lab[o.v + 1] AS b, k.mk[o.u + 1] AS ma, k.mk[o.v + 1] AS mb, (ma > 0 AND mb > 0 AND ma <> mb) AS apart FROM kr k JOIN ord o ON o.image_id = k.image_id AND o.i = k.i + 1)),
ends AS (SELECT * FROM kr QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i DESC) = 1)
SELECT image_id, p AS v, mk[p + 1]::BIGINT AS marker FROM ends, range(0, 64) AS t(p)""",
)
def marker_watershed(spark, sf):
    marks = truth(spark, sf).filter("v in (9, 14, 49, 54)").select("image_id", "v", (F.col("label") + 1).alias("marker"))
    return hierarchy.marker_watershed(edges(spark, sf), marks)


@register("greedy_clusters")
def greedy_clusters(spark, sf):
    return hierarchy.greedy_clusters(_regions(spark, sf))


@register(
    "supplier_graph",
    """WITH pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), linked AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v FROM pairs a JOIN pairs b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey)
SELECT 0::BIGINT AS image_id, u, v, count(*)::DOUBLE AS w FROM linked GROUP BY ALL""",
)
def supplier_graph(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    linked = pairs.select("l_partkey", F.col("l_suppkey").alias("u")).join(pairs.select("l_partkey", F.col("l_suppkey").alias("v")), "l_partkey").filter("u < v")
    return linked.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w")).select(F.lit(0).cast("long").alias("image_id"), "u", "v", "w")


@register(
    "supplier_tree",
    """WITH RECURSIVE pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), linked AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v FROM pairs a JOIN pairs b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey),
g AS (SELECT u, v, count(*)::DOUBLE AS w FROM linked GROUP BY ALL), ord AS (SELECT *, row_number() OVER (ORDER BY w DESC, u, v) AS i FROM g),
kr AS (SELECT 0::BIGINT AS i, range(0, (SELECT max(v) + 1 FROM g)) AS lab
  UNION ALL SELECT o.i, list_transform(k.lab, lambda x: CASE WHEN x = k.lab[o.v + 1] THEN k.lab[o.u + 1] ELSE x END) FROM kr k JOIN ord o ON o.i = k.i + 1)
SELECT 0::BIGINT AS image_id, o.u, o.v, o.w FROM ord o JOIN kr k ON k.i = o.i - 1 WHERE k.lab[o.u + 1] <> k.lab[o.v + 1]""",
)
def supplier_tree(spark, sf):
    return hierarchy.boruvka(supplier_graph(spark, sf))


@register("scene_watershed")
def scene_watershed(spark, sf):
    from basinflow.sources import generators

    scene = generators.ramp_two_squares(spark, 32)
    return watershed.watershed(graph.grid_edges(scene, 32, graph.ABSDIFF))[1]


@register(
    "small_optimum",
    """WITH RECURSIVE ed(u, v, w) AS (VALUES (0, 1, 0.5::DOUBLE), (0, 2, 0.1), (1, 2, 0.4), (2, 3, -0.3), (3, 4, 0.6), (4, 5, 0.3), (3, 5, 0.2)),
p AS (SELECT [0] AS p UNION ALL SELECT list_append(p, b::INT) FROM p, range(0, 6) AS t(b) WHERE len(p) < 6 AND b <= list_max(p) + 1),
s AS (SELECT p, round(sum(CASE WHEN p[u + 1] <> p[v + 1] THEN w ELSE 0 END), 9) AS energy FROM p, ed WHERE len(p) = 6 GROUP BY p),
best AS (SELECT p FROM s ORDER BY energy, p LIMIT 1)
SELECT 0::BIGINT AS image_id, i AS v, p[i + 1] AS cluster FROM best, range(0, 6) AS t(i)""",
)
def small_optimum(spark, sf):
    from basinflow.sources import generators

    e = generators.affinity_graph(spark, {(0, 1): 0.5, (0, 2): 0.1, (1, 2): 0.4, (2, 3): -0.3, (3, 4): 0.6, (4, 5): 0.3, (3, 5): 0.2})
    return hierarchy.small_optimum(e)
