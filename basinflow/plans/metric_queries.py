"""Queries over labelings, losses, series and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators import components, features, graph, hierarchy, learn, loss, metrics, raster, watershed

from .catalog import register
from .raster_queries import BORDER
from .tables import BEST, EDGES, MERGES, PX, compact, edges, pixels, quadrant, rand_sql, sign_labels, table, truth


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


_FLAGS = "rows AS (SELECT l_suppkey AS image_id, l_returnflag AS seg, l_linestatus AS gt FROM lineitem)"


@register("rand_by_supplier", f"WITH {_FLAGS}, {rand_sql('rows')} SELECT * FROM rand")
def rand_by_supplier(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_returnflag").alias("seg"), F.col("l_linestatus").alias("gt"))
    return metrics.rand_contingency(rows, ["image_id"])


@register("rand_exhaustive", f"WITH {PX} SELECT a.image_id, count(*)::DOUBLE AS n_pairs, round(avg(CASE WHEN (a.sign = b.sign) <> (a.quad = b.quad) THEN 1.0::DOUBLE ELSE 0 END), 9) AS rand_error FROM px a JOIN px b ON a.image_id = b.image_id AND a.p < b.p GROUP BY ALL")
def rand_exhaustive(spark, sf):
    s = sign_labels(spark, sf).select("image_id", (F.col("y") * 8 + F.col("x")).alias("i"), F.col("label").alias("seg"), quadrant().alias("gt"))
    return _r(metrics.rand_exhaustive(s, ["image_id"], "i"), "rand_error", digits=9)


@register("rand_sampled")
def rand_sampled(spark, sf):
    rows = table(spark, sf, "customer").select((F.col("c_custkey") - 1).alias("i"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("gt"))
    return metrics.rand_sampled(rows, 100_000, 3)


@register("base_pair_counts", f"WITH {PX}, c AS (SELECT image_id, quad AS seg, sign, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, seg, sum(n)::BIGINT AS n, sum(n * (n - 1) // 2)::BIGINT AS extra_pos, (sum(n) * (sum(n) - 1) // 2 - sum(n * (n - 1) // 2))::BIGINT AS extra_neg FROM c GROUP BY ALL")
def base_pair_counts(spark, sf):
    return _base(spark, sf)


def _base(spark, sf) -> DataFrame:
    s = sign_labels(spark, sf).select("image_id", quadrant().alias("seg"), F.col("label").alias("gt"))
    return metrics.base_pair_counts(s)


@register(
    "even_weights",
    f"""WITH {PX}, c AS (SELECT image_id, quad, sign, count(*) AS n FROM px GROUP BY ALL), r AS (SELECT image_id, sum(n * (n - 1) // 2) AS p, sum(n) * (sum(n) - 1) // 2 - sum(n * (n - 1) // 2) AS q FROM c GROUP BY image_id, quad),
t AS (SELECT image_id, sum(p)::BIGINT AS pos, sum(q)::BIGINT AS neg FROM r GROUP BY image_id)
SELECT image_id, pos, neg, CASE WHEN pos > 0 THEN 0.5::DOUBLE / pos ELSE 0 END AS weight_pos, CASE WHEN neg > 0 THEN 0.5::DOUBLE / neg ELSE 0 END AS weight_neg FROM t""",
)
def even_weights(spark, sf):
    return metrics.even_weights(_base(spark, sf))


@register(
    "transfer_counts",
    f"""WITH {PX}, c AS (SELECT image_id, quad // 2 AS parent, quad, sign, count(*) AS n FROM px GROUP BY ALL)
SELECT a.image_id, a.parent, sum(CASE WHEN a.sign = b.sign THEN a.n * b.n ELSE 0 END)::BIGINT AS cross_pos, sum(CASE WHEN a.sign <> b.sign THEN a.n * b.n ELSE 0 END)::BIGINT AS cross_neg
FROM c a JOIN c b ON a.image_id = b.image_id AND a.parent = b.parent AND a.quad < b.quad GROUP BY ALL""",
)
def transfer_counts(spark, sf):
    s = sign_labels(spark, sf).select("image_id", quadrant().alias("region"), F.floor(quadrant() / 2).alias("parent"), F.col("label").alias("gt"))
    return metrics.transfer_counts(s, "region", "parent", "gt")


@register("edge_error", f"WITH {EDGES} SELECT image_id, count(*) AS n_edges, round(avg(CASE WHEN (w >= 0) <> (qa = qb) THEN 1.0::DOUBLE ELSE 0 END), 9) AS edge_error FROM e GROUP BY image_id")
def edge_error(spark, sf):
    return _r(metrics.edge_error(graph.edge_gt_labels(edges(spark, sf), truth(spark, sf)), 0.0), "edge_error", digits=9)


_CUT = """by_v AS (SELECT {k}, v, sum(CASE WHEN good THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN good THEN 0.0::DOUBLE ELSE 1 END) AS n FROM rows GROUP BY ALL),
placed AS (SELECT {k}, v, lead(v) OVER w AS nxt, sum(p) OVER (PARTITION BY {k}) AS pos, sum(n) OVER (PARTITION BY {k}) AS neg, sum(p) OVER u AS hit, sum(n) OVER u AS fal FROM by_v
  WINDOW w AS (PARTITION BY {k} ORDER BY v DESC), u AS (PARTITION BY {k} ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT {k}, round(coalesce((v + nxt) / 2, v - 1e-8), 6) + 0 AS threshold, round((pos - hit + fal) / (pos + neg), 9) AS error, round(hit / nullif(pos, 0), 9) AS detection, round(fal / nullif(neg, 0), 9) AS false_alarm
FROM placed QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY pos - hit + fal, -v) = 1"""


def _cut(df: DataFrame) -> DataFrame:
    return _r(_r(df, "error", "detection", "false_alarm", digits=9), "threshold")


@register("iid_threshold", f"WITH {EDGES}, rows AS (SELECT image_id, w AS v, qa = qb AS good FROM e), {_CUT.format(k='image_id')}")
def iid_threshold(spark, sf):
    return _cut(metrics.iid_threshold(graph.edge_gt_labels(edges(spark, sf), truth(spark, sf))))


@register("stump_threshold", f"WITH rows AS (SELECT d.lang, d.n_chars::DOUBLE AS v, l.quality = 1 AS good FROM documents d JOIN labels l USING (doc_id)), {_CUT.format(k='lang')}")
def stump_threshold(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, sf, "labels"), "doc_id")
    return _cut(metrics.best_cut(rows, ["lang"], "n_chars", F.col("quality") == 1, F.lit(1.0)))


@register("stump_search", f"WITH {EDGES}, long AS (SELECT 'w' AS feature, w AS v, qa = qb AS good FROM e UNION ALL SELECT 'd', -abs(va - vb), qa = qb FROM e), rows AS (SELECT * FROM long), {_CUT.format(k='feature')}")
def stump_search(spark, sf):
    d = edges(spark, sf, graph.ABSDIFF).withColumnRenamed("w", "d")
    rows = graph.edge_gt_labels(edges(spark, sf), truth(spark, sf)).join(d, ["image_id", "u", "v"])
    return _cut(learn.stump_search(rows, ["w", "d"]))


@register("moving_average", "SELECT event_id, event_type, value, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), 10) + 0 AS moving FROM events")
def moving_average(spark, sf):
    series = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return _r(metrics.moving_average(series, "event_type", ["ts", "event_id"], "value", 200).drop("ts"), "moving", digits=10)


@register("running_best", "SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, sf):
    series = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return metrics.running_best(series, "event_type", ["ts", "event_id"], "value").drop("ts")


@register("mean_std_runs", "SELECT user_id % 50 AS epoch, round(avg(value), 6) + 0 AS mean, round(stddev_pop(value), 6) + 0 AS std, count(*) AS n FROM events GROUP BY ALL")
def mean_std_runs(spark, sf):
    return _r(metrics.mean_std_runs(table(spark, sf, "events"), F.col("user_id") % 50, "value"), "mean", "std")


@register("normalise_by_max", "SELECT event_id, event_type, round(value / max(value) OVER (PARTITION BY event_type), 9) + 0 AS value FROM events")
def normalise_by_max(spark, sf):
    return _r(metrics.normalise_by_max(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", "value"), "value", digits=9)


@register(
    "ttest_pair",
    """WITH s AS (SELECT avg(o_totalprice) FILTER (o_orderstatus = 'O') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS vb,
count(*) FILTER (o_orderstatus = 'O') AS na, count(*) FILTER (o_orderstatus = 'F') AS nb FROM orders)
SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0 AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM s""",
)
def ttest_pair(spark, sf):
    return _r(_r(metrics.t_test(table(spark, sf, "orders"), "o_orderstatus", "O", "F", "o_totalprice"), "t"), "df", digits=4)


#: Borders of quadrants with counts of border edges whose ends have the same sign and different signs.
_COUNTS = f"{EDGES}, c AS (SELECT image_id, least(qa, qb) AS u, greatest(qa, qb) AS v, avg(w) AS w, count(*) FILTER (sa = sb) AS same, count(*) FILTER (sa <> sb) AS diff FROM e WHERE qa <> qb GROUP BY ALL)"


def _counts(spark, sf) -> DataFrame:
    labels = sign_labels(spark, sf).select("image_id", (F.col("y") * 8 + F.col("x")).alias("v"), "label")
    rows = graph.edge_gt_labels(edges(spark, sf), labels).withColumn("same_sign", F.col("gt") == 1).drop("gt")
    a = truth(spark, sf).select("image_id", F.col("v").alias("u"), F.col("label").alias("_a"))
    b = truth(spark, sf).select("image_id", "v", F.col("label").alias("_b"))
    rows = rows.join(a, ["image_id", "u"]).join(b, ["image_id", "v"]).filter("_a != _b")
    return rows.groupBy("image_id", F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).agg(F.avg("w").alias("w"), F.count_if("same_sign").alias("same"), F.count_if(~F.col("same_sign")).alias("diff"))


def _targets(spark, sf, kind: str) -> DataFrame:
    return _r(loss.edge_targets(_counts(spark, sf), None, kind).select("image_id", "u", "v", "label", "weight"), "weight", digits=9)


_SIGN = "CASE WHEN same >= diff THEN 1.0::DOUBLE ELSE -1.0 END"


@register("purity_loss", f"WITH {_COUNTS} SELECT image_id, u, v, {_SIGN} AS label, round(abs(same - diff)::DOUBLE / (same + diff), 9) AS weight FROM c")
def purity_loss(spark, sf):
    return _targets(spark, sf, loss.PURITY)


@register("equal_loss", f"WITH {_COUNTS} SELECT image_id, u, v, {_SIGN} AS label, 1.0::DOUBLE AS weight FROM c")
def equal_loss(spark, sf):
    return _targets(spark, sf, loss.EQUAL)


@register(
    "error_loss",
    f"""WITH {_COUNTS} SELECT image_id, u, v, CASE WHEN diff = 0 THEN 1.0::DOUBLE WHEN same = 0 THEN -1.0 WHEN w >= 0 THEN -1.0 ELSE 1.0 END AS label,
(CASE WHEN diff = 0 THEN same WHEN same = 0 THEN diff WHEN w >= 0 THEN diff ELSE same END)::DOUBLE AS weight FROM c""",
)
def error_loss(spark, sf):
    return _targets(spark, sf, loss.ERROR)


@register(
    "vertex_accumulated_purity",
    f"""WITH {_COUNTS}, n AS (SELECT image_id, u AS v, same, diff FROM c UNION ALL SELECT image_id, v, same, diff FROM c), s AS (SELECT image_id, v, sum(same)::BIGINT AS pos, sum(diff)::BIGINT AS neg FROM n GROUP BY ALL)
SELECT image_id, v, pos, neg, CASE WHEN pos > neg THEN 1.0::DOUBLE ELSE -1.0 END AS label, round(abs(pos - neg)::DOUBLE / (pos + neg), 9) AS weight FROM s""",
)
def vertex_accumulated_purity(spark, sf):
    return _r(loss.vertex_purity(_counts(spark, sf)), "weight", digits=9)


_ENDS = f"""{EDGES}, ends AS (SELECT image_id, u, v, w, CASE WHEN qa = qb THEN 1.0::DOUBLE ELSE -1.0 END AS label, abs(w) AS weight, unnest([u, v]) AS p FROM e),
pix AS (SELECT image_id, p, label, weight FROM ends QUALIFY row_number() OVER (PARTITION BY image_id, p ORDER BY u * 64 + v DESC) = 1)"""


def _edge_labels(spark, sf) -> DataFrame:
    rows = graph.edge_gt_labels(edges(spark, sf), truth(spark, sf))
    return rows.select("image_id", "u", "v", F.col("gt").cast("double").alias("label"), F.abs("w").alias("weight"))


def _scattered(spark, sf) -> DataFrame:
    return loss.scatter_last(_edge_labels(spark, sf), 8, F.col("u") * 64 + F.col("v"))


@register("scatter_last_write", f"WITH {_ENDS} SELECT image_id, (p % 8)::INT AS x, (p // 8)::INT AS y, label, weight FROM pix")
def scatter_last_write(spark, sf):
    return _scattered(spark, sf)


@register("scatter_direction", f"WITH {EDGES} SELECT image_id, (u % 8)::INT AS x, (u // 8)::INT AS y, CASE WHEN v - u = 1 THEN 0 ELSE 1 END AS band, CASE WHEN qa = qb THEN 1.0::DOUBLE ELSE -1.0 END AS label, abs(w) AS weight FROM e")
def scatter_direction(spark, sf):
    return loss.scatter_direction(_edge_labels(spark, sf), 8, F.col("u") * 64 + F.col("v"))


@register("squared_loss", f"WITH {_ENDS} SELECT image_id, round(sum(weight * pow(value - label, 2)), 6) AS loss FROM pix JOIN px USING (image_id, p) GROUP BY image_id")
def squared_loss(spark, sf):
    return _r(loss.squared_loss(pixels(spark, sf), _scattered(spark, sf)), "loss")


@register("hinge_loss", f"WITH {_ENDS} SELECT image_id, round(sum(weight * greatest(0, 1 - value * label)), 6) AS loss FROM pix JOIN px USING (image_id, p) GROUP BY image_id")
def hinge_loss(spark, sf):
    return _r(loss.hinge_loss(pixels(spark, sf), _scattered(spark, sf)), "loss")


@register("logistic_loss", f"WITH {EDGES}, m AS (SELECT image_id, greatest(-30, least(30, w * CASE WHEN qa = qb THEN 10 ELSE -10 END)) AS m FROM e) SELECT image_id, round(sum(ln(1 + exp(-m))), 6) + 0 AS loss, round(avg(-1 / (1 + exp(m))), 9) + 0 AS slope FROM m GROUP BY image_id")
def logistic_loss(spark, sf):
    rows = graph.edge_gt_labels(edges(spark, sf), truth(spark, sf))
    return _r(_r(loss.logistic_loss(rows, F.col("w") * F.col("gt") * 10, ["image_id"]), "loss"), "slope", digits=9)


_BEST_CUT = (
    MERGES
    + """, t AS (SELECT image_id, step, w, {p}::DOUBLE * sum(same) OVER a AS none, {p}::DOUBLE * sum(same) OVER a + {n}::DOUBLE * sum(diff) OVER a AS scale,
  ({p}::DOUBLE * (sum(same) OVER a - sum(same) OVER o) + {n}::DOUBLE * sum(diff) OVER o) / scale AS error, lead(w) OVER (PARTITION BY image_id ORDER BY step) AS nxt
  FROM merges WINDOW a AS (PARTITION BY image_id), o AS (PARTITION BY image_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT image_id, step, error, coalesce((w + nxt) / 2, w - 1e-8) AS threshold FROM t WHERE nxt IS NULL OR w - nxt >= 1e-8
  UNION ALL SELECT image_id, 0, none / scale, w + 1e-8 FROM t WHERE step = 1)
SELECT image_id, threshold, error, step AS n_merges FROM cand QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY error, step, threshold) = 1"""
)


@register(
    "rand_at_threshold",
    f"""WITH RECURSIVE {MERGES}, s AS (SELECT image_id, sum(same)::BIGINT AS pos, sum(diff)::BIGINT AS neg, sum(CASE WHEN w >= 0.1 THEN 0 ELSE same END)::BIGINT AS false_neg, sum(CASE WHEN w >= 0.1 THEN diff ELSE 0 END)::BIGINT AS false_pos FROM merges GROUP BY image_id)
SELECT *, (false_neg + false_pos) / (pos + neg) AS rand_error FROM s""",
)
def rand_at_threshold(spark, sf):
    return metrics.rand_at_threshold(hierarchy.merges(edges(spark, sf), truth(spark, sf)), F.lit(0.1))


@register("rand_best_threshold", "WITH RECURSIVE " + _BEST_CUT.format(p=1, n=1))
def rand_best_threshold(spark, sf):
    return metrics.rand_best_threshold(hierarchy.merges(edges(spark, sf), truth(spark, sf)))


@register("rand_weighted_threshold", "WITH RECURSIVE " + _BEST_CUT.format(p=2, n=1))
def rand_weighted_threshold(spark, sf):
    return metrics.rand_best_threshold(hierarchy.merges(edges(spark, sf), truth(spark, sf)), 2.0, 1.0)


@register(
    "feature_gradient",
    f"""WITH RECURSIVE {MERGES}, g AS (SELECT image_id, -CASE WHEN same >= diff THEN 1 ELSE -1 END * abs(same - diff) / sum(same + diff) OVER (PARTITION BY image_id) AS c, w, w * CASE WHEN same >= diff THEN 1 ELSE -1 END AS margin FROM merges)
SELECT image_id, component, round(sum(CASE WHEN component = 0 THEN c * w ELSE c END), 9) + 0 AS gradient FROM (SELECT *, unnest([0, 1])::INT AS component FROM g WHERE margin < 1) GROUP BY ALL""",
)
def feature_gradient(spark, sf):
    e = edges(spark, sf)
    f = e.select("image_id", "u", "v", F.array(F.col("w"), F.lit(1.0)).alias("f"))
    return _r(loss.feature_gradient(hierarchy.merges(e, truth(spark, sf)), f), "gradient", digits=9)


@register(
    "cut_gradient",
    f"""WITH {BEST}, side AS (SELECT e.image_id, e.u, e.v, e.w, e.qa, e.qb, i.n, i.w AS ow FROM e JOIN inc i ON i.image_id = e.image_id AND (i.n = e.u OR i.n = e.v) AND NOT (i.u = e.u AND i.v = e.v)
  QUALIFY row_number() OVER (PARTITION BY e.image_id, e.u, e.v, i.n ORDER BY i.w DESC, i.u, i.v) = 1),
win AS (SELECT image_id, w, ow, CASE WHEN qa = qb THEN 1 ELSE -1 END AS label FROM side QUALIFY row_number() OVER (PARTITION BY image_id, u, v ORDER BY ow, n <> u) = 1)
SELECT image_id, component, round(sum(CASE WHEN component = 0 THEN -label * abs(w) * (w - ow) ELSE 0 END), 6) + 0 AS gradient
FROM (SELECT *, unnest([0, 1])::INT AS component FROM win WHERE (w - ow) * label < 1) GROUP BY ALL""",
)
def cut_gradient(spark, sf):
    e = edges(spark, sf)
    f = e.select("image_id", "u", "v", F.array(F.col("w"), F.lit(1.0)).alias("f"))
    return _r(loss.cut_gradient(watershed.minmax_edges(e), _edge_labels(spark, sf), f), "gradient")


_PRICE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("range_normalise", "WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 9) + 0 AS o_totalprice FROM orders, r")
def range_normalise(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _r(learn.RangeNormalise.fit(rows, ["o_totalprice"]).apply(rows), "o_totalprice", digits=9)


@register("covariance", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem GROUP BY l_returnflag")
def covariance(spark, sf):
    m = learn.moments(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], keys=["l_returnflag"])
    return m.select("l_returnflag", F.round(F.col("p_0_1") / F.col("n") - F.col("s_0") / F.col("n") * F.col("s_1") / F.col("n"), 2).alias("covariance"))


@register("linear_score", "SELECT l_orderkey, l_linenumber, round(0.5::DOUBLE * l_quantity - 0.25::DOUBLE * l_discount - 10, 6) + 0 AS score FROM lineitem")
def linear_score(spark, sf):
    model = learn.LinearModel(["l_quantity", "l_discount"], [0.5, -0.25], 10.0)
    return _r(model.apply(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "score"), "score")


@register(
    "forest_vote",
    f"WITH {EDGES} SELECT image_id, u, v, (CASE WHEN qa <> qb THEN 1 ELSE 0 END + CASE WHEN sa <> sb THEN 1 ELSE 0 END)::BIGINT AS votes, 2::BIGINT AS n_trees FROM e",
)
def forest_vote(spark, sf):
    labels = sign_labels(spark, sf).select(F.lit(1).alias("tree"), "image_id", (F.col("y") * 8 + F.col("x")).alias("v"), "label")
    trees = truth(spark, sf).select(F.lit(0).alias("tree"), "image_id", "v", "label").unionByName(labels)
    return learn.forest_votes(edges(spark, sf), trees)


@register(
    "merge_features",
    f"WITH {PX}, m AS (SELECT image_id, quad, avg(value) AS f FROM px GROUP BY ALL) SELECT image_id, quad // 2 AS parent, round(avg(f), 6) + 0 AS mean, count(*) AS n_children FROM m GROUP BY ALL",
)
def merge_features(spark, sf):
    m = features.pool_moments(pixels(spark, sf).withColumn("label", quadrant()))
    parents = m.select("image_id", "label", F.floor(F.col("label") / 2).alias("parent"))
    return _r(features.merge_vertex_features(m, parents, "mean"), "mean")


@register("merge_edge_features", f"WITH {EDGES}, c AS (SELECT image_id, least(qa, qb) AS u, greatest(qa, qb) AS v, max(w) AS f FROM e WHERE qa <> qb GROUP BY ALL) SELECT image_id, least(u // 2, v // 2) AS u, greatest(u // 2, v // 2) AS v, min(f) AS low, max(f) AS high FROM c WHERE u // 2 <> v // 2 GROUP BY ALL")
def merge_edge_features(spark, sf):
    c = graph.contract(edges(spark, sf), truth(spark, sf))
    parents = truth(spark, sf).select("image_id", "label").distinct().withColumn("parent", F.floor(F.col("label") / 2))
    return features.merge_edge_features(c, parents, "max_w")


@register(
    "boundary_shape",
    f"""{BORDER}, b AS (SELECT image_id, u, v, min(least(a, b)) AS low, count(*) AS length FROM nb GROUP BY ALL), r AS (SELECT image_id, quad, min(value) AS low, count(*) AS n FROM px GROUP BY ALL)
SELECT b.image_id, b.u, b.v, length, b.low - greatest(x.low, y.low) AS depth, (b.low - greatest(x.low, y.low)) * length AS volume, round(length / sqrt(least(x.n, y.n)), 9) AS aspect
FROM b JOIN r x ON x.image_id = b.image_id AND x.quad = b.u JOIN r y ON y.image_id = b.image_id AND y.quad = b.v""",
)
def boundary_shape(spark, sf):
    p = pixels(spark, sf).withColumn("label", quadrant())
    regions = p.groupBy("image_id", "label").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    return _r(features.boundary_shape(features.pool_boundary(p), regions), "aspect", digits=9)


@register(
    "smooth_triangles",
    f"""{BORDER}, b AS (SELECT image_id, u, v, min(least(a, b)) AS low FROM nb GROUP BY ALL), d AS (SELECT image_id, u AS r, v AS o, low AS f FROM b UNION ALL SELECT image_id, v, u, low FROM b),
m AS (SELECT b.image_id, b.u, b.v, avg((x.f + y.f) / 2) AS m FROM b JOIN d x ON x.image_id = b.image_id AND x.r = b.u AND x.o <> b.v JOIN d y ON y.image_id = b.image_id AND y.r = b.v AND y.o = x.o GROUP BY ALL)
SELECT b.image_id, b.u, b.v, round(coalesce(0.5::DOUBLE * b.low + 0.5::DOUBLE * m.m, b.low), 6) + 0 AS low FROM b LEFT JOIN m ON m.image_id = b.image_id AND m.u = b.u AND m.v = b.v""",
)
def smooth_triangles(spark, sf):
    p = pixels(spark, sf).withColumn("label", quadrant())
    return _r(features.smooth_triangles(features.pool_boundary(p).select("image_id", "u", "v", "low"), "low"), "low")


@register("whiten_apply")
def whiten_apply(spark, sf):
    rows = table(spark, sf, "lineitem")
    return learn.Whiten.fit(rows, _PRICE).apply(rows).select("l_orderkey", "l_linenumber", *[f"white_{c}" for c in _PRICE])


@register("acd_scores")
def acd_scores(spark, sf):
    rows = table(spark, sf, "lineitem")
    q = learn.change_detector(rows, _PRICE[:2], _PRICE[2:])
    return rows.select("l_orderkey", "l_linenumber", learn.quadratic_score(_PRICE, q).alias("score"))


@register(
    "fisher_weights",
    """WITH g AS (SELECT l_returnflag = 'R' AS y, count(*)::DOUBLE AS n, avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_pop(l_quantity) AS va, var_pop(l_extendedprice) AS vb, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT sum(n * va) / sum(n) AS va, sum(n * vb) / sum(n) AS vb, sum(n * c) / sum(n) AS c, sum(CASE WHEN y THEN a ELSE -a END) AS da, sum(CASE WHEN y THEN b ELSE -b END) AS db, avg(a) AS ma, avg(b) AS mb FROM g),
w AS (SELECT (vb * da - c * db) / (va * vb - c * c) AS wa, (va * db - c * da) / (va * vb - c * c) AS wb, ma, mb FROM s)
SELECT l_orderkey, l_linenumber, round(wa * (l_quantity - ma) + wb * (l_extendedprice - mb), 6) + 0 AS score FROM lineitem, w""",
)
def fisher_weights(spark, sf):
    rows = table(spark, sf, "lineitem")
    return learn.fisher(rows, _PRICE[:2], F.col("l_returnflag") == "R").apply(rows).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@register("logreg_fit")
def logreg_fit(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("size")).join(table(spark, sf, "labels"), "doc_id")
    return learn.logistic(rows, ["size"], F.col("quality") == 1).apply(rows).select("doc_id", "score")


@register("kmeans_maps")
def kmeans_maps(spark, sf):
    p = raster.patches(pixels(spark, sf))
    return learn.kmeans_maps(p, "patch", learn.kmeans(p, "patch", 4)).drop("patch")


@register("slic_superpixels")
def slic_superpixels(spark, sf):
    return learn.slic(pixels(spark, sf), 4, 8, 0.5, rounds=2)


@register("hungarian_match")
def hungarian_match(spark, sf):
    s = sign_labels(spark, sf).select("image_id", F.col("label").alias("row"), quadrant().alias("col"))
    return learn.assignment(s.groupBy("image_id", "row", "col").agg((-F.count(F.lit(1))).cast("double").alias("cost")), ["image_id"])


@register("vertex_count_by_image", f"WITH {PX} SELECT image_id, count(*) AS n FROM px GROUP BY image_id")
def vertex_count_by_image(spark, sf):
    return compact(spark, sf).select("image_id", F.size("values").cast("long").alias("n"))


_NEAR = "list_max([v for v in [m[p], CASE WHEN p % 8 <> 1 THEN m[p - 1] END, CASE WHEN p % 8 <> 0 THEN m[p + 1] END, CASE WHEN p > 8 THEN m[p - 8] END, CASE WHEN p <= 56 THEN m[p + 8] END] if v IS NOT NULL])"


@register(
    "morph_reconstruction",
    f"""WITH RECURSIVE r AS (SELECT vec_id AS image_id, embedding::DOUBLE[] AS lim, 0 AS i, list_transform(range(1, 65), lambda p: {_NEAR.replace("list_max", "list_min").replace("m[", "embedding[")})::DOUBLE[] AS m FROM embeddings
  UNION ALL SELECT image_id, lim, i + 1, list_transform(range(1, 65), lambda p: least(lim[p], {_NEAR})) FROM r WHERE i < 64)
SELECT image_id, ((p - 1) % 8)::INT AS x, ((p - 1) // 8)::INT AS y, m[p] AS value FROM r, range(1, 65) AS t(p) WHERE i = 64""",
)
def morph_reconstruction(spark, sf):
    from basinflow.operators.reconstruction import reconstruct

    p = pixels(spark, sf)
    return reconstruct(raster.erode(p, raster.CROSS), p)
