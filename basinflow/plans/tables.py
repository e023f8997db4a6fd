"""The driver tables as rasters, graphs and labelings, in Spark and in DuckDB.

Each embedding of 64 numbers is an 8 x 8 raster; its quadrants are the true segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.operators import graph, raster

WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("values"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.explode_raster(compact(spark, sf_dir), WIDTH)


def edges(spark: SparkSession, sf_dir: str, kind: str = graph.MEAN) -> DataFrame:
    return graph.grid_edges_compact(compact(spark, sf_dir), WIDTH, kind)


def quadrant(x: Column | str = "x", y: Column | str = "y") -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return (2 * F.floor(y / 4) + F.floor(x / 4)).cast("long")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, v, label: the quadrant of every vertex; no pixel value is read."""
    rows = compact(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * WIDTH - 1))).alias("v"))
    return rows.withColumn("label", quadrant(F.col("v") % WIDTH, F.floor(F.col("v") / WIDTH)))


def sign_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, value, label: 1 where the value is positive, else 0."""
    return pixels(spark, sf_dir).withColumn("label", F.when(F.col("value") > 0, 1).otherwise(0).cast("long"))


PX = """px AS (SELECT vec_id AS image_id, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, (i - 1)::INT AS p, embedding[i]::DOUBLE AS value,
  (2 * ((i - 1) // 32) + ((i - 1) % 8) // 4)::BIGINT AS quad, CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END::BIGINT AS sign
  FROM embeddings, range(1, 65) AS t(i))"""
EDGES = (
    PX
    + """, e AS (SELECT a.image_id, a.p AS u, b.p AS v, (a.value + b.value) / 2 AS w, a.value AS va, b.value AS vb, a.quad AS qa, b.quad AS qb, a.sign AS sa, b.sign AS sb
  FROM px a JOIN (SELECT *, unnest([1, 8]) AS step FROM px) b ON a.image_id = b.image_id AND a.p = b.p - b.step WHERE b.step = 8 OR b.x > 0)"""
)
BEST = (
    EDGES
    + """, inc AS (SELECT image_id, u AS n, v AS o, u, v, w FROM e UNION ALL SELECT image_id, v, u, u, v, w FROM e),
best AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY image_id, n ORDER BY w DESC, u, v) = 1)"""
)
#: Needs WITH RECURSIVE.
BASINS = (
    BEST
    + """, ptr AS (SELECT a.image_id, a.n, CASE WHEN b.u = a.u AND b.v = a.v THEN least(a.n, a.o) ELSE a.o END AS nxt
  FROM best a JOIN best b ON b.image_id = a.image_id AND b.n = a.o),
walk AS (SELECT image_id, n, nxt AS r FROM ptr UNION SELECT w.image_id, w.n, p.nxt FROM walk w JOIN ptr p ON p.image_id = w.image_id AND p.n = w.r),
roots AS (SELECT DISTINCT w.image_id, w.n, w.r AS root FROM walk w JOIN ptr p ON p.image_id = w.image_id AND p.n = w.r WHERE p.nxt = w.r),
basins AS (SELECT b.image_id, r.root, row_number() OVER (PARTITION BY b.image_id ORDER BY b.w DESC, b.u, b.v)::INT AS basin, b.w AS weight
  FROM best b JOIN roots r ON r.image_id = b.image_id AND r.n = b.n WHERE r.n = r.root),
lab AS (SELECT r.image_id, r.n AS v, b.basin AS label FROM roots r JOIN basins b ON b.image_id = r.image_id AND b.root = r.root)"""
)
SUPER = (
    BASINS
    + """, crossing AS (SELECT e.image_id, least(a.label, b.label) AS b1, greatest(a.label, b.label) AS b2, e.w, e.u, e.v
  FROM e JOIN lab a ON a.image_id = e.image_id AND a.v = e.u JOIN lab b ON b.image_id = e.image_id AND b.v = e.v WHERE a.label <> b.label),
se AS (SELECT c.image_id, b1, b2, c.w - greatest(x.weight, y.weight) AS depth, c.u, c.v, c.w FROM crossing c
  JOIN basins x ON x.image_id = c.image_id AND x.basin = c.b1 JOIN basins y ON y.image_id = c.image_id AND y.basin = c.b2
  QUALIFY row_number() OVER (PARTITION BY c.image_id, b1, b2 ORDER BY c.w DESC, c.u, c.v) = 1)"""
)
#: The depth at which each super-edge's ends are first connected, and that depth's rank.
RANKS = (
    SUPER
    + """, dirs AS (SELECT image_id, b1 AS a, b2 AS b, depth FROM se UNION ALL SELECT image_id, b2, b1, depth FROM se),
cuts AS (SELECT DISTINCT image_id, depth AS t FROM se),
reach AS (SELECT c.image_id, c.t, s.b1 AS src, s.b1 AS node FROM cuts c JOIN (SELECT DISTINCT image_id, b1 FROM se) s ON s.image_id = c.image_id
  UNION SELECT r.image_id, r.t, r.src, d.b FROM reach r JOIN dirs d ON d.image_id = r.image_id AND d.a = r.node AND d.depth >= r.t),
bottle AS (SELECT s.image_id, s.b1, s.b2, s.depth, max(r.t) AS bn FROM se s JOIN reach r ON r.image_id = s.image_id AND r.src = s.b1 AND r.node = s.b2 GROUP BY ALL),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY bn DESC)::INT AS rank FROM bottle)"""
)
_CUT_AT = (
    RANKS
    + """, placed AS (SELECT image_id, depth, row_number() OVER (PARTITION BY image_id ORDER BY depth DESC) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM se),
theta AS (SELECT image_id, depth AS theta FROM placed WHERE i = least(floor(n * OFFSET::DOUBLE)::BIGINT, n - 1)),
steps AS (SELECT r.image_id, rank, sum(depth - theta) AS gone, max(depth - theta) AS w FROM ranked r JOIN theta USING (image_id) GROUP BY ALL),
curve AS (SELECT image_id, rank, w, total - sum(gone) OVER (PARTITION BY image_id ORDER BY rank) AS energy
  FROM (SELECT image_id, rank, gone, w FROM steps UNION ALL SELECT image_id, 0, 0, NULL FROM steps GROUP BY image_id)
  JOIN (SELECT image_id, sum(gone) AS total FROM steps GROUP BY image_id) USING (image_id)),
befores AS (SELECT *, coalesce(lag(w) OVER o, first_w + 1000) AS before FROM curve JOIN (SELECT image_id, max(w) AS first_w FROM curve GROUP BY image_id) USING (image_id)
  WINDOW o AS (PARTITION BY image_id ORDER BY rank)),
lowest AS (SELECT image_id, energy, CASE WHEN rank = 0 THEN first_w + 1000 ELSE (w + before) / 2 END AS cut
  FROM befores QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY energy, rank) = 1)"""
)
_FINAL_AT = (
    _CUT_AT
    + """, kept AS (SELECT d.image_id, d.a, d.b FROM dirs d JOIN theta t ON t.image_id = d.image_id JOIN lowest l ON l.image_id = d.image_id WHERE d.depth - t.theta >= l.cut),
flow AS (SELECT image_id, basin AS src, basin AS node FROM basins UNION SELECT f.image_id, f.src, k.b FROM flow f JOIN kept k ON k.image_id = f.image_id AND k.a = f.node),
comps AS (SELECT image_id, src AS basin, min(node) AS comp FROM flow GROUP BY image_id, src),
final AS (SELECT l.image_id, l.v, c.comp FROM lab l JOIN comps c ON c.image_id = l.image_id AND c.basin = l.label)"""
)

def cut_sql(offset: float = 0.75) -> str:
    """CTEs to `lowest`, the clustering's threshold at an offset."""
    return _CUT_AT.replace("OFFSET", str(offset))


def final_sql(offset: float = 0.75) -> str:
    """CTEs to `final`, every pixel's final label: the least basin that kept super-edges reach; lone basins are their own."""
    return _FINAL_AT.replace("OFFSET", str(offset))


CUT, FINAL = cut_sql(), final_sql()


def merges_sql(edges: str = "e") -> str:
    """CTEs from a table of edges of 64 vertices on: the merges of its maximum spanning forest in order, with pair
    counts by quadrant. The labels of all vertices are carried from edge to edge."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w DESC, u, v) AS i FROM {edges}),
kr AS (SELECT DISTINCT image_id, 0::BIGINT AS i, range(0, 64) AS lab FROM {edges}
  UNION ALL SELECT k.image_id, o.i, list_transform(k.lab, lambda x: CASE WHEN x = k.lab[o.v + 1] THEN k.lab[o.u + 1] ELSE x END) FROM kr k JOIN ord o ON o.image_id = k.image_id AND o.i = k.i + 1),
made AS (SELECT o.image_id, o.u, o.v, o.w, row_number() OVER (PARTITION BY o.image_id ORDER BY o.i)::INT AS step,
    list_filter(range(0, 64), lambda j: k.lab[j + 1] = k.lab[o.u + 1]) AS us, list_filter(range(0, 64), lambda j: k.lab[j + 1] = k.lab[o.v + 1]) AS vs
  FROM ord o JOIN kr k ON k.image_id = o.image_id AND k.i = o.i - 1 WHERE k.lab[o.u + 1] <> k.lab[o.v + 1]),
pairs_of AS (SELECT *, list_sum(list_transform(range(0, 4), lambda q: len(list_filter(us, lambda j: 2 * (j // 32) + (j % 8) // 4 = q)) * len(list_filter(vs, lambda j: 2 * (j // 32) + (j % 8) // 4 = q))))::BIGINT AS same FROM made),
merges AS (SELECT image_id, step, u::BIGINT AS u, v::BIGINT AS v, w, same, (len(us) * len(vs) - same)::BIGINT AS diff FROM pairs_of)"""


#: Needs WITH RECURSIVE.
MERGES = f"{EDGES}, {merges_sql()}"


def rand_sql(rows: str, keys: str = "image_id", seg: str = "seg", gt: str = "gt") -> str:
    """CTEs that end in `rand` with the Rand error by keys of the rows."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()} AND a.{k.strip()} = c.{k.strip()} AND a.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return f"""
cells AS (SELECT {keys}, {seg} AS s, {gt} AS t, count(*)::DOUBLE AS n FROM {rows} GROUP BY ALL),
c_both AS (SELECT {keys}, sum(n * (n - 1) / 2) AS k FROM cells GROUP BY ALL),
c_seg AS (SELECT {keys}, sum(n * (n - 1) / 2) AS k FROM (SELECT {keys}, s, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
c_gt AS (SELECT {keys}, sum(n * (n - 1) / 2) AS k FROM (SELECT {keys}, t, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
c_all AS (SELECT {keys}, n * (n - 1) / 2 AS k FROM (SELECT {keys}, sum(n) AS n FROM cells GROUP BY ALL)),
rand AS (SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, d.k AS n_pairs, a.k AS both, b.k AS same_seg, c.k AS same_gt, coalesce((b.k + c.k - 2 * a.k) / nullif(d.k, 0), 0) AS rand_error
  FROM c_both a, c_seg b, c_gt c, c_all d WHERE {on})"""
