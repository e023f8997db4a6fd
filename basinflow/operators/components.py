"""Connected components of edge tables (image_id, u, v), and what follows from labels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL, neighbours

_OWN_DIR: list[tempfile.TemporaryDirectory] = []


def written(df: DataFrame) -> DataFrame:
    """Writes df to the folder in spark.checkpoint.dir and reads it back: what was worked out
    survives lost executors. Where none is set, on one machine, a folder of this process is used."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR.append(tempfile.TemporaryDirectory(prefix="basinflow-"))
        base = f"file://{_OWN_DIR[-1].name}"
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables of written() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rounds-" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, vertices: DataFrame | None = None, by_image: bool = False) -> DataFrame:
    """image_id, v, comp: the smallest vertex that edges reach. Vertices without edges are their own.

    Distributed, for graphs of any size: in each round every vertex takes the least label among
    its own and its neighbours', and then that label's label (pointer jumping). With by_image each
    image is searched by one task, without rounds: for many images that fit one.
    """
    if by_image:
        return _components_by_image(edges, vertices)
    ends = edges.select("image_id", "u", "v").union(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
    ends = written(ends.distinct())
    known = ends.select("image_id", F.col("u").alias("v"))
    labels = written((known if vertices is None else known.union(vertices.select("image_id", "v"))).distinct().withColumn("comp", F.col("v")))
    while True:
        near = ends.join(labels, ["image_id", "v"]).groupBy("image_id", "u").agg(F.min("comp").alias("_near"))
        hop = labels.join(near.withColumnRenamed("u", "v"), ["image_id", "v"], "left")
        hop = hop.select("image_id", "v", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        jump = hop.select("image_id", F.col("v").alias("comp"), F.col("comp").alias("_next"))
        after = hop.join(jump, ["image_id", "comp"]).select("image_id", "v", F.least("comp", "_next").alias("comp"), "_old")
        after = written(after)
        dropped(labels)
        labels = after.drop("_old")
        if after.filter("comp != _old").isEmpty():
            dropped(ends)
            return labels


def _components_by_image(edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    # A vertex without edges is a loop.
    rows = edges.select("image_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    if vertices is not None:
        own = F.col("v").cast("long")
        rows = rows.union(vertices.select("image_id", own.alias("u"), own.alias("v")))

    def run(table: pa.Table) -> pa.Table:
        u, v = (table.column(c).to_numpy() for c in ("u", "v"))
        names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        home = list(range(len(names)))

        def root(x: int) -> int:
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        for a, b in zip(*ends.reshape(2, -1).tolist(), strict=True):
            a, b = root(a), root(b)
            home[max(a, b)] = min(a, b)
        comp = names[[root(x) for x in range(len(names))]]
        return pa.table({"image_id": pa.array(np.full(len(names), table.column("image_id")[0].as_py())), "v": pa.array(names), "comp": pa.array(comp)})

    kind = (vertices if vertices is not None else edges).schema["v"].dataType.simpleString()
    found = rows.groupBy("image_id").applyInArrow(run, "image_id long, v long, comp long")
    return found.select("image_id", F.col("v").cast(kind).alias("v"), F.col("comp").cast(kind).alias("comp"))


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id").agg(F.countDistinct("label").alias("n_labels"), F.min("label").alias("low"), F.max("label").alias("high"))


def label_tally(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


def centroids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))


def weighted_centroids(labels: DataFrame, confidence: str = "value") -> DataFrame:
    """Centroids by confidence, and the mean confidence; labels without any have none."""
    total = F.sum(confidence)
    return labels.groupBy("image_id", "label").agg((F.sum(F.col("x") * F.col(confidence)) / F.nullif(total, F.lit(0.0))).alias("cx"), (F.sum(F.col("y") * F.col(confidence)) / F.nullif(total, F.lit(0.0))).alias("cy"), F.avg(confidence).alias("confidence"))


def order_statistic(rows: DataFrame, fraction: float, value: str = "w", descending: bool = False, ranges: int | None = None) -> DataFrame:
    """image_id, threshold: the value at place floor(fraction * n), from 0, clamped; exact.

    With `ranges` an image's values are counted by about so many ranges first, and only those of the
    range that holds the place are sorted: for images with more values than one task should sort.
    """
    from pyspark.sql import Window as W

    v = F.col(value).cast("double")
    rows = rows.select("image_id", F.col(value).alias("_v"), (-v if descending else v).alias("_k"))
    n = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    at = F.greatest(F.lit(0), F.least(F.floor(fraction * F.col("_n")), F.col("_n") - 1)) + 1
    wanted = n.select("image_id", at.alias("_at"))
    if ranges:
        marks = F.approx_percentile("_k", [i / ranges for i in range(1, ranges)], 100 * ranges)
        rows = rows.join(rows.groupBy("image_id").agg(marks.alias("_marks")), "image_id")
        rows = rows.withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col("_k")))).drop("_marks")
        counts = rows.groupBy("image_id", "_range").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(W.partitionBy("image_id").orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
        held = counts.withColumn("_upto", upto).join(wanted, "image_id").filter("_at <= _upto and _at > _upto - _c")
        rows = rows.join(held.select("image_id", "_range", (F.col("_at") - (F.col("_upto") - F.col("_c"))).alias("_at")), ["image_id", "_range"])
    else:
        rows = rows.join(wanted, "image_id")
    placed = rows.withColumn("_i", F.row_number().over(W.partitionBy("image_id").orderBy("_k")))
    return placed.filter("_i = _at").select("image_id", F.col("_v").alias("threshold"))


def relabel_zero(labels: DataFrame, width: int, value: int = 0, split: DataFrame | None = None) -> DataFrame:
    """Each 8-connected part of a label gets an id of its own above the image's greatest label.

    The parts are numbered by their least vertex y * width + x.
    """
    from pyspark.sql import Window as W

    part = labels.filter(F.col("label") == value)
    nodes = part.select("image_id", (F.col("y") * width + F.col("x")).alias("v"))
    sent = neighbours(part.withColumnRenamed("label", "value"), [(0, 0), (1, 0), (0, 1), (1, 1), (-1, 1)])
    own = sent.filter("dx = 0 and dy = 0").select("image_id", "x", "y")
    pairs = sent.filter("dx != 0 or dy != 0").join(own, PIXEL)
    u = F.col("y") * width + F.col("x")
    v = (F.col("y") + F.col("dy")) * width + F.col("x") + F.col("dx")
    comps = components(pairs.select("image_id", u.alias("u"), v.alias("v")), nodes)
    heads = comps.select("image_id", "comp").distinct().withColumn("_k", F.row_number().over(W.partitionBy("image_id").orderBy("comp")))
    top = labels.groupBy("image_id").agg(F.max("label").alias("_top"))
    fresh = comps.join(heads, ["image_id", "comp"]).join(top, "image_id").select("image_id", "v", (F.col("_k") + F.col("_top")).alias("_new"))
    keyed = labels.withColumn("v", F.col("y") * width + F.col("x"))
    return keyed.join(fresh, ["image_id", "v"], "left").select(*PIXEL, F.coalesce("_new", "label").cast("long").alias("label"))


def foreground_edges(raster: DataFrame, width: int, theta: float) -> tuple[DataFrame, DataFrame]:
    """4-neighbour edges, and vertices, of the pixels with value > theta."""
    on = raster.filter(F.col("value") > theta)
    sent = neighbours(on, [(1, 0), (0, 1)])
    own = on.select(*PIXEL)
    u = F.col("y") * width + F.col("x")
    v = (F.col("y") + F.col("dy")) * width + F.col("x") + F.col("dx")
    pairs = sent.join(own, PIXEL, "left_semi").select("image_id", u.alias("u"), v.alias("v"))
    return pairs, on.select("image_id", u.alias("v"))


def binary_components(raster: DataFrame, width: int, theta: float) -> DataFrame:
    """4-connected components of the pixels above theta, -1 for the others, as a label raster."""
    edges, nodes = foreground_edges(raster, width, theta)
    comps = components(edges, nodes)
    keyed = raster.select(*PIXEL, (F.col("y") * width + F.col("x")).alias("v"))
    return keyed.join(comps, ["image_id", "v"], "left").select(*PIXEL, F.coalesce("comp", F.lit(-1)).cast("long").alias("label"))


def flatten_tree(parents: DataFrame) -> DataFrame:
    """image_id, node, root: where following parents leads. parents: image_id, node, parent; a root
    is its own parent or has none. Pointer jumping: as many rounds as the depth has binary digits."""
    at = written(parents.select("image_id", "node", F.coalesce("parent", F.col("node")).alias("root")))
    while True:
        jump = at.select("image_id", F.col("node").alias("root"), F.col("root").alias("_next"))
        after = written(at.join(jump, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("_next", F.col("root")).alias("root"), F.col("root").alias("_old")))
        dropped(at)
        at = after.drop("_old")
        if after.filter("root != _old").isEmpty():
            return at
