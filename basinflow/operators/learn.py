"""Statistics and learning: moments are added up on the executors, small matrices solved on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .watershed import IMAGE


def moments(rows: DataFrame, features: list[str], weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """n, sums s_i and products p_i_j (i <= j) of the features, weighted: one row a key."""
    w = F.lit(1.0) if weight is None else weight
    d = len(features)
    aggs = [F.sum(w).alias("n")]
    aggs += [F.sum(w * F.col(f)).alias(f"s_{i}") for i, f in enumerate(features)]
    aggs += [F.sum(w * F.col(features[i]) * F.col(features[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i, d)]
    return rows.groupBy(*(keys or [])).agg(*aggs)


def mean_and_covariance(row, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    n = float(row["n"] or 0)
    mean = np.array([row[f"s_{i}"] or 0.0 for i in range(d)]) / max(n, 1e-300)
    second = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            second[i, j] = second[j, i] = (row[f"p_{i}_{j}"] or 0.0) / max(n, 1e-300)
    return n, mean, second - np.outer(mean, mean)


def dot(features: list[str], weights) -> Column:
    total = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        total = total + F.col(f) * float(w)
    return total


@dataclass(frozen=True)
class Whiten:
    """(x - mean) times the inverse covariance."""

    features: list[str]
    mean: list[float]
    inverse: list[list[float]]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str]) -> Whiten:
        _, mean, cov = mean_and_covariance(moments(rows, features).first(), len(features))
        return cls(features, mean.tolist(), np.linalg.pinv(cov).tolist())

    def apply(self, rows: DataFrame, bias: bool = False) -> DataFrame:
        shifted = [F.col(f) - m for f, m in zip(self.features, self.mean, strict=True)]
        out = {}
        for i, f in enumerate(self.features):
            total = F.lit(0.0)
            for j, x in enumerate(shifted):
                total = total + x * self.inverse[j][i]
            out[f"white_{f}"] = total
        return rows.withColumns(out | ({"bias": F.lit(1.0)} if bias else {}))


@dataclass(frozen=True)
class RangeNormalise:
    """To [-1, 1] by least and greatest value; features without range become 0."""

    features: list[str]
    low: list[float]
    high: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str]) -> RangeNormalise:
        r = rows.agg(*[F.min(f).cast("double").alias(f"l{i}") for i, f in enumerate(features)], *[F.max(f).cast("double").alias(f"h{i}") for i, f in enumerate(features)]).first()
        return cls(features, [r[f"l{i}"] for i in range(len(features))], [r[f"h{i}"] for i in range(len(features))])

    def apply(self, rows: DataFrame) -> DataFrame:
        out = {}
        for f, low, high in zip(self.features, self.low, self.high, strict=True):
            out[f] = F.lit(0.0) if low is None or high - low <= 1e-12 else (F.col(f) - low) / (high - low) * 2 - 1
        return rows.withColumns(out)

    def in_range(self, rows: DataFrame) -> Column:
        ok = F.lit(True)
        for f, low, high in zip(self.features, self.low, self.high, strict=True):
            ok = ok & F.col(f).between(low, high)
        return ok


def save_model(model, spark, path: str) -> None:
    """A model's parameters as one JSON row, in any store that Spark writes to."""
    spark.createDataFrame([(type(model).__name__, json.dumps(asdict(model)))], "kind string, model string").coalesce(1).write.mode("overwrite").json(path)


def load_model(spark, path: str):
    row = spark.read.schema("kind string, model string").json(path).first()
    kinds = {c.__name__: c for c in (Whiten, RangeNormalise, LinearModel, Parameters)}
    return kinds[row["kind"]](**json.loads(row["model"]))


@dataclass(frozen=True)
class Parameters:
    """Of the segmentation: what is filtered before and after the gradient, scale, threshold."""

    scale: float = 1.0
    pre_type: int = 0
    pre_size: int = 0
    grad_type: int = 1
    post_type: int = 0
    post_size: int = 0
    threshold: float = 0.5
    absolute: bool = False
    waterfall: bool = False


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    weights: list[float]
    threshold: float = 0.0

    @classmethod
    def start(cls, features: list[str], kind: str = "uniform", seed: int = 0) -> LinearModel:
        d = len(features)
        w = {"uniform": np.full(d, 1 / d), "zero": np.zeros(d)}.get(kind)
        return cls(features, (np.random.default_rng(seed).uniform(-1, 1, d) if w is None else w).tolist())

    def normalised(self) -> LinearModel:
        n = float(np.linalg.norm(self.weights)) or 1.0
        return LinearModel(self.features, [w / n for w in self.weights], self.threshold / n)

    def apply(self, rows: DataFrame, hard: bool = False) -> DataFrame:
        score = dot(self.features, self.weights) - self.threshold
        return rows.withColumn("score", F.when(score >= 0, 1.0).otherwise(-1.0) if hard else score)


def fisher(rows: DataFrame, features: list[str], positive: Column, weight: Column | None = None) -> LinearModel:
    """Weights from the pooled scatter and the two weighted means; the threshold is midway."""
    stats = {r["_y"]: mean_and_covariance(r, len(features)) for r in moments(rows.withColumn("_y", positive), features, weight, ["_y"]).collect()}
    (na, ma, ca), (nb, mb, cb) = stats[True], stats[False]
    w = np.linalg.lstsq((na * ca + nb * cb) / (na + nb), ma - mb, rcond=None)[0]
    return LinearModel(features, w.tolist(), float(w @ (ma + mb) / 2))


def change_detector(rows: DataFrame, x: list[str], y: list[str]) -> np.ndarray:
    """Q of the anomalous-change score z'Qz: the inverse of the joint scatter less those of both parts."""
    n, _, cov = mean_and_covariance(moments(rows, x + y).first(), len(x) + len(y))
    scatter, d = cov * n, len(x)
    apart = np.zeros_like(scatter)
    apart[:d, :d], apart[d:, d:] = np.linalg.pinv(scatter[:d, :d]), np.linalg.pinv(scatter[d:, d:])
    return np.linalg.pinv(scatter) - apart


def quadratic_score(features: list[str], q: np.ndarray, mean: np.ndarray | None = None) -> Column:
    z = [F.col(f) - (0.0 if mean is None else float(mean[i])) for i, f in enumerate(features)]
    total = F.lit(0.0)
    for i in range(len(z)):
        for j in range(len(z)):
            total = total + z[i] * z[j] * float(q[i][j])
    return total


def logistic(rows: DataFrame, features: list[str], positive: Column, weight: Column | None = None, penalty: float = 1.0, rounds: int = 25) -> LinearModel:
    """L2-penalised logistic regression by Newton steps; each step is one aggregation."""
    d = len(features) + 1
    names = [*features, "_one"]
    base = rows.select(*features, F.lit(1.0).alias("_one"), F.when(positive, 1.0).otherwise(0.0).alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    beta = np.zeros(d)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot(names, beta)))))
        scored = base.withColumn("_p", p)
        curve = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        aggs = [F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * F.col(f)).alias(f"g{i}") for i, f in enumerate(names)]
        aggs += [F.sum(curve * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        r = scored.agg(*aggs).first()
        g = np.array([r[f"g{i}"] for i in range(d)]) - beta / penalty
        h = np.eye(d) / penalty
        for i in range(d):
            for j in range(i, d):
                h[i, j] += r[f"h{i}_{j}"]
                h[j, i] = h[i, j]
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return LinearModel(features, beta[:-1].tolist(), float(-beta[-1]))


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 50) -> np.ndarray:
    """Centres by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=1e-4).fit(rows.select(array_to_vector(F.col(vector)).alias("features")))
    return np.array(model.clusterCenters())


def kmeans_maps(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Adds distances to all centres (all_map), the nearest's number and distance (one_map, distance)
    and how much nearer than the mean each centre is, at least 0 (tri_map)."""
    distances = F.array(*[F.sqrt(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for c in centres])
    rows = rows.withColumn("all_map", distances)
    low = F.array_min("all_map")
    mean = F.aggregate("all_map", F.lit(0.0), lambda s, x: s + x) / len(centres)
    return rows.withColumns({"distance": low, "one_map": F.array_position("all_map", low).cast("int") - 1, "tri_map": F.transform("all_map", lambda x: F.greatest(F.lit(0.0), mean - x))})


def slic(pixels: DataFrame, step: int, width: int, compactness: float, rounds: int = 5) -> DataFrame:
    """Super-pixels: k-means of place and value from a grid of seeds; a pixel looks only at seeds of
    its own grid cell and the eight around it. pixels: image_id, x, y, value."""
    from .components import written

    across = -(-width // step)
    home = (F.floor(F.col("y") / step) * across + F.floor(F.col("x") / step)).cast("int")
    base = pixels.withColumn("_home", home)
    seeds = base.groupBy(IMAGE, F.col("_home").alias("label")).agg(F.avg("x").alias("_sx"), F.avg("y").alias("_sy"), F.avg("value").alias("_sv"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cx, cy = F.floor(F.col("x") / step) + F.col("_o.i"), F.floor(F.col("y") / step) + F.col("_o.j")
    looks = pixels.select(IMAGE, "x", "y", "value", F.explode(near).alias("_o")).filter((cx >= 0) & (cx < across) & (cy >= 0)).select(IMAGE, "x", "y", "value", (cy * across + cx).cast("int").alias("label"))
    for _ in range(rounds):
        d = F.pow(F.col("value") - F.col("_sv"), 2) + compactness**2 / step**2 * (F.pow(F.col("x") - F.col("_sx"), 2) + F.pow(F.col("y") - F.col("_sy"), 2))
        best = looks.join(seeds, [IMAGE, "label"]).groupBy(IMAGE, "x", "y", "value").agg(F.min(F.struct(d.alias("d"), "label")).alias("b"))
        labels = written(best.select(IMAGE, "x", "y", "value", F.col("b.label").alias("label")))
        seeds = labels.groupBy(IMAGE, "label").agg(F.avg("x").alias("_sx"), F.avg("y").alias("_sy"), F.avg("value").alias("_sv"))
    return labels.select(IMAGE, "x", "y", "label")


def stump_search(edges: DataFrame, features: list[str]) -> DataFrame:
    """feature, threshold, error ...: the best cut of each edge feature, all features in one pass."""
    from .metrics import best_cut

    long = edges.select("gt", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_s"))
    return best_cut(long.select("gt", "_s.feature", "_s.value"), ["feature"], "value", F.col("gt") == 1, F.lit(1.0), ranges=64)


def parameter_sweep(curves: DataFrame, parameters: list[float], evaluate, name: str = "offset") -> DataFrame:
    """Rows of evaluate(curves, parameter) for each parameter, with the parameter."""
    out = None
    for p in parameters:
        one = evaluate(curves, p).withColumn(name, F.lit(float(p)))
        out = one if out is None else out.unionByName(one)
    return out


def forest_votes(edges: DataFrame, labelings: DataFrame) -> DataFrame:
    """image_id, u, v, votes: how many trees give an edge's ends different labels.

    labelings: tree, image_id, v, label. Each tree's labels of both ends meet in one aggregation.
    """
    ends = edges.select(IMAGE, "u", F.col("v").alias("_v"), F.explode(F.array(F.col("u"), F.col("v"))).alias("v"))
    rows = ends.join(labelings, [IMAGE, "v"]).groupBy(IMAGE, "u", "_v", "tree").agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    return rows.groupBy(IMAGE, "u", F.col("_v").alias("v")).agg(F.count_if(F.col("_a") != F.col("_b")).alias("votes"), F.count(F.lit(1)).alias("n_trees"))


def assignment(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Optimal assignment of rows to columns by key: costs (keys, row, col, cost) to the chosen cells.

    Shortest augmenting paths with potentials, one small matrix per task; missing cells can't be chosen
    unless nothing else is left.
    """

    def run(table: pa.Table) -> pa.Table:
        rows, cols = sorted(set(table.column("row").to_pylist())), sorted(set(table.column("col").to_pylist()))
        wide = len(rows) <= len(cols)
        n, m = (len(rows), len(cols)) if wide else (len(cols), len(rows))
        cost = np.full((n, m), 1e15)
        ri, ci = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(cols)}
        for r, c, x in zip(*(table.column(k).to_pylist() for k in ("row", "col", "cost")), strict=True):
            cost[(ri[r], ci[c]) if wide else (ci[c], ri[r])] = x
        u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
        for i in range(n):
            slack, done, came = np.full(m, np.inf), np.zeros(m, bool), np.full(m, -1)
            at, j = i, -1
            while True:
                free = ~done
                seen = cost[at] - u[at] - v
                better = free & (seen < slack)
                slack[better], came[better] = seen[better], j
                k = int(np.argmin(np.where(free, slack, np.inf)))
                delta = slack[k]
                u[i] += delta
                for q in np.flatnonzero(done):
                    u[owner[q]] += delta
                    v[q] -= delta
                slack[free] -= delta
                done[k], j = True, k
                if owner[k] < 0:
                    break
                at = owner[k]
            while j >= 0:
                prev = came[j]
                owner[j] = i if prev < 0 else owner[prev]
                j = prev
        pairs = [((rows[owner[j]], cols[j]) if wide else (rows[j], cols[owner[j]])) + (float(cost[owner[j], j]),) for j in range(m) if owner[j] >= 0]
        pairs = sorted(p for p in pairs if p[2] < 1e15)
        head = {k: table.column(k)[:1].combine_chunks().take(pa.array([0] * len(pairs))) for k in keys}
        return pa.table(head | {"row": pa.array([p[0] for p in pairs], pa.int64()), "col": pa.array([p[1] for p in pairs], pa.int64()), "cost": pa.array([p[2] for p in pairs], pa.float64())})

    kinds = ", ".join(f"{k} {costs.schema[k].dataType.simpleString()}" for k in keys)
    return costs.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("cost").cast("double").alias("cost")).groupBy(*keys).applyInArrow(run, f"{kinds}, row long, col long, cost double")


def discrete_draw(rows: DataFrame, weights: list[float], seed: int) -> DataFrame:
    """Adds draw: a seeded choice among the weights, from the row's id column."""
    total, at = sum(weights), 0.0
    x = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)
    choice = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        at = sum(weights[: i + 1]) / total
        choice = F.when(x < at, i).otherwise(choice)
    return rows.withColumn("draw", choice)
