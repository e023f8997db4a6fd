"""Trained segmentation: edge classifiers, learners, trees and forests over edge tables.

Edges carry feature columns beside image_id, u, v; truth is image_id, v, label. A model scores edges,
merges those at or over its threshold, and components are the labels. Learners keep a handful of
numbers on the driver; every pass over edges is distributed by image.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy, loss, metrics
from .components import components, written
from .watershed import IMAGE, minmax_cut

CC, WS = "cc", "ws"


@dataclass(frozen=True)
class EdgeModel:
    """A linear score of features, by itself (cc) or as its min-max cut (ws), less a threshold."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    threshold: float = 0.0
    kind: str = CC

    def raw(self) -> Column:
        score = F.lit(0.0)
        for name, weight in zip(self.features, self.weights, strict=True):
            score = score + F.col(name) * F.lit(float(weight))
        return score


def raw_scores(edges: DataFrame, model: EdgeModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, u, v, w: the score before the threshold; lone edges of a cut count as the score itself."""
    rows = edges.select(IMAGE, "u", "v", model.raw().alias("w"), *keep)
    if model.kind == CC:
        return rows
    if model.kind != WS:
        raise ValueError(f"unknown segmentation {model.kind}")
    cut = minmax_cut(rows.select(IMAGE, "u", "v", "w")).select(IMAGE, "u", "v", "w", "cut")
    cut = cut.select(IMAGE, "u", "v", F.when(F.col("cut") == float("inf"), F.col("w")).otherwise(F.col("cut")).alias("w"))
    return cut if not keep else cut.join(rows.drop("w"), [IMAGE, "u", "v"])


def apply(edges: DataFrame, model: EdgeModel) -> DataFrame:
    """image_id, u, v, w: scores less the threshold; edges at 0 or over it merge."""
    return raw_scores(edges, model).withColumn("w", F.col("w") - F.lit(float(model.threshold)))


def segment(edges: DataFrame, model: EdgeModel, vertices: DataFrame) -> DataFrame:
    """image_id, v, comp: the components of the edges that the model merges."""
    return components(apply(edges, model).filter("w >= 0"), vertices)


def evaluate(scored: DataFrame, truth: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rand error by image when edges with w at the threshold or over it merge, from the merges' pair counts."""
    return metrics.rand_at_threshold(hierarchy.merges(scored, truth), F.lit(float(threshold)))


def pooled_cut(merge_table: DataFrame, keys: list[str] | None = None, weight_pos: float = 1.0, weight_neg: float = 1.0) -> DataFrame:
    """threshold, error, detection, false_alarm (by keys): one threshold for the merges of all images,
    at which the weighted pairs that are wrong are fewest."""
    keys = keys or ["_pool"]
    rows = merge_table if "_pool" not in keys else merge_table.withColumn("_pool", F.lit(0))
    return metrics.best_cut_of(rows, keys, "w", F.col("same") * F.lit(weight_pos), F.col("diff") * F.lit(weight_neg), ranges=64).drop("_pool")


def _exploded(edges: DataFrame, truth: DataFrame, variants: list[EdgeModel]) -> tuple[DataFrame, DataFrame]:
    """Edges scored by every variant, and the truth, with `variant` beside the image: the pass over merges
    is planned once for all. The image's number is shifted to keep variants of an image apart."""
    n, scored = len(variants), None
    for i, model in enumerate(variants):
        one = raw_scores(edges, model).withColumn(IMAGE, F.col(IMAGE) * n + i)
        scored = one if scored is None else scored.unionByName(one)
    spread = truth.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"), IMAGE, "v", "label")
    return scored, spread.select((F.col(IMAGE) * n + F.col("_i")).alias(IMAGE), "v", "label")


def variant_cuts(edges: DataFrame, truth: DataFrame, variants: list[EdgeModel], weight_pos: float = 1.0, weight_neg: float = 1.0) -> DataFrame:
    """variant (its place), threshold, error, detection, false_alarm: the best threshold of each variant over all images."""
    scored, spread = _exploded(edges, truth, variants)
    rows = hierarchy.merges(scored, spread).withColumn("variant", F.pmod(F.col(IMAGE), F.lit(len(variants))).cast("int"))
    return pooled_cut(rows, ["variant"], weight_pos, weight_neg)


def train_stump(edges: DataFrame, truth: DataFrame, features: list[str], kinds: tuple[str, ...] = (CC, WS), weight_pos: float = 1.0, weight_neg: float = 1.0) -> tuple[EdgeModel, float]:
    """The one feature, way of segmenting and threshold of least error, first of equals; and that error."""
    variants = [EdgeModel((f,), (1.0,), kind=kind) for f in features for kind in kinds]
    best = min(variant_cuts(edges, truth, variants, weight_pos, weight_neg).collect(), key=lambda r: (r["error"], r["variant"]))
    return replace(variants[best["variant"]], threshold=best["threshold"]), best["error"]


@dataclass(frozen=True)
class Step:
    """An iteration of a learner."""

    model: EdgeModel
    error: float
    gradient: tuple[float, ...]


def updated(weights: np.ndarray, gradient: np.ndarray, step: int, error: float, update: str, rate: float, normalise: bool) -> np.ndarray:
    """The next weights. svm: the step shrinks with 1 / (rate n) and weights with 1 - 1 / n, inside a
    ball of radius 1 / sqrt(rate); l1: error / (error + 1) of the step and the rest of the weights;
    std: a constant rate. The others are scaled to length 1 when normalised."""
    if update == "svm":
        out = weights * (1 - 1 / (step + 1)) + gradient / (rate * (step + 1))
    elif update == "l1":
        out = (weights + gradient * error) / (error + 1)
    elif update == "std":
        out = weights + gradient * rate
    else:
        raise ValueError(f"unknown update {update}")
    size = float(np.linalg.norm(out))
    if not normalise or size == 0:
        return out
    return out * min(1.0, 1 / np.sqrt(rate) / size) if update == "svm" else out / size


def train_linear(
    edges: DataFrame,
    truth: DataFrame,
    features: list[str],
    rounds: int = 10,
    rate: float = 0.1,
    update: str = "std",
    normalise: bool = True,
    kind: str = CC,
    start: list[float] | None = None,
) -> tuple[EdgeModel, float, list[Step]]:
    """Sub-gradient descent on the hinge of the clustering, or of the min-max cut; the best model, its
    error and all steps.

    Each round scores the edges, finds the best threshold over all images' merges, and adds up the
    gradient of the violated merges (cc) or edges (ws). What reaches the driver is a threshold, an
    error and one number a feature.
    """
    edges = written(edges.select(IMAGE, "u", "v", *features))
    table = edges.select(IMAGE, "u", "v", F.array(*[F.col(f).cast("double") for f in features]).alias("f"))
    weights = np.array(start if start is not None else np.ones(len(features)) / np.sqrt(len(features)), float)
    steps: list[Step] = []
    for i in range(rounds):
        model = EdgeModel(tuple(features), tuple(weights.tolist()), kind=kind)
        merged = written(hierarchy.merges(raw_scores(edges, model), truth))
        best = pooled_cut(merged).first()
        if best is None:
            raise ValueError("no edges to learn from")
        t = best["threshold"]
        if kind == CC:
            parts = loss.feature_gradient(merged.withColumn("w", F.col("w") - F.lit(t)), table)
        else:
            from .graph import edge_gt_labels
            from .watershed import minmax_edges

            scored = edges.select(IMAGE, "u", "v", model.raw().alias("w"))
            cut = minmax_edges(scored).withColumn("cut", F.col("cut") - F.lit(t))
            sides = edge_gt_labels(scored.select(IMAGE, "u", "v"), truth).select(IMAGE, "u", "v", F.col("gt").cast("double").alias("label"), F.lit(1.0).alias("weight"))
            parts = loss.cut_gradient(cut, sides, table)
        # A loss's gradient points uphill; the step goes the other way.
        sums = {r["component"]: r["g"] for r in parts.groupBy("component").agg(F.avg("gradient").alias("g")).collect()}
        gradient = -np.array([sums.get(j, 0.0) for j in range(len(features))])
        steps.append(Step(replace(model, threshold=t), best["error"], tuple(gradient.tolist())))
        weights = updated(weights, gradient, i + 1, best["error"], update, rate, normalise)
    least = min(steps, key=lambda s: s.error)
    return least.model, least.error, steps


class Segmenter:
    """Fits a stump or a linear model, labels vertices, and scores labels against a truth."""

    def __init__(self, features: list[str], learner: str = "stump", **options):
        if learner not in ("stump", "linear"):
            raise ValueError(f"unknown learner {learner}")
        self.features, self.learner, self.options = list(features), learner, options
        self.model: EdgeModel | None = None
        self.error: float | None = None

    def fit(self, edges: DataFrame, truth: DataFrame) -> Segmenter:
        train = train_stump if self.learner == "stump" else train_linear
        self.model, self.error, *_ = train(edges, truth, self.features, **self.options)
        return self

    def _model(self) -> EdgeModel:
        if self.model is None:
            raise ValueError("fit the segmenter first")
        return self.model

    def with_threshold(self, threshold: float) -> Segmenter:
        """The same model at another threshold."""
        other = Segmenter(self.features, self.learner, **self.options)
        other.model, other.error = replace(self._model(), threshold=threshold), None
        return other

    def transform(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        return segment(edges, self._model(), vertices)

    def evaluate(self, edges: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluate(apply(edges, self._model()), truth)


@dataclass
class SegmentTree:
    """A chain of stumps. A merge node joins clusters of the labels so far, a split node parts them.

    All nodes work on the vertices of the first graph: edges inside a cluster, or between clusters,
    are fixed, and those that a node decides have the mean features of their pair of clusters (merge)
    or their own (split). So pair counts need no contraction.
    """

    features: list[str]
    depth: int = 3
    growth: str = "merge"
    nodes: list[tuple[str, EdgeModel]] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def _decided(self, edges: DataFrame, labels: DataFrame | None, kind: str) -> tuple[DataFrame, DataFrame | None]:
        """The edges that a node decides, and those that are merged whatever it does."""
        if labels is None:
            return edges, None
        a = labels.select(IMAGE, F.col("v").alias("u"), F.col("comp").alias("_a"))
        b = labels.select(IMAGE, "v", F.col("comp").alias("_b"))
        rows = written(edges.join(a, [IMAGE, "u"]).join(b, [IMAGE, "v"]))
        if kind == "split":
            return rows.filter("_a = _b").drop("_a", "_b"), None
        pair = [F.least("_a", "_b").alias("_x"), F.greatest("_a", "_b").alias("_y")]
        across = rows.filter("_a != _b")
        means = across.groupBy(IMAGE, *pair).agg(*[F.avg(f).alias(f) for f in self.features])
        across = across.select(IMAGE, "u", "v", *pair).join(means, [IMAGE, "_x", "_y"]).drop("_x", "_y")
        return across, rows.filter("_a = _b").select(IMAGE, "u", "v")

    def _labels(self, decided: DataFrame, fixed: DataFrame | None, model: EdgeModel, vertices: DataFrame) -> DataFrame:
        kept = apply(decided, model).filter("w >= 0").select(IMAGE, "u", "v")
        return written(components(kept if fixed is None else kept.union(fixed), vertices))

    def _truth(self, edges: DataFrame, fixed: DataFrame | None, truth: DataFrame, variants: list[EdgeModel]) -> DataFrame:
        """The merges of each variant, those of fixed edges first and out of its account."""
        scored, spread = _exploded(edges, truth, variants)
        if fixed is not None:
            n = len(variants)
            sure = fixed.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"), IMAGE, "u", "v")
            scored = scored.unionByName(sure.select((F.col(IMAGE) * n + F.col("_i")).alias(IMAGE), "u", "v", F.lit(float("inf")).alias("w")))
        return hierarchy.merges(scored, spread).withColumn("variant", F.pmod(F.col(IMAGE), F.lit(len(variants))).cast("int"))

    def fit(self, edges: DataFrame, truth: DataFrame) -> SegmentTree:
        """Grows nodes while the error falls and more than one cluster is left. growth: merge, split,
        error (merge where more pairs are wrongly apart than together) or alt (split, merge in turn)."""
        if self.growth not in ("merge", "split", "error", "alt"):
            raise ValueError(f"unknown growth {self.growth}")
        vertices, labels, wrong = truth.select(IMAGE, "v"), None, (0.0, 0.0)
        self.nodes, self.errors = [], []
        total = _pair_total(truth)
        for i in range(self.depth):
            kind = "merge" if i == 0 or self.growth == "merge" else "split" if self.growth == "split" or self.growth == "alt" and i % 2 else "merge"
            if i and self.growth == "error":
                kind = "merge" if wrong[0] >= wrong[1] else "split"
            decided, fixed = self._decided(edges, labels, kind)
            variants = [EdgeModel((f,), (1.0,), kind=k) for f in self.features for k in (CC, WS)]
            merged = written(self._truth(decided, fixed, truth, variants))
            # Merges of fixed edges lie above every threshold.
            cuts = pooled_cut(merged.filter(F.col("w") < float("inf")), ["variant"]).collect()
            if not cuts:
                break
            best = min(cuts, key=lambda r: (r["error"], r["variant"]))
            model = replace(variants[best["variant"]], threshold=best["threshold"])
            at = self._labels(decided, fixed, model, vertices)
            counts = _pairs_wrong(at, truth)
            error = sum(counts) / max(total, 1)
            if self.errors and error >= self.errors[-1] and not (self.growth == "alt" and i % 2):
                break
            self.nodes.append((kind, model))
            self.errors.append(error)
            labels, wrong = at, counts
            if labels.groupBy(IMAGE).agg(F.countDistinct("comp").alias("n")).filter("n > 1").isEmpty():
                break
        return self

    def transform(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        """image_id, v, comp after the last node."""
        labels, vertices = None, vertices.select(IMAGE, "v")
        for kind, model in self.nodes:
            decided, fixed = self._decided(edges, labels, kind)
            labels = self._labels(decided, fixed, model, vertices)
        if labels is None:
            raise ValueError("fit the tree first")
        return labels


def _joined(labels: DataFrame, truth: DataFrame) -> DataFrame:
    return labels.join(truth.select(IMAGE, "v", F.col("label").alias("gt")), [IMAGE, "v"]).withColumnRenamed("comp", "seg")


def _pair_total(truth: DataFrame) -> float:
    n = truth.groupBy(IMAGE).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0


def _pairs_wrong(labels: DataFrame, truth: DataFrame) -> tuple[float, float]:
    """Pairs wrongly apart and wrongly together, over all images."""
    r = metrics.rand_contingency(_joined(labels, truth), [IMAGE]).agg(F.sum(F.col("same_gt") - F.col("both")).alias("apart"), F.sum(F.col("same_seg") - F.col("both")).alias("together")).first()
    return r["apart"] or 0.0, r["together"] or 0.0


@dataclass
class SegmentForest:
    """Trees on seeded samples of images and features; an edge's vote is how many trees part its ends."""

    features: list[str]
    trees: int = 3
    depth: int = 2
    share: float = 0.7
    seed: int = 1
    grown: list[SegmentTree] = field(default_factory=list)
    threshold: float = 0.0

    def fit(self, edges: DataFrame, truth: DataFrame) -> SegmentForest:
        self.grown = []
        for i in range(self.trees):
            drawn = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), IMAGE), F.lit(1 << 20)) < F.lit(int(self.share * (1 << 20)))
            chosen = feature_subset(self.features, max(1, round(len(self.features) * self.share)), self.seed + i)
            self.grown.append(SegmentTree(chosen, self.depth).fit(edges.filter(drawn), truth.filter(drawn)))
        # Votes less than the threshold merge: the stump works on their negative.
        best = pooled_cut(hierarchy.merges(self._votes(edges, truth.select(IMAGE, "v")), truth)).first()
        self.threshold = best["threshold"]
        return self

    def votes(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        from .learn import forest_votes

        labels = None
        for i, tree in enumerate(self.grown):
            one = tree.transform(edges, vertices).select(F.lit(i).alias("tree"), IMAGE, "v", F.col("comp").alias("label"))
            labels = one if labels is None else labels.unionByName(one)
        if labels is None:
            raise ValueError("fit the forest first")
        return forest_votes(edges.select(IMAGE, "u", "v"), labels)

    def _votes(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        return self.votes(edges, vertices).select(IMAGE, "u", "v", (-F.col("votes")).cast("double").alias("w"))

    def transform(self, edges: DataFrame, vertices: DataFrame) -> DataFrame:
        return components(self._votes(edges, vertices).filter(F.col("w") >= F.lit(self.threshold)), vertices.select(IMAGE, "v"))


def feature_subset(features: list[str], n: int, seed: int) -> list[str]:
    """n of the features, drawn by seed, in their order."""
    chosen = set(np.random.default_rng(seed).permutation(len(features))[:n].tolist())
    return [f for i, f in enumerate(features) if i in chosen]


def image_thresholds(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, threshold, error, n_merges: every image's own best threshold."""
    return metrics.rand_best_threshold(hierarchy.merges(scored, truth))


def batch_report(scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """One row over a batch of images: mean, least and greatest of their own best thresholds and errors,
    and the mean error at the one threshold given."""
    merged = written(hierarchy.merges(scored, truth))
    own = metrics.rand_best_threshold(merged).select(IMAGE, "threshold", "error")
    at = metrics.rand_at_threshold(merged, F.lit(float(threshold))).select(IMAGE, "rand_error")
    rows = own.join(at, IMAGE)
    spans = [f(c).alias(f"{n}_{c}") for c in ("threshold", "error") for n, f in (("mean", F.avg), ("least", F.min), ("greatest", F.max))]
    return rows.agg(F.count(F.lit(1)).alias("n_images"), *spans, F.avg("rand_error").alias("mean_error_at"))


def baseline(edges: DataFrame, truth: DataFrame, feature: str) -> tuple[EdgeModel, float]:
    """The stump on one raw feature, without a watershed."""
    return train_stump(edges, truth, [feature], (CC,))


def offset_sweep(edges_by_setting: dict[str, DataFrame], truth: DataFrame, offsets: list[float]) -> DataFrame:
    """setting, offset, rand_error (mean over images), n_images: the hierarchy at every offset over the
    edges of every setting (a radius, a filter). Settings and offsets lie beside the image, so one
    pass is planned for the whole grid; the offset goes to the image's task with its edges."""
    names, n = list(edges_by_setting), len(edges_by_setting) * len(offsets)
    rows = None
    for i, name in enumerate(names):
        one = edges_by_setting[name].select((F.col(IMAGE) * n + i * len(offsets)).alias("_at"), "u", "v", "w", F.explode(F.sequence(F.lit(0), F.lit(len(offsets) - 1))).alias("_o"))
        one = one.select((F.col("_at") + F.col("_o")).alias(IMAGE), "u", "v", "w")
        rows = one if rows is None else rows.unionByName(one)
    spread = truth.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"), IMAGE, "v", "label")
    spread = spread.select((F.col(IMAGE) * n + F.col("_i")).alias(IMAGE), "v", "label")
    totals = hierarchy.scored_pass(rows, spread, offsets).totals
    place = F.pmod(F.col(IMAGE), F.lit(n))
    setting = F.element_at(F.array(*map(F.lit, names)), F.floor(place / len(offsets)).cast("int") + 1)
    offset = F.element_at(F.array(*[F.lit(float(o)) for o in offsets]), F.pmod(place, F.lit(len(offsets))).cast("int") + 1)
    return totals.groupBy(setting.alias("setting"), offset.alias("offset")).agg(F.avg("rand_error").alias("rand_error"), F.count(F.lit(1)).alias("n_images"))


class Session:
    """Interactive retraining: labels given so far, the model they train, and the labels it gives."""

    def __init__(self, edges: DataFrame, features: list[str], learner: str = "stump", **options):
        self.edges = edges
        self.segmenter = Segmenter(features, learner, **options)
        self.truth: DataFrame | None = None

    def update(self, labels: DataFrame) -> Session:
        """Adds labels (image_id, v, label); a vertex's later label takes the place of an earlier one."""
        fresh = labels.select(IMAGE, "v", "label")
        old = None if self.truth is None else self.truth.join(fresh.select(IMAGE, "v"), [IMAGE, "v"], "left_anti")
        self.truth = written(fresh if old is None else old.unionByName(fresh))
        return self

    def train(self) -> Session:
        """Trains on the edges between labelled vertices."""
        if self.truth is None:
            raise ValueError("give labels first")
        known = self.truth.select(IMAGE, "v")
        inside = self.edges.join(known, [IMAGE, "v"], "left_semi").join(known.withColumnRenamed("v", "u"), [IMAGE, "u"], "left_semi")
        self.segmenter.fit(inside, self.truth)
        return self

    def apply(self, vertices: DataFrame) -> DataFrame:
        return self.segmenter.transform(self.edges, vertices)
