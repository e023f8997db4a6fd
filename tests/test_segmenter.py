"""Trained segmentation on small graphs: against plain loops, single runs and known optima."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinflow.operators import components, graph, hierarchy, metrics, segmenter


@pytest.fixture(scope="module")
def scenes(spark):
    """Six 6 x 6 images of two halves: feature a tells the halves apart, b is noise."""
    rng, rows, truth = np.random.default_rng(3), [], []
    for image in range(6):
        label = lambda v: (v % 6) // 3
        truth += [(image, v, label(v)) for v in range(36)]
        for v in range(36):
            for o in [v + 1] * (v % 6 < 5) + [v + 6] * (v < 30):
                rows.append((image, v, o, float((1.0 if label(v) == label(o) else -1.0) + rng.normal(0, 0.3)), float(rng.normal())))
    edges = spark.createDataFrame(rows, "image_id long, u long, v long, a double, b double")
    return components.written(edges), components.written(spark.createDataFrame(truth, "image_id long, v long, label long"))


def test_stump_takes_the_telling_feature(scenes):
    edges, truth = scenes
    model, error = segmenter.train_stump(edges, truth, ["b", "a"])
    assert model.features == ("a",) and error < 0.05
    labels = segmenter.segment(edges, model, truth.select("image_id", "v"))
    assert labels.count() == 6 * 36
    wrong = segmenter.evaluate(segmenter.apply(edges, model), truth).agg(F.avg("rand_error")).first()[0]
    assert wrong == pytest.approx(error)
    counts = metrics.rand_contingency(labels.join(truth, ["image_id", "v"]).withColumnsRenamed({"comp": "seg", "label": "gt"}), ["image_id"])
    assert counts.agg(F.avg("rand_error")).first()[0] == pytest.approx(error)


def test_ranged_cut_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v), int(p)) for k, v, p in zip(rng.integers(0, 3, 4000), np.round(rng.normal(size=4000), 2), rng.integers(0, 2, 4000), strict=True)]
    d = spark.createDataFrame(rows, "k int, v double, p int")
    plain, ranged = (sorted(map(tuple, metrics.best_cut(d, ["k"], "v", F.col("p") == 1, F.lit(1.0), ranges=r).collect())) for r in (None, 16))
    assert ranged == [pytest.approx(x) for x in plain]
    for k, threshold, error, *_ in plain:
        mine = [(v, p) for i, v, p in rows if i == k]
        wrong = lambda t, mine=mine: sum((v >= t) != (p == 1) for v, p in mine) / len(mine)
        assert error == pytest.approx(wrong(threshold)) == pytest.approx(min(wrong(v) for v, _ in mine))


def test_ranged_statistics_are_the_plain_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 1), strict=True))]
    d = spark.createDataFrame(rows, "image_id long, t long, w double")
    for fraction in (0.0, 0.3, 0.75, 1.0):
        for down in (False, True):
            plain, ranged = ({r.image_id: r.threshold for r in components.order_statistic(d, fraction, descending=down, ranges=n).collect()} for n in (None, 16))
            for k in range(3):
                mine = sorted((v for i, _, v in rows if i == k), reverse=down)
                assert plain[k] == ranged[k] == mine[min(int(fraction * len(mine)), len(mine) - 1)]
    plain, ranged = (sorted(map(tuple, metrics.running_best(d, "image_id", ["t"], "w", n).collect())) for n in (None, 8))
    assert plain == ranged


def test_linear_learner_follows_its_gradient(scenes):
    edges, truth = scenes
    model, error, steps = segmenter.train_linear(edges, truth, ["a", "b"], rounds=3, rate=1.0)
    assert error == min(s.error for s in steps) and error <= steps[0].error
    assert abs(model.weights[0]) > abs(model.weights[1])
    # The gradient by hand, at the first step.
    merged = hierarchy.merges(segmenter.raw_scores(edges, steps[0].model), truth).join(edges, ["image_id", "u", "v"]).collect()
    total, image = np.zeros(2), {}
    for r in merged:
        image.setdefault(r.image_id, []).append(r)
    for rows in image.values():
        pairs = sum(r.same + r.diff for r in rows)
        for r in rows:
            sign = 1 if r.same >= r.diff else -1
            if (r.w - steps[0].model.threshold) * sign < 1:
                total += sign * abs(r.same - r.diff) / pairs * np.array([r.a, r.b]) / len(image)
    assert np.allclose(total, steps[0].gradient)
    assert np.allclose(steps[1].model.weights, segmenter.updated(np.array(steps[0].model.weights), total, 1, steps[0].error, "std", 1.0, True))


def test_updates():
    w, g = np.array([3.0, 4.0]), np.array([1.0, 0.0])
    assert np.allclose(segmenter.updated(w, g, 1, 0.5, "std", 0.5, False), [3.5, 4])
    assert np.allclose(segmenter.updated(w, g, 1, 1.0, "l1", 0.5, False), [2, 2])
    assert np.allclose(segmenter.updated(w, g, 1, 1.0, "svm", 1.0, True), np.array([2, 2]) / np.sqrt(8))
    with pytest.raises(ValueError, match="unknown update"):
        segmenter.updated(w, g, 1, 1.0, "x", 1.0, True)


def test_watershed_learner_and_facade(scenes):
    edges, truth = scenes
    _, error, steps = segmenter.train_linear(edges, truth, ["a", "b"], rounds=2, kind=segmenter.WS, update="svm")
    assert len(steps) == 2 and 0 <= error <= 1
    fitted = segmenter.Segmenter(["a", "b"]).fit(edges, truth)
    high = fitted.with_threshold(1e9)
    assert high.transform(edges, truth.select("image_id", "v")).filter("comp != v").isEmpty()
    assert fitted.evaluate(edges, truth).count() == 6
    with pytest.raises(ValueError, match="fit"):
        segmenter.Segmenter(["a"]).evaluate(edges, truth)


def test_trees_and_forests(scenes):
    edges, truth = scenes
    vertices = truth.select("image_id", "v")
    for growth in ("error", "alt"):
        tree = segmenter.SegmentTree(["a", "b"], 2, growth).fit(edges, truth)
        assert tree.nodes and tree.errors[0] < 0.1
        assert tree.transform(edges, vertices).count() == 6 * 36
    forest = segmenter.SegmentForest(["a", "b"], trees=2, depth=1, share=1.0).fit(edges, truth)
    assert forest.transform(edges, vertices).count() == 6 * 36
    assert segmenter.feature_subset(["a", "b", "c"], 2, 4) == segmenter.feature_subset(["a", "b", "c"], 2, 4)


def test_session_learns_from_some_labels(scenes):
    edges, truth = scenes
    session = segmenter.Session(edges, ["a"]).update(truth.filter("image_id < 2")).update(truth.filter("image_id = 1")).train()
    assert session.segmenter.error < 0.1
    assert session.apply(truth.select("image_id", "v")).count() == 6 * 36


def test_sweep_is_that_of_single_runs(scenes):
    edges, truth = scenes
    one = edges.select("image_id", "u", "v", F.col("a").alias("w"))
    two = edges.select("image_id", "u", "v", F.col("b").alias("w"))
    got = {(r.setting, r.offset): r.rand_error for r in segmenter.offset_sweep({"one": one, "two": two}, truth, [0.4, 0.8]).collect()}
    for name, e in (("one", one), ("two", two)):
        for offset in (0.4, 0.8):
            alone = hierarchy.scored_pass(e, truth, offset).totals.agg(F.avg("rand_error")).first()[0]
            assert got[name, offset] == pytest.approx(alone)
    report = segmenter.batch_report(one, truth, 0.0).first()
    assert report.n_images == 6 and report.least_threshold <= report.mean_threshold <= report.greatest_threshold


def test_contracted_rounds_give_the_forest(spark):
    rng = np.random.default_rng(9)
    rows = [(0, int(min(a, b)), int(max(a, b)), float(w)) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300), strict=True) if a != b]
    e = spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "image_id long, u long, v long, w double")
    assert sorted(map(tuple, hierarchy.boruvka(e).collect())) == sorted(map(tuple, hierarchy.mst_edges(e).collect()))


def test_contrast_labels(spark):
    v = spark.createDataFrame([(0, i) for i in range(4)], "image_id long, v long")
    assert sorted((r.v, r.label) for r in graph.contrast_labels(v, 4).collect()) == [(i, i // 4) for i in range(8)]


def test_components_by_image(spark):
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in zip(rng.integers(0, 4, 120), rng.integers(0, 40, 120), rng.integers(0, 40, 120), strict=True)], "image_id long, u int, v int")
    v = spark.createDataFrame([(i, x) for i in range(5) for x in range(42)], "image_id long, v int")
    one, many = (components.components(e, v, by_image=b) for b in (True, False))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.dtypes == many.dtypes


def test_compact_watershed_of_odd_rasters(spark):
    from basinflow.operators import watershed

    rng = np.random.default_rng(2)
    rows = [(0, [1.0]), (1, [1.0, 1.0, 1.0]), (2, rng.normal(size=9).tolist()), (3, rng.integers(0, 3, 30).astype(float).tolist())]
    c = spark.createDataFrame(rows, "image_id long, values array<double>")
    found = components.written(watershed.compact_basins(c, 3, pixels=64))
    labels, basins = watershed.compact_watershed(found)
    edges = components.written(graph.grid_edges_compact(c, 3))
    want, held = watershed.watershed(edges)
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.select("image_id", "v", "label").collect()))
    assert sorted(map(tuple, basins.collect())) == sorted(map(tuple, held.collect()))
    for waterfall in (False, True):
        assert sorted(map(tuple, watershed.compact_super_edges(found, 3, waterfall=waterfall).collect())) == sorted(map(tuple, watershed.super_edges(edges, want, held, waterfall).collect()))


def test_sparse_logistic_meets_its_conditions(spark):
    from basinflow.operators import descent

    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4))
    y = (x @ [2.0, -1.0, 0.0, 0.0] + 0.5 + rng.logistic(size=600)) > 0
    d = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, y boolean").coalesce(1).cache()
    evaluate = descent.logistic_loss_at(d, list("abcd"), F.col("y"))
    l1 = np.array([0.05] * 4 + [0.0])
    w, total = descent.owl_qn(evaluate, np.zeros(5), l1, 60, tolerance=1e-6)
    loss, g = evaluate(w)
    signs = np.where(y, 1.0, -1.0)
    z = np.column_stack([x, np.ones(600)])
    assert loss == pytest.approx(np.log1p(np.exp(-signs * (z @ w))).mean()) and total == pytest.approx(loss + l1 @ np.abs(w))
    # At the least loss a weight's slope is l1 against its sign, and within l1 where the weight is 0.
    for wi, gi, li in zip(w, g, l1, strict=True):
        assert gi == pytest.approx(-li * np.sign(wi), abs=1e-4) if wi else abs(gi) <= li + 1e-6
    assert (w[2:4] == 0).all() and w[0] > 0 > w[1]


def test_filter_learns_what_made_the_targets(spark):
    from basinflow.operators import descent, raster

    rng = np.random.default_rng(1)
    rows = [(0, x, y, float(rng.normal())) for x in range(20) for y in range(20)]
    p = spark.createDataFrame(rows, "image_id long, x int, y int, value double")
    weights = [0.0, 0.5, 0.0, -0.5, 1.0, 0.25, 0.0, 0.0, 0.1]
    target = raster.linear_filter(p, weights, 0.3)
    fit = descent.train_filter(p, target, epochs=2000, method="sgd", rate=0.1)
    assert np.allclose(fit.weights, weights, atol=1e-3) and fit.bias == pytest.approx(0.3, abs=1e-3)
    for method in ("adam", "adadelta"):
        errors = descent.train_filter(p, target, epochs=200, method=method).errors
        assert errors[-1] < errors[0] == pytest.approx(fit.errors[0])
