"""Merge sequences against brute force on small random graphs."""

import itertools

import pytest

from basinflow.operators import hierarchy, metrics, watershed
from basinflow.sources import generators


@pytest.fixture(scope="module")
def graphs(spark):
    e = generators.random_graph(spark, 4, images=6, seed=5)
    labels = e.selectExpr("image_id", "explode(array(u, v)) as v").distinct().selectExpr("image_id", "v", "v % 3 as label")
    return e.cache(), labels.cache()


def test_boruvka_is_the_merge_forest(graphs):
    e, _ = graphs
    assert set(map(tuple, hierarchy.boruvka(e).select("image_id", "u", "v").collect())) == set(map(tuple, hierarchy.mst_edges(e).select("image_id", "u", "v").collect()))


def test_merge_counts_give_the_exhaustive_rand_error(graphs):
    e, labels = graphs
    merges = hierarchy.merges(e, labels)
    totals = metrics.rand_at_threshold(merges, 0.0 * merges["w"]).collect()
    edges, truth = e.collect(), {(r.image_id, r.v): r.label for r in labels.collect()}
    for t in totals:
        home = {v: v for i, v in truth if i == t.image_id}

        def root(x, home=home):
            while home[x] != x:
                x = home[x]
            return x

        for r in edges:
            if r.image_id == t.image_id and r.w >= 0:
                home[root(r.u)] = root(r.v)
        pairs = list(itertools.combinations(home, 2))
        wrong = sum((root(a) == root(b)) != (truth[t.image_id, a] == truth[t.image_id, b]) for a, b in pairs)
        assert t.rand_error == pytest.approx(wrong / len(pairs))


def test_forest_of_best_edges_is_the_positive_cut(graphs):
    e, _ = graphs
    cut = watershed.minmax_cut(e).filter("cut > 0").select("image_id", "u", "v")
    assert set(map(tuple, cut.collect())) == set(map(tuple, watershed.best_forest(e).select("image_id", "u", "v").collect()))


def test_scored_pass_threshold_is_that_of_the_curve(graphs):
    e, labels = graphs
    found = hierarchy.scored_pass(e, labels).totals.collect()
    lab, bas = watershed.watershed(e)
    regions = watershed.super_edges(e, lab, bas).selectExpr("image_id", "b1 as u", "b2 as v", "depth as w").cache()
    theta = hierarchy.offset_threshold(regions, 0.75)
    low = hierarchy.min_energy_threshold(hierarchy.energy_curve(regions, theta)).join(theta, "image_id")
    want = {r.image_id: (r.threshold + r.theta, r.energy) for r in low.collect()}
    for r in found:
        if r.n_basins > 1:
            assert (r.threshold, r.energy) == (pytest.approx(want[r.image_id][0]), pytest.approx(want[r.image_id][1]))


def test_small_optimum_of_the_worked_example(spark):
    e = generators.affinity_graph(spark, {(0, 1): 0.5, (0, 2): 0.1, (1, 2): 0.4, (2, 3): -0.3, (3, 4): 0.6, (4, 5): 0.3, (3, 5): 0.2})
    for found in (hierarchy.small_optimum(e), hierarchy.greedy_clusters(e)):
        groups = {}
        for r in found.collect():
            groups.setdefault(r.cluster, set()).add(r.v)
        assert sorted(groups.values(), key=min) == [{0, 1, 2}, {3, 4, 5}]


def test_partitions_are_bell_numbers():
    assert [len(list(hierarchy.partitions(n))) for n in range(7)] == [1, 1, 2, 5, 15, 52, 203]
