"""Registered queries against their DuckDB counterparts on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from basinflow.plans import catalog

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all.
NAMES = ["raster_explode", "minmax_scale", "stack_bands", "sobel", "radius_edges", "rag_from_labels", "binary_cc", "fix_zero_labels", "minmax_cut", "watershed_labels", "super_graph_depth", "waterfall_level2", "merge_rank", "cc_min_energy_threshold", "hierarchical_labels", "scored_rand", "rand_exhaustive", "transfer_counts", "stump_threshold", "error_loss", "scatter_last_write", "rand_best_threshold", "cut_gradient", "marker_watershed", "gather_cut"]


def rows(frame):
    columns = sorted(frame.columns)
    return Counter(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "nation customer supplier orders lineitem events documents embeddings labels".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
