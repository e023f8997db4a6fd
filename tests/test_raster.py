"""Resampling and the gradient bank: against plain loops, and without joins, whose small side Spark would broadcast."""

import math

import pytest

from basinflow.operators import raster


def images(w, h):
    """Two whole images, and one that lacks pixels."""
    value = lambda i, x, y: math.sin(1 + 7 * i + 3 * x + 5 * y)
    return {i: {(x, y): value(i, x, y) for x in range(w) for y in range(h) if i < 2 or (x + 2 * y) % 3} for i in range(3)}


def frame(spark, found):
    return spark.createDataFrame([(i, x, y, v) for i, p in found.items() for (x, y), v in p.items()], "image_id long, x int, y int, value double")


def cubic(d, a=-0.75):
    d = abs(d)
    return ((a + 2) * d - (a + 3)) * d * d + 1 if d <= 1 else ((a * d - 5 * a) * d + 8 * a) * d - 4 * a if d < 2 else 0.0


def resampled(p, w, h, new_w, new_h):
    out = {}
    for x in range(new_w):
        for y in range(new_h):
            gx, gy = (x + 0.5) * w / new_w - 0.5, (y + 0.5) * h / new_h - 0.5
            for i in range(math.floor(gx) - 1, math.floor(gx) + 3):
                for j in range(math.floor(gy) - 1, math.floor(gy) + 3):
                    at, weight = (max(0, min(w - 1, i)), max(0, min(h - 1, j))), cubic(i - gx) * cubic(j - gy)
                    if at in p and weight:
                        out[x, y] = out.get((x, y), 0) + p[at] * weight
    return out


def near(p, x, y, element):
    return [(p[x + dx, y + dy], dx * dx + dy * dy) for dx, dy in element if (x + dx, y + dy) in p]


def smoothed(p):
    box = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return {(x, y): sum(v * math.exp(-d / 2) for v, d in near(p, x, y, box)) / sum(math.exp(-d / 2) for _, d in near(p, x, y, box)) for x, y in p}


def gradient(p):
    return {(x, y): max(near(p, x, y, raster.CROSS))[0] - min(near(p, x, y, raster.CROSS))[0] for x, y in p}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [(8, 8, 4, 4), (7, 5, 3, 9), (1, 4, 3, 2)])
def test_resample_cubic_sends_pixels_and_joins_nothing(spark, size):
    found = images(*size[:2])
    out = raster.resample(frame(spark, found), *size, cubic=True)
    assert "Join" not in plan(out) and plan(out).count("Exchange") == 1
    assert {(r.image_id, r.x, r.y): r.value for r in out.collect()} == pytest.approx({(i, *at): v for i, p in found.items() for at, v in resampled(p, *size).items()})


def test_gradient_bank_joins_nothing_and_shuffles_once(spark):
    found = images(8, 8)
    settings = [(3, "morphological", 3, 0.5), (0, "morphological", 0, 1.0)]
    out = raster.gradient_bank(frame(spark, found), 8, 8, settings)
    assert "Join" not in plan(out) and plan(out).count("Exchange") == len(settings)
    want = {}
    for i, p in found.items():
        small = resampled(p, 8, 8, 4, 4)
        want |= {(i, 0, *at): v for at, v in resampled(smoothed(gradient(smoothed(small))), 4, 4, 8, 8).items()}
        want |= {(i, 1, *at): v for at, v in gradient(p).items()}
    assert {(r.image_id, r.variant, r.x, r.y): r.value for r in out.collect()} == pytest.approx(want)


def test_resample_cubic_query_has_no_join_to_broadcast(spark):
    from basinflow.plans import catalog

    assert "Join" not in plan(catalog.queries()["resample_cubic"](spark, "/root/testdata/sf0.001"))
