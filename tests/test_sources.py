import numpy as np

from basinflow.operators import features, learn
from basinflow.sources import formats, generators


def test_tiff_round_trip(spark, tmp_path):
    image = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert np.array_equal(formats.decode_tiff(formats.encode_tiff(image))[0, :, :, 0], image)
    (tmp_path / "stack_0_1_2.tif").write_bytes(formats.encode_tiff(image))
    rows = formats.stack_index(formats.read_tiff(spark, str(tmp_path)).select("path", "x", "y", "value")).collect()
    assert {(r.x, r.y, r.value) for r in rows} == {(x, y, float(image[y, x])) for y in range(3) for x in range(4)}
    assert {(r.z, r.row, r.col) for r in rows} == {(0, 1, 2)}


def test_edge_list_round_trip(spark, tmp_path):
    e = generators.affinity_graph(spark, {(0, 1): 0.5, (2, 1): -1.25})
    formats.write_edge_list(e, f"{tmp_path}/g")
    back = formats.read_edge_list(spark, f"{tmp_path}/g/image_id=0")
    assert sorted(map(tuple, back.collect())) == [(0, 0, 1, 0.5), (0, 1, 2, -1.25)]


def test_models_are_kept(spark, tmp_path):
    rows = generators.two_classes(spark, 200)
    model = learn.Whiten.fit(rows, ["x0", "x1"])
    learn.save_model(model, spark, f"{tmp_path}/m")
    assert learn.load_model(spark, f"{tmp_path}/m") == model
    fisher = learn.fisher(rows, ["x0", "x1"], rows["label"] == 1).apply(rows, hard=True)
    assert fisher.filter("(score > 0) = (label = 1)").count() > 150


def test_contour_of_a_square_has_its_corners(spark):
    labels = spark.createDataFrame([(0, x, y, 7) for x in (1, 2) for y in (1, 2)], "image_id long, x int, y int, label long")
    ring = features.contours(labels).first().ring
    assert ring[0] == ring[-1] and {tuple(p) for p in ring} == {(1, 1), (3, 1), (3, 3), (1, 3)}


def test_assignment_is_optimal(spark):
    import itertools

    cost = np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]], float)
    rows = spark.createDataFrame([(0, r, c, float(cost[r, c])) for r in range(3) for c in range(3)], "image_id long, row long, col long, cost double")
    best = min(sum(cost[i, p[i]] for i in range(3)) for p in itertools.permutations(range(3)))
    assert sum(r.cost for r in learn.assignment(rows, ["image_id"]).collect()) == best


def test_windows_bands_and_strips(tmp_path):
    import struct

    import numpy as np

    from basinflow.sources import formats

    image = np.arange(7 * 5).reshape(7, 5).astype(float)
    data = formats.encode_tiff(image)
    assert formats.decode_tiff(data, (1, 2, 4, 9))[0, :, :, 0].tolist() == image[2:7, 1:4].tolist()
    # The same in strips of two rows.
    raw = image.astype("<f4")
    strips = [raw[i : i + 2].tobytes() for i in range(0, 7, 2)]
    body, offsets = b"".join(strips), np.cumsum([8, *map(len, strips)])[:-1]
    lists = struct.pack("<4I", *offsets) + struct.pack("<4I", *map(len, strips))
    at = 8 + len(body)
    tags = [(256, 4, 1, 5), (257, 4, 1, 7), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 4, at), (277, 3, 1, 1), (278, 4, 1, 2), (279, 4, 4, at + 16), (339, 3, 1, 3)]
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    striped = struct.pack("<2sHI", b"II", 42, at + 32) + body + lists + table
    for window in (None, (0, 3, 5, 4), (2, 1, 3, 7), (9, 9, 12, 12)):
        x0, y0, x1, y1 = window or (0, 0, 5, 7)
        assert formats.decode_tiff(striped, window)[0, :, :, 0].tolist() == image[y0:y1, x0:x1].tolist()


def test_fits_and_pairs(spark, tmp_path):
    import numpy as np

    from basinflow.sources import formats

    for shape in ((3, 4), (2, 3, 4)):
        values = np.arange(np.prod(shape)).reshape(shape).astype(float)
        assert formats.decode_fits(formats.encode_fits(values)).tolist() == values.reshape(-1, 3, 4).tolist()
    (tmp_path / "a.fits").write_bytes(formats.encode_fits(np.arange(12.0).reshape(3, 4)))
    rows = formats.read_fits(spark, str(tmp_path))
    assert sorted((r.y, r.x, r.value) for r in rows.collect()) == [(i // 4, i % 4, float(i)) for i in range(12)]
    listing = spark.createDataFrame([(7, rows.first().path, "truth", "train"), (8, "none", "truth", "test")], "index int, image string, labels string, part string")
    truth = rows.selectExpr("'truth' as path", "x", "y", "value * 0 + 5 as value")
    assert {(r["index"], r.label) for r in formats.batch(rows, truth, listing, "train").collect()} == {(7, 5)}
    labelled = formats.image_with_labels(rows.selectExpr("1L as image_id", "x", "y", "value"), truth.filter("x < 2").selectExpr("1L as image_id", "x", "y", "value"))
    assert labelled.count() == 6 and labelled.select("label").distinct().count() == 1


def test_graphml_round_trip(spark, tmp_path):
    from basinflow.sources import formats

    v = spark.createDataFrame([(1, 0, 2.5, 1.0), (1, 1, None, 2.0), (2, 0, 0.5, 3.0)], "image_id long, v long, x double, label double")
    e = spark.createDataFrame([(1, 0, 1, -0.25)], "image_id long, u long, v long, weight double")
    formats.write_graphml(v, e, str(tmp_path / "g"))
    nodes, edges = formats.read_graphml(spark, str(tmp_path / "g"))
    assert sorted((r.image_id, r.v, tuple(sorted(r.data.items()))) for r in nodes.collect()) == [(1, 0, (("label", 1.0), ("x", 2.5))), (1, 1, (("label", 2.0),)), (2, 0, (("label", 3.0), ("x", 0.5)))]
    assert [(r.image_id, r.u, r.v, r.data) for r in edges.collect()] == [(1, 0, 1, {"weight": -0.25})]
    import xml.etree.ElementTree as tree

    text = next((tmp_path / "g" / "image_id=1").glob("part-*")).read_text()
    assert tree.fromstring(text).tag.endswith("graphml")


def test_raster_graph_and_metric_files(spark, tmp_path):
    r = generators.ramp_square(spark, 8, 2, 4)
    assert r.filter("value > 0").count() == 16 and r.agg({"value": "max"}).first()[0] == 13.0
    formats.write_raster(r, f"{tmp_path}/r", ["image_id"])
    assert spark.read.parquet(f"{tmp_path}/r").count() == 64
    e = generators.random_graph(spark, 3, whole=True)
    v = e.selectExpr("image_id", "u as v").distinct()
    formats.write_graph(v, e, f"{tmp_path}/g")
    back, edges = formats.read_graph(spark, f"{tmp_path}/g")
    assert edges.count() == 12 and back.count() == v.count()
    series = spark.createDataFrame([("a", 1, "loss", 0.5), ("a", 2, "loss", 0.25)], "run string, epoch int, metric string, value double")
    formats.append_metrics(series, f"{tmp_path}/m")
    formats.append_metrics(series, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").filter("run = 'a' and metric = 'loss'").count() == 4
    (tmp_path / "s.txt").write_text("2 3\n1 0.5 1 2\n-1 0 0 1\n")
    assert [(x.label, x.features) for x in formats.read_samples(spark, f"{tmp_path}/s.txt").collect()] == [(1.0, [0.5, 1.0, 2.0]), (-1.0, [0.0, 0.0, 1.0])]
    (tmp_path / "l.txt").write_text("+1 1:0.5 3:2\n-1 2:1\n")
    assert [(x.label, x.features) for x in formats.read_libsvm(spark, f"{tmp_path}/l.txt").collect()] == [(1.0, {1: 0.5, 3: 2.0}), (-1.0, {2: 1.0})]


def test_lines_blocks_draws_and_products(spark):
    from basinflow.operators import raster

    lines = spark.createDataFrame([(0, 0, 0, 3, 3, 1.0), (0, 0, 3, 3, 0, 2.0), (0, 1, 1, 1, 1, 5.0)], "image_id long, x0 int, y0 int, x1 int, y1 int, value double")
    drawn = {(r.x, r.y): r.value for r in formats.lines_to_raster(lines).collect()}
    assert drawn == {**{(i, i): 1.0 for i in range(4)}, **{(i, 3 - i): 2.0 for i in range(4)}, (1, 1): 5.0}
    block = generators.simple_block(spark, 4)
    assert block.filter("w > 0.5").count() == 4 and block.filter("w < -0.5").count() == 20
    twisted = generators.twisted_graph(spark, 6)
    assert twisted.filter("w = 0.001").count() > 0 and twisted.filter("abs(w) < 0.5 and w != 0.001").count() == 0
    draws = learn.discrete_draw(spark.range(2000), [1.0, 3.0, 0.0], 5).groupBy("draw").count().collect()
    share = {r.draw: r["count"] / 2000 for r in draws}
    assert abs(share[0] - 0.25) < 0.05 and abs(share[1] - 0.75) < 0.05 and 2 not in share
    p = generators._grid(spark, 8, 8, 10).selectExpr("*", "double(x + y) as value")
    products = raster.train_valid_products(p, 8, 8, 3)
    parts = {r.part: r.n for r in products.groupBy("part").agg({"image_id": "count"}).withColumnRenamed("count(image_id)", "n").collect()}
    assert parts == {"train": 15 * 16, "valid": 15 * 16}
    assert products.groupBy("image_id").agg({"x": "max"}).select("max(x)").distinct().first()[0] == 3
