"""Readers and writers of files that hold rasters, graphs and samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The TIFF tags that are read and written, and the sizes of TIFF's types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}


def read_edge_list(spark: SparkSession, path: str, image_id: int = 0) -> DataFrame:
    """Lines `u v w`, separated by blanks."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.lit(image_id).cast("long").alias("image_id"), F.least(p[0].cast("long"), p[1].cast("long")).alias("u"), F.greatest(p[0].cast("long"), p[1].cast("long")).alias("v"), p[2].cast("double").alias("w"))


def write_edge_list(edges: DataFrame, path: str, value: str = "w") -> None:
    """Lines `u v value`; one image a folder."""
    edges.select("image_id", F.concat_ws(" ", "u", "v", value).alias("value")).write.partitionBy("image_id").text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Text with a first line `N D`, then `label f1 ... fD`: label (kept as it is) and features."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.size("p") > 2)
    return rows.select(F.col("p")[0].cast("double").alias("label"), F.transform(F.slice("p", 2, 1 << 30), lambda x: x.cast("double")).alias("features"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """label and features as a map of positions to values."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.size("p") > 1)
    pairs = F.transform(F.slice("p", 2, 1 << 30), lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double")))
    return rows.select(F.col("p")[0].cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_raster(raster: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Long rows as Parquet, one folder per slice or tile if `by` names its columns."""
    writer = raster.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_metrics(series: DataFrame, path: str) -> None:
    """(run, epoch, metric, value) rows, kept by run and metric."""
    series.select("run", "epoch", "metric", "value").write.mode("append").partitionBy("run", "metric").parquet(path)


def decode_tiff(data: bytes, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Pages x height x width x samples of an uncompressed TIFF; with a window (x0, y0, x1, y1), ends
    exclusive, only its rows are decoded, strip by strip."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at, pages = struct.unpack(f"{end}I", data[4:8])[0], []
    while at:
        n = struct.unpack_from(f"{end}H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{end}I", data, at + 10 + 12 * i)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{end}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, place)
        if tags.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("compressed TIFF files are not supported")
        w, h, s = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
        bits, form = tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]
        kind = np.dtype(f"{end}{'f' if form == 3 else 'i' if form == 2 else 'u'}{bits // 8}")
        x0, y0, x1, y1 = window or (0, 0, w, h)
        x0, y0, x1, y1 = max(x0, 0), max(y0, 0), max(min(x1, w), max(x0, 0)), max(min(y1, h), max(y0, 0))
        strip = tags.get(ROWS, (h,))[0]
        first, last = y0 // strip, -(-y1 // strip)
        raw = b"".join(data[o : o + c] for o, c in list(zip(tags[OFFSETS], tags[COUNTS], strict=True))[first:last])
        rows = np.frombuffer(raw, kind).reshape(-1, w, s)
        pages.append(rows[y0 - first * strip : y1 - first * strip, x0:x1].astype(np.float64))
        at = struct.unpack_from(f"{end}I", data, at + 2 + 12 * n)[0]
    return np.stack(pages)


def encode_tiff(values: np.ndarray) -> bytes:
    """A one-page TIFF of 32-bit floats."""
    h, w = values.shape
    raw = values.astype("<f4").tobytes()
    tags = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 32), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, 8), (SAMPLES, 3, 1), (ROWS, 4, h), (COUNTS, 4, len(raw)), (FORMAT, 3, 3)]
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + table


def read_tiff(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, bands: list[int] | None = None) -> DataFrame:
    """Long rows of TIFF files: path, z, x, y, band, value. One file a time is held by a task. Of a
    window (x0, y0, x1, y1), ends exclusive, only rows inside are decoded; of bands only those named."""
    x0, y0 = (max(window[0], 0), max(window[1], 0)) if window else (0, 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                stack = decode_tiff(bytes(content), window)
                chosen = np.arange(stack.shape[3]) if bands is None else np.array(bands)
                for z, page in enumerate(stack):
                    page = page[:, :, chosen]
                    y, x, b = (i.ravel() for i in np.indices(page.shape))
                    yield pd.DataFrame({"path": name, "z": z, "x": x + x0, "y": y + y0, "band": chosen[b], "value": page.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, z int, x int, y int, band int, value double")


def tiff_images(raster: DataFrame, name: str = "image_id") -> DataFrame:
    """One row per image with its TIFF bytes in `content`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1))
        image[frame["y"], frame["x"]] = frame["value"]
        return pd.DataFrame({name: [frame[name].iloc[0]], "content": [encode_tiff(image)]})

    return raster.select(name, "x", "y", "value").groupBy(name).applyInPandas(run, f"{name} {raster.schema[name].dataType.simpleString()}, content binary")


def stack_index(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds z, row and col of file names ..._z_row_col.ext."""
    parts = [F.regexp_extract(path, r"_(\d+)_(\d+)_(\d+)\.[^./]+$", i).cast("int") for i in (1, 2, 3)]
    return files.withColumns(dict(zip(("z", "row", "col"), parts, strict=True)))


def lines_to_raster(segments: DataFrame) -> DataFrame:
    """Draws (image_id, x0, y0, x1, y1, value) as lines; a pixel takes its greatest value."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    rows = segments.select("*", n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("_i"))
    step = F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_i") / F.col("_n"))
    x = F.floor(F.col("x0") + (F.col("x1") - F.col("x0")) * step + 0.5).cast("int")
    y = F.floor(F.col("y0") + (F.col("y1") - F.col("y0")) * step + 0.5).cast("int")
    return rows.groupBy("image_id", x.alias("x"), y.alias("y")).agg(F.max("value").alias("value"))


#: The size of a FITS block and of its header's lines, and its types by BITPIX.
_FITS_BLOCK, _FITS_CARD = 2880, 80
_FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def decode_fits(data: bytes) -> np.ndarray:
    """The primary array of a FITS file as slices x height x width, scaled; row 0 is the file's first."""
    head, at = {}, 0
    while "END" not in head:
        if at + _FITS_BLOCK > len(data):
            raise ValueError("FITS header without an end")
        for i in range(at, at + _FITS_BLOCK, _FITS_CARD):
            card = data[i : i + _FITS_CARD].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END" or card[8:10] == "= ":
                head.setdefault(name, card[10:].split("/")[0].strip())
        at += _FITS_BLOCK
    shape = [int(head[f"NAXIS{i}"]) for i in range(int(head["NAXIS"]), 0, -1)]
    if not shape:
        return np.zeros((0, 0, 0))
    kind = np.dtype(_FITS_TYPES[int(head["BITPIX"])])
    values = np.frombuffer(data, kind, int(np.prod(shape)), at).astype(np.float64)
    values = values * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
    return values.reshape([int(np.prod(shape[:-2])) if len(shape) > 2 else 1, *([1] * (2 - len(shape))), *shape[-2:]])


def encode_fits(values: np.ndarray) -> bytes:
    """A FITS file of 32-bit floats."""
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", f"NAXIS   = {values.ndim:20d}"]
    cards += [f"NAXIS{i + 1:<3d}= {n:20d}" for i, n in enumerate(reversed(values.shape))] + ["END"]
    head = "".join(f"{c:<{_FITS_CARD}}" for c in cards).encode()
    raw = values.astype(">f4").tobytes()
    return head + b" " * (-len(head) % _FITS_BLOCK) + raw + bytes(-len(raw) % _FITS_BLOCK)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of FITS files: path, z, x, y, value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for z, page in enumerate(decode_fits(bytes(content))):
                    y, x = (i.ravel() for i in np.indices(page.shape))
                    yield pd.DataFrame({"path": name, "z": z, "x": x, "y": y, "value": page.ravel()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, z int, x int, y int, value double")


def image_with_labels(image: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The pixels of images that have a label raster, with the label beside the value.

    image: image_id, x, y, value (and band); labels: image_id, x, y, value or label.
    """
    keys = keys or ["image_id", "x", "y"]
    name = "label" if "label" in labels.columns else "value"
    return image.join(labels.select(*keys, F.col(name).cast("long").alias("label")), keys)


def batch(images: DataFrame, labels: DataFrame, listing: DataFrame, part: str | None = None) -> DataFrame:
    """Images with their segmentations by a list of pairs: index, image (path), labels (path) and, if
    `part` is given, those rows of the list whose column part says so. Returns index, x, y, value, label."""
    chosen = listing if part is None else listing.filter(F.col("part") == part)
    pixels = images.join(chosen.select("index", F.col("image").alias("path")), "path").select("index", "x", "y", "value")
    truth = labels.join(chosen.select("index", F.col("labels").alias("path")), "path").select("index", "x", "y", F.col("value").cast("long").alias("label"))
    return pixels.join(truth, ["index", "x", "y"])


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file a graph, in text parts that follow each other: vertices (image_id, v and more
    columns), edges (image_id, u, v and more). Files lie in folders by image_id and are one part each,
    lines in order; a graph is one task's."""
    more = {"node": [c for c in vertices.columns if c not in ("image_id", "v")], "edge": [c for c in edges.columns if c not in ("image_id", "u", "v")]}
    keys = [f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="double"/>' for k, names in more.items() for c in names]

    def data(names: list[str]) -> Column:
        return F.concat(F.lit(""), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), F.col(c).cast("double").cast("string"), F.lit("</data>"))).otherwise("") for c in names])

    node = vertices.select("image_id", F.lit(1).alias("_o"), F.col("v").alias("_a"), F.lit(0).cast("long").alias("_b"), F.concat(F.lit('<node id="n'), F.col("v"), F.lit('">'), data(more["node"]), F.lit("</node>")).alias("value"))
    edge = edges.select("image_id", F.lit(2).alias("_o"), F.col("u").alias("_a"), F.col("v").alias("_b"), F.concat(F.lit('<edge source="n'), F.col("u"), F.lit('" target="n'), F.col("v"), F.lit('">'), data(more["edge"]), F.lit("</edge>")).alias("value"))
    ids = vertices.select("image_id").distinct()
    head = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph id="G" edgedefault="undirected">'])
    ends = [ids.select("image_id", F.lit(o).alias("_o"), F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit(t).alias("value")) for o, t in ((0, head), (3, "</graph></graphml>"))]
    rows = node.unionByName(edge).unionByName(ends[0]).unionByName(ends[1])
    rows.repartition("image_id").sortWithinPartitions("image_id", "_o", "_a", "_b").select("image_id", "value").write.mode("overwrite").partitionBy("image_id").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (image_id, v, data) and edges (image_id, u, v, data) of GraphML files in folders
    image_id=..., one element a line; data is a map of names to numbers."""
    rows = spark.read.option("basePath", path).text(path)
    names, values = (F.regexp_extract_all("value", F.lit('<data key="([^"]*)">([^<]*)</data>'), F.lit(i)) for i in (1, 2))
    data = F.map_from_arrays(names, F.transform(values, lambda x: x.cast("double"))).alias("data")
    image = F.col("image_id").cast("long").alias("image_id")
    number = lambda pattern: F.regexp_extract("value", pattern, 1).cast("long")
    nodes = rows.filter(F.col("value").startswith("<node ")).select(image, number('<node id="n(-?[0-9]+)"').alias("v"), data)
    edges = rows.filter(F.col("value").startswith("<edge ")).select(image, number('source="n(-?[0-9]+)"').alias("u"), number('target="n(-?[0-9]+)"').alias("v"), data)
    return nodes, edges
