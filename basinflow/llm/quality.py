"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null, make_room, small_batches, stage_table

#: What each statistic measures, in order.
NAMES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "blanks", "lines", "stops", "commas", "bangs", "bars",
    "signs", "quotes", "high", "word_length", "word_spread", "distinct_words", "top_word", "pair_repeats", "distinct_lines",
    "capital_words", "signed_words", "byte_entropy", "line_length",
)

_CLASS = np.zeros((10, 256), bool)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*+-/<=>@^_~")):
    _CLASS[_i, list(_chars)] = True


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, put on scales where they spread evenly: logarithms of
    counts, square roots of shares. All are defined for the empty text."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    lower, upper, digits, blanks, lines, stops, commas, bangs, bars, signs = (_CLASS @ counts) / n
    share = counts[counts > 0] / n
    words = data.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    rows = [x for x in data.split(b"\n") if x.strip()]
    root = np.sqrt
    return [
        np.log1p(len(data)), np.log1p(len(words)), root(lower), root(upper), root(digits), root(blanks), root(lines), root(stops), root(commas), root(bangs), root(bars),
        root(signs), root((counts[34] + counts[39]) / n), root(counts[128:].sum() / n), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(tally) / w, root(max(tally.values(), default=0) / w), 1 - pairs / max(len(words) - 1, 1) if len(words) > 1 else 0.0, len(set(rows)) / max(len(rows), 1),
        root(sum(map(bytes.istitle, words)) / w), root(sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:" for x in words) / w), float(-(share * np.log2(share)).sum()), np.log1p(len(data) / max(len(rows), 1)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(len(batch), len(NAMES))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values.ravel())], ["doc_id", "x"])

    rows = docs.select("doc_id", blank_if_null("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and what doesn't depend on x.

    A side without rows, or a model without both sides, scores by the share of the classes alone.
    """

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    offsets: np.ndarray
    dead: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1, from the difference of the Mahalanobis log-densities."""
        if self.dead:
            return np.full(len(x), 1 / (1 + np.exp(self.offsets[0] - self.offsets[1])))
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        log = [self.offsets[c] - 0.5 * np.square((z - self.means[c]) @ self.inverse_factors[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def train(labelled: DataFrame, to_common: float = 0.05, to_round: float = 0.001) -> Discriminant:
    """Fits from all rows (x, y), y 0 or 1: counts, sums and products are added up in the
    partitions, so only one row a class and partition is shuffled and two reach the driver.

    Class covariances are shrunk by `to_common` to the common one and by `to_round` to a round one.
    """
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for batch in batches:
            x = np.column_stack([batch.column(0).flatten().to_numpy().reshape(len(batch), d), np.ones(len(batch))])
            y = batch.column(1).to_numpy()
            for c in sums:
                part = x[y == c]
                sums[c] += part.T @ part
        values = np.concatenate([sums[0].ravel(), sums[1].ravel()])
        at = np.arange(len(values))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.float64())], ["at", "v"])

    # One row for each of the 2 (d+1)^2 sums, whatever the input.
    parts = labelled.select("x", F.col("y").cast("long").alias("y")).mapInArrow(partial, "at long, v double")
    total = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    m = np.array([total.get(i, 0.0) for i in range(2 * (d + 1) ** 2)]).reshape(2, d + 1, d + 1)
    n = m[:, d, d]
    prior = np.log((n + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), prior, dead=True)
    centre = m.sum(0)[:d, d] / n.sum()
    spread = np.diag(m.sum(0))[:d] / n.sum() - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means = (m[:, :d, d] / n[:, None] - centre) / scale
    raw = [m[c, :d, :d] / n[c] - np.outer(m[c, :d, d], m[c, :d, d]) / n[c] ** 2 for c in (0, 1)]
    scatter = [r / np.outer(scale, scale) for r in raw]
    common = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - to_common) * scatter[c] + to_common * common
        s = (1 - to_round) * s + to_round * max(np.trace(s) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(factor))
        offsets.append(prior[c] - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every whole text of docs; learns from labels of rows that aren't held out.

    docs: doc_id, text; labels: doc_id, quality 0 or 1 (others are left out); more columns are
    ignored. Returns doc_id, held_out, score and predicted. Null and empty texts are scored as any
    others; null ids are never held out and have no label; repeated rows count each by itself;
    without labels of both classes all get the same score; an empty table gives no rows.
    """
    found = stage_table(features(docs), "quality-features")
    known = labels.select("doc_id", F.col("quality").alias("y")).filter("y in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id")))
    model = train(found.join(known, "doc_id").select("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(1).flatten().to_numpy().reshape(len(batch), len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = found.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
