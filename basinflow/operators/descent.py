"""Descent on losses that one aggregation evaluates: the driver holds weights and gradients only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import LinearModel, dot, mean_and_covariance, moments
from .raster import PIXEL, patches

#: What evaluates weights: the loss and its gradient.
Evaluate = Callable[[np.ndarray], tuple[float, np.ndarray]]


def logistic_loss_at(rows: DataFrame, features: list[str], positive: Column) -> Evaluate:
    """The mean logistic loss of a linear score with an intercept, at given weights: one pass a call."""
    names = [*features, "_one"]
    base = rows.select(*features, F.lit(1.0).alias("_one"), F.when(positive, 1.0).otherwise(-1.0).alias("_y"))

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_y") * dot(names, w)))
        slope = -F.col("_y") / (1 + F.exp(margin))
        r = base.agg(F.avg(F.log1p(F.exp(-margin))).alias("loss"), *[F.avg(slope * F.col(f)).alias(f"g{i}") for i, f in enumerate(names)]).first()
        return r["loss"] or 0.0, np.array([r[f"g{i}"] or 0.0 for i in range(len(names))])

    return at


def owl_qn(evaluate: Evaluate, start: np.ndarray, l1: np.ndarray | float = 0.0, rounds: int = 50, memory: int = 6, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent on loss + sum of l1 |w|, staying in one orthant a step.

    Returns the weights and the whole loss. l1 may differ by weight, 0 for an intercept.
    """
    w, l1 = np.array(start, float), np.broadcast_to(np.asarray(l1, float), np.shape(start))
    loss, gradient = evaluate(w)
    total, steps = loss + float(l1 @ np.abs(w)), []
    for _ in range(rounds):
        # The steepest of the sub-gradients: at 0 a weight moves only if the loss falls faster than l1 rises.
        shrunk = np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0)
        pseudo = np.where(w != 0, gradient + l1 * np.sign(w), shrunk)
        if np.abs(pseudo).max(initial=0) < tolerance:
            break
        direction, kept = -pseudo, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        direction = np.where((direction * pseudo < 0) | (l1 == 0), direction, 0.0)
        if direction @ pseudo >= 0:
            direction, steps = -pseudo, []
        orthant = np.where(w != 0, np.sign(w), -np.sign(pseudo))
        size = 1.0 if steps else 1 / max(1.0, float(np.linalg.norm(pseudo)))
        for _ in range(30):
            moved = w + size * direction
            moved = np.where((l1 > 0) & (moved * orthant < 0), 0.0, moved)
            new_loss, new_gradient = evaluate(moved)
            new_total = new_loss + float(l1 @ np.abs(moved))
            if new_total <= total + 1e-4 * float(pseudo @ (moved - w)):
                break
            size /= 2
        else:
            break
        s, y = moved - w, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        w, gradient, total = moved, new_gradient, new_total
    return w, total


def sparse_logistic(rows: DataFrame, features: list[str], positive: Column, l1: float, rounds: int = 50) -> LinearModel:
    """Logistic regression with an L1 penalty on the mean loss; the intercept isn't penalised."""
    penalty = np.array([l1] * len(features) + [0.0])
    w, _ = owl_qn(logistic_loss_at(rows, features, positive), np.zeros(len(features) + 1), penalty, rounds)
    return LinearModel(features, w[:-1].tolist(), float(-w[-1]))


@dataclass(frozen=True)
class FilterFit:
    """A filter's weights row by row, its bias, and the mean squared error before every epoch and after the last."""

    weights: tuple[float, ...]
    bias: float
    errors: tuple[float, ...]


def train_filter(raster: DataFrame, targets: DataFrame, radius: int = 1, epochs: int = 100, method: str = "adadelta", rate: float | None = None, rho: float = 0.99) -> FilterFit:
    """Trains a linear filter to predict targets (image_id, x, y, value) from the pixels around.

    Squared error needs the patches' moments only, which one aggregation adds up; all epochs of
    full-batch descent then run on the driver, whatever the number of pixels. method: adadelta
    (rate 1, rho 0.99), adam (rate 0.01) or sgd (rate 0.01).
    """
    d = (2 * radius + 1) ** 2
    rows = patches(raster, radius).join(targets.select(*PIXEL, F.col("value").alias("_t")), PIXEL)
    names = [f"_x{i}" for i in range(d)]
    rows = rows.select(*[F.col("patch")[i].alias(n) for i, n in enumerate(names)], F.lit(1.0).alias("_one"), "_t")
    n, mean, covariance = mean_and_covariance(moments(rows, [*names, "_one", "_t"]).first(), d + 2)
    if not n:
        return FilterFit((0.0,) * d, 0.0, (0.0,))
    second = covariance + np.outer(mean, mean)
    xx, xt, tt = second[: d + 1, : d + 1], second[: d + 1, d + 1], second[d + 1, d + 1]
    w, errors = np.zeros(d + 1), []
    squares, moved, momentum = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    rate = rate if rate is not None else {"adadelta": 1.0, "adam": 0.01, "sgd": 0.01}.get(method, 0.0)
    for epoch in range(1, epochs + 1):
        errors.append(float(w @ xx @ w - 2 * w @ xt + tt))
        g = 2 * (xx @ w - xt)
        if method == "adadelta":
            squares = rho * squares + (1 - rho) * g * g
            step = g * np.sqrt(moved + 1e-6) / np.sqrt(squares + 1e-6)
            moved = rho * moved + (1 - rho) * step * step
        elif method == "adam":
            momentum, squares = 0.9 * momentum + 0.1 * g, 0.999 * squares + 0.001 * g * g
            step = momentum / (1 - 0.9**epoch) / (np.sqrt(squares / (1 - 0.999**epoch)) + 1e-8)
        elif method == "sgd":
            step = g
        else:
            raise ValueError(f"unknown method {method}")
        w = w - rate * step
    errors.append(float(w @ xx @ w - 2 * w @ xt + tt))
    return FilterFit(tuple(w[:d].tolist()), float(w[d]), tuple(errors))
