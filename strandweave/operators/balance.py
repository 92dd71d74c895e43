"""Balancing of a symmetric non-negative map: a scale x so that the rows of x_i m_ij x_j add up to one.

The scale is unique where it exists, so any convergent scheme gives it.  Zero diagonal entries count as one while the scale
is sought, and only then.  Up to DENSE_CELLS cells, one task solves by Newton steps with conjugate gradients on the symmetric
system; beyond, rounds of a join and a grouped sum do, each written, until the same bound on the residual holds.  These rounds are
halved steps in log scale, mixed with the last HISTORY of them by least squares (Anderson's acceleration), whose few sums are all
that reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..tables import written
from .contacts import symmetric
from .normalise import scaled

#: Cells of the upper triangle that one task solves, at most (24 bytes each).
DENSE_CELLS = 4_000_000
#: Rounds that the distributed scheme mixes.
HISTORY = 5


def solve(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, tolerance: float, rounds: int) -> np.ndarray:
    """Scale of a symmetric matrix in upper-triangle coordinates: Newton's method for x * (m x) = 1, in log scale, each step by conjugate gradients."""
    off = i != j
    diagonal = np.zeros(n)
    np.add.at(diagonal, i[~off], v[~off])
    a, b, w = i[off], j[off], v[off]
    diagonal[diagonal == 0] = 1.0

    def product(x: np.ndarray) -> np.ndarray:
        return diagonal * x + np.bincount(a, w * x[b], n) + np.bincount(b, w * x[a], n)

    x = 1 / np.sqrt(product(np.ones(n)))
    for _ in range(rounds):
        r = x * product(x)
        gap = 1 - r
        if gap @ gap <= tolerance**2:
            return x
        # (diag(r) + x m x) step = 1 - r, solved approximately
        target = min(0.1, np.sqrt(gap @ gap)) ** 2 * (gap @ gap)
        step, left = np.zeros(n), gap.copy()
        inverse = 1 / (r + diagonal * x * x)
        z = inverse * left
        direction, size = z.copy(), left @ z
        for _ in range(200):
            image = r * direction + x * product(x * direction)
            rate = size / (direction @ image)
            step += rate * direction
            left -= rate * image
            if left @ left <= target:
                break
            z = inverse * left
            new = left @ z
            direction, size = z + new / size * direction, new
        x = x * np.exp(np.clip(step, -1.5, 1.5))
        if not np.isfinite(x).all():
            raise ArithmeticError("balancing met a value that isn't finite")
    raise ArithmeticError(f"balancing didn't converge in {rounds} rounds")


def scale_factors(contacts: DataFrame, tolerance: float = 1e-6, rounds: int = 1000, value: str = "value", dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(seq_id, x) for the sequences with a cell.  contacts: upper triangle (i, j, value)."""
    ship(contacts.sparkSession)
    cells = written(contacts.where(F.col(value) != 0).select("i", "j", F.col(value).cast("double").alias("v")))
    if cells.count() <= dense_cells:

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(np.concatenate((rows["i"], rows["j"])), return_inverse=True)
            x = solve(at[: len(rows)], at[len(rows) :], rows["v"].to_numpy(), len(ids), tolerance, rounds)
            return pd.DataFrame({"seq_id": ids.astype(np.int32), "x": x})

        return cells.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda rows: one(rows), "seq_id int, x double")
    full = symmetric(cells)
    own = full.where("i = j").select("i")
    ids = full.select("i").distinct()
    full = written(full.unionByName(ids.join(own, "i", "left_anti").select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))))
    # l: log of the scale; g: where a round leads; f: its step; dg, df: differences of the last of those, the newest first
    now = full.groupBy("i").agg((-F.log(F.sum("v")) / 2).alias("l")).select("i", "l", F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("f"), *[F.array().cast("array<double>").alias(n) for n in ("dg", "df")])
    now, kept, best = written(now), 0, float("inf")
    for _ in range(rounds):
        image = full.join(now.select(F.col("i").alias("j"), F.exp("l").alias("xj")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xj")).alias("y"))
        step = -(F.col("l") + F.log("y")) / 2
        rows = now.join(image, "i").select("i", "l", "y", (F.col("l") + step).alias("g2"), step.alias("f2"), "g", "f", "dg", "df")
        longer = lambda new, old, past: F.when(F.col(old).isNull(), F.col(past)).otherwise(F.slice(F.concat(F.array(F.col(new) - F.col(old)), F.col(past)), 1, HISTORY))
        rows = written(rows.select("i", "l", "y", F.col("g2").alias("g"), F.col("f2").alias("f"), longer("g2", "g", "dg").alias("dg"), longer("f2", "f", "df").alias("df")))
        cell = lambda a: F.get("df", F.lit(a))
        sums = [F.sum(cell(a) * cell(b)) for a in range(HISTORY) for b in range(a, HISTORY)] + [F.sum(cell(a) * F.col("f")) for a in range(HISTORY)]
        gap, kept, *sums = rows.agg(F.sum(F.pow(1 - F.exp("l") * F.col("y"), F.lit(2))), F.coalesce(F.max(F.size("df")), F.lit(0)), *sums).first()
        if gap is None or gap <= tolerance**2:
            return rows.select(F.col("i").cast("int").alias("seq_id"), F.exp("l").alias("x"))
        if not np.isfinite(gap):
            raise ArithmeticError("balancing met a value that isn't finite")
        weights = _mixed(sums, kept) if gap < 100 * best else []  # a step that led far off: the next is a plain one
        best = min(best, gap)
        after = F.col("g")
        for a, w in enumerate(weights):
            after = after - F.lit(w) * F.get("dg", F.lit(a))
        past = [F.col(n) if weights or not kept else F.array().cast("array<double>").alias(n) for n in ("dg", "df")]
        now = rows.select("i", after.alias("l"), "g", "f", *past)
    raise ArithmeticError(f"balancing didn't converge in {rounds} rounds")


def _mixed(sums: list[float], kept: int) -> list[float]:
    """Weights of the differences whose sum is nearest to the step, from their inner products."""
    gram, at = np.zeros((HISTORY, HISTORY)), 0
    for a in range(HISTORY):
        for b in range(a, HISTORY):
            gram[a, b] = gram[b, a] = sums[at] or 0.0
            at += 1
    right = np.array([x or 0.0 for x in sums[at:]])
    return np.linalg.lstsq(gram[:kept, :kept], right[:kept], rcond=1e-12)[0].tolist() if kept else []


def balanced(contacts: DataFrame, tolerance: float = 1e-6, value: str = "value", **more) -> tuple[DataFrame, DataFrame]:
    """(the map times its scale, the scale); the map's own diagonal is scaled, not the one that replaced zeros."""
    scale = scale_factors(contacts, tolerance, value=value, **more)
    return scaled(contacts, scale, value), scale


def balanced_tips(tips: DataFrame, tolerance: float = 1e-6, value: str = "value", **more) -> tuple[DataFrame, DataFrame]:
    """The same for a tip table: the scale is that of the tips added up."""
    summed = tips.groupBy("i", "j").agg(F.sum(value).alias(value))
    scale = scale_factors(summed, tolerance, value=value, **more)
    return scaled(tips, scale, value), scale
