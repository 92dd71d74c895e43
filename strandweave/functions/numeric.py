"""Column functions: bins, tips, means, densities.  All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_of(name: str, x: Column | str, y: Column | str) -> Column:
    """Geometric, harmonic or arithmetic mean of two columns."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    if name == "geometric":
        return F.sqrt(x * y)
    if name == "harmonic":
        return 2 * x * y / (x + y)
    if name == "arithmetic":
        return (x + y) / 2
    raise ValueError(f"{name}: the means are geometric, harmonic and arithmetic")


def bin_count(length: Column | str, size: int) -> Column:
    """Whole bins of about size in a length: the quotient rounded half up, one at least."""
    return F.greatest(F.lit(1), F.floor(_c(length) / size + 0.5)).cast("int")


def bin_edges(length: Column | str, n: Column | str) -> Column:
    """n + 1 edges at equal steps from 0 to the length, cut to whole numbers."""
    length, n = _c(length), _c(n)
    step = length.cast("double") / n
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == n, length.cast("long")).otherwise(F.floor(i * step)))


def locate_bin(edges: Column | str, x: Column | str) -> Column:
    """Number of the bin whose right edge is the first at or beyond x; what lies beyond all is in the last, no join needed."""
    edges, x = _c(edges), _c(x)
    right = F.slice(edges, 2, F.size(edges) - 1)
    return F.least(F.size(F.filter(right, lambda e: e < x)), F.size(right) - 1)


def tip_of(position: Column | str, length: Column | str, tip: int) -> Column:
    """0 for the left tip, 1 for the right, null for neither; where tips would overlap, the nearer end, the midpoint being neither's."""
    p, n = _c(position), _c(length)
    apart = F.when(p < tip, 0).when(p > n - tip, 1)
    near = F.when(p < n - p, 0).when(p > n - p, 1)
    return F.when(n > 2 * tip, apart).otherwise(near).cast("byte")


def five_prime(position: Column | str, aligned: Column | str, reverse: Column) -> Column:
    return F.when(reverse, _c(position) + _c(aligned)).otherwise(_c(position))


def has_flag(flag: Column | str, bit: int) -> Column:
    return _c(flag).bitwiseAND(F.lit(bit)) != 0


# Parameters of the contact density by separation.
DENSITY_LIMIT, DENSITY_FLOOR = 500e3, 2e-8
PARETO_ALPHA = 0.122123774414444
PARETO_LAMBDA = 13.675170758388262
PARETO_MU = 13.973247315647466


def contact_density(s: Column | str) -> Column:
    """Pareto type II density of a separation below the limit, a constant from there on."""
    s = _c(s).cast("double")
    pareto = PARETO_ALPHA / PARETO_LAMBDA * F.pow(1 + (s - PARETO_MU) / PARETO_LAMBDA, F.lit(-PARETO_ALPHA - 1))
    return F.when(s < DENSITY_LIMIT, pareto).otherwise(F.lit(DENSITY_FLOOR))


def poisson_term(observed: Column | str, expected: Column | str, with_zero: bool = True) -> Column:
    """Poisson log mass by Stirling's formula; an observation of zero takes off the expectation, or nothing."""
    n, q = _c(observed).cast("double"), _c(expected).cast("double")
    some = n * F.ln(n / q) + q - n + 0.5 * F.ln(2 * math.pi * n)
    return -F.when(n > 0, some).otherwise(q if with_zero else F.lit(0.0))
