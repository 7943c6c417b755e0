"""Polar coordinates, resolution tiers and cell keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LEAST_RANGE, TIERS



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def radius(x="x", y="y") -> Column:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y)


def bearing(x="x", y="y") -> Column:
    return F.atan2(col(y), col(x))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + F.pi(), F.lit(2.0) * F.pi()) - F.pi()


def resolution(r: Column, finest: Column | None = None, tiers=TIERS) -> Column:
    """Cell size in metres. `finest` tells whether the finest tier holds, in place of its static range; the last tier has no end."""
    if len(tiers) == 1:
        return F.lit(tiers[0][1])
    first = r < tiers[0][0] if finest is None else finest
    out = F.when(first, tiers[0][1])
    for far, size in tiers[1:-1]:
        out = out.when(r < far, size)
    return out.otherwise(tiers[-1][1])


def tier_index(size: Column, tiers=TIERS) -> Column:
    if len(tiers) == 1:
        return F.lit(0)
    out = F.when(size == tiers[0][1], 0)
    for i, (_, s) in enumerate(tiers[1:-1], 1):
        out = out.when(size == s, i)
    return out.otherwise(len(tiers) - 1)


def angular_step(size: Column, r: Column) -> Column:
    return size / F.greatest(r, F.lit(LEAST_RANGE))


def ring(r: Column, size: Column) -> Column:
    """Truncates toward zero, as angle_cell does; bin 0 of angles is twice as wide."""
    return (r / size).cast("long")


def angle_cell(theta: Column, size: Column, r: Column) -> Column:
    return (theta / angular_step(size, r)).cast("long")


def cell_id(tier: Column, ring_idx: Column, angle_idx: Column) -> Column:
    return tier.cast("long") * 10**12 + ring_idx * 10**6 + angle_idx + 500_000


def center(ring_idx="ring_idx", angle_idx="angle_idx", size="resolution_tier") -> dict[str, Column]:
    """r, theta, x and y of a cell's centre."""
    size = col(size)
    r = (col(ring_idx) + 0.5) * size
    theta = (col(angle_idx) + 0.5) * angular_step(size, r)
    return {"r": r, "theta": theta, "x": r * F.cos(theta), "y": r * F.sin(theta)}


def confidence(count: Column, mean_r: Column) -> Column:
    need = F.greatest(F.lit(1.0), F.lit(150.0) / F.greatest(F.lit(1.0), mean_r))
    return F.least(F.lit(1.0), count / need)


def fine_cells(size: Column) -> Column:
    """Cells of the finest size in one cell of this size; a double division cut to an integer, so 8 for 0.15."""
    ratio = size / 0.05
    return (ratio * ratio).cast("long")

