"""The column functions by name, for queries written as SQL text.

Scalar and table functions are SQL functions: Catalyst inlines them, so a query that uses them has the plan of one that
writes them out. z_split is an aggregate in Python, as it takes rounds over a group's values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import FOVEA, LEAST_RANGE, OVERHANG_GAP, TIERS, Fovea

LOBES = "ARRAY<STRUCT<height: DOUBLE, at: DOUBLE, sigma: DOUBLE, factor: DOUBLE, cap: DOUBLE>>"
ROUNDS, SETTLED = 5, 1e-4


def split_heights(z: np.ndarray, gap: float = OVERHANG_GAP) -> dict[str, float | None]:
    """The ground of a cell, and bottom and top of what hangs over it: two means of the heights, as operators.project has them."""
    z = np.sort(np.asarray(z, float))
    mean = lambda v: float(v.cumsum()[-1] / len(v))  # noqa: E731  one by one and ascending, as there
    lo, hi = float(z[0]), float(z[-1])
    none = {"ground": lo, "bottom": None, "top": None}
    c1, c2 = lo, hi
    if hi - lo < gap:
        return none
    for _ in range(ROUNDS):
        first = np.abs(z - c1) < np.abs(z - c2)
        if first.all() or not first.any():
            break
        m1, m2 = mean(z[first]), mean(z[~first])
        moved = max(abs(m1 - c1), abs(m2 - c2))
        c1, c2 = m1, m2
        if moved < SETTLED:
            break
    first = np.abs(z - c1) < np.abs(z - c2)
    if first.all() or not first.any():
        return none
    low, up = z[first], z[~first]
    if mean(low) > mean(up):
        low, up = up, low
    return {"ground": float(low.min()), "bottom": float(up.min()), "top": float(up.max())} if up.min() - low.max() > gap else none


def texts(p: Fovea = FOVEA) -> list[str]:
    """The functions, each after those it uses."""
    num = lambda v: f"{float(v)!r}D"
    (near, s0), (middle, s1), (_, s2) = TIERS
    far, lane = num(p.farthest_threat), num(p.corridor)
    stretch = num(p.max_stretch) if p.reference_speed == 0 else f"(1D + {num(p.max_stretch - 1)} * least(greatest(speed / {num(p.reference_speed)}, 0D), 1D))"
    return [
        f"tier_size(r DOUBLE) RETURNS DOUBLE RETURN CASE WHEN r < {num(near)} THEN {num(s0)} WHEN r < {num(middle)} THEN {num(s1)} ELSE {num(s2)} END",
        f"""polar_cell(r DOUBLE, theta DOUBLE, size DOUBLE) RETURNS STRUCT<tier_idx: INT, ring_idx: BIGINT, angle_idx: BIGINT> RETURN named_struct(
          'tier_idx', CASE size WHEN {num(s0)} THEN 0 WHEN {num(s1)} THEN 1 ELSE 2 END, 'ring_idx', CAST(r / size AS BIGINT), 'angle_idx', CAST(theta / (size / greatest(r, {num(LEAST_RANGE)})) AS BIGINT))""",
        "polar_key(x DOUBLE, y DOUBLE) RETURNS STRUCT<tier_idx: INT, ring_idx: BIGINT, angle_idx: BIGINT> RETURN polar_cell(sqrt(x*x + y*y), atan2(y, x), tier_size(sqrt(x*x + y*y)))",
        "wrapped(angle DOUBLE) RETURNS DOUBLE RETURN pmod(angle + pi(), 2D * pi()) - pi()",
        f"""ellipse_at(d DOUBLE, a DOUBLE) RETURNS DOUBLE RETURN CASE WHEN abs(d) < pi() / 2 THEN
          a * {num(p.base_radius)} / greatest(sqrt(pow({num(p.base_radius)} * cos(d), 2D) + pow(a * sin(d), 2D)), 1e-6D) ELSE {num(p.base_radius)} END""",
        f"ellipse_radius(theta DOUBLE, speed DOUBLE, steering DOUBLE, shear DOUBLE) RETURNS DOUBLE RETURN ellipse_at(wrapped(theta - steering * shear), {num(p.base_radius)} * {stretch})",
        f"""attention(theta DOUBLE, lobes {LOBES}) RETURNS DOUBLE RETURN
          coalesce(greatest(0D, array_max(transform(lobes, l -> least(l.height * exp(-0.5D * pow((pmod(theta - l.at + pi(), 2D * pi()) - pi()) / l.sigma, 2D)) * l.factor, l.cap)))), 0D)""",
        f"fine_radius(theta DOUBLE, speed DOUBLE, steering DOUBLE, lobes {LOBES}) RETURNS DOUBLE RETURN greatest(ellipse_radius(theta, speed, steering, {num(p.shear)}), attention(theta, lobes))",
        f"""fovea_polyline(speed DOUBLE, steering DOUBLE, lobes {LOBES}) RETURNS TABLE (k INT, x DOUBLE, y DOUBLE) RETURN
          SELECT k, r * cos(theta), r * sin(theta) FROM (SELECT k, theta, greatest(ellipse_radius(theta, speed, steering, {num(p.drawn_shear)}), attention(theta, lobes)) AS r
          FROM (SELECT k, k * (2D * pi() / 119D) - pi() AS theta FROM (SELECT explode(sequence(0, 119)) AS k)))""",
        f"""threat_kind(x DOUBLE, y DOUBLE, vx DOUBLE, vy DOUBLE, r DOUBLE, closing DOUBLE, enter DOUBLE) RETURNS STRING RETURN CASE WHEN r > {far} OR r < 0.5D THEN 'out of range'
          WHEN x > 0D AND abs(y) <= 5.5D AND (closing >= 0.5D OR vx <= -0.5D) THEN 'A' WHEN x > 0D AND abs(y) <= {lane} AND (closing < -0.5D OR vx > 0.5D) THEN 'B rejected'
          WHEN x > 0D AND abs(y) <= {lane} AND r <= 25D THEN 'B' WHEN sqrt(vx*vx + vy*vy) >= 0.8D AND abs(y) > {lane} AND abs(y) <= 10D AND ((y > 0D AND vy < -0.5D) OR (y < 0D AND vy > 0.5D))
            AND x + vx * enter BETWEEN 0D AND 25D AND enter <= 3D THEN 'C' ELSE 'none' END""",
        f"""threat_of(kind STRING, x DOUBLE, y DOUBLE, r DOUBLE, meet DOUBLE) RETURNS STRUCT<kind: STRING, is_threat: BOOLEAN, reach: DOUBLE, bearing: DOUBLE> RETURN named_struct('kind', kind, 'is_threat', kind IN ('A', 'B', 'C'),
          'reach', CASE WHEN kind IN ('A', 'B') THEN least(r + 5D, {far}) WHEN kind = 'C' THEN least(abs(meet) + 4D, {far}) ELSE 0D END, 'bearing', CASE WHEN kind IN ('A', 'B', 'C') THEN atan2(y, x) ELSE 0D END)""",
        f"""threat(x DOUBLE, y DOUBLE, vx DOUBLE, vy DOUBLE) RETURNS STRUCT<kind: STRING, is_threat: BOOLEAN, reach: DOUBLE, bearing: DOUBLE> RETURN
          threat_of(threat_kind(x, y, coalesce(vx, 0D), coalesce(vy, 0D), sqrt(x*x + y*y), -(x * coalesce(vx, 0D) + y * coalesce(vy, 0D)) / greatest(sqrt(x*x + y*y), 0.1D), (abs(y) - {lane}) / greatest(abs(coalesce(vy, 0D)), 0.1D)),
            x, y, sqrt(x*x + y*y), x + coalesce(vx, 0D) * ((abs(y) - {lane}) / greatest(abs(coalesce(vy, 0D)), 0.1D)))""",
    ]


def register(spark: SparkSession, p: Fovea = FOVEA) -> SparkSession:
    """Makes the functions known to SQL text in this session; made again, they take the new settings."""
    for text in texts(p):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")

    @F.arrow_udf("struct<ground: double, bottom: double, top: double>")
    def z_split(z: pa.Array) -> float:  # one value for all rows makes it an aggregate
        known = z.drop_null()
        return split_heights(known.to_numpy(zero_copy_only=False)) if len(known) else None

    spark.udf.register("z_split", z_split)
    return spark
