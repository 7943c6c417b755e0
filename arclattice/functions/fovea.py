"""The fine zone: an ellipse that speed stretches and steering turns, and lobes towards threats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FOVEA, Fovea
from .polar import bearing, col, radius, wrap


def stretch(speed: Column, p: Fovea = FOVEA) -> Column:
    if p.reference_speed == 0:
        return F.lit(p.max_stretch)
    return 1.0 + (p.max_stretch - 1.0) * F.least(F.greatest(speed / p.reference_speed, F.lit(0.0)), F.lit(1.0))


def threat(x="x", y="y", vx="vx", vy="vy", p: Fovea = FOVEA) -> Column:
    """struct<is_threat, reach, bearing, kind>: oncoming (A), in the lane (B), crossing (C) or none."""
    x, y, vx, vy = (col(c) for c in (x, y, vx, vy))
    vx, vy = F.coalesce(vx, F.lit(0.0)), F.coalesce(vy, F.lit(0.0))
    r, far = radius(x, y), F.lit(p.farthest_threat)
    closing = -(x * vx + y * vy) / F.greatest(r, F.lit(0.1))
    ahead, side = x > 0.0, F.abs(y)
    oncoming = ahead & (side <= 5.5) & ((closing >= 0.5) | (vx <= -0.5))
    in_lane = ahead & (side <= p.corridor)
    leaving = (closing < -0.5) | (vx > 0.5)
    inward = ((y > 0.0) & (vy < -0.5)) | ((y < 0.0) & (vy > 0.5))
    enter = (side - p.corridor) / F.greatest(F.abs(vy), F.lit(0.1))
    meet = x + vx * enter
    crossing = (radius(vx, vy) >= 0.8) & (side > p.corridor) & (side <= 10.0) & inward & (meet >= 0.0) & (meet <= 25.0) & (enter <= 3.0)

    def said(reach: Column, kind: str) -> Column:
        return F.struct(F.lit(True).alias("is_threat"), F.least(reach, far).alias("reach"), bearing(x, y).alias("bearing"), F.lit(kind).alias("kind"))

    def none(kind: str) -> Column:
        return F.struct(F.lit(False).alias("is_threat"), F.lit(0.0).alias("reach"), F.lit(0.0).alias("bearing"), F.lit(kind).alias("kind"))

    return (
        F.when((r > far) | (r < 0.5), none("out of range"))
        .when(oncoming, said(r + 5.0, "A"))
        .when(in_lane & leaving, none("B rejected"))
        .when(in_lane & (r <= 25.0), said(r + 5.0, "B"))
        .when(crossing, said(F.abs(meet) + 4.0, "C"))
        .otherwise(none("none"))
    )


def lobe(t: Column, p: Fovea = FOVEA) -> Column:
    """A track's lobe: struct<height, at, sigma, factor, cap>, null without one. It does not depend on an angle.

    t: struct of class_id, x, y, vx, vy, bbox_l, bbox_w.
    """
    r, width = radius(t["x"], t["y"]), F.greatest(t["bbox_l"], t["bbox_w"])
    speed = radius(F.coalesce(t["vx"], F.lit(0.0)), F.coalesce(t["vy"], F.lit(0.0)))
    fast, far = (speed >= p.moving_speed) & F.lit(p.boost > 1.0), F.lit(p.farthest_threat)

    def made(height: Column, at: Column, sigma: Column, boosts: Column) -> Column:
        factor = F.when(boosts, F.lit(p.boost)).otherwise(1.0)
        return F.struct(height.alias("height"), at.alias("at"), sigma.alias("sigma"), factor.alias("factor"), F.when(boosts, far).otherwise(height).alias("cap"))

    if p.collision_only:
        found = threat(t["x"], t["y"], t["vx"], t["vy"], p)
        sigma = F.greatest(F.lit(0.35), width / F.greatest(r, F.lit(1.0)))
        out = F.when(found["is_threat"], made(found["reach"], found["bearing"], sigma, fast))
    else:
        sigma = F.greatest(width / F.greatest(r, F.lit(1.0)), F.lit(0.2))
        moves = (F.abs(t["vx"]) > 1e-3) | (F.abs(t["vy"]) > 1e-3)
        px, py = t["x"] + t["vx"] * p.lead_time, t["y"] + t["vy"] * p.lead_time
        reach = F.least(F.greatest(r, radius(px, py)) + p.buffer, far)
        still = made(F.least(r + 5.0, far), bearing(t["x"], t["y"]), sigma, F.lit(False))
        out = F.when(moves, made(reach, bearing(px, py), sigma, fast)).otherwise(still)
    return F.when(t["class_id"] == 3, out)


def height_at(theta: Column, x: Column) -> Column:
    return F.least(x["height"] * F.exp(-0.5 * F.pow(wrap(theta - x["at"]) / x["sigma"], F.lit(2.0))) * x["factor"], x["cap"])


def attention(theta: Column, lobes: Column) -> Column:
    """Height of the highest of an array of lobes at theta; 0 without any."""
    return F.coalesce(F.aggregate(lobes, F.lit(0.0), lambda top, x: F.greatest(top, height_at(theta, x))), F.lit(0.0))


def sector_of(theta: Column, n: int) -> Column:
    """Which of n equal sectors of the circle, from -pi on, theta lies in."""
    return F.least(F.greatest(F.floor((theta + F.pi()) / (2.0 * F.pi() / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def lobes_of_sector(lobes: Column, sector: Column, n: int) -> Column:
    """The lobes that can be the highest anywhere in a sector: the one that stays highest at its worst, and all that rise above that."""
    half = F.pi() / n + 1e-9
    middle = (sector + 0.5) * (2.0 * F.pi() / n) - F.pi()

    def off(x: Column) -> Column:
        return F.abs(wrap(middle - x["at"]))

    least = F.transform(lobes, lambda x: F.struct(height_at(x["at"] + F.least(off(x) + half, F.pi() - 1e-12), x).alias("height"), x.alias("lobe")))

    def kept(best: Column) -> Column:
        return F.concat(F.array(best["lobe"]), F.filter(lobes, lambda x: height_at(x["at"] + F.greatest(off(x) - half, F.lit(0.0)), x) > best["height"]))

    # bound by a lambda, so that the best is found once and not for each lobe
    return F.when(F.size(lobes) > 0, F.element_at(F.transform(F.array(F.array_max(least)), kept), 1)).otherwise(lobes)


def in_fine_zone(r: Column, theta: Column, speed: Column, steering: Column, lobes: Column | None = None, p: Fovea = FOVEA) -> Column:
    """r < fine_radius(theta), where lobes are looked at only for points between the ellipse and the farthest lobe."""
    inside = r < ellipse_radius(theta, speed, steering, p)
    if lobes is None or not p.enabled:
        return inside
    return F.when(inside, True).when(r >= p.farthest_threat, False).otherwise(F.coalesce(F.exists(lobes, lambda x: r < height_at(theta, x)), F.lit(False)))


def ellipse_radius(theta: Column, speed: Column, steering: Column, p: Fovea = FOVEA, shear: float | None = None) -> Column:
    b = F.lit(p.base_radius)
    a = b * stretch(speed, p)
    d = wrap(theta - steering * (p.shear if shear is None else shear))
    across, along = b * F.cos(d), a * F.sin(d)
    size = F.sqrt(across * across + along * along)
    size = F.when(size == 0, 1e-6).otherwise(size)
    return F.when(F.abs(d) < F.pi() / 2, a * b / size).otherwise(b)


def fine_radius(theta, speed="speed_mps", steering="steering_angle_rad", lobes: Column | None = None, p: Fovea = FOVEA, shear: float | None = None) -> Column:
    out = ellipse_radius(col(theta), col(speed), col(steering), p, shear)
    return F.greatest(out, attention(col(theta), lobes)) if lobes is not None and p.enabled else out


def polyline_angles(n: int = 120) -> Column:
    """n angles from -pi to pi, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: -F.pi() + i * (2.0 * F.pi() / (n - 1)))


def polyline(speed="speed_mps", steering="steering_angle_rad", lobes: Column | None = None, p: Fovea = FOVEA, n: int = 120, digits: int | None = 3) -> Column:
    """array of [x, y]; digits None leaves them unrounded."""
    cut = (lambda v: v) if digits is None else (lambda v: F.bround(v, digits))

    def point(theta):
        r = fine_radius(theta, speed, steering, lobes, p, p.drawn_shear)
        return F.array(cut(r * F.cos(theta)), cut(r * F.sin(theta)))

    return F.transform(polyline_angles(n), point)
