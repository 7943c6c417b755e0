"""Point classes without a model: a ground plane, a radial ground profile and height rules."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SEGMENTATION, Segmentation
from ..functions import polar
from .checkpoint import kept

FRAME = ["seq_id", "frame_id"]


def ground_planes(points: DataFrame, seed: int = 0, p: Segmentation = SEGMENTATION) -> DataFrame:
    """(seq_id, frame_id, a, b, c, d): the plane of three low points with most low points near it.

    Low points are those up to the 35th percentile of z (all, if these are under 10). Each frame has
    a generator seeded from `seed` and its key, so a rerun gives the same plane. Python draws ranks and spans planes by the
    drawn points; ranking and counting points is left to Spark, so that no task of Python holds a frame.
    """

    kinds = dict(points.dtypes)
    frame = f"seq_id {kinds['seq_id']}, frame_id {kinds['frame_id']}"
    w = Window.partitionBy(*FRAME)
    rows = points.select(*FRAME, "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).withColumns({"_at": F.row_number().over(w.orderBy("z")), "_n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("_cut", F.max(F.when(F.col("_at") <= F.floor((F.col("_n") - 1) * p.plane_percentile) + 1, F.col("z"))).over(w))
    rows = rows.withColumn("_low", F.count_if(F.col("z") <= F.col("_cut")).over(w)).filter((F.col("z") <= F.col("_cut")) | (F.col("_low") < 10))
    low = kept(rows.select(*FRAME, "_n", "x", "y", "z", (F.row_number().over(w.orderBy("point_id")) - 1).alias("rank")))

    def drawn(parts):
        for part in parts:
            for r in part.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(f"{r.seq_id}/{r.frame_id}".encode())])
                triples = np.stack([rng.choice(r.low, 3, replace=False) for _ in range(p.hypotheses)])
                yield pd.DataFrame({"seq_id": r.seq_id, "frame_id": r.frame_id, "rank": triples.ravel(), "drawn": np.arange(3 * p.hypotheses)})

    def spanned(corners: pd.DataFrame) -> pd.DataFrame:
        xyz = corners.sort_values("drawn")[["x", "y", "z"]].to_numpy(float).reshape(-1, 3, 3)
        a, b, c = xyz[:, 0], xyz[:, 1], xyz[:, 2]
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal, axis=1)
        normal = normal / np.where(size < 1e-6, 1.0, size)[:, None]
        normal *= np.where(normal[:, 2:] < 0, -1, 1)
        good = (size >= 1e-6) & (normal[:, 2] >= p.upright)
        out = pd.DataFrame(np.c_[normal, -(normal * a).sum(1)], columns=list("abcd")).assign(seq_id=corners.seq_id.iloc[0], frame_id=corners.frame_id.iloc[0], number=np.arange(len(xyz)))
        return out[good][["seq_id", "frame_id", "number", *"abcd"]]

    sizes = low.groupBy(*FRAME).agg(F.max("_n").alias("n"), F.count(F.lit(1)).alias("low")).filter("n >= 3")
    corners = low.join(sizes.mapInPandas(drawn, f"{frame}, rank int, drawn int"), [*FRAME, "rank"])
    planes = kept(corners.groupBy(*FRAME).applyInPandas(spanned, f"{frame}, number int, a double, b double, c double, d double"))
    off = F.abs(F.col("x") * F.col("a") + F.col("y") * F.col("b") + F.col("z") * F.col("c") + F.col("d"))
    counts = low.join(planes, FRAME).groupBy(*FRAME, "number").agg(F.count_if(off < p.inlier).alias("count")).filter("count > 0")
    best = counts.groupBy(*FRAME).agg((-F.max(F.struct("count", (-F.col("number")).alias("first")))["first"]).alias("number"))
    found = planes.join(best, [*FRAME, "number"])
    default = dict(zip("abcd", (0.0, 0.0, 1.0, 1.5), strict=True))
    return points.select(*FRAME).distinct().join(found, FRAME, "left").select(*FRAME, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()])


def plane_height(a="a", b="b", c="c", d="d") -> F.Column:
    """Height above the plane a x + b y + c z + d = 0."""
    c = polar.col(c)
    safe = F.greatest(F.abs(c), F.lit(1e-4)) * F.when(c >= 0, 1.0).otherwise(-1.0)
    return F.col("z") + (polar.col(a) * F.col("x") + polar.col(b) * F.col("y") + polar.col(d)) / safe


def sector_and_bin(p: Segmentation = SEGMENTATION) -> dict[str, F.Column]:
    turn = (polar.bearing() + F.pi()) / (2.0 * F.pi()) * p.sectors
    clip = lambda v, top: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(top)).cast("int")
    return {"sector": clip(turn, p.sectors - 1), "r_bin": clip(polar.radius() / p.bin_size, p.bins - 1)}


def fused(a: F.Column, b: F.Column, c: F.Column) -> F.Column:
    """a * b + c, rounded once: the product's error and the sum's are added at the end."""

    def halves(v):
        big = v * 134217729.0  # 2^27 + 1
        high = big - (big - v)
        return high, v - high

    (ah, al), (bh, bl), product = halves(a), halves(b), a * b
    total = product + c
    back = total - product
    return total + (((product - (total - back)) + (c - back)) + (((ah * bh - product) + ah * bl + al * bh) + al * bl))


def low_percentile(rows: DataFrame, key: list[str], value: str, share: float) -> DataFrame:
    """key, low and n: the percentile of value, between its two neighbours in rank as other engines round it, and the rows."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumns({"_at": F.row_number().over(w.orderBy(value)) - 1, "n": F.count(F.lit(1)).over(w)}).withColumn("_place", (F.col("n") - 1) * share)
    first = F.floor("_place")
    ranked = ranked.filter((F.col("_at") == first) | (F.col("_at") == first + 1))
    ends = ranked.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_place").alias("_place"), F.first("n").alias("n"))
    ends = ends.withColumn("_d", F.col("_place") - F.floor("_place")).withColumns({"_e": 1.0 - F.col("_d"), "_c": F.col("_hi") * F.col("_d")})
    return ends.select(*key, fused(F.col("_lo"), F.col("_e"), F.col("_c")).alias("low"), "n")


def ground_profile(rows: DataFrame, p: Segmentation = SEGMENTATION) -> DataFrame:
    """(seq_id, frame_id, sector, r_bin, offset) for every bin of every sector that has points.

    rows: seq_id, frame_id, sector, r_bin, h. A bin with enough candidates offers its 10th percentile
    of h, taken only if the step from the last offset is gentle; other bins keep the last one, first 0.
    """
    near = low_percentile(rows.filter("h >= -0.6 and h <= 0.5"), [*FRAME, "sector", "r_bin"], "h", p.percentile)
    near = near.filter(F.col("n") >= p.least_in_bin).select(*FRAME, "sector", "r_bin", "low")
    sectors = rows.select(*FRAME, "sector").distinct()
    offers = near.groupBy(*FRAME, "sector").agg(F.map_from_entries(F.collect_list(F.struct("r_bin", "low"))).alias("offers"))
    limit = p.slope * p.bin_size

    def step(acc, i):
        low = F.try_element_at(F.col("offers"), i)
        last = acc["last"]
        new = F.when(low.isNotNull() & (F.abs(low - last) <= limit), low).otherwise(last)
        return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("all"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(p.bins - 1)), start, step, lambda acc: acc["all"])
    out = sectors.join(offers, [*FRAME, "sector"], "left").withColumn("walked", walked)
    return out.select(*FRAME, "sector", F.posexplode("walked").alias("r_bin", "offset"))


def column_heights(rows: DataFrame) -> DataFrame:
    """rows with column_top, the largest height in their 0.5 m column of the frame."""
    gx, gy = F.floor(F.col("x") / 0.5), F.floor(F.col("y") / 0.5)
    return rows.withColumn("column_top", F.max("height").over(Window.partitionBy(*FRAME, gx, gy)))


def label(p: Segmentation = SEGMENTATION) -> F.Column:
    """Class from height, column_top, x and y."""
    h, side = F.col("height"), F.abs("y")
    r = polar.radius()
    ground = (h >= -0.28) & (h <= 0.22)
    moving = (r >= 2.5) & (r <= 45.0) & (side <= p.road_half_width + 0.3) & (h >= 0.35) & (h <= 2.2) & (F.col("column_top") <= 2.30)
    return F.when(ground & (side <= p.road_half_width) & (h <= 0.12), 0).when(ground, 1).when(moving, 3).otherwise(2)


def heuristic_labels(points: DataFrame, planes: DataFrame | None = None, seed: int = 0, p: Segmentation = SEGMENTATION) -> DataFrame:
    """points with h (above the plane), height (above the profile), column_top and label."""
    planes = ground_planes(points, seed, p) if planes is None else planes
    rows = points.join(planes, FRAME).withColumn("h", plane_height()).drop("a", "b", "c", "d").withColumns(sector_and_bin(p))
    rows = rows.join(ground_profile(rows, p), [*FRAME, "sector", "r_bin"], "left")
    rows = rows.withColumn("height", F.col("h") - F.coalesce("offset", F.lit(0.0)))
    return column_heights(rows).withColumn("label", label(p))


def classified(points: DataFrame, seed: int = 0) -> DataFrame:
    """points with a class for every row, by frame: raw ids are collapsed where any is above 3, classes kept as they are, and a frame without any (-1 all over) is segmented."""
    from ..functions.labels import collapse

    w = Window.partitionBy(*FRAME)
    rows = points.withColumn("_top", F.max("class_id").over(w)).withColumn("_low", F.min("class_id").over(w))
    bare = (F.col("_top") == -1) & (F.col("_low") == -1)
    known = rows.filter(~bare).withColumn("class_id", F.when(F.col("_top") > 3, collapse("class_id")).otherwise(F.col("class_id")))
    guessed = heuristic_labels(rows.filter(bare), seed=seed).withColumn("class_id", F.col("label"))
    return known.select(points.columns).unionByName(guessed.select(points.columns))


def model_labels(points: DataFrame, load, chunk_degrees: float = 90.0) -> DataFrame:
    """points with pred, the arg max of a model's scores. load() gives a function from (n, 3) coordinates to (n, classes).

    The model sees one chunk of azimuth of one frame at a time. An angle of exactly 360 degrees belongs to the last chunk.
    """
    chunk = F.least(F.floor((F.degrees(polar.bearing()) + 180.0) / chunk_degrees), F.lit(int(np.ceil(360 / chunk_degrees)) - 1))
    cache: list = []

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if not cache:
            cache.append(load())
        scores = cache[0](group[["x", "y", "z"]].to_numpy(np.float32))
        return group.drop(columns="_chunk").assign(pred=np.asarray(scores).argmax(-1).astype("int32"))

    schema = ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", pred int"
    return points.withColumn("_chunk", chunk).groupBy(*FRAME, "_chunk").applyInPandas(run, schema)
