"""Sequences whose fine zone follows their tracks: one stateful processor for tables and streams.

A frame's fine zone depends on the tracks of the frame before, which come from the dynamic cells of its
own fine zone. Only that circle runs in the processor, sequence by sequence and frame by frame: the mean
fine radius of each angular sector, held against jitter, the dynamic cells under it, their clusters and the tracks.
What it hands on, the held radii and the tracks, makes all cells, footprints and ghosts of all
frames in one plan (closed_loop).

State: the last frame (value), the held radius of each sector (map), the tracks in their order (list). A
table's points of one place and class are counted by Spark and become one row; the rows are dealt by sequence and sorted
by frame, so that a task holds one frame's places at a time. In a stream,
a frame comes whole in one batch; a timer on the frames' event time forgets a sequence that is `idle` long over.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import atan2, hypot, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import HYSTERESIS, LEAST_RANGE, TIERS, Fovea
from ..functions import polar
from ..functions.fovea import sector_of
from . import cluster, project
from .checkpoint import kept
from .track import Track, footprints, ghost_counts, track_step, vacated

FIELDS = list(Track.__dataclass_fields__)
TRACK = (
    "track_id long, class_id int, x double, y double, vx double, vy double, pred_x double, pred_y double, frames_since_seen int, state string, hits int, "
    "bbox_l double, bbox_w double, p_pos double, p_cross double, p_vel double"
)
#: What the processor reads of a point, and n if a row stands for several; a frame's row without a point has a null r.
POINT = ["seq_id", "frame_id", "speed_mps", "steering_angle_rad", "r", "theta", "class_id"]
SIZES = np.array([size for _, size in TIERS])
#: Slices of a frame's points on their way to its speed, steering and roof.
SLICES = 32
#: Sectors whose lobes are compared together.
SECTORS_AT_ONCE = 64


def lobe_of(t: Track, p: Fovea) -> tuple[float, float, float, float, float] | None:
    """functions.fovea.lobe of one track: height, bearing, width, factor and cap."""
    if t.class_id != 3:
        return None
    r, side, width, far = hypot(t.x, t.y), abs(t.y), max(t.bbox_l, t.bbox_w), p.farthest_threat
    boosts = hypot(t.vx, t.vy) >= p.moving_speed and p.boost > 1.0
    if not p.collision_only:
        sigma = max(width / max(r, 1.0), 0.2)
        if abs(t.vx) <= 1e-3 and abs(t.vy) <= 1e-3:
            height = min(r + 5.0, far)
            return height, atan2(t.y, t.x), sigma, 1.0, height
        px, py = t.x + t.vx * p.lead_time, t.y + t.vy * p.lead_time
        height, at = min(max(r, hypot(px, py)) + p.buffer, far), atan2(py, px)
    else:
        if r > far or r < 0.5:
            return None
        closing, sigma, at = -(t.x * t.vx + t.y * t.vy) / max(r, 0.1), max(0.35, width / max(r, 1.0)), atan2(t.y, t.x)
        if t.x > 0 and side <= 5.5 and (closing >= 0.5 or t.vx <= -0.5):
            reach = r + 5.0
        elif t.x > 0 and side <= p.corridor:
            reach = r + 5.0 if r <= 25.0 and closing >= -0.5 and t.vx <= 0.5 else None
        else:
            reach = _crossing(t, p)
        if reach is None:
            return None
        height = min(reach, far)
    return height, at, sigma, p.boost if boosts else 1.0, far if boosts else height


def _crossing(t: Track, p: Fovea) -> float | None:
    side = abs(t.y)
    enter = (side - p.corridor) / max(abs(t.vy), 0.1)
    meet = t.x + t.vx * enter
    inward = (t.y > 0 and t.vy < -0.5) or (t.y < 0 and t.vy > 0.5)
    if hypot(t.vx, t.vy) >= 0.8 and p.corridor < side <= 10.0 and inward and 0.0 <= meet <= 25.0 and enter <= 3.0:
        return abs(meet) + 4.0
    return None


def _wrap(angle):
    return np.mod(angle + pi, 2 * pi) - pi


def fine_of(theta: np.ndarray, speed: float, steering: float, tracks: list[Track], p: Fovea) -> np.ndarray:
    """functions.fovea.fine_radius of one frame's angles."""
    b = p.base_radius
    a = b * (p.max_stretch if p.reference_speed == 0 else 1.0 + (p.max_stretch - 1.0) * min(max(speed / p.reference_speed, 0.0), 1.0))
    d = _wrap(theta - steering * p.shear)
    size = np.sqrt((b * np.cos(d)) ** 2 + (a * np.sin(d)) ** 2)
    out = np.where(np.abs(d) < pi / 2, a * b / np.where(size == 0, 1e-6, size), b)
    lobes = [v for v in (lobe_of(t, p) for t in tracks) if v] if p.enabled else []
    return raised(theta, out, np.array(lobes).T) if lobes and len(theta) else out


def _height(distance, lobes: np.ndarray) -> np.ndarray:
    height, _, sigma, factor, cap = lobes
    return np.minimum(height * np.exp(-0.5 * (distance / sigma) ** 2) * factor, cap)


def candidates_of(low: np.ndarray, centre: np.ndarray, lobes: np.ndarray) -> np.ndarray:
    """Whether each lobe (rows) may be the highest somewhere in each sector (columns), where it is at least low.

    A lobe that is nowhere above what another one is everywhere is left out; the other one stays.
    """
    column = lobes[:, :, None]
    away, half = np.abs(_wrap(centre - column[1])), pi / project.SECTORS + 1e-9
    least = _height(np.minimum(away + half, pi), column)
    may = _height(np.maximum(away - half, 0.0), column) > np.maximum(least.max(0), low)
    may[least.argmax(0), np.arange(len(centre))] = True
    return may


def raised(theta: np.ndarray, out: np.ndarray, lobes: np.ndarray) -> np.ndarray:
    """out, or the highest of the lobes (columns). An angle meets the lobes that may be the highest in its sector, not all of them."""
    width, out = 2 * pi / project.SECTORS, out.copy()
    sector = np.clip(np.floor((_wrap(theta) + pi) / width).astype(np.int64), 0, project.SECTORS - 1)
    order = np.argsort(sector, kind="stable")
    names, starts = np.unique(sector[order], return_index=True)
    lows, ends = np.minimum.reduceat(out[order], starts), np.r_[starts[1:], len(order)]
    for a in range(0, len(names), SECTORS_AT_ONCE):
        b = min(a + SECTORS_AT_ONCE, len(names))
        may = candidates_of(lows[a:b], (names[a:b] + 0.5) * width - pi, lobes)
        listed, many = np.argsort(~may, axis=0, kind="stable"), may.sum(0)
        here = order[starts[a] : ends[b - 1]]
        place = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
        for k in range(int(many.max())):
            left = many[place] > k
            here, place = here[left], place[left]
            one = lobes[:, listed[k, place]]
            out[here] = np.maximum(out[here], _height(_wrap(theta[here] - one[1]), one))
    return out


class Frame:
    """One frame's points at or below the roof: its angles and how many points each has, and its places with their class and points."""

    def __init__(self, points: pd.DataFrame, p: Fovea):
        self.speed, self.steering, self.p = float(points["speed_mps"].iloc[0]), float(points["steering_angle_rad"].iloc[0]), p
        points = points[points["r"].notna()]
        self.r, self.theta, self.classes = points["r"].to_numpy(float), points["theta"].to_numpy(float), points["class_id"].to_numpy(np.int64)
        self.n = points["n"].to_numpy(np.int64) if "n" in points else np.ones(len(points), np.int64)
        self.angles, angle = np.unique(self.theta, return_inverse=True)
        self.weights = np.bincount(angle, self.n, len(self.angles))
        self.names, self.sector = np.unique(np.rint(self.angles / HYSTERESIS.sector).astype(np.int64), return_inverse=True)
        self.place = self.sector[angle]

    def hold(self, tracks: list[Track], held: dict[int, float]) -> dict[int, float]:
        """The held radius of every sector that has points; held is brought up to date."""
        fine = fine_of(self.angles, self.speed, self.steering, tracks, self.p)
        means = np.bincount(self.sector, fine * self.weights, len(self.names)) / np.bincount(self.sector, self.weights, len(self.names))
        for s, mean in zip(self.names.tolist(), means.tolist(), strict=True):
            if s not in held or abs(mean - held[s]) >= HYSTERESIS.radius_margin:
                held[s] = mean
        return {s: held[s] for s in self.names.tolist()}

    def detections(self, fine: dict[int, float]) -> list[tuple[float, float, int]]:
        """Centroids of the clusters of dynamic cells."""
        if not len(self.r):
            return []
        inside = self.r < np.array([fine[s] for s in self.names.tolist()])[self.place]
        tier = np.where(inside, 0, np.where(self.r < TIERS[1][0], 1, 2))
        size = SIZES[tier]
        ring = np.trunc(self.r / size).astype(np.int64)
        angle = np.trunc(self.theta / (size / np.maximum(self.r, LEAST_RANGE))).astype(np.int64)
        pairs, pair = np.unique(np.stack([tier, ring, angle, self.classes]), axis=1, return_inverse=True)
        count = np.bincount(pair.ravel(), self.n, pairs.shape[1])
        order = np.lexsort((pairs[3], -count, pairs[2], pairs[1], pairs[0]))  # of a cell's classes the most frequent first, then the lowest
        pairs = pairs[:, order]
        first = np.r_[True, (np.diff(pairs[:3]) != 0).any(0)]
        tier, ring, angle, _ = pairs[:, first & (pairs[3] == 3)]
        if not len(tier):
            return []
        r = (ring + 0.5) * SIZES[tier]
        theta = (angle + 0.5) * (SIZES[tier] / np.maximum(r, LEAST_RANGE))
        x, y = r * np.cos(theta), r * np.sin(theta)
        _, part = np.unique(cluster.grid_components(x, y), return_inverse=True)
        n = np.bincount(part)
        order, starts = np.argsort(part, kind="stable"), np.cumsum(n) - n
        span = lambda v: np.maximum.reduceat(v[order], starts) - np.minimum.reduceat(v[order], starts)
        good = (n <= cluster.MOST_CELLS) & (span(x) <= cluster.WIDEST) & (span(y) <= cluster.WIDEST)
        return sorted((a, b, 3) for a, b in zip((np.bincount(part, x) / n)[good].tolist(), (np.bincount(part, y) / n)[good].tolist(), strict=True))


def step(frame: Frame, tracks: list[Track], held: dict[int, float], first: bool) -> tuple[dict[int, float], list[Track]]:
    """(held radii of the frame's sectors, tracks) after a frame. The first one is looked at again once its tracks are known."""
    fine = frame.hold(tracks, held)
    tracks = track_step(tracks, frame.detections(fine))
    return (frame.hold(tracks, held) if first else fine), tracks


class Loop(StatefulProcessor):
    """Rows (POINT and, with idle, event_time) of a sequence to its held radii (kind sector) and tracks (kind track).

    Frames up to the last one seen are left out, so that a replay changes nothing. ordered: rows come sorted by frame.
    """

    def __init__(self, p: Fovea, ordered: bool, idle: int | None = None):
        self.p, self.ordered, self.idle = p, ordered, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame_id int")
        self.held = handle.getMapState("held", "sector long", "radius double")
        self.tracks = handle.getListState("tracks", TRACK)

    def frames(self, parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        """Whole frames in their order; of sorted rows, one at a time."""
        if not self.ordered:
            parts = iter([pd.concat(list(parts)).sort_values("frame_id", kind="stable")])
        waiting: list[pd.DataFrame] = []
        for part in parts:
            for number, rows in part.groupby("frame_id", sort=False):
                if waiting and waiting[0]["frame_id"].iloc[0] != number:
                    if number < waiting[0]["frame_id"].iloc[0]:
                        raise ValueError("rows of a sequence must come sorted by frame")
                    yield int(waiting[0]["frame_id"].iloc[0]), pd.concat(waiting)
                    waiting = []
                waiting.append(rows)
        if waiting:
            yield int(waiting[0]["frame_id"].iloc[0]), pd.concat(waiting)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        held = {s[0]: r[0] for s, r in self.held.iterator()} if self.held.exists() else {}
        tracks = [Track(*t) for t in self.tracks.get()] if self.tracks.exists() else []
        was, latest = dict(held), None
        for number, points in self.frames(rows):
            if self.idle is not None:
                latest = max(filter(None, (latest, points["event_time"].max())))
            if last is not None and number <= last:
                continue
            fine, tracks = step(Frame(points, self.p), tracks, held, last is None)
            last = number
            yield pd.concat([
                pd.DataFrame({"seq_id": key[0], "frame_id": number, "kind": "sector", "sector": list(fine), "held": list(fine.values())}, columns=COLUMNS, dtype=object),
                pd.DataFrame([(key[0], number, "track", None, None, *(getattr(t, f) for f in FIELDS)) for t in tracks], columns=COLUMNS, dtype=object),
            ])
        if last is not None:
            self.last.update((last,))
        for s, r in held.items():
            if was.get(s) != r:
                self.held.updateValue((s,), (r,))
        self.tracks.clear()
        if tracks:
            self.tracks.put([tuple(getattr(t, f) for f in FIELDS) for t in tracks])
        if latest is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.last, self.held, self.tracks):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


COLUMNS = ["seq_id", "frame_id", "kind", "sector", "held", *FIELDS]


def schema_of(seq_kind: str) -> str:
    return f"seq_id {seq_kind}, frame_id int, kind string, sector long, held double, {TRACK}"


def loop_rows(points: DataFrame, frames: DataFrame) -> DataFrame:
    """POINT of the points at or below their frame's roof, and a row without a point for every frame. Points meet their frame slice by slice, so that it is spread over tasks."""
    slices = frames.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    rows = points.withColumn("_slice", F.coalesce(sector_of(polar.bearing(), SLICES), F.lit(0))).join(slices, ["seq_id", "frame_id", "_slice"]).filter("z <= roof").withColumn("r", polar.radius()).withColumn("theta", polar.bearing())
    return rows.select(POINT).unionByName(frames.select(*POINT[:4]), allowMissingColumns=True)


def places(rows: DataFrame) -> DataFrame:
    """One of equal rows, with their number n. Counted before rows are dealt, so that a sequence's task does not grow with points at places it has."""
    return rows.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"))


def loop_states(points: DataFrame, frames: DataFrame, p: Fovea = Fovea()) -> DataFrame:
    """Held radii and tracks of a table's frames (seq_id, frame_id, speed_mps, steering_angle_rad, roof)."""
    spark = points.sparkSession
    with_states(spark)
    dealt = places(loop_rows(points, frames)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id").sortWithinPartitions("seq_id", "frame_id")
    return dealt.groupBy("seq_id").transformWithStateInPandas(Loop(p, ordered=True), schema_of(dict(frames.dtypes)["seq_id"]), "append", "None")


def loop_stream(rows: DataFrame, p: Fovea = Fovea(), idle: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """Held radii and tracks of a stream of POINT and event_time; idle: milliseconds of event time after which a sequence is forgotten."""
    with_states(rows.sparkSession)
    rows = rows.select(*POINT, "event_time").withWatermark("event_time", delay)
    return rows.groupBy("seq_id").transformWithStateInPandas(Loop(p, ordered=False, idle=idle), schema_of(dict(rows.dtypes)["seq_id"]), "append", "EventTime")


def with_states(spark) -> None:
    """The store that keyed state of several kinds needs, for later queries of the session too; a batch query also needs the streams' manager to be there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.streams.active  # noqa: B018


def loop_cells(points: DataFrame, frames: DataFrame, states: DataFrame) -> DataFrame:
    """The cells of all frames under the held radii of loop_states.

    Points meet radius and roof by sector and are then dealt by cell, so that a frame is spread over tasks.
    """
    fine = states.filter("kind = 'sector'").select("seq_id", "frame_id", "sector", F.col("held").alias("fine"))
    fine = fine.join(frames.select("seq_id", "frame_id", "roof"), ["seq_id", "frame_id"])
    rows = points.withColumn("sector", F.rint(polar.bearing() / HYSTERESIS.sector).cast("long")).join(fine, ["seq_id", "frame_id", "sector"])
    return project.grid_cells(project.with_key(rows, F.col("r") < F.col("fine"), F.col("roof")))


def closed_loop(points: DataFrame, frames: DataFrame, p: Fovea = Fovea()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, tracks, ghosts) of all frames. frames: seq_id, frame_id, speed_mps, steering_angle_rad and roof."""
    frames = kept(frames)
    states = kept(loop_states(points, frames, p))
    tracks = states.filter("kind = 'track'").select("seq_id", "frame_id", *FIELDS)
    cells = kept(loop_cells(points, frames, states))
    centred = project.with_center(cells).withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    prints = kept(footprints(tracks, centred))
    return cells, tracks, ghost_counts(vacated(prints, frames, cells), frames)
