"""Constant-velocity Kalman tracks and their footprints.

x and y share one variance block (p, c, v) of position, cross term and velocity, as the noise is
alike in both and never couples them; so the filter has a closed form without matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import TRACKING, Tracking
from ..functions import polar
from .cluster import around, bucket


@dataclass
class Track:
    track_id: int
    class_id: int
    x: float
    y: float
    vx: float = 0.0
    vy: float = 0.0
    pred_x: float = 0.0
    pred_y: float = 0.0
    frames_since_seen: int = 0
    state: str = "TENTATIVE"
    hits: int = 1
    bbox_l: float = 4.0
    bbox_w: float = 2.0
    p_pos: float = TRACKING.first_position
    p_cross: float = 0.0
    p_vel: float = TRACKING.first_velocity


def predicted(t: Track, k: Tracking = TRACKING) -> Track:
    dt = k.dt
    return replace(
        t, x=t.x + t.vx * dt, y=t.y + t.vy * dt, p_pos=t.p_pos + 2 * dt * t.p_cross + dt * dt * t.p_vel + k.position_noise,
        p_cross=t.p_cross + dt * t.p_vel, p_vel=t.p_vel + k.velocity_noise,
    )


def corrected(t: Track, x: float, y: float, class_id: int, k: Tracking = TRACKING) -> Track:
    """A predicted track after its measurement."""
    s = t.p_pos + k.measurement_noise
    a, b = t.p_pos / s, t.p_cross / s
    dx, dy, hits = x - t.x, y - t.y, t.hits + 1
    return replace(
        t, x=t.x + a * dx, y=t.y + a * dy, vx=t.vx + b * dx, vy=t.vy + b * dy, p_pos=(1 - a) * t.p_pos, p_cross=(1 - a) * t.p_cross, p_vel=t.p_vel - b * t.p_cross,
        class_id=class_id, hits=hits, frames_since_seen=0, state="CONFIRMED" if hits >= k.hits_to_confirm else t.state,
    )


def gated_costs(tracks: list[Track], x: np.ndarray, y: np.ndarray, k: Tracking = TRACKING) -> np.ndarray:
    """Squared Mahalanobis distances of predicted tracks (rows) to detections; infinite outside the gates."""
    if not tracks or not len(x):
        return np.full((len(tracks), len(x)), np.inf)
    of = lambda name: np.array([getattr(t, name) for t in tracks])[:, None]
    d2 = (x[None] - of("x")) ** 2 + (y[None] - of("y")) ** 2
    m2 = d2 / (of("p_pos") + k.measurement_noise)
    gate = np.where(of("state") == "CONFIRMED", k.gate_confirmed, k.gate_tentative)
    return np.where((m2 < gate) & (np.sqrt(d2) <= k.farthest), m2, np.inf)


def blocks(cost: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of the finite costs."""
    rows, cols = np.nonzero(np.isfinite(cost))
    part = np.arange(cost.shape[0])
    while True:
        of_col = np.full(cost.shape[1], cost.shape[0])
        np.minimum.at(of_col, cols, part[rows])
        least = part.copy()
        np.minimum.at(least, rows, of_col[cols])
        if (least == part).all():
            break
        part = least
    order = np.argsort(part[rows], kind="stable")
    cuts = np.flatnonzero(np.diff(part[rows][order])) + 1
    return [(np.unique(rows[e]), np.unique(cols[e])) for e in np.split(order, cuts) if len(e)]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns: as many finite ones as possible, of these the least total cost."""
    row, col = np.nonzero(np.isfinite(cost))
    return assign_pairs(row, col, cost[row, col])


def candidates(tracks: list[Track], x: np.ndarray, y: np.ndarray, k: Tracking = TRACKING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gated_costs as rows, columns and costs of the finite ones: detections are looked up in squares as wide as the widest gate."""
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    if not tracks or not len(x):
        return none
    tx, ty, p = (np.array([getattr(t, name) for t in tracks], float) for name in ("x", "y", "p_pos"))
    spread, gate = p + k.measurement_noise, np.where([t.state == "CONFIRMED" for t in tracks], k.gate_confirmed, k.gate_tentative)
    far = np.minimum(np.sqrt(np.maximum(gate * spread, 0)), k.farthest)
    seen, known = np.flatnonzero(np.isfinite(x) & np.isfinite(y)), np.flatnonzero(np.isfinite(tx) & np.isfinite(ty) & (far > 0))
    if not len(seen) or not len(known):
        return none
    side = float(far[known].max()) * (1 + 1e-9)
    squares = lambda v: np.floor(v / side)
    seen = seen[np.lexsort((squares(y[seen]), squares(x[seen])))]
    strips, starts = np.unique(squares(x[seen]), return_index=True)
    across = squares(y[seen])
    ends = np.r_[starts[1:], len(seen)]
    out: list[tuple] = [none]
    for ox in (-1, 0, 1):
        at = np.searchsorted(strips, squares(tx[known]) + ox)
        here = at < len(strips)
        here[here] = strips[at[here]] == squares(tx[known][here]) + ox
        for s in np.unique(at[here]):
            rows = known[here & (at == s)]
            strip = across[starts[s] : ends[s]]
            low, high = (np.searchsorted(strip, squares(ty[rows]) + o, e) + starts[s] for o, e in ((-1, "left"), (1, "right")))
            n = high - low
            row = np.repeat(rows, n)
            col = seen[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(row))]
            d2 = (x[col] - tx[row]) ** 2 + (y[col] - ty[row]) ** 2
            m2 = d2 / spread[row]
            good = (m2 < gate[row]) & (np.sqrt(d2) <= k.farthest)
            out.append((row[good], col[good], m2[good]))
    row, col, m2 = map(np.concatenate, zip(*out, strict=True))
    order = np.lexsort((col, row))
    return row[order], col[order], m2[order]


def assign_pairs(row: np.ndarray, col: np.ndarray, cost: np.ndarray) -> list[tuple[int, int]]:
    """assign, of the finite costs alone: memory and work follow them and not rows times columns.

    Successive shortest paths with potentials over a heap, a row of the shorter side at a time. A row may also stay alone, at one
    large cost, which ends a path as a free column does.
    """
    if not len(row):
        return []
    rows, r = np.unique(row, return_inverse=True)
    cols, c = np.unique(col, return_inverse=True)
    turned = len(rows) > len(cols)
    if turned:
        rows, cols, r, c = cols, rows, c, r
    order = np.lexsort((c, r))
    r, c, cost = r[order], c[order], np.asarray(cost, float)[order]
    starts = np.searchsorted(r, np.arange(len(rows) + 1)).tolist()
    alone = (cost.max() + 1.0) * (len(rows) + 1)
    row_price, col_price = [0.0] * len(rows), np.zeros(len(cols))
    owner, mate = [-1] * len(cols), [-1] * len(rows)
    dist, before = np.full(len(cols), np.inf), np.full(len(cols), -1)
    for i in range(len(rows)):
        at, far, heap, done, touched = i, 0.0, [], [], []
        best, last = np.inf, -1  # the cheapest row to leave alone
        while True:
            a, b = starts[at], starts[at + 1]
            near = c[a:b]
            if far + alone - row_price[at] < best:
                best, last = far + alone - row_price[at], at
            there = cost[a:b] - col_price[near] + (far - row_price[at])
            better = there < dist[near]
            near, there = near[better], there[better]
            dist[near], before[near] = there, at
            touched.append(near)
            for entry in zip(there.tolist(), near.tolist(), strict=True):
                heappush(heap, entry)
            while heap and heap[0][0] > dist[heap[0][1]]:
                heappop(heap)
            if not heap or heap[0][0] >= best:
                far, to = best, -1
                break
            far, to = heappop(heap)
            if owner[to] < 0:
                break
            done.append((to, far))
            dist[to] = -np.inf  # not to be reached again
            at = owner[to]
        row_price[i] += far
        for j, d in done:
            row_price[owner[j]] += far - d
            col_price[j] -= far - d
        at = last if to < 0 else int(before[to])
        if to < 0:
            to, mate[at] = mate[at], -1  # it gives its column, if it has one, to the row before on the path
            at = int(before[to]) if to >= 0 else i
        while to >= 0:
            owner[to], mate[at], to = at, to, mate[at]
            at = int(before[to]) if to >= 0 else at
        for near in touched:
            dist[near] = np.inf
    pairs = [(int(rows[i]), int(cols[j])) for i, j in enumerate(mate) if j >= 0]
    return sorted((j, i) for i, j in pairs) if turned else pairs


def assign_block(cost: np.ndarray) -> list[tuple[int, int]]:
    """assign on the whole matrix, for parts small enough to hold all their costs.

    Successive shortest paths with potentials, a row at a time; infinite costs count as one large number.
    """
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    finite = np.isfinite(c)
    c = np.where(finite, c, (c[finite].max() + 1.0) * (min(c.shape) + 1))
    n, m = c.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the row of each column; column m starts a path
    for i in range(n):
        owner[m], at = i, m
        dist, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            r = owner[at]
            slack = c[r] - row_price[r] - col_price[:m]
            better = ~done[:m] & (slack < dist)
            dist[better], before[better] = slack[better], at
            free = np.where(done[:m], np.inf, dist)
            to = int(free.argmin())
            step = free[to]
            row_price[owner[done]] += step
            col_price[done] -= step
            dist[~done[:m]] -= step
            at = to
        while at != m:
            prior = before[at]
            owner[at] = owner[prior]
            at = prior
        owner[m] = -1
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0 and finite[owner[j], j]]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def track_step(tracks: list[Track], detections: list[tuple[float, float, int]], k: Tracking = TRACKING) -> list[Track]:
    """Tracks after one frame: matched ones, then coasting ones, then new ones."""
    ahead = [predicted(t, k) for t in tracks]
    x, y = (np.array([d[i] for d in detections], float) for i in (0, 1))
    pairs = assign_pairs(*candidates(ahead, x, y, k))
    rows, cols = {i for i, _ in pairs}, {j for _, j in pairs}
    out = [corrected(ahead[i], *detections[j], k) for i, j in pairs]
    coasting = [replace(t, frames_since_seen=t.frames_since_seen + 1) for i, t in enumerate(ahead) if i not in rows]
    out += [t for t in coasting if t.frames_since_seen <= k.coast]
    fresh = max((t.track_id for t in tracks), default=0) + 1
    for j, (dx, dy, c) in enumerate(detections):
        if j not in cols:
            out.append(Track(fresh, c, dx, dy))
            fresh += 1
    return [replace(t, pred_x=t.x + t.vx * k.dt, pred_y=t.y + t.vy * k.dt) for t in out]


def track(detections: DataFrame, frames: DataFrame, k: Tracking = TRACKING, confirmed_only: bool = False) -> DataFrame:
    """Tracks of every frame. detections: seq_id, frame_id, x, y, class_id; frames: seq_id, frame_id, also those without any.

    A sequence is one fold, as its frames depend on each other; sequences run beside each other.
    """
    fields = list(Track.__dataclass_fields__)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, tracks = pd.concat(list(parts)), []
        seq = group.seq_id.iloc[0]
        for frame, part in group.groupby("frame_id", sort=True):
            part = part[part["x"].notna()].sort_values(["x", "y"])
            tracks = track_step(tracks, list(zip(part["x"], part["y"], part["class_id"].astype(int), strict=True)), k)
            rows = [(seq, frame, *(getattr(t, f) for f in fields)) for t in tracks if t.state == "CONFIRMED" or not confirmed_only]
            yield pd.DataFrame(rows, columns=["seq_id", "frame_id", *fields])  # a frame at a time, so that no sequence's tracks stand in memory at once

    joined = frames.select("seq_id", "frame_id").distinct().join(detections.select("seq_id", "frame_id", "x", "y", "class_id"), ["seq_id", "frame_id"], "left")
    kinds = dict(joined.dtypes)
    schema = (
        f"seq_id {kinds['seq_id']}, frame_id {kinds['frame_id']}, track_id long, class_id int, x double, y double, vx double, vy double, pred_x double, pred_y double, "
        "frames_since_seen int, state string, hits int, bbox_l double, bbox_w double, p_pos double, p_cross double, p_vel double"
    )
    return joined.groupBy("seq_id").applyInPandas(run, schema)


def association_candidates(tracks: DataFrame, detections: DataFrame, k: Tracking = TRACKING, on: list[str] = ["frame_id"]) -> DataFrame:  # noqa: B006
    """Gated pairs of predicted tracks (with p_pos and state) and detections, by buckets of the farthest distance."""
    left = bucket(tracks, k.farthest)
    right = around(bucket(detections.select(*on, "det_id", F.col("x").alias("dx"), F.col("y").alias("dy")), k.farthest, "dx", "dy"))
    ox, oy = F.col("dx") - F.col("x"), F.col("dy") - F.col("y")
    d2 = ox * ox + oy * oy
    gate = F.when(F.col("state") == "CONFIRMED", k.gate_confirmed).otherwise(k.gate_tentative)
    pairs = left.join(right, [*on, "bx", "by"]).withColumn("d2", d2).withColumn("m2", F.col("d2") / (F.col("p_pos") + k.measurement_noise))
    return pairs.filter((F.col("m2") < gate) & (F.sqrt("d2") <= k.farthest)).drop("bx", "by")


def moving_objects(tracks: DataFrame) -> DataFrame:
    """Dynamic tracks with speed, heading, next position, and whether they move or threaten."""
    from ..config import FOVEA
    from ..functions.fovea import threat

    speed = polar.radius("vx", "vy")
    rows = tracks.filter("class_id = 3").withColumn("speed_mps", speed).withColumn("_t", threat())
    return rows.withColumns({
        "heading_rad": F.when(F.col("speed_mps") > 1e-3, F.atan2("vy", "vx")).otherwise(0.0),
        "next_x": F.col("x") + F.col("vx") * 0.1, "next_y": F.col("y") + F.col("vy") * 0.1,
        "is_moving": F.col("speed_mps") >= FOVEA.moving_speed, "is_collision_threat": F.col("_t.is_threat"), "threat_reach_m": F.col("_t.reach"),
    }).drop("_t")


#: Side in m of the squares that cells are looked up by.
SQUARE = 4.0


def footprints(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """(seq_id, frame_id, track_id, cell key): dynamic cells within a track's larger box side of its position.

    cells: with their centre cx, cy. Each track is sought in all squares that its reach touches, however large its box is.
    """
    frame = ["seq_id", "frame_id"]
    cell = ["tier_idx", "ring_idx", "angle_idx"]
    left = bucket(cells.filter("semantic_class = 3").select(*frame, *cell, "cx", "cy"), SQUARE, "cx", "cy")
    right = tracks.select(*frame, "track_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.greatest("bbox_l", "bbox_w").alias("reach")).filter("reach >= 0")
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / SQUARE), F.floor((F.col(c) + F.col("reach")) / SQUARE)))
    right = right.withColumn("bx", touched("tx")).withColumn("by", touched("ty"))
    dx, dy = F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty")
    return left.join(right, [*frame, "bx", "by"]).filter(dx * dx + dy * dy <= F.col("reach") * F.col("reach")).select(*frame, "track_id", *cell)


def vacated(prints: DataFrame, frames: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that a track had in the frame before and has no more, with what became of them.

    outcome: gone (no such cell now), stale (still dynamic but not updated in this frame: it is
    erased), kept (still dynamic and updated: not counted) or other (another class). erased: counted.
    """
    frame, cell = ["seq_id", "frame_id"], ["tier_idx", "ring_idx", "angle_idx"]
    # the next frame that the sequence has, whatever its number
    order = Window.partitionBy("seq_id").orderBy("frame_id")
    following = frames.select(*frame).distinct().withColumn("_next", F.lead("frame_id").over(order)).filter("_next is not null")
    before = prints.join(following, frame).drop("frame_id").withColumnRenamed("_next", "frame_id").select(prints.columns)
    left = before.join(prints, [*frame, "track_id", *cell], "left_anti")
    now = cells.select(*frame, *cell, "semantic_class", "last_updated_frame")
    rows = left.join(now, [*frame, *cell], "left")
    outcome = F.when(F.col("semantic_class").isNull(), "gone").when(F.col("semantic_class") != 3, "other").when(F.col("last_updated_frame") < F.col("frame_id"), "stale").otherwise("kept")
    return rows.select(*frame, "track_id", *cell, outcome.alias("outcome")).withColumn("erased", F.col("outcome") != "kept")


def erased_cells(cells: DataFrame, vacated_cells: DataFrame) -> DataFrame:
    """cells with stale ghosts turned into drivable ground without an overhang top."""
    frame, cell = ["seq_id", "frame_id"], ["tier_idx", "ring_idx", "angle_idx"]
    stale = vacated_cells.filter("outcome = 'stale'").select(*frame, *cell).distinct().withColumn("_stale", F.lit(True))
    rows = cells.join(stale, [*frame, *cell], "left")
    return rows.withColumns({
        "semantic_class": F.when(F.col("_stale"), 0).otherwise(F.col("semantic_class")),
        "elevation_obstacle_top": F.when(F.col("_stale"), None).otherwise(F.col("elevation_obstacle_top")),
    }).drop("_stale")


def ghost_counts(vacated_cells: DataFrame, frames: DataFrame) -> DataFrame:
    counts = vacated_cells.groupBy("seq_id", "frame_id").agg(F.count_if("erased").alias("ghosts"))
    return frames.select("seq_id", "frame_id").distinct().join(counts, ["seq_id", "frame_id"], "left").withColumn("ghosts", F.coalesce("ghosts", F.lit(0)))
