"""The stateful operators on streams: the steps are those of the batch folds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import HYSTERESIS, ROOF, TIERS, TRACKING, Hysteresis, Tracking
from ..operators.hysteresis import hold
from ..operators.track import Track, track_step

FIELDS = list(Track.__dataclass_fields__)
TRACKS = (
    "seq_id string, frame_id int, track_id long, class_id int, x double, y double, vx double, vy double, pred_x double, pred_y double, frames_since_seen int, state string, hits int, "
    "bbox_l double, bbox_w double, p_pos double, p_cross double, p_vel double"
)


def stateful(rows: DataFrame, keys: list[str], step: Callable, schema: str) -> DataFrame:
    """Runs step(state, frame_id, rows of the frame) -> (state, output rows) frame by frame for each key.

    A frame's rows must come in one batch; frames up to the last one seen are dropped, so that a
    replay changes nothing.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, memory = (-1, None) if not state.exists else pickle.loads(state.get[0])
        out = []
        for frame, group in pd.concat(list(parts)).groupby("frame_id", sort=True):
            if frame > last:
                memory, made = step(key, memory, frame, group)
                out += made
                last = frame
        state.update((pickle.dumps((last, memory)),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "memory binary", "append", GroupStateTimeout.NoTimeout)


def track_stream(detections: DataFrame, k: Tracking = TRACKING) -> DataFrame:
    """Tracks of a stream of seq_id, frame_id, x, y, class_id; a frame without detections is one row with a null x."""

    def step(key, tracks, frame, group):
        group = group[group["x"].notna()].sort_values(["x", "y"])
        tracks = track_step(tracks or [], list(zip(group["x"], group["y"], group["class_id"].astype(int), strict=True)), k)
        return tracks, [(key[0], int(frame), *(getattr(t, f) for f in FIELDS)) for t in tracks]

    return stateful(detections, ["seq_id"], step, TRACKS)


def radius_stream(sectors: DataFrame, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """Held radii of a stream of seq_id, sector, frame_id, radius."""

    def step(key, held, frame, group):
        held = hold(held, float(group["radius"].iloc[0]), p.radius_margin)
        return held, [(key[0], int(key[1]), int(frame), held)]

    return stateful(sectors, ["seq_id", "sector"], step, "seq_id string, sector long, frame_id int, held double")


def tier_stream(rows: DataFrame, boundary: float = TIERS[0][0], p: Hysteresis = HYSTERESIS) -> DataFrame:
    """Tier sizes of a stream of seq_id, place, frame_id, range_m that change only beyond the margin."""
    inner, outer = TIERS[0][1], TIERS[1][1]

    def step(key, tier, frame, group):
        r = float(group["range_m"].iloc[0])
        if tier is None:
            tier = inner if r < boundary else outer
        elif abs(r - boundary) > p.radius_margin:
            tier = outer if r > boundary else inner
        return tier, [(key[0], int(key[1]), int(frame), tier)]

    return stateful(rows, ["seq_id", "place"], step, "seq_id string, place long, frame_id int, tier double")


def clip_stream(rows: DataFrame, roof: float = ROOF, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """Whether places of a stream of seq_id, place, frame_id, z_max are clipped: beyond the margin at once, within it from the second frame on."""

    def step(key, above, frame, group):
        z = float(group["z_max"].iloc[0])
        above = (above or 0) + 1 if z > roof else 0
        return above, [(key[0], int(key[1]), int(frame), above, z > roof + p.clip_margin or above >= p.clip_after)]

    return stateful(rows, ["seq_id", "place"], step, "seq_id string, place long, frame_id int, above_frames long, clipped boolean")


def degraded_stream(cells: DataFrame, p: Hysteresis = HYSTERESIS) -> DataFrame:
    """Cells of a stream of seq_id, ring_idx, angle_idx, tier_idx, frame_id, point_count, confidence, resolution_tier; long sparse places are marked down.

    A place that does not appear keeps its count, so states stay: choose the RocksDB state store for large areas.
    """

    def step(key, low, frame, group):
        out, low = [], low or 0
        for c in group.sort_values("tier_idx").itertuples(index=False):
            low = low + 1 if c.point_count < p.least_points else 0
            bad = low >= p.degraded_after
            made = (3, 0.3, TIERS[-1][1]) if bad else (int(c.point_count), c.confidence, c.resolution_tier)
            out.append((key[0], int(key[1]), int(key[2]), int(c.tier_idx), int(frame), *made, bad))
        return low, out

    schema = "seq_id string, ring_idx long, angle_idx long, tier_idx int, frame_id int, point_count long, confidence double, resolution_tier double, degraded boolean"
    return stateful(cells, ["seq_id", "ring_idx", "angle_idx"], step, schema)


def vacated_stream(rows: DataFrame) -> DataFrame:
    """What became of the cells that tracks left, as track.vacated has it.

    rows: a stream of seq_id, frame_id, track_id, tier_idx, ring_idx, angle_idx, semantic_class,
    last_updated_frame: a frame's cells with a null track_id, and a row for each cell of a track's
    footprint. A sequence's state is the footprints of its last frame.
    """
    cell = ["tier_idx", "ring_idx", "angle_idx"]

    def step(key, before, frame, group):
        of_track = group["track_id"].notna()
        places = group[of_track].astype({c: "int64" for c in ["track_id", *cell]})
        now = set(places[["track_id", *cell]].itertuples(index=False, name=None))
        left = sorted((before or set()) - now)
        wanted = {c[1:] for c in left}
        cells = group[~of_track][[*cell, "semantic_class", "last_updated_frame"]].itertuples(index=False, name=None)
        there = {c[:3]: c[3:] for c in cells if c[:3] in wanted}
        out = []
        for track_id, *place in left:
            kind, updated = there.get(tuple(place), (None, None))
            outcome = "gone" if kind is None else "other" if kind != 3 else "stale" if updated < frame else "kept"
            out.append((key[0], int(frame), track_id, *place, outcome, outcome != "kept"))
        return now, out

    return stateful(rows, ["seq_id"], step, "seq_id string, frame_id int, track_id long, tier_idx int, ring_idx long, angle_idx long, outcome string, erased boolean")


def send(payload: DataFrame, put: Callable[[int, DataFrame], None], trigger: dict, checkpoint: str):
    """Starts a query that hands each batch of compressed frames to put(batch id, messages)."""
    from ..operators.payload import compressed

    def batch(df: DataFrame, number: int) -> None:
        put(number, compressed(df))

    return payload.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
