"""What a service asks for: listings, contours, frames, playback."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config
from .functions.fovea import polyline

#: Sequence ids come as "7", "07" or behind a word, like "seq_07".
ALIAS = r"^(?:[A-Za-z_]*_)?(\d{1,2})$"


def health(spark: SparkSession) -> dict:
    return {"status": "ok", "timestamp": datetime.now(UTC).timestamp(), "spark": spark.version}


def settings(path: str | None = None) -> dict:
    """All settings that hold, those of a file where one is given."""
    held = config.load(path or "")
    return {n: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v for n, v in held.items()}


def contour(spark: SparkSession, speed_mps: float = 10.0, steering_angle_rad: float = 0.0, base_radius_m: float = 10.0, max_stretch: float = 2.5, shear_strength: float = 0.6) -> DataFrame:
    """(k, x, y): the 120 points of the fine zone's outline."""
    p = dataclasses.replace(config.FOVEA, base_radius=base_radius_m, max_stretch=max_stretch, drawn_shear=shear_strength)
    line = spark.range(1).select(F.posexplode(polyline(F.lit(float(speed_mps)), F.lit(float(steering_angle_rad)), p=p)).alias("k", "p"))
    return line.select("k", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def frame(spark: SparkSession, written: DataFrame | None, name: str, frame_id: int, compute: Callable[[str, int], DataFrame]) -> DataFrame:
    """The payload of one frame by the sequence's id or alias: the written one, or computed where there is none.

    Written frames without an outline get it from their speed and steering. No row: there is no such frame.
    """
    seq_id = spark.range(1).select(resolve(F.lit(name))).first()[0]
    if written is not None:
        found = written.filter((F.col("seq_id") == seq_id) & (F.col("frame_id") == frame_id)).limit(1)
        if not found.isEmpty():
            state = F.col("vehicle_state")
            drawn = polyline(state["speed_mps"], state["steering_angle_rad"])
            return found.withColumn("fovea_polyline", F.when(F.size("fovea_polyline") > 0, F.col("fovea_polyline")).otherwise(drawn))
    return compute(seq_id, frame_id)


def sequences(frames: DataFrame, written: DataFrame) -> DataFrame:
    """(seq_id, scans, precomputed)."""
    there = written.select("seq_id").distinct().withColumn("_there", F.lit(True))
    rows = frames.groupBy("seq_id").agg(F.countDistinct("frame_id").alias("scans"))
    return rows.join(there, "seq_id", "left").select("seq_id", "scans", F.coalesce("_there", F.lit(False)).alias("precomputed"))


def scenarios(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """One playlist: real sequences first."""
    a = real.select(F.col("seq_id").cast("string").alias("id"), F.lit("real").alias("kind"))
    return a.unionByName(synthetic.select(F.col("seq_id").cast("string").alias("id"), F.lit("synthetic").alias("kind")))


def scoped(playlist: DataFrame, scope: str = "all") -> DataFrame:
    """The part of a playlist (id, kind, precomputed) that a scope plays: all, real or ready (precomputed or synthetic).

    A scope that holds nothing plays all. A playlist is short: one task looks at it.
    """
    holds = {"all": F.lit(True), "real": F.col("kind") == "real", "ready": F.col("precomputed") | (F.col("kind") == "synthetic")}[scope]
    whole = Window.partitionBy(F.lit(0))
    rows = playlist.withColumn("_in", F.coalesce(holds, F.lit(False)))
    return rows.filter(F.col("_in")).unionByName(rows.withColumn("_any", F.bool_or("_in").over(whole)).filter("not _any").drop("_any")).drop("_in")


def resolve(name="name") -> F.Column:
    """A sequence id from its alias, two digits; other names stay as they are."""
    n = F.col(name) if isinstance(name, str) else name
    found = F.regexp_extract(n, ALIAS, 1)
    return F.when(found == "", n).otherwise(F.lpad(found, 2, "0"))


def neighbours(playlist: DataFrame) -> DataFrame:
    """playlist (seq_id, ...) with next_id and prev_id, in a circle. A playlist is short: one task orders it."""
    w = Window.orderBy("seq_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return playlist.withColumns({
        "next_id": F.coalesce(F.lead("seq_id").over(w), F.first("seq_id").over(whole)), "prev_id": F.coalesce(F.lag("seq_id").over(w), F.last("seq_id").over(whole)),
    })


def newest(rows: DataFrame, keys: list[str], order: str, keep: int = 2) -> DataFrame:
    """The last rows of each key: a queue that drops its oldest."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_n") <= keep).drop("_n")


def playback_step(state: tuple | None, command: str, value: int, frames: int, scenarios: int) -> tuple:
    """(scenario, frame, playing, loop) after a command; a step past the end stays, or goes on to the next scenario with loop."""
    s, f, playing, loop = state or (0, 0, True, True)
    if command == "set_scenario":
        s, f = value % scenarios, 0
    elif command == "next_scenario":
        s, f = (s + 1) % scenarios, 0
    elif command == "prev_scenario":
        s, f = (s - 1) % scenarios, 0
    elif command == "set_auto_loop":
        loop = value % 2 == 1
    elif command == "play":
        playing = True
    elif command == "pause":
        playing = False
    elif command == "seek":
        f = min(max(value, 0), frames - 1)
    elif command == "step":
        if f + 1 < frames:
            f += 1
        elif loop:
            s, f = (s + 1) % scenarios, 0
    return s, f, playing, loop


def playback(commands: DataFrame, keys: list[str], frames: int = 20, scenarios: int = 4) -> DataFrame:
    """commands (keys, position, command, value) with the state after each."""
    from .operators.scan import scan

    def step(state, command, value):
        state = playback_step(state, command, int(value), frames, scenarios)
        return state, state

    return scan(commands, keys, ["position"], ["command", "value"], step, "scenario int, frame int, playing boolean, loop boolean").drop("command", "value")
