"""Queries over listings, poses, playback, payloads, scenarios and the closed loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import serving
from ..config import FOVEA, ROOF, TRACKING, Fovea
from ..functions import labels
from ..operators.checkpoint import kept
from ..operators import loop, metrics, payload, project, segment
from ..sources import frames as frame_files
from ..sources import samples, scans, scenarios
from ..views import LABEL_WORD, SQL, oracle, table, view
from ..operators.track import footprints, ghost_counts, vacated
from .tracking import GHOSTS_SQL, moving_tracks
from .grid import CENTER_SQL, ELLIPSE_SQL, FOVEATED, MEMORY_SQL, foveated_cells, points


def sequence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "frames_v")
    return serving.sequences(frames, frames.filter("frame_id = 1 and seq_id <> 2"))


SEQUENCES_SQL = oracle("frames_v") + " SELECT seq_id, count(DISTINCT frame_id) AS scans, bool_or(frame_id = 1 AND seq_id <> 2) AS precomputed FROM frames_v GROUP BY seq_id"


def scan_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "frames_v").withColumn("seq_id", F.lpad(F.col("seq_id").cast("string"), 2, "0"))
    return scans.playlist(frames, [1, "3"])


PLAYLIST_SQL = oracle("frames_v") + " SELECT lpad(CAST(seq_id AS VARCHAR), 2, '0') AS seq_id, frame_id FROM frames_v WHERE seq_id IN (1, 3)"


def playlist_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.neighbours(view(spark, sf_dir, "frames_v").select("seq_id").distinct())


NEXT_SQL = oracle("frames_v") + """, s AS (SELECT DISTINCT seq_id FROM frames_v) SELECT seq_id,
  coalesce(lead(seq_id) OVER (ORDER BY seq_id), (SELECT min(seq_id) FROM s)) AS next_id, coalesce(lag(seq_id) OVER (ORDER BY seq_id), (SELECT max(seq_id) FROM s)) AS prev_id FROM s"""


def playlist_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope plays of the sequences and drives."""
    real = sequence_scans(spark, sf_dir).select(F.col("seq_id").cast("string").alias("id"), F.lit("real").alias("kind"), "precomputed")
    made = spark.createDataFrame([(s, "synthetic", True) for s in scenarios.SCENARIOS], "id string, kind string, precomputed boolean")
    parts = [(rows, scope, name) for rows, name in ((real.unionByName(made), "both"), (made, "synthetic")) for scope in ("all", "real", "ready")]
    return reduce(DataFrame.unionByName, [serving.scoped(rows, scope).select(F.lit(name).alias("playlist"), F.lit(scope).alias("scope"), "id") for rows, scope, name in parts])


SCOPES_SQL = SEQUENCES_SQL.replace(" SELECT seq_id, count", ", s AS (SELECT seq_id, count", 1) + f"""), m AS (SELECT unnest([{", ".join(repr(s) for s in scenarios.SCENARIOS)}]) AS id),
b AS (SELECT CAST(seq_id AS VARCHAR) AS id, true AS is_real, precomputed AS ready FROM s UNION ALL SELECT id, false, true FROM m)
SELECT 'both' AS playlist, scope, id FROM b, (SELECT unnest(['all', 'real', 'ready']) AS scope) WHERE scope = 'all' OR (scope = 'real' AND is_real) OR (scope = 'ready' AND ready)
UNION ALL SELECT 'synthetic', scope, id FROM m, (SELECT unnest(['all', 'real', 'ready']) AS scope)"""


def sample_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the labelled drive by frame, raw class and instance, and those of the test scan."""
    rows = samples.drive(spark).unionByName(samples.scan(spark))
    rows = rows.select("seq_id", "frame_id", labels.raw_class("class_id").alias("raw"), labels.instance("class_id").alias("instance"))
    return rows.groupBy("seq_id", "frame_id", "raw", "instance").agg(F.count(F.lit(1)).alias("n"))


DRIVE_SQL = """SELECT '00' AS seq_id, CAST(f AS INT) AS frame_id, raw, instance, CAST(n AS BIGINT) AS n FROM (VALUES (40, 0, 6000), (48, 0, 3000), (50, 0, 2500), (80, 0, 400), (10, 1, 400), (10, 2, 350), (30, 3, 120)) v(raw, instance, n), range(30) r(f)
UNION ALL SELECT 'test', 0, raw, 0, CAST(n AS BIGINT) FROM (VALUES (40, 4280), (80, 50), (30, 100), (81, 80), (10, 300)) v(raw, n)"""


def scenario_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in scenarios.SCENARIOS], "seq_id string")
    return serving.scenarios(view(spark, sf_dir, "frames_v").select("seq_id").distinct(), names)


SCENARIOS_SQL = oracle("frames_v") + f""" SELECT DISTINCT CAST(seq_id AS VARCHAR) AS id, 'real' AS kind FROM frames_v
UNION ALL SELECT unnest([{", ".join(repr(s) for s in scenarios.SCENARIOS)}]), 'synthetic'"""


def alias_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, n).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("drive_seq_"), n)).otherwise("highway_cruise")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return rows.withColumn("seq_id", serving.resolve())


ALIAS_SQL = """SELECT s_suppkey, name, CASE WHEN regexp_extract(name, '^(?:[A-Za-z_]*_)?([0-9]{1,2})$', 1) = '' THEN name ELSE lpad(regexp_extract(name, '^(?:[A-Za-z_]*_)?([0-9]{1,2})$', 1), 2, '0') END AS seq_id FROM (
  SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'drive_seq_' || CAST(s_suppkey AS VARCHAR) ELSE 'highway_cruise' END AS name FROM supplier)"""


def uniform_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seq_id"), F.col("c_custkey").alias("path"), F.when(F.col("c_nationkey") % 2 == 0, 160_000).otherwise(F.col("c_custkey") * 16).alias("length"))
    rows = rows.withColumn("frame_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("path")) - 1)
    return scans.one_size(rows)


SIGNATURE_SQL = """SELECT seq_id, count(*) >= 2 AND count(DISTINCT length) = 1 AS synthetic FROM (SELECT c_nationkey AS seq_id, CASE WHEN c_nationkey % 2 = 0 THEN 160000 ELSE c_custkey * 16 END AS length,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k <= 10 GROUP BY seq_id"""


def pose_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    yaw = F.pmod(k * 0.7, F.lit(5.0)) - 2.5
    zero = F.lit(0.0)
    pose = F.array(F.cos(yaw), zero, zero, F.pmod(k * 37, F.lit(173)).cast("double") * 0.51, F.sin(yaw), zero, zero, F.pmod(k * 91, F.lit(167)).cast("double") * 0.52, zero, zero, F.lit(1.0), zero)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seq_id"), F.col("c_custkey").alias("frame_id"), pose.alias("pose"))
    return scans.kinematics(rows).withColumns({"speed_mps": F.round("speed_mps", 6), "steering_angle_rad": F.round("steering_angle_rad", 6)})


POSE_SQL = """WITH p AS (SELECT c_nationkey AS seq_id, c_custkey AS frame_id, CAST((c_custkey * 37) % 173 AS DOUBLE) * 0.51::DOUBLE AS x, CAST((c_custkey * 91) % 167 AS DOUBLE) * 0.52::DOUBLE AS y,
  atan2(sin((c_custkey * 0.7::DOUBLE) % 5 - 2.5), cos((c_custkey * 0.7::DOUBLE) % 5 - 2.5)) AS yaw FROM customer),
l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, yaw - lag(yaw) OVER w AS t FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id))
SELECT seq_id, frame_id, round(coalesce(sqrt(dx*dx + dy*dy) / 0.1::DOUBLE, 10), 6) AS speed_mps,
  round(CASE WHEN t IS NULL THEN 0 ELSE least(greatest((t + pi()) - 2*pi() * floor((t + pi()) / (2*pi())) - pi(), -0.8::DOUBLE), 0.8::DOUBLE) END, 6) + 0 AS steering_angle_rad FROM l"""


def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive that a folder lacks or has in another size."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") * 16).alias("size"))
    there = members.filter("name % 4 <> 0").withColumn("size", F.when(F.col("name") % 7 == 0, F.col("size") - 16).otherwise(F.col("size")))
    return members.join(there, ["name", "size"], "left_anti")


MISSING_SQL = "SELECT s_suppkey AS name, s_suppkey * 16 AS size FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 7 = 0"


def pothole_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside any pothole: a semi join by distance."""
    x, y = F.col("x"), F.col("y")
    inside = reduce(lambda a, b: a | b, [(x - px) * (x - px) + (y - py) * (y - py) <= pr * pr for px, py, pr in POTHOLES])
    return points(spark, sf_dir).filter(inside).groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))


POTHOLES = tuple((x, y, r * 4) for x, y, r in scenarios.POTHOLES)
POTHOLE_SQL = oracle("points_v") + f""", h(px, py, pr) AS (VALUES {", ".join(f"({x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE)" for x, y, r in POTHOLES)})
SELECT seq_id, frame_id, count(*) AS n FROM points_v p SEMI JOIN h ON (p.x - px)*(p.x - px) + (p.y - py)*(p.y - py) <= pr * pr GROUP BY ALL"""


def queue_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


QUEUE_SQL = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2"
COMMANDS = ("set_scenario", "next_scenario", "prev_scenario", "set_auto_loop", "play", "pause", "seek", "step")


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("client"), F.col("event_id").alias("position"), F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), ((F.col("event_id") * 7) % 8 + 1).cast("int")).alias("command"), (F.col("event_id") % 23).alias("value"))
    return serving.playback(rows, ["client"])


PLAYBACK_SQL = f"""WITH RECURSIVE c AS (SELECT user_id % 64 AS client, event_id AS position, ([{", ".join(repr(c) for c in COMMANDS)}])[CAST((event_id * 7) % 8 AS INT) + 1] AS command, event_id % 23 AS value,
  row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS k FROM events),
w AS (SELECT DISTINCT client, CAST(NULL AS BIGINT) AS position, CAST(0 AS BIGINT) AS k, 0 AS scenario, 0 AS frame, true AS playing, true AS loop FROM c
  UNION ALL SELECT c.client, c.position, c.k,
    CAST(CASE command WHEN 'set_scenario' THEN value % 4 WHEN 'next_scenario' THEN (scenario + 1) % 4 WHEN 'prev_scenario' THEN (scenario + 3) % 4
      WHEN 'step' THEN CASE WHEN frame + 1 >= 20 AND loop THEN (scenario + 1) % 4 ELSE scenario END ELSE scenario END AS INT),
    CAST(CASE WHEN command IN ('set_scenario', 'next_scenario', 'prev_scenario') THEN 0 WHEN command = 'seek' THEN least(greatest(value, 0), 19)
      WHEN command = 'step' THEN CASE WHEN frame + 1 < 20 THEN frame + 1 WHEN loop THEN 0 ELSE frame END ELSE frame END AS INT),
    CASE command WHEN 'play' THEN true WHEN 'pause' THEN false ELSE playing END, CASE WHEN command = 'set_auto_loop' THEN value % 2 = 1 ELSE loop END
  FROM w JOIN c ON c.client = w.client AND c.k = w.k + 1)
SELECT client, position, scenario, frame, playing, loop FROM w WHERE k > 0"""


def contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.contour(spark, speed_mps=20.0, steering_angle_rad=0.3)


CONTOUR_SQL = f"""WITH l AS (SELECT CAST(k AS INT) AS k, k * (2*pi() / 119) - pi() AS theta, 20.0::DOUBLE AS speed_mps, 0.3::DOUBLE AS steering_angle_rad FROM (SELECT unnest(range(120)) AS k))
SELECT k, round_even(ellipse * cos(theta), 3) + 0 AS x, round_even(ellipse * sin(theta), 3) + 0 AS y FROM ({ELLIPSE_SQL.format(points="l", shear=FOVEA.drawn_shear)})"""

# Rows that no SQL gives: drawn points, whole drives, nested payloads, files.


def scenario_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_histogram(scenarios.points(spark), ["seq_id", "frame_id"])


def scenario_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the drives, the bridge under its higher roof."""
    frames = scenarios.frames(spark)
    rows = scenarios.points(spark).join(frames.select("seq_id", "frame_id", scenarios.roof_height().alias("roof")), ["seq_id", "frame_id"])
    cells = project.grid_cells(project.with_foveated_key(rows.filter("z <= roof"), frames, roof=F.col("roof")))
    return metrics.overhang_counts(cells, ["seq_id", "frame_id"])


def scenario_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter against the drives' classes."""
    found = segment.heuristic_labels(scenarios.points(spark), seed=1)
    return metrics.miou(found.select(F.col("class_id").alias("gt"), F.col("label").alias("pred")))


def _labelled(spark, sf_dir):
    """The points with the words of their labels, as scan folders hold them."""
    raw = view(spark, sf_dir, "points_v").sparkSession.sql(LABELLED_POINTS, base=table(spark, sf_dir, "lineitem"))
    w = Window.partitionBy("seq_id", "frame_id").orderBy("x", "y", "z", "intensity", "word")
    return raw.withColumns({"seq_id": frame_files.sequence_number(), "frame_id": F.col("frame_id").cast("int") - 1, "point_id": F.row_number().over(w).cast("long"), "class_id": labels.raw_class(), "instance": labels.instance()})


def _written(spark, sf_dir) -> DataFrame:
    """The points after they were written to a scan folder and read again."""
    root = scans.new_folder(spark)
    frame_files.save_scans(_labelled(spark, sf_dir), root)
    return frame_files.load_scans(spark, root)


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point and label files written and read again."""
    back = _written(spark, sf_dir)
    return back.groupBy("seq_id", "frame_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"), F.sum("instance").alias("instances"))


def scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few frames of two sequences: other files are not opened."""
    back = _written(spark, sf_dir).filter("seq_id in ('01', '03') and frame_id >= 1 and frame_id < 4")
    return back.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("sum_z"))


LABELLED_POINTS = SQL["points_v"].replace("FROM lineitem", f", {LABEL_WORD} AS word FROM {{base}}")
_RAW_POINTS = f"WITH p AS ({LABELLED_POINTS.replace('{base}', 'lineitem')})"
SCAN_FILES_SQL = _RAW_POINTS + """ SELECT lpad(CAST(seq_id AS VARCHAR), 2, '0') AS seq_id, CAST(frame_id - 1 AS INT) AS frame_id, CAST(word & 65535 AS INT) AS class_id, count(*) AS n,
  round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE)), 3) AS sum_x, CAST(sum((word >> 16) & 65535) AS BIGINT) AS instances FROM p GROUP BY ALL"""
SCAN_WINDOW_SQL = _RAW_POINTS + """ SELECT lpad(CAST(seq_id AS VARCHAR), 2, '0') AS seq_id, CAST(frame_id - 1 AS INT) AS frame_id, count(*) AS n,
  round(sum(CAST(CAST(z AS FLOAT) AS DOUBLE)), 3) AS sum_z FROM p WHERE seq_id IN (1, 3) AND frame_id - 1 >= 1 AND frame_id - 1 < 4 GROUP BY ALL"""


def frame_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "frames_v").withColumns({"timestamp_s": F.col("frame_id") * 0.1, "scenario_name": F.lit("tables"), "description": F.lit("")})
    cells, t = kept(foveated_cells(spark, sf_dir)), moving_tracks(spark, sf_dir)
    state = F.when(F.col("hits") >= TRACKING.hits_to_confirm, "CONFIRMED").otherwise("TENTATIVE")
    t = t.withColumns({"pred_x": F.col("x") + F.col("vx") * 0.1, "pred_y": F.col("y") + F.col("vy") * 0.1, "frames_since_seen": F.lit(0), "hits": F.col("k") + 1}).withColumn("state", state)
    centred = project.with_center(cells).withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    ghosts = ghost_counts(vacated(kept(footprints(t, centred)), frames, cells), frames)
    return payload.frame_payload(frames, cells, t, ghosts)


def payload_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the frames' payloads, a row each."""
    rows = frame_payload(spark, sf_dir).select("seq_id", "frame_id", F.explode("cells").alias("c"))
    names = ["ring_idx", "angle_idx", "semantic_class", "resolution_tier"]
    return rows.select("seq_id", "frame_id", *[F.col(f"c.{n}").alias(n) for n in names], *[(F.col(f"c.{n}") + 0).alias(n) for n in ("r", "x", "y")])


PAYLOAD_CELLS_SQL = FOVEATED + f""" SELECT seq_id, frame_id, ring_idx, angle_idx, semantic_class, resolution_tier, round_even(cr, 3) + 0 AS r, round_even(cx, 3) + 0 AS x, round_even(cy, 3) + 0 AS y
FROM ({CENTER_SQL.format(cells="cells")})"""


def payload_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the frames' payloads."""
    names = ["active_cells_count", "memory_bytes_foveated", "memory_bytes_uniform_baseline", "memory_savings_pct", "moving_objects_count", "motion_foveation_active"]
    return frame_payload(spark, sf_dir).select("seq_id", "frame_id", *[F.col(f"metrics.{n}").alias(n) for n in names], F.col("metrics.ghosting_cells_erased").alias("ghosts"), F.size("tracks").alias("tracks"), F.size("cells").alias("cells"), F.size(F.filter("tracks", lambda t: t["state"] == "CONFIRMED")).alias("confirmed"))


PAYLOAD_METRICS_SQL = FOVEATED + f""", m AS ({MEMORY_SQL[MEMORY_SQL.rindex("SELECT seq_id, frame_id, count(*) AS active_cells"):]}),
{GHOSTS_SQL},
t AS (SELECT seq_id, frame_id, count(*) AS tracks, count(*) FILTER (sqrt(vx*vx + vy*vy) >= {FOVEA.moving_speed}::DOUBLE) AS moving, count(*) FILTER (k = 2) AS confirmed FROM mt GROUP BY ALL)
SELECT f.seq_id, f.frame_id, coalesce(active_cells, 0) AS active_cells_count, coalesce(memory_bytes_foveated, 0) AS memory_bytes_foveated, coalesce(memory_bytes_uniform_baseline, 0) AS memory_bytes_uniform_baseline,
  coalesce(memory_savings_pct, 0) AS memory_savings_pct, coalesce(moving, 0) AS moving_objects_count, coalesce(moving, 0) > 0 AS motion_foveation_active,
  ghosts, CAST(coalesce(tracks, 0) AS INT) AS tracks, CAST(coalesce(active_cells, 0) AS INT) AS cells, CAST(coalesce(confirmed, 0) AS INT) AS confirmed
FROM frames_v f JOIN gc ON gc.seq_id = f.seq_id AND gc.frame_id = f.frame_id LEFT JOIN m ON m.seq_id = f.seq_id AND m.frame_id = f.frame_id LEFT JOIN t ON t.seq_id = f.seq_id AND t.frame_id = f.frame_id"""


def frame_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payload.compressed(payload.with_stream_metrics(frame_payload(spark, sf_dir), 25.0, 100.0))
    return out.select("seq_id", "frame_id", F.octet_length("message").alias("bytes"))


def export_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of an export that was begun with some and completed later, and in which run each was written."""
    path, all_frames = scans.new_folder(spark), view(spark, sf_dir, "frames_v")
    payloads = frame_payload(spark, sf_dir)
    compute = lambda some: payloads.join(some.select("seq_id", "frame_id"), ["seq_id", "frame_id"], "left_semi")
    payload.export_missing(all_frames.filter("frame_id <= 3 and seq_id <> 2"), compute, path)
    first = kept(payload.written_frames(spark, path, all_frames).withColumn("run", F.lit(1)))
    payload.export_missing(all_frames, compute, path)
    there = payload.written_frames(spark, path, all_frames)
    return there.join(first, ["seq_id", "frame_id"], "left").fillna(2, ["run"])


EXPORT_SQL = oracle("frames_v") + " SELECT seq_id, frame_id, CASE WHEN frame_id <= 3 AND seq_id <> 2 THEN 1 ELSE 2 END AS run FROM frames_v"


def closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, tracks and ghosts of all frames whose fine zone follows their tracks."""
    frames = view(spark, sf_dir, "frames_v").withColumn("roof", F.lit(ROOF))
    cells, tracks, ghosts = loop.closed_loop(points(spark, sf_dir), frames, Fovea())
    counts = cells.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("cells"))
    t = tracks.groupBy("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("tracks"), F.max("hits").alias("most_hits"))
    return counts.join(t, ["seq_id", "frame_id"], "left").join(ghosts, ["seq_id", "frame_id"])


QUERIES = {
    "sequence_scans": (sequence_scans, SEQUENCES_SQL),
    "scan_playlist": (scan_playlist, PLAYLIST_SQL),
    "playlist_next": (playlist_next, NEXT_SQL),
    "playlist_scopes": (playlist_scopes, SCOPES_SQL),
    "sample_drive": (sample_drive, DRIVE_SQL),
    "scenario_list": (scenario_list, SCENARIOS_SQL),
    "alias_dispatch": (alias_dispatch, ALIAS_SQL),
    "uniform_signature": (uniform_signature, SIGNATURE_SQL),
    "pose_kinematics": (pose_kinematics, POSE_SQL),
    "missing_members": (missing_members, MISSING_SQL),
    "pothole_points": (pothole_points, POTHOLE_SQL),
    "queue_newest": (queue_newest, QUEUE_SQL),
    "playback": (playback, PLAYBACK_SQL),
    "contour": (contour, CONTOUR_SQL),
    "scenario_points": (scenario_points, None),
    "scenario_cells": (scenario_cells, None),
    "scenario_miou": (scenario_miou, None),
    "scan_files": (scan_files, SCAN_FILES_SQL),
    "scan_window": (scan_window, SCAN_WINDOW_SQL),
    "frame_payload": (frame_payload, None),
    "payload_cells": (payload_cells, PAYLOAD_CELLS_SQL),
    "payload_metrics": (payload_metrics, PAYLOAD_METRICS_SQL),
    "frame_messages": (frame_messages, None),
    "export_incremental": (export_incremental, EXPORT_SQL),
    "closed_loop": (closed_loop, None),
}
