"""The benchmark tables seen as frames, points, tracks and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RAW_TO_CLASS

CLASS = "CASE WHEN l_discount >= 0.08 THEN 3 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END"
#: The same SELECT text runs in Spark and in other engines.
SQL = {
    "points_v": f"""SELECT CAST(l_suppkey % 4 AS BIGINT) AS seq_id, l_linenumber AS frame_id,
      CAST((l_partkey*37 + l_suppkey*11) % 61 AS DOUBLE)*CAST(1.9713 AS DOUBLE) - CAST(59.9869 AS DOUBLE) AS x,
      CAST((l_orderkey*53 + l_partkey*7) % 61 AS DOUBLE)*CAST(1.9637 AS DOUBLE) - CAST(59.9827 AS DOUBLE) AS y,
      l_quantity*CAST(0.1 AS DOUBLE) - CAST(2.43 AS DOUBLE) AS z, l_discount*10 AS intensity,
      CAST(CASE WHEN l_tax = 0 THEN -1 ELSE {CLASS} END AS INT) AS class_id,
      CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey % 4 AS INT) ELSE CAST({CLASS} AS INT) END AS pred FROM lineitem""",
    "frames_v": """SELECT DISTINCT CAST(l_suppkey % 4 AS BIGINT) AS seq_id, l_linenumber AS frame_id,
      l_linenumber*CAST(3.1 AS DOUBLE) AS speed_mps, (l_suppkey % 4 - CAST(1.5 AS DOUBLE))*CAST(0.13 AS DOUBLE) AS steering_angle_rad FROM lineitem""",
    "tracks_v": """SELECT s_suppkey AS track_id, CAST(s_suppkey % 4 AS BIGINT) AS seq_id, CAST(1 + s_suppkey % 7 AS INT) AS frame_id, 3 AS class_id,
      CAST((s_suppkey*37) % 97 AS DOUBLE)*CAST(0.5213 AS DOUBLE) - CAST(9.3 AS DOUBLE) AS x,
      CAST((s_suppkey*61) % 89 AS DOUBLE)*CAST(0.2111 AS DOUBLE) - CAST(9.1 AS DOUBLE) AS y,
      CASE WHEN s_suppkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((s_suppkey*29) % 41 AS DOUBLE)*CAST(0.413 AS DOUBLE) - CAST(9.3 AS DOUBLE) END AS vx,
      CASE WHEN s_suppkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((s_suppkey*17) % 31 AS DOUBLE)*CAST(0.317 AS DOUBLE) - CAST(4.3 AS DOUBLE) END AS vy,
      CAST(3.5 AS DOUBLE) AS bbox_l, CAST(1.8 AS DOUBLE) AS bbox_w FROM supplier""",
    "detections_v": """SELECT c_nationkey AS frame_id, c_custkey AS det_id,
      CAST((c_custkey*37) % 173 AS DOUBLE)*CAST(0.5171 AS DOUBLE) - CAST(44.7 AS DOUBLE) AS x,
      CAST((c_custkey*91) % 167 AS DOUBLE)*CAST(0.5093 AS DOUBLE) - CAST(42.3 AS DOUBLE) AS y FROM customer""",
    "sector_radius_v": "SELECT user_id % 64 AS sector, event_id AS frame_id, 10 + value/40 AS radius FROM events",
}
TABLE = {"points_v": "lineitem", "frames_v": "lineitem", "tracks_v": "supplier", "detections_v": "customer", "sector_radius_v": "events"}
_RAW = sorted(RAW_TO_CLASS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = TABLE[name]
    return spark.sql(SQL[name].replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


#: A label word for each row: one of the raw classes, and an instance above it. The text fits Spark and other engines.
LABEL_WORD = f"CASE l_partkey % {len(_RAW)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_RAW))} END + (l_suppkey % 100)*65536"
LABEL_WORDS_SQL = f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {LABEL_WORD} AS word FROM lineitem"


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABEL_WORDS_SQL.replace("FROM lineitem", "FROM {base}"), base=table(spark, sf_dir, "lineitem"))


def oracle(*names: str) -> str:
    """WITH clauses of the named views."""
    return "WITH " + ", ".join(f"{n} AS ({LABEL_WORDS_SQL if n == 'label_words_v' else SQL[n]})" for n in names)
