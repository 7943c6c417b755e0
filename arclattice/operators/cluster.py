"""Dynamic cells to detections: all chains of cells within 2.5 m are one cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import kept

REACH, MOST_CELLS, WIDEST = 2.5, 200, 14.0


def bucket(rows: DataFrame, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    return rows.withColumn("bx", F.floor(F.col(x) / reach)).withColumn("by", F.floor(F.col(y) / reach))


def around(rows: DataFrame) -> DataFrame:
    """A row for each of the nine buckets around."""
    offsets = F.sequence(F.lit(-1), F.lit(1))
    rows = rows.withColumn("_dx", F.explode(offsets)).withColumn("_dy", F.explode(offsets))
    return rows.withColumn("bx", F.col("bx") + F.col("_dx")).withColumn("by", F.col("by") + F.col("_dy")).drop("_dx", "_dy")


def near_pairs(rows: DataFrame, group: list[str], key: str, reach: float = REACH) -> DataFrame:
    """(group, a, b), a < b: keys of rows at most `reach` apart, by an equi-join on square buckets of that size.

    Two buckets meet once, as a row is sought in its own and in the four ahead of it. Partitions are given by number: pairs outgrow
    rows, so that few bytes may not be merged into few tasks.
    """
    conf, cores = rows.sparkSession.conf, rows.sparkSession.sparkContext.defaultParallelism
    on, parts = [*group, "bx", "by"], max(int(conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    left = bucket(rows.select(*group, F.col(key).alias("p"), F.col("x").alias("ax"), F.col("y").alias("ay")), reach, "ax", "ay")
    right = bucket(rows.select(*group, F.col(key).alias("q"), F.col("x").alias("cx"), F.col("y").alias("cy")), reach, "cx", "cy")
    ahead = F.array(*[F.struct(F.lit(ox).alias("x"), F.lit(oy).alias("y")) for ox, oy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    right = right.withColumn("_to", F.explode(ahead)).withColumns({"bx": F.col("bx") + F.col("_to.x"), "by": F.col("by") + F.col("_to.y"), "_own": (F.col("_to.x") == 0) & (F.col("_to.y") == 0)}).drop("_to")
    dx, dy = F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")
    once = F.when(F.col("_own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))
    pairs = left.repartition(parts, *on).join(right.repartition(parts, *on), on).filter(once & (dx * dx + dy * dy <= reach * reach))
    return pairs.select(*group, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def grid_components(x: np.ndarray, y: np.ndarray, reach: float = REACH) -> np.ndarray:
    """For each point the smallest index in its chain; neighbours are looked up in square buckets."""
    root = np.arange(len(x))
    places: dict[tuple[int, int], list[int]] = {}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (bx, by) in enumerate(zip(np.floor(x / reach).astype(int).tolist(), np.floor(y / reach).astype(int).tolist(), strict=True)):
        for ox in (-1, 0, 1):
            for oy in (-1, 0, 1):
                for j in places.get((bx + ox, by + oy), ()):
                    if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= reach * reach:
                        a, b = top(i), top(j)
                        root[max(a, b)] = min(a, b)
        places.setdefault((bx, by), []).append(i)
    return np.array([top(i) for i in range(len(x))], int)


#: Side of a tile, in reaches: a task holds the rows of one tile of one frame.
TILE = 16


def components(rows: DataFrame, group: list[str], key: str, reach: float = REACH) -> DataFrame:
    """rows with component, the smallest key of their chain. A frame is spread over tasks, tile by tile.

    Chains are found within each tile. Rows near its border, and only they, are compared with those of the tiles
    around; what meets there joins chains, of which a frame has few enough for one task. Rows without
    coordinates are chains of their own.
    """
    side = TILE * reach
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + f", _tx long, _ty long, _root {dict(rows.dtypes)[key]}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key).reset_index(drop=True)
        if part["_tx"].isna().any() or part["_ty"].isna().any():
            return part.assign(_root=part[key])
        found = grid_components(part["x"].to_numpy(float), part["y"].to_numpy(float), reach)
        return part.assign(_root=part[key].to_numpy()[found])

    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < 1e12), F.floor(F.col(c) / side))
    tiled = rows.withColumn("_tx", finite("x")).withColumn("_ty", finite("y"))
    parts = kept(tiled.groupBy(*group, "_tx", "_ty").applyInPandas(run, schema))
    inside = lambda c: F.pmod(F.col(c), F.lit(side)).between(reach, side - reach)
    edge = parts.filter(F.col("_tx").isNotNull() & F.col("_ty").isNotNull() & ~(inside("x") & inside("y")))
    left = bucket(edge.select(*group, F.col("_root").alias("a"), F.struct("_tx", "_ty").alias("ta"), F.col("x").alias("ax"), F.col("y").alias("ay")), reach, "ax", "ay")
    right = around(bucket(edge.select(*group, F.col("_root").alias("b"), F.struct("_tx", "_ty").alias("tb"), F.col("x").alias("cx"), F.col("y").alias("cy")), reach, "cx", "cy"))
    dx, dy = F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")
    met = left.join(right, [*group, "bx", "by"]).filter((F.col("a") < F.col("b")) & (F.col("ta") != F.col("tb")) & (dx * dx + dy * dy <= reach * reach)).select(*group, "a", "b").distinct()
    kinds = dict(rows.dtypes)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        root = joined(zip(part["a"], part["b"], strict=True))
        first = [part[g].iloc[0] for g in group]
        return pd.DataFrame([(*first, k, v) for k, v in root.items()], columns=[*group, "_root", "component"])

    merged = met.groupBy(*group).applyInPandas(merge, ", ".join([*(f"{g} {kinds[g]}" for g in group), f"_root {kinds[key]}", f"component {kinds[key]}"]))
    return parts.join(merged, [*group, "_root"], "left").select(*rows.columns, F.coalesce("component", "_root").alias("component"))


def joined(pairs) -> dict:
    """The smallest member reachable, for every member of a pair."""
    root: dict = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in root}


def clusters(rows: DataFrame, group: list[str], key: str, reach: float = REACH) -> DataFrame:
    """(group, component, x, y, class_id, cells): centroids of chains that are neither too large nor too wide.

    Where no two rows of a frame are near each other, every row is its own cluster.
    """
    parts = components(rows, group, key, reach)
    out = parts.groupBy(*group, "component").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.min_by("class_id", key).alias("class_id"), F.count(F.lit(1)).alias("cells"),
        (F.max("x") - F.min("x")).alias("span_x"), (F.max("y") - F.min("y")).alias("span_y"),
    )
    return out.filter((F.col("cells") <= MOST_CELLS) & (F.col("span_x") <= WIDEST) & (F.col("span_y") <= WIDEST)).drop("span_x", "span_y")
