"""Class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RAW_TO_CLASS
from .polar import col


def raw_class(word="word") -> Column:
    """The low 16 bits of a label word; the high ones are the instance."""
    return col(word).bitwiseAND(0xFFFF).cast("int")


def instance(word="word") -> Column:
    return F.shiftright(col(word), 16).bitwiseAND(0xFFFF).cast("int")


def collapse(raw="raw_class", classes: dict[int, int] = RAW_TO_CLASS) -> Column:
    """One of the classes, or -1 for ids without one."""
    pairs = [F.lit(x) for kv in classes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(raw).cast("int")), F.lit(-1))


def height_band_class(x="x", y="y", z="z", chance: Column | None = None) -> Column:
    """Raw classes from height alone: road, building, and by chance a moving car in the middle band."""
    r = F.sqrt(col(x) * col(x) + col(y) * col(y))
    z = col(z)
    car = (z >= -1.0) & (z < 1.0) & (r > 5.0) & (r < 30.0) & ((chance if chance is not None else F.lit(1.0)) < 0.1)
    return F.when(car, 252).when(z < -1.5, 40).when((z >= -1.5) & (z < 3.0), 50).otherwise(0)
