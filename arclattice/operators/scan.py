"""States that follow from row to row of a key, in time linear in the rows and memory of one state.

Rows are ranged and sorted by key and order, so that ranges cut any key anywhere. A task walks through its
range batch by batch and carries the state along; it begins its first key as if it were new. Where that key
comes from the range before, its rows there are walked again from the end state that the range before hands
on. A range that one key fills hands on another end state if it began with another one, so such ranges
are walked again, all at once, until no end state changes: states that forget their beginning, as smoothed and held ones do,
settle after one round, and any others after as many rounds as the key has ranges.

Only end states pass through the driver, one a range. The ranges are kept at a checkpoint, whose
partitions are the ranges in their order: walking again shuffles nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .checkpoint import kept

#: state, values of a row -> (state, results of the row). The state of a key's first row is None.
Step = Callable[..., tuple[object, tuple]]
_HEAD, _RANGE, _END = "_head", "_range", "_end"


def walked(batches: Iterable[pa.RecordBatch], keys: list[str], values: list[str], step: Step, key: tuple | None, state: object) -> Iterator[tuple[pa.RecordBatch, list[tuple], tuple, object]]:
    """(batch, results, its last key, the state after it) of sorted batches, beginning with a key's state."""
    for b in batches:
        made = []
        for k, v in zip(zip(*[b.column(c).to_pylist() for c in keys], strict=True), zip(*[b.column(c).to_pylist() for c in values], strict=True), strict=True):
            if k != key:
                key, state = k, None
            state, out = step(state, *v)
            made.append(out)
        yield b, made, key, state


def columns(made: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [()] * len(schema), schema, strict=True)]


def scan(rows: DataFrame, keys: list[str], order: list[str], values: list[str], step: Step, results: str, ranges: int | None = None) -> DataFrame:
    """rows with the columns `results` (a schema), made by step(state, *values) row by row of each key in order.

    Keys are independent; null is a key of its own. Rows of equal key and order go by their values. States are compared and handed on pickled.
    ranges: how many, else spark.sql.shuffle.partitions. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    made_schema = to_arrow_schema(StructType.fromDDL(results))
    by, own_columns = [*keys, *order], rows.columns
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *[v for v in values if v not in by])
    whole = StructType([*rows.schema.fields, *StructType.fromDDL(results).fields, *StructType.fromDDL(f"{_HEAD} boolean, {_RANGE} int, {_END} binary").fields])

    names, types = whole.names, to_arrow_schema(whole).types

    def first(batches):
        place, begun, single, state, key = TaskContext.get().partitionId(), None, True, None, None
        for b, made, key, state in walked((b for b in batches if b.num_rows), keys, values, step, None, None):
            own = list(zip(*[b.column(c).to_pylist() for c in keys], strict=True))
            begun = own[0] if begun is None else begun
            head = [single and k == begun for k in own]
            single = single and key == begun  # sorted: once another key has come, the first one is over
            yield pa.record_batch([*b.columns, *columns(made, made_schema), pa.array(head), pa.array([place] * b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        if begun is not None:
            end = pickle.dumps((begun, key, single, pickle.dumps(state)))
            yield pa.record_batch([*[pa.nulls(1, t) for t in types[:-2]], pa.array([place], pa.int32()), pa.array([end], pa.binary())], names=names)

    held = kept(dealt.mapInArrow(first, StructType([f for f in _nullable(whole)])))
    ends = {r[_RANGE]: pickle.loads(bytes(r[_END])) for r in held.filter(F.col(_END).isNotNull()).select(_RANGE, _END).collect()}  # a row a range
    starts = settled(held.filter(F.col(_END).isNull()), ends, keys, values, step)

    def again(batches):
        begun, state = False, None
        for b in batches:
            if not b.num_rows:
                continue
            place = b.column(_RANGE)[0].as_py()
            if place in starts and b.column(_HEAD)[0].as_py():
                n = b.column(_HEAD).to_pylist()
                n = n.index(False) if False in n else b.num_rows
                key = tuple(b.column(c)[0].as_py() for c in keys)
                (_, made, _, state), = walked([b.slice(0, n)], keys, values, step, key, state if begun else pickle.loads(starts[place]))
                begun = True
                more = columns(made, made_schema)
                old = [b.column(f.name).slice(n) for f in made_schema]
                more = [pa.concat_arrays([m, o]) for m, o in zip(more, old, strict=True)]
            else:
                more = [b.column(f.name) for f in made_schema]
            yield pa.record_batch([*[b.column(c) for c in own_columns], *more], names=names[:-3])

    return held.filter(F.col(_END).isNull()).mapInArrow(again, StructType(_nullable(StructType(whole.fields[:-3]))))


def _nullable(schema: StructType):
    from pyspark.sql.types import StructField

    return [StructField(f.name, f.dataType, True) for f in schema.fields]


def settled(held: DataFrame, ends: dict[int, tuple], keys: list[str], values: list[str], step: Step) -> dict[int, bytes]:
    """The pickled state that each range's first key comes with, for ranges whose first key is the last one of the range before."""
    order = sorted(ends)
    end = {r: ends[r][3] for r in order}
    comes = [(a, b) for a, b in zip(order[:-1], order[1:], strict=True) if ends[a][1] == ends[b][0]]
    known: dict[int, bytes] = {}
    while True:
        starts = {b: end[a] for a, b in comes}
        todo = {b: s for b, s in starts.items() if ends[b][2] and known.get(b) != s}
        if not todo:
            return starts

        def last(batches, todo=todo):
            place, state, any_rows = None, None, False
            for b in batches:
                if not b.num_rows:
                    continue
                place = b.column(_RANGE)[0].as_py()
                key = tuple(b.column(c)[0].as_py() for c in keys)
                (_, _, _, state), = walked([b], keys, values, step, key, state if any_rows else pickle.loads(todo[place]))
                any_rows = True
            if any_rows:
                yield pa.record_batch([pa.array([place], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=[_RANGE, _END])

        found = held.filter(F.col(_RANGE).isin(list(todo))).mapInArrow(last, f"{_RANGE} int, {_END} binary").collect()
        known |= todo
        end |= {r[_RANGE]: bytes(r[_END]) for r in found}
