"""Ordered folds: sequential rules whose next step depends on the state so far.

A fold streams over partitions that Spark has shuffled by key and sorted by order. The
worker keeps one small state per key and never holds a group. Oversized groups are cut
into segments; each segment is folded from an assumed start state, and the segments whose
true start state turns out different are folded again until nothing changes. That ends
with exactly the sequential result, and takes few rounds for rules that forget quickly.
"""

from __future__ import annotations

import pickle
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint, ship_package
from .skew import SEG, deal, find_split, same_keys


class Rule:
    """A sequential rule. ``start`` is the state before the first row of a group.

    ``step(state, row)`` gets one row as a tuple of the requested columns and returns
    ``(state, rows_out)``; ``finish(state)`` returns the rows still owed at group end.
    States must be small, picklable and comparable with ``==``.
    """

    start: Any = None

    def step(self, state, row):  # pragma: no cover - interface
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        return []

    def parts(self, state) -> tuple[Any, Any]:
        """(what only adds to all that follows, the state without it). A segment whose true start differs in the
        first part alone is not folded again."""
        return None, state

    def after(self, added, end):
        """The state after a segment that ended in ``end`` when started without ``added``."""
        return end


_NAN = float("nan")


def _values(column: pa.Array, key: bool) -> list:
    """Python values: integers stay exact and nulls stay None, but for missing numbers a rule computes with."""
    out = column.to_pylist()
    if not pa.types.is_floating(column.type):
        return out
    if key:  # one object, so that NaN equals NaN as it does in a grouping
        return [_NAN if v is not None and v != v else v for v in out]
    return [_NAN if v is None else v for v in out]


def _runner(rule: Rule, n_keys: int, schema: T.StructType, starts: dict, flush: dict | None, states_only: bool):
    """mapInArrow body. Input columns: keys, segment, then the rule's columns."""
    fields = list(to_arrow_schema(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        # a number a rule leaves as NaN is a missing one
        cols = [pa.array(c, f.type, from_pandas=i >= n_keys and pa.types.is_floating(f.type)) for i, (c, f) in enumerate(zip(zip(*rows), fields))]
        return pa.RecordBatch.from_arrays(cols, schema.names)

    def run(batches):
        current, state = None, None
        out: list[tuple] = []
        done: list[tuple] = []

        def close():
            if current is None:
                return
            if states_only:
                done.append((*current, pickle.dumps(state)))
            elif flush is None or flush.get(current[:-1]) == current[-1] or current[-1] < 0:
                out.extend((*current[:-1], *r) for r in rule.finish(state))

        for b in batches:
            for row in zip(*[_values(c, i < n_keys) for i, c in enumerate(b.columns)]):
                gid = row[: n_keys + 1]
                if gid != current:
                    close()
                    current = gid
                    state = starts.get(gid, rule.start)
                state, emitted = rule.step(state, row[n_keys + 1 :])
                if emitted and not states_only:
                    out.extend((*gid[:-1], *r) for r in emitted)
                if len(out) >= 50_000:
                    yield table(out)
                    out = []
        close()
        res = done if states_only else out
        if res:
            yield table(res)

    return run


def fold(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rule: Rule, out: str) -> DataFrame:
    """Apply ``rule`` to every group. ``out`` is the DDL of the rows it emits (without keys)."""
    ship_package(df.sparkSession)
    split = find_split(df, keys, order)
    tagged = df.withColumn(SEG, F.lit(-1)) if split is None else split.tag(df).withColumn(SEG, F.coalesce(SEG, F.lit(-1)))
    need = list(dict.fromkeys([*keys, SEG, *cols, *order]))
    part = [*keys, SEG]
    # the rule sees exactly `cols`, after the keys and the segment
    lanes = [F.col(k) for k in keys] + [F.col(SEG)] + [F.col(c).alias(f"__{i}_{c}") for i, c in enumerate(cols)]
    tagged = tagged.select(*need)
    laid = deal(tagged, part).sortWithinPartitions(*part, *order)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + list(T._parse_datatype_string(out).fields))
    if split is None:
        return laid.select(*lanes).mapInArrow(_runner(rule, len(keys), out_schema, {}, None, False), out_schema)

    tagged = checkpoint(tagged)
    starts: dict = {}  # without the parts that only add
    true_starts: dict = {}
    ends: dict = {}
    todo = {(*k, s) for k, last in split.last.items() for s in range(last + 1)}
    state_schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in key_fields]
        + [T.StructField(SEG, T.IntegerType()), T.StructField("__state", T.BinaryType())]
    )
    spark = df.sparkSession
    while todo:
        # the work list holds at most one row per segment of the split table
        pending = spark.createDataFrame(sorted(todo, key=str), T.StructType([T.StructField(f"__w_{f.name}", f.dataType) for f in state_schema.fields[:-1]]))
        cond = same_keys([F.col(c) for c in part], [F.col(f"__w_{c}") for c in part])
        work = tagged.join(F.broadcast(pending), cond, "left_semi")
        laid = work.repartition(*part).sortWithinPartitions(*part, *order)
        found = laid.select(*lanes).mapInArrow(
            _runner(rule, len(keys), state_schema, dict(starts), None, True), state_schema
        ).collect()
        for r in found:
            ends[tuple(r)[:-1]] = pickle.loads(bytes(r["__state"]))
        todo = set()
        for k, last in split.last.items():
            carried = rule.start
            for s in range(last + 1):
                gid = (*k, s)
                true_starts[gid] = carried
                added, bare = rule.parts(carried)
                if starts.get(gid, rule.start) != bare:
                    starts[gid] = bare
                    if gid in ends:
                        todo.add(gid)
                # an empty segment hands its start state on
                carried = rule.after(added, ends[gid]) if gid in ends else carried
    laid = deal(tagged, part).sortWithinPartitions(*part, *order)
    # a group's pending rows belong to its last segment that has any row
    final = {k: max([s for s in range(last + 1) if (*k, s) in ends], default=-1) for k, last in split.last.items()}
    return laid.select(*lanes).mapInArrow(_runner(rule, len(keys), out_schema, true_starts, final, False), out_schema)
