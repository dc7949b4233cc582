"""Grounded functions: user Python as columns, predicates, aggregates and table functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def grounded(name: str, returns: str | T.DataType) -> Callable[..., Column]:
    """``py:module.function`` as an Arrow-batched column function of pandas series."""
    scheme, _, path = name.partition(":")
    if scheme != "py":
        raise ValueError(f"only py: functions can be grounded, not {name}")
    module, _, attr = path.strip().rpartition(".")
    return schema(getattr(import_module(module), attr), returns)


def schema(f: Callable[..., pd.Series], returns: str | T.DataType) -> Callable[..., Column]:
    def run(*args):  # untyped on purpose: the number of arguments is the caller's
        return f(*args)

    return F.pandas_udf(run, returns, F.PandasUDFType.SCALAR)


def predicate(f: Callable[..., pd.Series]) -> Callable[..., Column]:
    """A boolean function; anything but a true is a false."""
    test = schema(f, "boolean")
    return lambda *c: F.coalesce(test(*c), F.lit(False))


Frame = Callable[[pa.Table], pa.Table]


def aggregate(df: DataFrame, key: list[str], partial: Frame, merge: Frame, finish: Frame, state: str, returns: str) -> DataFrame:
    """A user aggregate over Arrow tables, each with the rows of many groups.

    ``partial`` makes states of rows (the key and the state's columns), one a group; ``merge`` makes
    one state a group of several; ``finish`` makes results of states. None is called for a single
    group, and a group is never in one worker whole: batches are reduced wherever they lie, and
    of the states that meet only those of the batch at hand are held.
    """
    states, results = (to_arrow_schema(T._parse_datatype_string(x)) for x in (state, returns))

    def cast(t: pa.Table, to: pa.Schema) -> pa.Table:
        return t.select(to.names).cast(to)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield from cast(partial(pa.Table.from_batches([x])), states).to_batches()

    def last_group(t: pa.Table) -> int:
        """Where the rows of the last key begin, in a table in order of the key."""
        same = pa.scalar(True)
        for k in key:
            col, last = t[k], t[k][-1]
            if not last.is_valid:
                eq = pc.is_null(col)
            elif pa.types.is_floating(col.type) and math.isnan(last.as_py()):
                eq = pc.fill_null(pc.is_nan(col), False)
            else:
                eq = pc.fill_null(pc.equal(col, last), False)
            same = pc.and_(same, eq)
        return t.num_rows - pc.sum(same).as_py()

    def merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = states.empty_table()
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.concat_tables([held, cast(pa.Table.from_batches([x]), states)])
            at = last_group(t)
            if at:
                yield from cast(finish(cast(merge(t.slice(0, at)), states)), results).to_batches()
            held = cast(merge(t.slice(at)), states)
        if held.num_rows:
            yield from cast(finish(held), results).to_batches()

    reduced = df.mapInArrow(reduce_rows, state)
    return reduced.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge_states, returns)


def flatten(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """A function that returns lists, one row an element."""
    return df.select(*keep, F.explode(array).alias(name))
