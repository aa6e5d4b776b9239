"""Rows in Python: columns made of columns, and groups without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.session import bound_batches


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Arrow batches as frames. A column of whole numbers with nulls holds Python's: floats would round ids beyond 2^53."""
    for b in batches:
        yield b.to_pandas(integer_object_nulls=True)


def record_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that follow one another with equal keys; a group may span batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        new = np.zeros(len(b), bool)
        for k in keys:
            v = b[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = b.iloc[lo:hi]
            if held and any(held[-1][k].iloc[-1] != part[k].iloc[0] for k in keys):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def by_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: T.StructType | str) -> DataFrame:
    """f over the groups of df with equal keys, each sorted by order: one shuffle, one sort, batches of many groups. Groups have to be bounded."""
    bound_batches(df.sparkSession)

    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pd.DataFrame] = []
        n = 0
        for group in runs(frames(batches), keys):
            got = f(group)
            if got is not None and len(got):
                out.append(got)
                n += len(got)
            if n > 5000:
                yield record_batch(pd.concat(out), made)
                out, n = [], 0
        if out:
            yield record_batch(pd.concat(out), made)

    return gathered(df, keys, order).mapInArrow(run, kind)


def gathered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the rows of equal keys in one partition, one after another and sorted by order.

    Dealt by a hash of the keys: a shuffle by the keys themselves is left out where the rows lie so already, and then AQE may
    coalesce the inputs of a union each in its own way, or split a skewed join below, as Python's rows ask for nothing.
    """
    return df.repartition(F.xxhash64(*[F.col(k) for k in keys])).sortWithinPartitions(*keys, *order)


def changes(b: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows from the second on whose keys differ from those of the row before."""
    new = np.zeros(max(0, b.num_rows - 1), bool)
    for k in keys:
        x, y = b.column(k)[1:], b.column(k)[:-1]
        differ = pc.fill_null(pc.not_equal(x, y), True)
        new |= pc.and_not(differ, pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches that hold the groups of equal keys as a whole, many at a time, with where each begins, and the end."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[int]]:
        b = pa.concat_batches(parts)
        return b, [0, *changes(b, keys).tolist(), b.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield joined(held)
            held = []
        cuts = changes(b, keys)
        if len(cuts):
            last = int(cuts[-1])
            yield joined([*held, b.slice(0, last)])
            held, b = [], b.slice(last)
        held.append(b)
    if held:
        yield joined(held)


def append_by_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], added: Sequence[T.StructField], f: Callable[[pa.RecordBatch, list[int]], list[pa.Array]]) -> DataFrame:
    """df with columns that f makes of whole groups, many in a call. Groups have to be bounded; there may be any number of them."""
    bound_batches(df.sparkSession)
    kind = T.StructType([*df.schema.fields, *added])
    names = [x.name for x in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_runs(batches, keys):
            yield pa.RecordBatch.from_arrays([*b.columns, *f(b, at)], names)

    return gathered(df, keys, order).mapInArrow(run, kind)


def append(df: DataFrame, column: str, added: T.StructType, f: Callable[[pa.Array], list[pa.Array]], drop: Sequence[str] = ()) -> DataFrame:
    """df with the columns of added, which f makes of one column of a batch.

    Those of drop, and any that is called like an added one, give way; the others travel as Arrow, so that no id is changed.
    """
    bound_batches(df.sparkSession)
    gone = {x.lower() for x in (*drop, *added.names)}
    kept = [i for i, x in enumerate(df.columns) if x.lower() not in gone]
    place = [x.lower() for x in df.columns].index(column.lower())
    fields = [df.schema.fields[i] for i in kept] + added.fields
    names = [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + f(b.column(place)), names)

    # Spark looks the columns up by name, and stumbles over dots
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, T.StructType(fields))


def pack(df: DataFrame, without: Sequence[str] = (), **named: Column) -> DataFrame:
    """df's columns but those of `without` as one struct, row, and the named ones beside it: no name of df can clash with another."""
    inside = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return df.select(F.struct(*(inside or [F.lit(0).alias("none")])).alias("row"), *[v.alias(k) for k, v in named.items()])


def unpacked(columns: Sequence[str], **changed: Column) -> list[Column]:
    """The columns of a packed frame again, those of `changed` by their new values."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns]
