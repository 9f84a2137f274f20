"""Gram matrices as packed bytes: tasks add them up, a tree of fixed depth merges them, so that what is shuffled is one row a matrix, whatever its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Bytes of matrices that a task holds before it sends them on, and matrices that one task of the tree's first level adds up to one.
HELD_BYTES, FAN = 64 << 20, 32
#: Numbers of a block of windows in kept tables, and of a slice of windows in one product. Spark reads thousands of blocks at a time (4096 rows of a file, 10000 for a Python worker), so a block is small.
BLOCK_NUMBERS, SLICE_NUMBERS = 1 << 10, 1 << 19
#: Numbers of a vector that is small: a thousand tasks send 32 MB.
SMALL = 1 << 12


def packed(xx: np.ndarray, xy: np.ndarray, *scalars: float) -> np.ndarray:
    """The upper triangle of a symmetric matrix, a matrix of as many rows, and numbers, as one vector."""
    return np.concatenate([xx[np.triu_indices(len(xx))], xy.ravel(), np.array(scalars, float)])


def unpacked(v: np.ndarray, n: int, scalars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = n * (n + 1) // 2
    xx = np.zeros((n, n))
    xx[np.triu_indices(n)] = v[:k]
    xx = xx + np.triu(xx, 1).T
    return xx, v[k : len(v) - scalars].reshape(n, -1), v[len(v) - scalars :]


def matrix(col: pa.Array, rows: int) -> np.ndarray:
    """Lists of equal lengths as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in slices whose lists in `column` have some SLICE_NUMBERS numbers at most."""
    for b in batches:
        width = len(b.column(column)[0]) if b.num_rows else 0
        step = max(1, SLICE_NUMBERS // max(1, width))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def windows_of(b: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, x, y, numbers) of a batch of `window_blocks`, in slices of some SLICE_NUMBERS numbers: blocks of a key are joined. numbers has a row for each number of a window."""
    n, lags, steps = (b.column(c).to_numpy() for c in (1, 2, 3))
    for key, at in groups(b.column(0)):
        cuts = np.flatnonzero((np.diff(lags[at]) != 0) | (np.diff(steps[at]) != 0)) + 1
        for part in np.split(at, cuts):
            most = max(len(b.column(4)[int(part[0])].as_buffer()) // int(n[part[0]]) * int(n[part].max()) // 8, 1)
            step = max(1, SLICE_NUMBERS // most)
            for k in range(0, len(part), step):
                own = part[k : k + step]
                v = np.concatenate([np.frombuffer(b.column(4)[int(i)].as_buffer(), float) for i in own]).reshape(int(n[own].sum()), -1)
                x, y = int(lags[own[0]]), int(steps[own[0]])
                yield key, v[:, :x], v[:, x : x + y], v[:, x + y :].T


def window_blocks(rows: DataFrame) -> DataFrame:
    """(key, n, lags, steps, packed) of rows (key, x, y, numbers...): some BLOCK_NUMBERS numbers of a key's windows, one after the other, as one block of bytes, for tables that are read again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x, y = matrix(b.column(1), b.num_rows), matrix(b.column(2), b.num_rows)
            whole = np.column_stack([x, y, *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(3, b.num_columns))])
            step = max(1, BLOCK_NUMBERS // whole.shape[1])
            parts = [(key, at[k : k + step]) for key, at in groups(b.column(0)) for k in range(0, len(at), step)]
            shape = [pa.array([v] * len(parts), pa.int32()) for v in (x.shape[1], y.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in parts], b.column(0).type), pa.array([len(at) for _, at in parts], pa.int32()), *shape, pa.array([whole[at].tobytes() for _, at in parts], pa.binary())], ["key", "n", "lags", "steps", "packed"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n int, lags int, steps int, packed binary")


def block_sums(rows: DataFrame) -> DataFrame:
    """`sums` of kept `window_blocks` weighted by each of a window's numbers in turn: (key, packed, lags), key is the number's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        lags = 0
        for b in batches:
            for _, x, y, numbers in windows_of(b):
                x, lags = np.c_[x, np.ones(len(x))], x.shape[1] + 1
                for i, s in enumerate(numbers):
                    a, t = x * s[:, None], y * s[:, None]
                    held[i] = held.get(i, 0.0) + packed(a.T @ a, a.T @ t, float(np.sum(t * t)), float(t.size))
        if held:
            yield _batch(list(held), list(held.values()), [lags] * len(held), pa.int32())

    return tree(rows.mapInArrow(run, "key int, packed binary, lags int"))


def groups(key: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """(value, rows) of each value of a key."""
    codes = key.dictionary_encode()
    at = codes.indices.fill_null(-1).to_numpy()
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield (None if at[part[0]] < 0 else codes.dictionary[int(at[part[0]])].as_py()), part


def _batch(keys: list, sums: list[np.ndarray], lags: list[int], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array(lags, pa.int32())], ["key", "packed", "lags"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each key's rows (key, zx, zy, s): of [x 1] and y, weighted by s squared, with the squares of y and the number of targets."""
    held: dict[object, tuple[np.ndarray, int]] = {}
    kind, size = None, 0
    for b in slices(batches, 1):
        kind = b.column(0).type
        x, y, s = matrix(b.column(1), b.num_rows), matrix(b.column(2), b.num_rows), b.column(3).to_numpy(zero_copy_only=False)
        x, y = np.c_[x, np.ones(len(x))] * s[:, None], y * s[:, None]
        for key, at in groups(b.column(0)):
            a, t = x[at], y[at]
            got = packed(a.T @ a, a.T @ t, float(np.sum(t * t)), float(t.size))
            had = held.get(key)
            held[key] = (got if had is None else had[0] + got, x.shape[1])
            size += got.nbytes * (had is None)
            if size > HELD_BYTES:
                yield _batch(list(held), [v for v, _ in held.values()], [n for _, n in held.values()], kind)
                held, size = {}, 0
    if held:
        yield _batch(list(held), [v for v, _ in held.values()], [n for _, n in held.values()], kind)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rows of one key, which lie together: one vector is held."""
    key, total, lags, kind = None, None, 0, None
    for b in batches:
        kind = b.column(0).type
        for i in range(b.num_rows):
            k, v = b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_buffer(), float)
            if total is not None and k == key:
                total = total + v
                continue
            if total is not None:
                yield _batch([key], [total], [lags], kind)
            key, total, lags = k, v, b.column(2)[i].as_py()
    if total is not None:
        yield _batch([key], [total], [lags], kind)


def tree(parts: DataFrame, levels: int = 2) -> DataFrame:
    """(key, packed, lags) with one row a key: vectors of tasks are added in FAN tasks a key, then in one. Rows of a key are sorted together, so a task holds one vector."""
    schema = parts.schema
    out = parts
    if levels > 1:
        node = out.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(FAN)))
        out = node.repartition("key", "node").sortWithinPartitions("key", "node").drop("node").mapInArrow(_added, schema)
    return out.repartition("key").sortWithinPartitions("key").mapInArrow(_added, schema)


def levels_for(numbers: int) -> int:
    """Levels of a tree that adds vectors of so many numbers: small ones of all tasks are added in one task, without a first level."""
    return 1 if numbers <= SMALL else 2


def sums(rows: DataFrame, levels: int = 2) -> DataFrame:
    """(key, packed, lags) of rows (key, zx, zy, s): see `_partial`. Nothing grows with the number of rows of a key; a key with most rows is added up where they are."""
    kind = rows.schema["key"].dataType.simpleString()
    return tree(rows.select("key", "zx", "zy", F.col("s").cast("double").alias("s")).mapInArrow(_partial, f"key {kind}, packed binary, lags int"), levels)


def with_field(schema: StructType, name: str) -> StructType:
    """A schema with one more field, an array of doubles."""
    return StructType([*schema.fields, StructField(name, ArrayType(DoubleType()))])


def with_product(rows: DataFrame, weights: np.ndarray, x: str | Column = "x", out: str = "pred") -> DataFrame:
    """`rows` with an array of x W + b: one matrix product a batch in an Arrow worker. The weights go along with the task, so no plan grows with them."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(np.ascontiguousarray(weights))
    names = [c for c in rows.columns if c != out]
    schema = with_field(rows.select(*names).schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in slices(batches, -1):
            z = matrix(b.column(b.num_columns - 1), b.num_rows) @ w[:-1] + w[-1] if b.num_rows else np.zeros((0, w.shape[1]))
            at = pa.array(np.arange(b.num_rows + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array(z.ravel()))], schema=pa.schema([*(b.schema.field(i) for i in range(b.num_columns - 1)), pa.field(out, pa.list_(pa.float64()))]))

    column = F.col(x) if isinstance(x, str) else x
    return rows.select(*names, column.alias("_x")).mapInArrow(run, schema)
