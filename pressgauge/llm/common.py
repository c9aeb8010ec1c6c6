"""Shared plumbing: tables by name, and vectors of all tasks added up in a tree."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.intermediate import hot_join, hot_keys, new_path, released, saved, shared_dir
from ..sources.tables import table

__all__ = ["hot_join", "hot_keys", "lean", "new_path", "parts_of", "released", "saved", "shared_dir", "small_batches", "summed", "table", "vector_rows"]

#: Tasks whose chunks meet in one place at each level of ``summed``, and numbers of an array that travel in one row.
FAN_IN, CHUNK = 32, 65_536


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Rows that go to a Python worker at once while the block runs, for workers that hold several arrays per text byte.

    The session's own setting is back afterwards, so what needs small batches must have been written by then.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 500):
    """``run`` for mapInArrow over slices of ``rows`` rows at most. What its task has freed goes back to the system at the end:
    idle workers stay beside the executor's heap, and each would keep the most that any of its tasks held."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    def over_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        finally:
            give_back()

    return over_slices


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_VECTOR = "chunk int, salt int, weight double, v binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("weight", pa.float64()), ("v", pa.binary())])


def vector_rows(values: np.ndarray, weight: float = 1.0) -> pa.RecordBatch:
    """A task's vector as rows for ``summed``, in single precision where that is exact; ``weight`` is summed beside it."""
    from pyspark import TaskContext

    def packed(part):
        small = part.astype(np.float32)
        return (small if np.array_equal(small, part) else part.astype(np.float64)).tobytes()

    parts = [packed(values[i : i + CHUNK]) for i in range(0, len(values), CHUNK)]
    n, at = len(parts), TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([at] * n, pa.int32()), pa.array([weight] * n, pa.float64()), pa.array(parts, pa.binary())], schema=_ARROW)


def summed(docs: DataFrame, size: int, make) -> tuple[np.ndarray | None, float]:
    """Sum over all tasks of the vectors of ``size`` that ``make(batches)`` yields as ``vector_rows``, and of their weights.

    Chunks are added in a tree of three levels: FAN_IN tasks' chunks meet in one place, FAN_IN such sums in the next, so no
    task reads a chunk from every task of a large job.
    """
    widths = [min(CHUNK, size - i) for i in range(0, size, CHUNK)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for b in batches:
            for c, s, w, v in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(v, np.float32 if len(v) == 4 * widths[c] else np.float64).astype(np.float64)
                if (c, s) in sums:
                    sums[c, s][0] += w
                    sums[c, s][1] += x
                else:
                    sums[c, s] = [w, x]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sums], pa.int32()), pa.array([s for _, s in sums], pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], schema=_ARROW)

    parts, rows = parts_of(docs.sparkSession), docs.mapInArrow(make, _VECTOR)
    for _ in range(2):
        rows = rows.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).repartition(parts, "chunk", "salt").mapInArrow(add, _VECTOR)
    got = rows.withColumn("salt", F.lit(0)).repartition(min(parts, len(widths)), "chunk").mapInArrow(add, _VECTOR).collect()
    if not got:
        return None, 0.0
    got.sort(key=lambda r: r.chunk)
    return np.concatenate([np.frombuffer(r.v, np.float64) if len(r.v) == 8 * w else np.frombuffer(r.v, np.float32) for r, w in zip(got, widths, strict=True)]), got[0].weight
