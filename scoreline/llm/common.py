"""Reading, shared scratch tables and Arrow batch limits for the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from scoreline.sources.scratch import written  # noqa: F401

#: Arrow batches to Python hold at most so many rows and bytes; one longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of this name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """df with these columns after its own; function maps batches of df to batches of both.

    Columns pass by their place, so that a dot in a name isn't taken for a path.
    """
    names, added = df.columns, StructType.fromDDL(ddl)
    places = df.toDF(*[f"c{k}" for k in range(len(names))])

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([*[f"c{k}" for k in range(len(names))], *added.names])

    return places.mapInArrow(by_place, StructType([*places.schema.fields, *added.fields])).toDF(*names, *added.names)


def sum_over(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], length: int, dtype: str) -> np.ndarray:
    """The sum over all tasks of partial(the task's batches), arrays of this length, which must not grow with the data."""
    # The arrays are sent in pieces, so that adding them up is spread over tasks that each hold one piece.
    size = -(-length // 64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = partial(batches)
        if array is not None:
            parts = [array[k : k + size].astype(dtype).tobytes() for k in range(0, length, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(sums, dtype)
                total[piece] = total[piece] + got if piece in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["piece", "sums"])

    schema = "piece int, sums binary"
    out = np.zeros(length, dtype)
    for row in df.mapInArrow(send, schema).repartition(16, "piece").mapInArrow(add, schema).collect():  # 64 rows
        out[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["sums"], dtype)
    return out
