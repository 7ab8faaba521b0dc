"""Shared helpers: table reading, durable cuts, batch-wise maps and bounded driver reads."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import checkpoint_folder, durable  # noqa: F401  (re-exported to the operators)

#: Text bytes that one step of a Python task works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder, which the driver and all executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each carries about ``size`` bytes of the text column; a single longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(text)
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield b.slice(start)


def map_texts(df: DataFrame, columns: list[str], text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """Apply a function of record batches to the named columns of ``df``; other columns are not read.

    ``make`` runs once per task and returns the function; batches are cut by text bytes first, so a task's memory does not
    depend on how long the texts are, apart from the longest single one.
    """
    def run(batches):
        step = make()
        for b in slices(batches, text, size):
            out = step(b)
            if out is not None and out.num_rows:
                yield out
    return df.select(*dict.fromkeys(columns)).mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def crc_mod(column: str, n: int):
    """crc32 of the id's text modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


class TooLarge(ValueError):
    """A table that has to be bounded is larger than its documented bound."""
