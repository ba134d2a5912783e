"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.ordering import settle

#: Tables of ids with up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame written once, and marked for broadcast if it has few enough rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of text that travel to a Python worker together.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of whole texts that stay small beside an
    executor's memory; a number that was set on purpose is kept."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return spark


#: What a worker keeps from task to task, by owner; another owner's work drops it.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """A memory of this worker that lasts while it does the owner's work alone."""
    return _kept.setdefault(owner, {})


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`rows` for mapInArrow in workers that live on after the task: what other
    work kept is dropped first, and freed memory goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _kept if n != owner]:
            del _kept[name]
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not this C library

    return run


def fresh(name: str, columns: Sequence[str]) -> str:
    """A column name that `columns` does not have, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
