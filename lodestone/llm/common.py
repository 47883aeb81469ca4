"""What the operators of this subpackage share: tables, the shared scratch folder, input selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import scratch, written  # noqa: F401  the operators import them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the names used inside an operator, so that no other column of
    the caller can clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def kept_in_worker(key: object, make) -> object:
    """make()'s result, once for each Python worker however many tasks it runs."""
    import sys
    import types

    module = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
    if key not in module.__dict__:
        module.__dict__[key] = make()
    return module.__dict__[key]


def release() -> None:
    """Gives memory that a kernel no longer uses back to the system: Spark keeps Python workers for
    later tasks, and what they hold counts against the executor."""
    import contextlib
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidied(kernel):
    """The kernel, with memory released when its partition is done."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release()

    return run
