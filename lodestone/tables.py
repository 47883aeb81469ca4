"""Tables in the folder that driver and executors share: a plan's lineage is cut by writing there."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    """A temporary folder that goes when this process ends."""
    path = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a temporary folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps start from there, and a lost
    executor loses nothing."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark))
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores, if its files make fewer partitions than there are; else the scan."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan._jdf.queryExecution().toRdd().getNumPartitions() < n else scan


def in_order(df: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """df as a written table with its rows numbered from 1 in an order; no task sees more than its range.
    What reaches the driver is a count for each partition."""
    own = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    before, starts = 0, []
    for r in sorted(own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    if not starts:
        return own
    known = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = own.withColumn("__part", part).join(F.broadcast(known), "__part")
    return out.withColumn(name, F.col("__start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__start")


def join_in_parts(left: DataFrame, right: DataFrame, on: list[str], hot: int = 1024) -> DataFrame:
    """The inner join, with groups of over ``hot`` rows of the right side dealt into parts, to each of which
    the left side's rows are copied, so that no group is one task's.  The right side is read twice."""
    known = written(right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(*on, F.ceil(F.col("__n") / hot).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = right.join(known, on, "left").withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in right.columns if c not in on] or [F.lit(0)]), parts).cast("int")).drop("__parts")
    copied = left.join(known, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return copied.join(dealt, [*on, "__part"]).drop("__part")
