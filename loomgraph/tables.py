"""Durable intermediate tables in a folder that driver and executors share, and joins of
frames of which it is known whether they grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that each side of a join through a hub is dealt into.
HUB_PARTS = 8
#: Rows of about four numbers that a task takes of a shuffle whose rows are counted.
TASK_ROWS = 500_000
#: Rows below which a task isn't divided further among idle cores.
LEAST_ROWS = 50_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, removed when the JVM ends.

    Only where that is unset in a local session, as in tests, a temporary folder takes its
    place; a cluster must name a folder that all its machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/graph/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends there, and a lost executor
    reads files instead of computing the rounds before again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of a shuffle of so many rows of about four numbers each; wider rows count more.

    What a task holds then doesn't grow with the data.  Spark's own parts are fixed in
    number, or sized by compressed bytes, of which ids that ascend take few."""
    return max(1, -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def join_parts(spark: SparkSession, rows: int) -> int | None:
    """As ``parts_for``, for both sides of a merged join; None where Spark's own parts, about
    one a core, are small enough.

    Spark raises the parts of such a join to ``spark.sql.shuffle.partitions``, which costs
    more than it gives where rows are few."""
    parts = -(-rows // TASK_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def joined(left: DataFrame, right: DataFrame, on: Column | list[str], left_grows: bool | None = True, right_grows: bool | None = True, how: str = "inner") -> DataFrame:
    """An equality join that broadcasts nothing that grows with the data.

    Small files of ids hold many rows, and Spark judges by the files: a frame that it would
    send whole through the driver to each task may be of hundreds of MB.  Two frames that
    grow are therefore merged; one that stays small is broadcast to the other.  Where it
    isn't known of either (None), Spark chooses."""
    if left_grows is None or right_grows is None:
        return left.join(right, on, how)
    if not right_grows:
        return left.join(F.broadcast(right), on, how)
    if left_grows or how != "inner":
        return left.join(right.hint("merge"), on, how)
    return F.broadcast(left).join(right, on, how)


def hub_joined(left: DataFrame, right: DataFrame, on: Column, left_by: Column, right_by: Column) -> DataFrame:
    """An inner join of two growing frames on few keys, so that each key has many rows on
    both sides and makes their product.

    Each side is dealt into ``HUB_PARTS`` parts, by a hash of ``left_by`` and ``right_by``,
    and each part of one side meets each of the other once: a key's product is made by
    ``HUB_PARTS`` squared tasks, for ``HUB_PARTS`` copies of the rows before the product."""
    part = lambda by: F.pmod(F.xxhash64(by), F.lit(HUB_PARTS))
    every = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long")))
    left = left.withColumn("_i", part(left_by)).withColumn("_j", every())
    right = right.withColumn("_jj", part(right_by)).withColumn("_ii", every())
    met = left.join(right.hint("merge"), on & (F.col("_i") == F.col("_ii")) & (F.col("_j") == F.col("_jj")))
    return met.drop("_i", "_j", "_ii", "_jj")
