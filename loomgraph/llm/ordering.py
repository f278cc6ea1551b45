"""Global order by an id without gathering rows: contiguous range slices.

``range_bounds`` returns the first and last id of each slice (as many rows as
there are partitions, whatever the data).  Rows then find their slice by binary
search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order key of rows without an id: before all others.
NO_ID = -(1 << 63)


def slices_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest keys, highest keys) of at most ``slices`` non-empty slices, ascending.

    One row per slice reaches the driver.  Equal keys share a slice."""
    ids = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k")).repartitionByRange(slices, "k")
    got = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    return np.array([r["lo"] for r in got], np.int64), np.array([r["hi"] for r in got], np.int64)
