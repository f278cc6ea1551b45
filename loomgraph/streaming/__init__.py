"""Ingest of dump files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import dump


def ingest_dumps(spark: SparkSession, inbox: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parses dump files that appear in ``inbox`` and appends their nodes (id, labels,
    props) and edges (src, type, dst, props) to ``folder``, partitioned by type.

    Each file counts once, across restarts; ``once`` takes what is there and ends."""
    text = spark.readStream.text(inbox, lineSep="\ncreate ")

    def add(batch: DataFrame, epoch: int) -> None:
        found = dump.clean(batch, "create")
        nodes, edges, _ = dump.parse(found)
        # A batch that is tried again replaces its own folder.
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes/batch={epoch}")
        edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges/batch={epoch}")

    writer = text.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
