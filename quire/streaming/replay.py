"""An extension: counts over an action log that grows, kept up to date by Structured Streaming.

The log arrives as Parquet files in a folder. Counts are additive, so each trigger's
batch is aggregated once and merged into the table of totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import state


def attribution_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes state.attribution of every batch of new files to `out`, one folder a batch; sum over them for the totals.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state.attribution(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
