"""The folder that all executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written under spark.checkpoint.dir (a temporary folder only where that is unset) and read again."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
