"""What the operators share: column selection, the shared folder, and distributed prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a prefix sum sorts.
ROWS_PER_RANGE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; set here only where it is unset."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends, and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """`run`, a function over Arrow batches, after which the worker gives freed memory back: it waits for the next stage beside the JVM."""

    def give_back(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return give_back


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def hash_key(*parts: Column | str) -> Column:
    """A 60-bit key from md5 of the parts joined by ':' (NULL as the empty text)."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_key_sql(*parts: str) -> str:
    """The same key in DuckDB."""
    text = " || ':' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


def word_count(text: str = "text") -> Column:
    """Words of a text: runs of characters other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


WORD_COUNT_SQL = r"cast(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) as bigint)"


def prefix_sums(df: DataFrame, group: str, key: str, measure: str, tie: list[str], out: str = "before") -> DataFrame:
    """Adds `out`: the sum of `measure` over rows of the same `group` with a smaller (`key`, *tie).

    `key` is uniform in [0, 2**60), so each group is cut into as many equal key ranges as
    its row count asks for. One task sorts one range; the sums of the ranges are joined to
    it. A group of any size is thus spread out. NULL is a group of its own.
    """
    ranges = df.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS_PER_RANGE)).cast("long").alias("_n"))
    placed = df.join(ranges, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_r", F.shiftright(F.shiftright(F.col(key), 30) * F.col("_n"), 30)).drop("_g", "_n")
    parts = placed.groupBy(F.col(group).alias("_pg"), F.col("_r").alias("_pr")).agg(F.sum(measure).alias("_s"))
    earlier = Window.partitionBy("_pg").orderBy("_pr").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pg", "_pr", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    within = Window.partitionBy(group, "_r").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(parts, F.col(group).eqNullSafe(F.col("_pg")) & (F.col("_r") == F.col("_pr")))
    return joined.withColumn(out, (F.col("_o") + F.coalesce(F.sum(measure).over(within), F.lit(0))).cast("long")).drop("_pg", "_pr", "_o", "_r")
