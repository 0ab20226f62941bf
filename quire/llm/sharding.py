"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash_key, materialise, pick, prefix_sums

SHARDS = 64


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[pd.DataFrame, np.ndarray]:
    """LPT for counts[i] groups of sizes[i]; gives (size, from_rank, to_rank, shard) and the loads.

    Sizes are taken in falling order; each group goes to the least loaded shard (of equal
    ones the lowest) by a heap. Groups of one size are alike, so where there are more of
    them than shards the heap's outcome is computed at once: a shard of load L takes its
    m-th group of size z at level L + (m - 1) z, and the c lowest levels win.
    """
    loads = np.zeros(shards, np.int64)
    out: list[tuple[int, int, int, int]] = []
    for z, c in sorted(zip(map(int, sizes), map(int, counts)), reverse=True):
        if c <= shards:
            heap = [(int(x), k) for k, x in enumerate(loads)]
            heapq.heapify(heap)
            took: dict[int, int] = {}
            for _ in range(c):
                load, k = heap[0]
                took[k] = took.get(k, 0) + 1
                heapq.heapreplace(heap, (load + z, k))
            share = sorted(took.items())
        elif z == 0:
            share = [(int(loads.argmin()), c)]
        else:
            low, high = int(loads.min()) - 1, int(loads.min()) + c * z
            while high - low > 1:  # the least level at which c groups or more have been taken
                mid = (low + high) // 2
                if int(np.maximum(0, (mid - loads) // z + 1).sum()) >= c:
                    high = mid
                else:
                    low = mid
            got = np.maximum(0, (high - 1 - loads) // z + 1)
            at_level = np.flatnonzero((loads <= high) & ((high - loads) % z == 0))[: c - int(got.sum())]
            got[at_level] += 1
            share = [(int(k), int(got[k])) for k in np.flatnonzero(got)]
        rank = 0
        for k, n in share:
            out.append((z, rank, rank + n, k))
            rank += n
            loads[k] += n * z
    return pd.DataFrame(out, columns=["size", "from_rank", "to_rank", "shard"]), loads


def shard(docs: DataFrame, shards: int = SHARDS, group_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, shard, group_key, group_size.

    Documents with the same group stay together; by default a group is all copies of one
    text (told by its MD5), or the values of group_col. A group's size is its characters.
    Groups go, longest first, to the least loaded shard. Groups of one size are told apart
    by a hash of their key only to say which goes where; the loads don't depend on it. The
    driver schedules over the histogram of sizes, of which there are no more than the
    longest group has characters, however many groups there are.

    A NULL text counts 0 characters, and without group_col all NULL texts are one group;
    NULL in group_col likewise is a group. Every row gets a shard, rows that repeat as
    often as they do.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(F.md5("text"), F.lit("")) if group_col is None else F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))
    base = pick(docs, doc_id=id_col, text=text_col, **({} if group_col is None else {"grp": group_col}))
    small = materialise(base.select("doc_id", key.alias("group_key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")), "groups")
    groups = small.groupBy("group_key").agg(F.sum("n").alias("group_size"))
    groups = materialise(prefix_sums(groups.withColumn("k", hash_key("group_key")).withColumn("one", F.lit(1).cast("long")), "group_size", "k", "one", ["group_key"], "rank").select("group_key", "group_size", "rank"), "ranks")
    histogram = groups.groupBy("group_size").count().toPandas()
    plan, _ = schedule(histogram["group_size"].to_numpy(), histogram["count"].to_numpy(), shards)
    plan = docs.sparkSession.createDataFrame(plan.astype("int64"), "size long, from_rank long, to_rank long, shard long")
    placed = groups.join(plan, (groups.group_size == plan["size"]) & (groups["rank"] >= plan.from_rank) & (groups["rank"] < plan.to_rank)).select("group_key", "group_size", F.col("shard").cast("int").alias("shard"))
    return small.join(placed, "group_key").select("doc_id", "shard", "group_key", "group_size")
