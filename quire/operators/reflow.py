"""The rounds of fitting: simulate, tune, classify, rewrite what doesn't fit, until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import classify, layout
from quire.sources.shared import materialise

#: (blocks to rewrite: doc_id, idx, mode, target_chars, text) -> (doc_id, idx, new_text)
Rewriter = Callable[[DataFrame], DataFrame]


def iterations(max_rounds: int, rewrite: bool) -> int:
    """How often the loop runs: once without rewriting, else rewriting rounds (one at least) and a last look."""
    return max(1, max(1, max_rounds) - 1) + 1 if rewrite else 1


def evaluate(blocks: DataFrame) -> DataFrame:
    """status, issue, fill_ratio and overflow_px of each block at its base style.

    blocks: doc_id, idx, text, width, height, size, line, char, locked, font_key, limit,
    threshold, global_min, global_max, max_delta.
    """
    tuned = blocks.select("*", layout.tuned_style().alias("_t")).select(*blocks.columns, "_t.status", "_t.overflow_px", F.col("_t.size").alias("t_size"), F.col("_t.char").alias("t_char"))
    fitted = layout.simulate(tuned.withColumnsRenamed({"size": "b_size", "char": "b_char"}).withColumnsRenamed({"t_size": "size", "t_char": "char"}))
    issue = F.when((F.col("status") == "overflow") & (F.col("overflow_px") > 2), "OVERFLOW").when(~F.col("is_overflow") & (F.col("fill_ratio") < F.col("threshold")) & ~F.col("font_key").isin("title", "heading"), "UNDERFLOW").otherwise("OPTIMAL")
    return fitted.withColumn("issue", issue).withColumnsRenamed({"size": "t_size", "char": "t_char"}).withColumnsRenamed({"b_size": "size", "b_char": "char"})


def target_chars(rows: DataFrame) -> DataFrame:
    """How long a rewritten text should be: characters by target over fill, within the bounds of growth."""
    r = rows.withColumns({"target_fill": F.expr(classify.FILL_TARGET_SQL).cast("double"), "low": F.expr(classify.MIN_GROWTH_SQL).cast("double"), "high": F.expr(classify.MAX_GROWTH_SQL).cast("double"), "n": F.length(F.regexp_replace("text", r"[ \n]", ""))})
    raw = F.floor(F.col("n") * F.col("target_fill") / F.greatest(F.col("fill_ratio"), F.lit(0.01)))
    longer = F.least(F.floor(F.col("n") * F.col("high")), F.greatest(raw, F.floor(F.col("n") * F.col("low")), F.col("n") + 6))
    return r.withColumn("target_chars", F.when(F.col("issue") == "OVERFLOW", F.greatest(F.lit(1), raw)).otherwise(longer).cast("long"))


def run_rounds(blocks: DataFrame, rewriter: Rewriter | None, max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(final blocks with their state, log of all rounds).

    Each round judges all blocks that aren't settled on one snapshot; what a rewriter
    returns counts from the next round on. Settled blocks (OPTIMAL or FORCE_FIT) aren't
    looked at again. The last round forces what still overflows and accepts what is still
    short. Every round is written to the shared folder, so its lineage ends there.
    """
    total = iterations(max_rounds, rewriter is not None)
    open_, settled, log = materialise(blocks, "blocks"), None, None
    for k in range(total):
        final = k == total - 1
        judged = target_chars(evaluate(open_))
        can = F.col("can_rewrite") & F.lit(not final)
        state = F.when((F.col("issue") != "OPTIMAL") & can, "REWRITE_SCHEDULED").when(F.col("issue") == "OVERFLOW", "FORCE_FIT").otherwise("OPTIMAL")
        judged = materialise(judged.withColumns({"state": state, "round": F.lit(k)}), "judged")
        entry = judged.select("doc_id", "idx", "round", "status", "issue", "state", "fill_ratio", "overflow_px", "target_chars")
        log = entry if log is None else log.unionByName(entry)
        done = judged.where("state <> 'REWRITE_SCHEDULED'").select(*blocks.columns, "state", "round", "t_size", "t_char")
        settled = done if settled is None else settled.unionByName(done)
        todo = judged.where("state = 'REWRITE_SCHEDULED'")
        if final or rewriter is None or todo.isEmpty():
            break
        asked = todo.select("doc_id", "idx", F.when(F.col("issue") == "OVERFLOW", "shorten").otherwise("lengthen").alias("mode"), "target_chars", "text")
        new = rewriter(asked).select("doc_id", "idx", "new_text")
        open_ = materialise(todo.select(*blocks.columns).join(new, ["doc_id", "idx"], "left").withColumn("text", F.coalesce("new_text", "text")).select(*blocks.columns), "blocks")
    return settled, log


def length_rewriter(asked: DataFrame) -> DataFrame:
    """A stand-in for a model: texts cut to their target, or repeated up to it."""
    n = F.greatest(F.lit(1), F.length("text"))
    long = F.substring(F.repeat(F.concat("text", F.lit(" ")), (F.floor(F.col("target_chars") / n) + 1).cast("int")), F.lit(1), F.col("target_chars").cast("int"))
    return asked.select("doc_id", "idx", F.when(F.col("mode") == "shorten", F.substring("text", F.lit(1), F.col("target_chars").cast("int"))).otherwise(long).alias("new_text"))


def round_stats(log: DataFrame) -> DataFrame:
    """For each round: blocks judged, satisfied ones and their share."""
    ok = F.col("issue") == "OPTIMAL"
    return log.groupBy("round").agg(F.count("*").alias("judged"), F.count_if(ok).alias("satisfied"), F.avg(ok.cast("double")).alias("share"))
