"""Joins of boxes: fills behind text, limits below it, partners in a column. All are equi-joins on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.order import column_of


def best_fill(blocks: DataFrame, drawings: DataFrame) -> DataFrame:
    """doc_id, idx, r, g, b: the fill of the drawing that fits a box best.

    Drawings that are all but white, far larger than the box or cover too little of it
    don't count. Containing ones come first, then the most overlap, then the tightest,
    then the earliest.
    """
    j = blocks.select("doc_id", "page_idx", "idx", "x0", "y0", "x1", "y1").join(drawings, ["doc_id", "page_idx"])
    area = lambda a, b, c, d: (F.col(c) - F.col(a)) * (F.col(d) - F.col(b))
    over = T.overlap_width(F.col("x0"), F.col("x1"), F.col("dx0"), F.col("dx1")) * T.overlap_width(F.col("y0"), F.col("y1"), F.col("dy0"), F.col("dy1"))
    j = j.withColumns({"box": F.greatest(F.lit(1.0), area("x0", "y0", "x1", "y1")), "inter": over, "cand": F.greatest(F.lit(1.0), area("dx0", "dy0", "dx1", "dy1"))})
    j = j.withColumns({"overlap": F.col("inter") / F.col("box"), "times": F.col("cand") / F.col("box")})
    j = j.where((F.col("inter") > 0) & ~((F.col("r") >= 0.97) & (F.col("g") >= 0.97) & (F.col("b") >= 0.97)) & (F.col("times") <= 2.6) & ~((F.col("overlap") < 0.86) & (F.col("times") > 1.6)) & (F.col("overlap") >= 0.72))
    contains = ((F.col("dx0") <= F.col("x0") - 0.2) & (F.col("dy0") <= F.col("y0") - 0.2) & (F.col("dx1") >= F.col("x1") + 0.2) & (F.col("dy1") >= F.col("y1") + 0.2)) | (F.col("overlap") >= 0.995)
    score = F.struct(contains.cast("int"), F.round("overlap", 6), (-F.round(F.greatest(F.lit(0.0), F.col("times") - 1), 6)), -F.col("draw_idx"))
    return j.groupBy("doc_id", "idx").agg(F.max_by(F.struct("r", "g", "b"), score).alias("f")).select("doc_id", "idx", "f.*")


def bottom_limits(blocks: DataFrame) -> DataFrame:
    """doc_id, idx, bottom_limit: how far a box may spill down.

    Three points beyond its bottom, or up to 0.8 above the next box below that overlaps it
    across by 18 % of the narrower one (8 points at least), but not above its own bottom.
    Boxes that begin more than 24 points beyond the spill don't matter. On pages the order
    is (top, left, idx).
    """
    b = blocks.select("doc_id", "page_idx", "idx", "x0", "y0", "x1", "y1")
    nxt = b.toDF("doc_id", "page_idx", "n_idx", "nx0", "ny0", "nx1", "ny1")
    width = lambda a, c: F.greatest(F.lit(1.0), F.col(c) - F.col(a))
    need = F.greatest(F.lit(8.0), F.least(width("x0", "x1"), width("nx0", "nx1")) * 0.18)
    below = b.join(nxt, ["doc_id", "page_idx"]).where((F.col("ny0") > F.col("y0")) & (F.col("ny0") <= F.col("y1") + 27) & (T.overlap_width(F.col("x0"), F.col("x1"), F.col("nx0"), F.col("nx1")) >= need))
    first = below.groupBy("doc_id", "idx").agg(F.min("ny0").alias("top"))
    limit = F.least(F.col("y1") + 3.0, F.greatest(F.col("y1"), F.col("top") - 0.8))
    return b.join(first, ["doc_id", "idx"], "left").select("doc_id", "idx", F.when(F.col("top").isNull(), F.col("y1") + 3.0).otherwise(limit).alias("bottom_limit"))


def column_pairs(entries: DataFrame, page_width: float) -> DataFrame:
    """Overflowing paragraphs with underflowing ones of the same page and column, first with first.

    entries: doc_id, page_idx, idx, lid, x0, x1, type, issue, chars. Targets: nine tenths
    of the characters for the one, 12 % more (6 at least) for the other. Of several pairs
    of a paragraph the last counts.
    """
    e = entries.where(~F.lower("type").isin("image", "table", "figure") & F.col("lid").isNotNull() & F.col("issue").isin("OVERFLOW", "UNDERFLOW")).withColumn("col", column_of(page_width))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_idx", "col", "issue").orderBy("idx")))
    o, u = (e.where(F.col("issue") == k).select("doc_id", "page_idx", "col", "nth", F.col("lid").alias(f"{p}_lid"), F.col("chars").alias(f"{p}_chars"), F.col("idx").alias(f"{p}_idx")) for k, p in (("OVERFLOW", "o"), ("UNDERFLOW", "u")))
    pairs = o.join(u, ["doc_id", "page_idx", "col", "nth"])
    side = lambda own, other, mode, target: pairs.select("doc_id", F.col(f"{own}_lid").alias("lid"), F.concat(F.col("page_idx").cast("string"), F.lit(":"), "col").alias("column_id"), F.col(f"{other}_lid").alias("partner_lid"), F.lit(mode).alias("mode"), target.cast("long").alias("target_chars"), F.struct(F.greatest("o_idx", "u_idx"), "nth", F.lit(mode)).alias("at"))
    both = side("o", "u", "shorten", F.greatest(F.lit(1), F.floor(F.col("o_chars") * 9 / 10))).unionByName(side("u", "o", "lengthen", F.greatest(F.col("u_chars") + 6, F.floor(F.col("u_chars") * 112 / 100))))
    return both.groupBy("doc_id", "lid").agg(F.max_by(F.struct("column_id", "partner_lid", "mode", "target_chars"), "at").alias("p")).select("doc_id", "lid", "p.*")


def clip_text(spans: DataFrame, blocks: DataFrame, margin: float = 0.5) -> DataFrame:
    """doc_id, idx, pdf_text: the spans whose centre lies in a block's box widened by the margin, in reading order."""
    s = spans.toDF(*(c if c in ("doc_id", "page_idx") else f"s_{c}" for c in spans.columns))
    cx, cy = (F.col("s_x0") + F.col("s_x1")) / 2, (F.col("s_y0") + F.col("s_y1")) / 2
    j = blocks.select("doc_id", "page_idx", "idx", "x0", "y0", "x1", "y1").join(s, ["doc_id", "page_idx"]).where(cx.between(F.col("x0") - margin, F.col("x1") + margin) & cy.between(F.col("y0") - margin, F.col("y1") + margin))
    g = j.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("s_y0", "s_x0", "s_text"))).alias("a"))
    return g.select("doc_id", "idx", T.squeeze(F.array_join(F.transform("a", lambda x: x["s_text"]), " ")).alias("pdf_text"))


def merged_length(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The length that overlapping or touching intervals of a group cover, and how many stretches they form."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("fresh", (seen.isNull() | (F.col(start) > seen)).cast("int"))
    islands = rows.withColumn("island", F.sum("fresh").over(w)).groupBy(*keys, "island").agg((F.max(end) - F.min(start)).alias("n"))
    return islands.groupBy(*keys).agg(F.sum("n").alias("covered"), F.count("*").alias("stretches"))
