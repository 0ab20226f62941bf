"""Page coverage: how much of the text expected on a page is found there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

NON_TEXT = tuple("curve equation figure formula image line rect table".split())


def page_stats(blocks: DataFrame) -> DataFrame:
    """Counts of each page from its blocks (doc_id, page_idx, type, detected_type, translated); page_no is 1-based."""
    kind, detected = F.lower(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("detected_type", F.lit("")))
    count = lambda c: F.count_if(c).cast("long")
    rows = blocks.where("page_idx is not null").select("doc_id", (F.col("page_idx") + 1).alias("page_no"), kind.alias("t"), detected.alias("d"), F.length(T.compact("translated")).alias("chars"))
    text = ~F.col("t").isin(*NON_TEXT)
    return rows.groupBy("doc_id", "page_no").agg(
        F.coalesce(F.sum(F.when(text, F.col("chars"))), F.lit(0)).cast("long").alias("expected_chars"), F.count("*").alias("total_items"), count(text).alias("text_items"), count(~text).alias("non_text_items"),
        count(F.col("t").isin("equation", "formula") | F.col("d").isin("equation", "formula")).alias("formula_items"), count((F.col("t") == "reference") | (F.col("d") == "reference")).alias("reference_items"),
        count(F.col("d").isin("title", "section_header")).alias("title_items"), count(F.col("t").isin("header", "page_footnote", "page_number") | F.col("d").isin("footnote", "footer")).alias("header_footer_items"))


COUNTS = ("expected_chars", "total_items", "text_items", "non_text_items", "formula_items", "reference_items", "title_items", "header_footer_items")

#: In SQL that both engines read; also the oracle's.
RATIO_SQL = "case when expected_chars <= 0 then case when actual_chars > 0 then 1.0 else 0.0 end else cast(actual_chars as double) / expected_chars end"
LABEL_SQL = """case when expected_chars <= 0 then '非主文本页' when ratio >= 0.82 then 'OK'
  when (formula_items >= 4 or (total_items > 0 and cast(formula_items as double) / total_items >= 0.35)) and ratio >= 0.5 then '公式页低抽取'
  when reference_items >= 3 and ratio >= 0.55 then '参考文献页低抽取' else '建议视觉复核' end"""


def page_coverage(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page of `pages` (doc_id, page_no, page_text) with its counts, ratio and label.

    Blocks on pages that don't exist are dropped; pages without blocks count zero.
    """
    found = pages.select("doc_id", "page_no", F.length(T.compact("page_text")).cast("long").alias("actual_chars"))
    joined = found.join(page_stats(blocks), ["doc_id", "page_no"], "left").fillna(0, list(COUNTS))
    return joined.withColumn("ratio", F.expr(RATIO_SQL).cast("double")).withColumn("label", F.expr(LABEL_SQL))


def label_totals(coverage: DataFrame) -> DataFrame:
    """Pages by label, for each document and (doc_id NULL) for all."""
    return coverage.groupingSets([["doc_id", "label"], ["label"]], "doc_id", "label").agg(F.count("*").alias("pages"))


def review_first(coverage: DataFrame, n: int = 30) -> DataFrame:
    """The n pages that most need a look: lowest ratio, then most text expected."""
    order = [F.col("ratio"), F.col("expected_chars").desc(), F.col("doc_id"), F.col("page_no")]
    top = coverage.where("label not in ('OK', '非主文本页')").orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "doc_id", "page_no", "label", "expected_chars", "actual_chars")
