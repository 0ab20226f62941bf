"""Reading order, columns and the paragraphs that ordered blocks form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import classify as C


def reading_order(blocks: DataFrame) -> DataFrame:
    """place: a block's rank in its logical paragraph (doc_id, lid), pages in order.

    On a page a paragraph looks two-columned if two boxes or more are at most 0.72 of its
    span wide and the centres lie 0.22 of the span apart. Then boxes across both columns
    (0.78 of the span) come first, then the left and the right column; else only height
    counts. Ties keep the order of idx. Blocks without lid are left out.
    """
    rows = blocks.where("lid is not null")
    page = Window.partitionBy("doc_id", "lid", "page_idx")
    wide, centre = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), (F.col("x0") + F.col("x1")) / 2
    rows = rows.withColumns({"span": F.greatest(F.lit(1.0), F.max("x1").over(page) - F.min("x0").over(page)), "spread": F.max(centre).over(page) - F.min(centre).over(page), "middle": F.avg(centre).over(page), "n": F.count("*").over(page)})
    rows = rows.withColumn("narrow", F.sum((wide <= F.col("span") * 0.72).cast("int")).over(page))
    two = (F.col("n") >= 2) & (F.col("narrow") >= 2) & (F.col("spread") >= F.col("span") * 0.22)
    column = F.when(~two, 0).when(wide >= F.col("span") * 0.78, -1).when(centre <= F.col("middle"), 0).otherwise(1)
    order = Window.partitionBy("doc_id", "lid").orderBy("page_idx", column, "y0", "x0", "idx")
    return rows.withColumn("place", F.row_number().over(order)).drop("span", "spread", "middle", "n", "narrow")


def column_of(page_width: float | str = "page_width") -> Column:
    """left, right or full, by where a box's centre lies."""
    w = F.lit(float(page_width)) if not isinstance(page_width, str) else F.col(page_width)
    c = (F.col("x0") + F.col("x1")) / 2
    return F.when((w > 0) & (c < w * 0.42), "left").when((w > 0) & (c > w * 0.58), "right").otherwise("full")


def contexts(blocks: DataFrame) -> DataFrame:
    """The text of each paragraph: its blocks by (page, top, left), squeezed and joined by spaces."""
    part = F.struct("page_idx", "y0", "x0", "idx", T.squeeze("text").alias("text"))
    grouped = blocks.where("lid is not null").groupBy("doc_id", "lid").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("doc_id", "lid", F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("context"))


def siblings(blocks: DataFrame) -> DataFrame:
    """doc_id, lid, type, idxs, source, translated: blocks of one paragraph and one raw type, in reading order.

    source is their text joined by blanks, translated theirs without any. NULL types are a
    type of their own; blocks without lid are left out.
    """
    part = F.struct("place", "idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("translated", F.lit("")).alias("translated"))
    grouped = reading_order(blocks).groupBy("doc_id", "lid", "type").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.select("doc_id", "lid", "type", F.expr("transform(p, x -> x.idx)").alias("idxs"), F.array_join(F.expr("transform(p, x -> x.text)"), " ").alias("source"), F.array_join(F.expr("transform(p, x -> x.translated)"), "").alias("translated"))


def reference_sections(blocks: DataFrame) -> DataFrame:
    """doc_id, lid, preserve, in_section: which paragraphs stay untranslated as references.

    A paragraph is preserved if its text is a heading such as References or any of its
    blocks has a reference type. in_section: a heading or a first block of such a type
    comes at or before its own place, by page and top of first blocks (ties count as one place).
    """
    typed = F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit("reference"))
    grouped = blocks.where("lid is not null").groupBy("doc_id", "lid").agg(F.max(typed).alias("any_typed"), F.min(F.struct("page_idx", "y0", "idx", typed.alias("typed"))).alias("first"))
    rows = grouped.join(contexts(blocks), ["doc_id", "lid"]).withColumn("heading", C.reference_heading("context"))
    begun = Window.partitionBy("doc_id").orderBy("first.page_idx", "first.y0")
    return rows.select("doc_id", "lid", (F.col("heading") | F.col("any_typed")).alias("preserve"), F.max(F.col("heading") | F.col("first.typed")).over(begun).alias("in_section"))


def recovery_examples(recovered: DataFrame, limit: int = 5) -> DataFrame:
    """doc_id, nth, page_no, source, excerpt: the first recovered blocks of each document by idx, 140 characters of each."""
    # a filter would be pushed below what recovers the texts and do all of that again; rows that are generated aren't
    found = F.when(F.col("recovered").isNotNull(), F.array(F.struct("source", F.substring("recovered", 1, 140).alias("excerpt")))).otherwise(F.array())
    rows = recovered.select("doc_id", "idx", "page_idx", F.inline(found))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit).select("doc_id", "nth", (F.col("page_idx") + 1).alias("page_no"), "source", "excerpt")


def first_blocks(blocks: DataFrame) -> DataFrame:
    """The first block of each paragraph by (page, top), without regard to columns."""
    return blocks.where("lid is not null").groupBy("doc_id", "lid").agg(F.min_by("idx", F.struct("page_idx", "y0", "idx")).alias("first_idx"), F.count("*").alias("boxes"))


def recover(blocks: DataFrame) -> DataFrame:
    """recovered, source: a better text for blocks that say next to nothing, from pdf_text or local_md.

    Of the candidates that are clearly richer the page's text is taken, unless the
    cleaned markdown carries more information.
    """
    rows = blocks.withColumn("_t", T.squeeze("text")).withColumn("_low", T.low_information_of(F.col("_t")))
    # each text is cleaned and counted once, and only where it may be taken
    rows = rows.withColumns({"_p": F.when(F.col("_low"), T.squeeze(T.strip_control("pdf_text"))), "_m": F.when(F.col("_low"), T.clean_markdown("local_md"))})
    rows = rows.withColumns({f"{c}n": F.when(F.col("_low"), T.information_of(F.col(c))) for c in ("_t", "_p", "_m")})
    better = {c: F.when(T.richer_of(F.col("_t"), F.col("_tn"), F.col(c), F.col(f"{c}n")), F.col(c)) for c in ("_p", "_m")}
    rows = rows.withColumns({f"{c}r": x for c, x in better.items()})
    by_md = F.col("_mr").isNotNull() & (F.col("_pr").isNull() | (F.col("_mn") > F.col("_pn")))
    rows = rows.withColumn("_by", F.when(by_md, "local_md").when(F.col("_pr").isNotNull(), "pdf_text"))
    return rows.withColumns({"recovered": F.when(F.col("_by") == "local_md", F.col("_mr")).when(F.col("_by") == "pdf_text", F.col("_pr")), "source": F.col("_by")}).drop("_t", "_low", "_p", "_m", "_tn", "_pn", "_mn", "_pr", "_mr", "_by")
