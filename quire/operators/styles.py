"""Styles of blocks: sizes, colours, spacing corridors, styled words, and what a frozen style allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.classify import meaningful_token
from quire.operators.spatial import merged_length

#: A block of one compact box at the top of the first page: names, dates, marks (columns page_idx, compact_box, multi_box, font_key, detected_type, y1, height, chars).
FRAGILE_META_SQL = """((font_key = '' or font_key = 'body') and page_idx = 0 and compact_box and not multi_box and not contains(detected_type, 'title') and not contains(detected_type, 'section_header') and y1 <= 200.0 and height <= 18.0 and chars <= 48)"""
FRAGILE_MULTIBOX_SQL = "((font_key = '' or font_key = 'body') and multi_box and not safe_prose)"


def span_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The median size of each block's spans (size above 0, more than one character), 9.0 without any."""
    ok = (F.col("size") > 0) & (F.length(T.squeeze("text")) > 1)
    return spans.groupBy(*keys).agg(F.coalesce(F.median(F.when(ok, F.col("size"))), F.lit(9.0)).alias("size"))


def shared_size(blocks: DataFrame) -> DataFrame:
    """blocks with `size` as the whole paragraph has it: that of its first block by idx. All blocks without lid share one, too."""
    w = Window.partitionBy("doc_id", "lid").orderBy("idx")
    return blocks.withColumn("size", F.first("size").over(w))


def golden_value(styles: DataFrame, key: str, value: str, step: float) -> DataFrame:
    """For each key the body style's value; without it the mode if any value repeats (the least of several), else the median, to the step."""
    v = styles.where(F.col(value).isNotNull())
    counted = v.groupBy(key, value).agg(F.count("*").alias("c"))
    modes = counted.groupBy(key).agg(F.max("c").alias("top"), F.max_by(value, F.struct("c", -F.col(value))).alias("mode"))
    g = v.groupBy(key).agg(F.max(F.when(F.col("style") == "body", F.col(value))).alias("body"), F.median(value).alias("median")).join(modes, key)
    other = F.when(F.col("top") > 1, F.col("mode")).otherwise(F.col("median"))
    return g.select(key, F.coalesce("body", T.round_step(other, step)).alias(value))


def clamp_style(rows: DataFrame) -> DataFrame:
    """line and char within the corridor around the base style (columns base_line, base_char, global_min, global_max, max_delta)."""
    low, high = F.greatest("global_min", F.col("base_char") - F.col("max_delta")), F.least("global_max", F.col("base_char") + F.col("max_delta"))
    return rows.withColumns({"line": F.round(F.least(F.lit(1.55), F.greatest(F.lit(1.15), F.col("base_line"))), 3), "char": F.least(high, F.greatest(low, F.col("char")))})


def force_fit(rows: DataFrame) -> DataFrame:
    """action and char for a block that still overflows: up to 5 points are accepted, else spacing shrinks by 0.01 to the floor."""
    small = F.col("overflow_px") <= 5
    return rows.withColumns({"action": F.when(small, "accept_minor_overflow").otherwise("force_fit_without_font_change"), "char": F.when(small, F.col("char")).otherwise(F.greatest(F.col("global_min"), F.col("char") - 0.01))})


def clamp_frozen(value: Column, low: Column, high: Column) -> Column:
    return T.round_step(F.least(high, F.greatest(low, value)), 0.005)


def formula_size(width: Column, height: Column, line_height: Column, max_width: Column) -> tuple[Column, Column]:
    """An image of a formula scaled down to a line's height and then to a width; never up."""
    by_height = F.least(F.lit(1.0), line_height / F.greatest(height, F.lit(1e-6)))
    scale = F.least(by_height, max_width / F.greatest(width * by_height, F.lit(1e-6)) * by_height)
    return width * scale, height * scale


def bottom_limit(y1: Column, size: Column, explicit: Column) -> Column:
    """How far down a box may be painted: as told, else 0.28 of the size (1.5 to 4 points) beyond its bottom."""
    return F.greatest(y1, F.coalesce(explicit, y1 + F.greatest(F.lit(1.5), F.least(F.lit(4.0), size * 0.28))))


def normalise_color(r: Column, g: Column, b: Column) -> Column:
    """Channels in 0 to 1; if one is above 1 all are taken as 0 to 255."""
    top = F.greatest(r, g, b)
    return F.struct(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(top > 1, c / 255.0).otherwise(c))).alias(n) for n, c in (("r", r), ("g", g), ("b", b))))


def color_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of channels; 1.0 if either colour is missing."""
    return F.coalesce((F.abs(a["r"] - b["r"]) + F.abs(a["g"] - b["g"]) + F.abs(a["b"] - b["b"])) / 3.0, F.lit(1.0))


def cleanup_fill(fill: Column) -> Column:
    """The colour that an area is cleared with: a known fill unless it is close to white, else white."""
    white = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("g"), F.lit(1.0).alias("b"))
    near = (fill["r"] >= 0.97) & (fill["g"] >= 0.97) & (fill["b"] >= 0.97)
    return F.when(fill.isNull() | near, white).otherwise(fill)


def style_keywords(spans: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, token, bold, italic: the words that a block's spans set in bold or italics, each once."""
    s = spans.select(*keys, T.squeeze("text").alias("token"), T.is_bold(F.col("flags")).alias("bold"), T.is_italic(F.col("flags")).alias("italic"))
    return s.where((F.length("token") >= least) & (F.col("bold") | F.col("italic"))).groupBy(*keys, "token").agg(F.bool_or("bold").alias("bold"), F.bool_or("italic").alias("italic"))


def sanitise_mapping(words: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """The styled words (keys, token, bold, italic) that make sense in the texts (keys, translated).

    Words that say something and occur stay; short ones that occur too often go. All of a
    text's words go if they cover more than 0.72 of it and are four or more, or if there
    are more than a sixth of its characters (14 at least).
    """
    j = words.where(meaningful_token("token") & (F.col("bold") | F.col("italic"))).join(texts, keys).where(F.contains("translated", F.col("token")))
    n, k = F.length("token"), F.floor((F.length("translated") - F.length(F.replace("translated", "token", F.lit("")))) / F.length("token"))
    j = j.withColumn("times", k).where(~((n <= 2) & (F.col("times") > 2)) & ~((n <= 3) & (F.col("times") > 3)))
    # where the pieces between occurrences end, the occurrences begin
    pieces = F.transform(F.slice(F.split("translated", F.concat(F.lit(r"\Q"), "token", F.lit(r"\E")), -1), F.lit(1), F.col("times").cast("int")), lambda x: F.length(x))
    starts = F.transform(pieces, lambda _, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + i * F.length("token"))
    spots = j.select(*keys, "token", F.explode(starts).alias("start")).withColumn("end", F.col("start") + F.length("token"))
    covered = merged_length(spots, keys)
    count = j.groupBy(*keys).agg(F.count_distinct("token").alias("tokens"), F.max(F.length("translated")).alias("len"))
    bad = covered.join(count, keys).where(((F.col("covered") / F.greatest(F.lit(1), F.col("len")) > 0.72) & (F.col("tokens") >= 4)) | (F.col("tokens") > F.greatest(F.lit(14), F.floor(F.col("len") / 6))))
    return j.select(*keys, "token", "bold", "italic").join(bad.select(*keys), keys, "left_anti")


def failed_paragraphs(blocks: DataFrame, skip: tuple[str, ...] = ("code", "curve", "equation", "figure", "image", "line", "rect", "table")) -> DataFrame:
    """doc_id, lid of paragraphs that have a block without translated text, apart from types that have none."""
    rows = blocks.where(F.col("lid").isNotNull() & ~F.lower("type").isin(*skip))
    return rows.groupBy("doc_id", "lid").agg(F.bool_or(T.squeeze("translated") == "").alias("f")).where("f").select("doc_id", "lid")


def paired_pages(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages of both sides by number; a side without the page gets 595 by 842 points."""
    a, b = (d.select("doc_id", "page_no", F.col("page_width").alias(f"{s}_width"), F.col("page_height").alias(f"{s}_height")) for d, s in ((original, "left"), (translated, "right")))
    return a.join(b, ["doc_id", "page_no"], "full").fillna({"left_width": 595.0, "left_height": 842.0, "right_width": 595.0, "right_height": 842.0})
