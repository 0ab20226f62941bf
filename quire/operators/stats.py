"""Statistics of documents, paragraphs and style buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.classify import TEXT_LIKE_SQL, bucket_sql

GRAPHICS = tuple("curve figure image line rect table".split())


def document_profile(blocks: DataFrame) -> DataFrame:
    """For each document: blocks, text blocks, mean text length, median area for each character, mean area."""
    text = T.strip(T.text_of("text"))
    rows = blocks.select("doc_id", (~F.lower(F.coalesce("type", F.lit(""))).isin(*GRAPHICS) & (text != "")).alias("is_text"), F.length(text).alias("n"), (F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))).alias("area"))
    solid = F.col("is_text") & (F.col("area") > 0)
    return rows.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.count_if("is_text").alias("text_block_count"), F.coalesce(F.avg(F.when(F.col("is_text"), F.col("n"))), F.lit(0.0)).alias("avg_text_length"),
                                      F.coalesce(F.median(F.when(solid, F.col("area") / F.greatest(F.lit(1), F.col("n")))), F.lit(0.0)).alias("median_source_density"), F.coalesce(F.avg(F.when(solid, F.col("area"))), F.lit(0.0)).alias("avg_bbox_area"))


def paragraph_facts(blocks: DataFrame) -> DataFrame:
    """Risk facts of each paragraph, from its first block by (page, top) and its joined text."""
    order = F.struct("page_idx", "y0", "idx")
    part = F.struct("page_idx", "y0", "idx", T.text_of("text").alias("text"))
    rows = blocks.where("lid is not null").withColumn("text_like", F.expr(TEXT_LIKE_SQL)).withColumn("bucket", F.expr(bucket_sql()))
    g = rows.groupBy("doc_id", "lid").agg(
        F.count("*").alias("boxes"), F.min_by(F.lower(F.coalesce("type", F.lit(""))), order).alias("type"), F.min_by("bucket", order).alias("bucket"), F.min_by(F.coalesce(F.nullif(F.lower("detected_type"), F.lit("")), F.lower("type"), F.lit("")), order).alias("detected_type"),
        F.min_by(F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")), order).alias("height"), F.bool_and("text_like").alias("all_text_like"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " ").alias("text"))
    g = g.withColumns({"chars": F.length(T.compact("text")), "math": T.math_segments("text"), "latex": T.latex_commands("text"), "theorem": T.theorem_like("text"), "compact_box": (F.col("height") > 0) & (F.col("height") <= 22), "multi_box": F.col("boxes") > 1})
    plain = (F.col("chars") >= 20) & (F.col("math") == 0) & (F.col("latex") == 0) & ~F.col("theorem") & ~F.col("compact_box")
    multi = F.col("multi_box") & (F.col("boxes") <= 3) & F.col("all_text_like")
    return g.withColumns({"plain": plain, "multi_ok": multi, "safe_multibox": (F.col("bucket") == "body") & plain & multi, "safe_prose": (F.col("bucket") == "body") & plain & (~F.col("multi_box") | multi)})


DOC_TYPES_SKIPPED = (*GRAPHICS, "equation", "code")
RISK_SQL = {
    "conservative_base": "theorem_ratio >= 0.06 or math_ratio >= 0.32 or (multi_ratio >= 0.08 and math_ratio >= 0.12)",
    "disabled_base": "math_ratio >= 0.48 or (math_ratio >= 0.18 and multi_ratio >= 0.22)",
    "overridden": "(math_ratio >= 0.48 or (math_ratio >= 0.18 and multi_ratio >= 0.22)) and (safe_blocks >= 8 or safe_ratio >= 0.08)",
}


def document_risk(facts: DataFrame) -> DataFrame:
    """Shares of paragraphs with formulas, theorem words, several boxes and safe prose, and what they imply for rewriting."""
    rows = facts.where(~F.col("type").isin(*DOC_TYPES_SKIPPED))
    text_like = F.col("type").isin("text", "abstract", "")
    safe = text_like & F.col("plain") & (~F.col("multi_box") | F.col("multi_ok"))
    count = lambda c: F.count_if(c).cast("long")
    g = rows.groupBy("doc_id").agg(F.count("*").alias("logical_blocks"), count((F.col("math") > 0) | (F.col("latex") >= 2)).alias("math_blocks"), count(F.col("theorem")).alias("theorem_blocks"), count(F.col("multi_box")).alias("multi_blocks"), count(safe).alias("safe_blocks"))
    g = g.withColumns({f"{k}_ratio": F.col(f"{k}_blocks") / F.col("logical_blocks") for k in ("math", "theorem", "multi", "safe")})
    g = g.withColumns({k: F.expr(v) for k, v in RISK_SQL.items()})
    return g.select("*", (F.col("conservative_base") | F.col("overridden")).alias("conservative"), (F.col("disabled_base") & ~F.col("overridden")).alias("disabled")).drop(*RISK_SQL)


def block_risk(facts: DataFrame, risk: DataFrame) -> DataFrame:
    """risk_flags (sorted), risk_level and rewrite_allowed of each paragraph."""
    from quire.operators.classify import REWRITE_PRESERVE, any_part

    j = facts.join(risk.select("doc_id", "conservative", "disabled"), "doc_id", "left").fillna(False, ["conservative", "disabled"])
    high = F.col("multi_box") | (F.col("math") > 0) | (F.col("latex") > 0) | F.col("theorem") | F.col("compact_box")
    named = F.col("bucket").isin(*"caption footer footnote header section_header title".split())
    flags = {
        "multi_box": F.col("multi_box"), "safe_multibox_body": F.col("safe_multibox"), "contains_math": F.col("math") > 0, "contains_latex_commands": F.col("latex") > 0, "theorem_like": F.col("theorem"), "compact_box": F.col("compact_box"), "long_text": F.col("chars") >= 360,
        "safe_prose_body": F.col("safe_prose"), "doc_global_rewrite_disabled": F.col("disabled"), "safe_prose_rewrite_override": F.col("disabled") & F.col("safe_prose"), "doc_conservative_mode": F.col("conservative") & high,
    }
    found = F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items()), F.when(named, F.concat(F.lit("bucket_"), "bucket")), F.when(F.col("type").isin("aside_text", "page_number"), F.concat(F.lit("type_"), "type")))))
    level = F.when((F.col("math") > 0) | (F.col("latex") > 0) | F.col("theorem") | F.col("multi_box"), "high").when(F.size(found) > 0, "medium").otherwise("low")
    allowed = ~F.expr(any_part(REWRITE_PRESERVE, "type", "detected_type")) & ~F.col("bucket").isin("title", "section_header", "header", "footer")
    return j.select("doc_id", "lid", "bucket", found.alias("risk_flags"), level.alias("risk_level"), allowed.alias("rewrite_allowed"))


def freeze_series(rows: DataFrame, keys: list[str], value: str, step: float, out: str) -> DataFrame:
    """One value for each group: of values rounded to the step the most frequent (their median if several), of fewer than 4 the median."""
    r = rows.where(F.col(value).isNotNull()).select(*keys, F.rint(F.col(value) / F.lit(step)).alias("r"))
    counted = r.groupBy(*keys, "r").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys)
    counted = counted.select("*", F.max("c").over(whole).alias("top"), F.sum("c").over(whole).alias("n"))
    taken = counted.where("n < 4 or c = top").select(*keys, F.explode(F.array_repeat("r", F.when(F.col("n") < 4, F.col("c")).otherwise(1).cast("int"))).alias("r"))
    return taken.groupBy(*keys).agg(F.median("r").alias("m")).select(*keys, (F.rint("m") * F.lit(step)).alias(out))


def freeze_body_size(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The frozen body size: half-rounded sizes' lower median (n < 6), else a low quantile that falls with their spread."""
    r = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(T.round_half(F.col(value)))).alias("a"))
    n = F.size("a")
    spread = F.element_at("a", -1) - F.element_at("a", 1)
    q = F.when(spread >= 2.5, 0.15).when(spread >= 1.5, 0.2).otherwise(0.25)
    at = (n - 1) * q
    low = F.floor(at).cast("int")
    mixed = F.get("a", low) + (F.get("a", F.least(n - 1, low + 1)) - F.get("a", low)) * (at - low)
    return r.select(*keys, T.round_half(F.when(n < 6, F.get("a", F.floor((n - 1) / 2).cast("int"))).otherwise(mixed)).alias(out))


def char_guardrails(styles: DataFrame, keys: list[str], value: str, lowest: float = 0.0, highest: float = 0.2, spread: float = 0.06) -> DataFrame:
    """The corridor of character spacing around the median of the styles' values (0.05 without any), in steps of 0.005."""
    g = styles.groupBy(*keys).agg(F.coalesce(F.median(value), F.lit(0.05)).alias("c"))
    low, high = F.greatest(F.lit(lowest), F.col("c") - spread / 2), F.least(F.lit(highest), F.col("c") + spread / 2)
    bad = high < low
    return g.select(*keys, T.round_step(F.when(bad, lowest).otherwise(low), 0.005).alias("global_min"), T.round_step(F.when(bad, highest).otherwise(high), 0.005).alias("global_max"), T.round_step(F.col("c"), 0.005).alias("center"))


def layout_mode(blocks: DataFrame, page_width: float) -> DataFrame:
    """single_col or double_col, by the share of body boxes that cross the middle and their mean width."""
    w, g = page_width, page_width * 0.05
    body = blocks.withColumn("b", (F.col("type") == "text") & (F.length("text") > 20))
    crossing = (F.col("x0") < w / 2 - g) & (F.col("x1") > w / 2 + g)
    r = body.groupBy("doc_id").agg(F.avg(F.when(F.col("b"), crossing.cast("double"))).alias("p"), F.avg(F.when(F.col("b"), F.col("x1") - F.col("x0"))).alias("m"))
    return r.select("doc_id", F.when(F.col("p").isNull() | (F.col("p") > 0.15), "single_col").when(F.col("m") / w < 0.55, "double_col").otherwise("single_col").alias("layout_mode"))


SINGLE_LINE_SQL = """1.46 - case when wr < 0.78 then 0.03 else 0 end - case when density <= 62 then 0.02 else 0 end - case when density <= 52 then 0.02 else 0 end - case when density <= 44 then 0.02 else 0 end - case when density >= 80 then 0.02 else 0 end
  - case when mr >= 0.10 then 0.01 else 0 end + case when wr >= 0.84 and density <= 70 and mr <= 0.05 then 0.01 else 0 end"""
SINGLE_FILL_SQL = """0.988 + case when wr < 0.78 then 0.008 else 0 end + case when density <= 62 then 0.012 else 0 end + case when density <= 52 then 0.014 else 0 end + case when density <= 44 then 0.014 else 0 end + case when density >= 80 then 0.015 else 0 end
  - case when mr >= 0.10 then 0.004 else 0 end + case when wr >= 0.84 and density <= 70 and mr <= 0.05 then 0.014 else 0 end"""
DOUBLE_FILL_SQL = """0.952 + case when wr < 0.48 then 0.015 else 0 end + case when density <= 60 then 0.008 else 0 end + case when density <= 52 then 0.01 else 0 end + case when density <= 44 then 0.01 else 0 end + case when density >= 56 then 0.008 else 0 end
  + case when density <= 46 then 0.01 else 0 end + case when mr >= 0.12 then -0.004 when mr <= 0.05 and wr < 0.5 then 0.015 else 0 end"""
_T = {"line": f"case when layout_mode = 'single_col' then greatest(1.34, least(1.50, {SINGLE_LINE_SQL})) else 1.32 end", "fill": f"case when layout_mode = 'single_col' then greatest(0.968, least(0.997, {SINGLE_FILL_SQL})) else greatest(0.938, least(0.968, {DOUBLE_FILL_SQL})) end"}


def body_targets(blocks: DataFrame, modes: DataFrame, page_width: float) -> DataFrame:
    """Body style of each document: base size, target line and fill, upscale factor, golden size.

    Density and size are medians over the 15 longest bodies (ties by idx); the upscale
    factor lifts a natural fill that is below its target by the square root of the ratio.
    """
    body = blocks.where((F.col("type") == "text") & (F.length("text") > 20)).withColumn("math", F.regexp_like("text", F.lit(r"\$|\\[A-Za-z]+")))
    nth = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "idx")
    ranked = body.withColumn("nth", F.row_number().over(nth))
    top = F.col("nth") <= 15
    g = ranked.groupBy("doc_id").agg(F.median(F.when(top, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.length("text"))).alias("density"), F.median(F.when(top, F.col("size"))).alias("body_size"), (F.avg(F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))) / page_width).alias("wr"), F.avg(F.col("math").cast("double")).alias("mr"))
    g = g.join(modes, "doc_id").withColumns({"line": F.expr(_T["line"]).cast("double"), "target": F.expr(_T["fill"]).cast("double")})
    g = g.withColumn("line", F.when(F.col("layout_mode") == "single_col", F.rint(F.col("line") * 20) / 20).otherwise(F.col("line")))
    natural = F.lit(0.6) * F.pow("body_size", F.lit(2.0)) * F.col("line") * 1.1 / F.col("density")
    up = F.when(natural < F.col("target"), F.least(F.sqrt(F.col("target") / natural), F.when(F.col("layout_mode") == "single_col", 1.72).otherwise(1.58))).otherwise(1.0)
    return g.withColumn("upscale", up).select("doc_id", "layout_mode", "density", "body_size", "line", "target", "upscale", T.round_half(F.greatest(F.lit(10.0), F.least(F.lit(13.5), F.col("body_size") * F.col("upscale")))).alias("golden_size"))


STYLE_SCALES = {"title": 1.8, "section_header": 1.25, "page_header": 0.9, "header": 0.9, "footer": 0.9, "caption": 0.9, "footnote": 0.9, "figure_caption": 0.9, "table_caption": 0.9}


def golden_sizes(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """The size of each style: the median of blocks whose type has the style's name in it, upscaled, else the body's by a scale; titles up to 26."""
    names = F.array(*(F.struct(F.lit(k).alias("style"), F.lit(v).alias("scale")) for k, v in STYLE_SCALES.items()))
    seen = blocks.select("doc_id", "size", "type", F.inline(names)).where(F.contains(F.lower("type"), F.col("style"))).groupBy("doc_id", "style").agg(F.median("size").alias("m"))
    wanted = targets.select("doc_id", "upscale", "golden_size", F.inline(names))
    size = F.coalesce(F.col("m") * F.col("upscale"), F.col("golden_size") * F.col("scale"))
    capped = F.when(F.contains("style", F.lit("title")), F.least(size, F.lit(26.0))).otherwise(size)
    return wanted.join(seen, ["doc_id", "style"], "left").select("doc_id", "style", T.round_half(capped).alias("size"))


def guard_summary(blocks: DataFrame) -> DataFrame:
    """Guards by document: paragraphs, those with a fallback, their share, whether that disables rewriting."""
    lids = blocks.where("lid is not null").groupBy("doc_id", "lid").agg(F.bool_or("fallback_used").alias("f"))
    g = lids.groupBy("doc_id").agg(F.count("*").alias("guarded"), F.count_if("f").alias("fallbacks"))
    ratio = F.col("fallbacks") / F.greatest(F.lit(1), F.col("guarded"))
    return g.select("*", ratio.alias("fallback_ratio"), ((F.col("fallbacks") >= 3) | (ratio >= 0.08)).alias("disable_rewrite"))


def mode_first(values: Column) -> Column:
    """The most frequent value of an array, the earliest of equal ones."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("c"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
    return F.element_at(F.array_sort(counted), -1)["v"]
