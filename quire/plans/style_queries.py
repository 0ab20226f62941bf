"""Queries over styles, spans and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import state, styles
from quire.plans.block_queries import SQ, W
from quire.plans.catalog import register
from quire.sources.tables import PDF_PAGES_SQL, blocks, pdf_pages

_KEY = ["doc_id", "idx"]
SPANS_SQL = f"""
spans as (select doc_id, idx, k, word as text, case idx % 3 when 0 then 16 when 1 then 2 else 0 end as flags, size + k as size from (select doc_id, idx, size, unnest(words[1:3]) as word, generate_subscripts(words[1:3], 1) - 1 as k from (select *, string_split({SQ.format('text')}, ' ') as words from blocks)))"""


def spans(spark, d):
    """The first three words of each block as spans."""
    b = blocks(spark, d)
    from quire.functions import text as T

    flags = F.when(F.col("idx") % 3 == 0, 16).when(F.col("idx") % 3 == 1, 2).otherwise(0)
    return b.select(*_KEY, F.posexplode(F.slice(F.split(T.squeeze("text"), " "), 1, 3)).alias("k", "text"), flags.alias("flags"), "size").withColumn("size", F.col("size") + F.col("k"))


register("a15_span_size", lambda s, d: styles.span_size(spans(s, d), _KEY), W + "," + SPANS_SQL + " select doc_id, idx, cast(coalesce(median(size) filter (size > 0 and length(text) > 1), 9.0) as double) as size from spans group by all")
register("a15_shared_size", lambda s, d: styles.shared_size(blocks(s, d).withColumn("size", F.col("size") + F.col("idx"))).select(*_KEY, "size"), W + " select doc_id, idx, cast(first_value(size + idx) over (partition by doc_id, lid order by idx) as double) as size from blocks")
register("f40_style_keywords", lambda s, d: styles.style_keywords(spans(s, d), _KEY, 2), W + "," + SPANS_SQL + " select doc_id, idx, text as token, bool_or(flags & 16 <> 0) as bold, bool_or(flags & 2 <> 0) as italic from spans where length(text) >= 2 and flags <> 0 group by all")
register("f42_sanitise_mapping", lambda s, d: styles.sanitise_mapping(styles.style_keywords(spans(s, d), _KEY), blocks(s, d).select(*_KEY, "translated"), _KEY).groupBy(*_KEY).agg(F.count("*").alias("n")))
register("a13_golden_value", lambda s, d: styles.golden_value(blocks(s, d).select("doc_id", F.col("type").alias("style"), (F.col("size") + F.col("idx") % 3).alias("v")), "doc_id", "v", 0.5), W + """, c as (select doc_id, size + idx % 3 as v, count(*) as c from blocks group by all),
  m as (select doc_id, max(c) as top, arg_max(v, {'a': c, 'b': -v}) as mode from c group by doc_id), g as (select doc_id, median(size + idx % 3) as med from blocks group by doc_id) select doc_id, cast(round_even(case when top > 1 then mode else med end * 2, 0) / 2 as double) as v from m join g using (doc_id)""")
register("c8_clamp_style", lambda s, d: styles.clamp_style(_spaced(s, d)).select(*_KEY, "line", F.round("char", 6).alias("char")), W + ", p as (select doc_id, idx, 1.1 + idx % 12 * 0.05::double as bl, (idx % 9) * 0.02::double as bc, (idx % 11) * 0.02::double as c from blocks) select doc_id, idx, round(least(1.55, greatest(1.15, bl)), 3) as line, round(least(least(0.08::double, bc + 0.035::double), greatest(greatest(0.02::double, bc - 0.035::double), c)), 6) as char from p")


def _spaced(spark, d):
    return blocks(spark, d).withColumns({"base_line": 1.1 + F.col("idx") % 12 * 0.05, "base_char": (F.col("idx") % 9) * 0.02, "char": (F.col("idx") % 11) * 0.02, "global_min": F.lit(0.02), "global_max": F.lit(0.08), "max_delta": F.lit(0.035), "overflow_px": (F.col("idx") % 12).cast("double")})


register("c11_force_fit", lambda s, d: styles.force_fit(_spaced(s, d)).select(*_KEY, "action", F.round("char", 6).alias("char")), W + ", p as (select doc_id, idx, (idx % 11) * 0.02::double as c from blocks) select doc_id, idx, case when idx % 12 <= 5 then 'accept_minor_overflow' else 'force_fit_without_font_change' end as action, round(case when idx % 12 <= 5 then c else greatest(0.02::double, c - 0.01::double) end, 6) as char from p")
register("c20_bottom_limit", lambda s, d: blocks(s, d).select(*_KEY, styles.bottom_limit(F.col("y1"), F.col("size"), F.when(F.col("idx") % 4 == 0, F.col("y1") - 5)).alias("low")), W + " select doc_id, idx, greatest(y1, case when idx % 4 = 0 then y1 - 5 else y1 + greatest(1.5, least(4.0, size * 0.28)) end)::double as low from blocks")
register("p10_fragile", lambda s, d: _fragile(s, d).select(*_KEY, F.expr(styles.FRAGILE_META_SQL).alias("meta"), F.expr(styles.FRAGILE_MULTIBOX_SQL).alias("multi")), W + """ select doc_id, idx, idx % 2 = 0 and page_idx = 0 and height <= 22 and idx % 5 <> 0 and type <> 'title' and type <> 'section_header' and y1 <= 200 and height <= 18 and length(text) <= 48 as meta, idx % 2 = 0 and idx % 5 = 0 and idx % 3 <> 0 as multi from blocks""")


def _fragile(spark, d):
    b = blocks(spark, d).drop("detected_type")
    return b.withColumns({"font_key": F.when(F.col("idx") % 2 == 0, "body").otherwise("caption"), "compact_box": F.col("height") <= 22, "multi_box": F.col("idx") % 5 == 0, "safe_prose": F.col("idx") % 3 == 0, "detected_type": F.col("type"), "chars": F.length("text")})


register("j12_failed_paragraphs", lambda s, d: styles.failed_paragraphs(blocks(s, d)), W + f" select doc_id, lid from blocks where lid is not null and type not in ('code', 'curve', 'equation', 'figure', 'image', 'line', 'rect', 'table') group by doc_id, lid having bool_or({SQ.format('translated')} = '')")
register("j10_paired_pages", lambda s, d: styles.paired_pages(pdf_pages(blocks(s, d)).where("page_no % 3 <> 0"), pdf_pages(blocks(s, d)).where("page_no % 2 = 0")), W + "," + PDF_PAGES_SQL + """, a as (select * from pdf_pages where page_no % 3 <> 0), b as (select * from pdf_pages where page_no % 2 = 0)
  select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.page_no, b.page_no) as page_no, coalesce(a.page_width, 595) as left_width, coalesce(a.page_height, 842) as left_height, coalesce(b.page_width, 595) as right_width, coalesce(b.page_height, 842) as right_height from a full join b on a.doc_id = b.doc_id and a.page_no = b.page_no""")
register("i13_registry", lambda s, d: state.registry(blocks(s, d)), W + " select doc_id, lid, arg_max(type, idx) as type, arg_max(page_idx, idx) as page_idx, 'REGISTERED' as state from blocks where lid is not null group by all")
register("f44_colors", lambda s, d: _colored(s, d).select(*_KEY, "a.*", F.round(styles.color_distance(F.col("a"), F.when(F.col("idx") % 4 != 0, F.col("b"))), 6).alias("dist"), styles.cleanup_fill(F.col("a"))["r"].alias("fill_r")), W + """,
  p as (select doc_id, idx, idx % 7 * 40 > 1 or idx % 5 * 50 > 1 as big, (idx % 7 * 40)::double as r0, (idx % 5 * 50)::double as g0 from blocks), q as (select *, least(1, case when big then r0 / 255 else r0 end)::double as r, least(1, case when big then g0 / 255 else g0 end)::double as g, 0.0::double as b from p)
  select doc_id, idx, r, g, b, round(case when idx % 4 = 0 then 1.0 else (abs(r - 0.5) + abs(g - 0.5) + abs(b - 0.5)) / 3 end, 6)::double as dist, case when r >= 0.97 and g >= 0.97 and b >= 0.97 then 1.0 else r end::double as fill_r from q""")


def _colored(spark, d):
    channel = lambda c: c.cast("double")
    half = F.struct(*(F.lit(0.5).alias(n) for n in "rgb"))
    return blocks(spark, d).withColumns({"a": styles.normalise_color(channel(F.col("idx") % 7 * 40), channel(F.col("idx") % 5 * 50), F.lit(0.0)), "b": half})


