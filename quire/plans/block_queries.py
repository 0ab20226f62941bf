"""Queries over the block views, each with the SQL that says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import latex
from quire.functions import text as T
from quire.operators import classify as C
from quire.operators import coverage, distribute, layout, order, reflow, spatial, state, stats
from quire.plans.catalog import register
from quire.sources.tables import ACTION_LOG_SQL, BLOCKS_SQL, DRAWINGS_SQL, PDF_PAGES_SQL, TRANSITIONS_SQL, action_log, blocks, drawings, pdf_pages, table, transitions_in

W = "with " + BLOCKS_SQL
PAGE_WIDTH = 600.0
#: Squeezed text in DuckDB (the supplied data has ASCII white space only).
SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
CM = "regexp_replace(coalesce({0}, ''), '\\s+', '', 'g')"
COUNT = "cast(len(regexp_extract_all({0}, '{1}')) as bigint)"


def cnt(text: str, pattern: str) -> str:
    return COUNT.format(text, pattern)


# Page coverage ---------------------------------------------------------------------------
_NT = ", ".join(f"'{t}'" for t in coverage.NON_TEXT)
_STATS = f"""
_stats as (select doc_id, page_idx + 1 as page_no, coalesce(sum(case when type not in ({_NT}) then length({CM.format('translated')}) end), 0) as expected_chars, count(*) as total_items,
  count(*) filter (type not in ({_NT})) as text_items, count(*) filter (type in ({_NT})) as non_text_items, count(*) filter (type in ('equation', 'formula') or coalesce(detected_type, '') in ('equation', 'formula')) as formula_items,
  count(*) filter (type = 'reference' or coalesce(detected_type, '') = 'reference') as reference_items, count(*) filter (coalesce(detected_type, '') in ('title', 'section_header')) as title_items,
  count(*) filter (type in ('header', 'page_footnote', 'page_number') or coalesce(detected_type, '') in ('footnote', 'footer')) as header_footer_items from blocks group by all),
_cov as (select p.doc_id, p.page_no, cast(length({CM.format('page_text')}) as bigint) as actual_chars, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in coverage.COUNTS)} from pdf_pages p left join _stats s on p.doc_id = s.doc_id and p.page_no = s.page_no),
cov as (select *, {coverage.LABEL_SQL} as label from (select *, cast({coverage.RATIO_SQL} as double) as ratio from _cov))"""
COV = W + "," + PDF_PAGES_SQL + "," + _STATS


def _coverage(spark, d):
    b = blocks(spark, d)
    return coverage.page_coverage(b, pdf_pages(b))


register("a3_page_coverage", _coverage, COV + " select * from cov")
register("a4_label_totals", lambda s, d: coverage.label_totals(_coverage(s, d)), COV + " select doc_id, label, count(*) as pages from cov group by grouping sets ((doc_id, label), (label))")
register("t1_review_first", lambda s, d: coverage.review_first(_coverage(s, d)), COV + """ select cast(row_number() over (order by ratio, expected_chars desc, doc_id, page_no) as int) as place, doc_id, page_no, label, expected_chars, actual_chars
  from (select * from cov where label not in ('OK', '非主文本页') order by ratio, expected_chars desc, doc_id, page_no limit 30)""")

# Text functions --------------------------------------------------------------------------
_KEY = ["doc_id", "idx"]
register("f1_squeeze", lambda s, d: blocks(s, d).select(*_KEY, T.squeeze("text").alias("squeezed"), F.length(T.compact("text")).cast("long").alias("n")), W + f" select doc_id, idx, {SQ.format('text')} as squeezed, length({CM.format('text')}) as n from blocks")
_INFO = r"[^0-9a-zA-Z\x{4e00}-\x{9fff}#@?!&%$`\"''.,;:~_^()}{\]\[|\\/*\-+<>=]"
_MARK = r"[(]?(?:[a-zA-Z]|\d+)[)]?[).]?"
register("f3_information", lambda s, d: blocks(s, d).select(*_KEY, T.information_score("text").cast("long").alias("score"), T.marker_count("text").cast("long").alias("markers"), T.low_information("text").alias("low")), W + rf""",
  q as (select doc_id, idx, {SQ.format('text')} as t from blocks), m as (select *, case when t <> '' and trim(regexp_replace(t, '{_MARK}', '', 'g')) = '' then {cnt('t', _MARK)} else 0 end as markers, length(regexp_replace(t, '[\d\s|\\/*\-+<>:;,.\]\[}}{{)(]+', '', 'g')) as rest from q)
  select doc_id, idx, length(regexp_replace(t, '{_INFO}', '', 'g')) as score, markers, t = '' or markers >= 2 or (rest <= 2 and contains(t, '(')) as low from m""")
register("f9_math_counts", lambda s, d: blocks(s, d).select(*_KEY, T.math_segments("text").cast("long").alias("math"), T.latex_commands("text").cast("long").alias("latex"), T.theorem_like("text").alias("theorem")), W + rf"""
  select doc_id, idx, {cnt('text', '[$]')} // 2 + {cnt('text', r'\\[\[(]')} as math, {cnt('text', r'\\[A-Za-z]+')} as latex, regexp_matches(text, '(?i)\b(claim|corollary|definition|example|lemma|proof|proposition|remark|theorem)\b') as theorem from blocks""")
register("f11_html_text", lambda s, d: table(s, d, "pages").select("page_id", T.clean_html("html").alias("text")), r"""
  select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<sup>([^<]{1,})</sup>', '^\1', 'gi'), '<sub>([^<]{1,})</sub>', '_\1', 'gi'), '<[^>]+>', '', 'g') as text from pages""")
#: The oracle's formulas: without look-behind, which is the same as the data have no backslash.
_FORM = r"\$[^$]+\$"
register("f16_formulas", lambda s, d: blocks(s, d).select(*_KEY, F.size(T.formulas("text")).cast("long").alias("n"), T.without_formulas("text").alias("rest")), W + f" select doc_id, idx, {cnt('text', _FORM)} as n, regexp_replace(text, '{_FORM}', ' ', 'g') as rest from blocks")


def _masked(spark, d):
    m = T.mask("text", tags=False)
    return blocks(spark, d).select(*_KEY, "text", m.alias("m")).select(*_KEY, F.col("m.text").alias("masked"), (T.unmask("m.text", F.col("m.formulas")) == F.col("text")).alias("same"))


register("f12_mask_round_trip", _masked, W + f""",
  p as (select doc_id, idx, text, string_split_regex(text, '{_FORM}') as parts from blocks)
  select doc_id, idx, array_to_string(list_transform(parts, lambda x, i: x || case when i < len(parts) then '[MATH_MASK_' || cast(i - 1 as varchar) || ']' else '' end), '') as masked, true as same from p""")
_FL = f"trim(regexp_replace(regexp_replace(text, '{_FORM}', ' ', 'g'), '\\s+', ' ', 'g'))"
register("f28_signal_score", lambda s, d: blocks(s, d).select(*_KEY, T.signal_score("text").cast("long").alias("signal"), T.cjk_chars("text").cast("long").alias("cjk")), W + rf""",
  p as (select doc_id, idx, text, {_FL} as t from blocks), q as (select *, regexp_replace(t, '[^\x00-\x7f]', 'é', 'g') as a from p)
  select doc_id, idx, cast(len(list_filter(regexp_extract_all(t, '[\pL\pN_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{2,}}'))) * 4 as bigint) + {cnt('t', r'[0-9]')} + {cnt('t', '[，。；：,.!?;:]')} + {cnt('t', r'[\x{4e00}-\x{9fff}]')} as signal, {cnt('text', r'[\x{4e00}-\x{9fff}]')} as cjk from q""")
register("f33_formula_guard", lambda s, d: blocks(s, d).select(*_KEY, F.array_join(T.formula_issues("text", "translated"), ",").alias("issues")), W + rf""",
  p as (select doc_id, idx, text, trim(translated, ' ' || chr(9) || chr(13)) as t, regexp_replace(trim(translated), '{_FORM}', ' ', 'g') as o from blocks)
  select doc_id, idx, case when t = '' then 'empty_translation' else array_to_string(list_filter([case when regexp_matches(o, '[{{}}]') then 'brace_leak' end, case when {cnt('t', _FORM)} < {cnt('text', _FORM)} then 'formula_loss' end,
    case when regexp_matches(o, '\\[A-Za-z]+') then 'latex_command_leak' end, case when {cnt('t', '[$]')} % 2 <> 0 then 'odd_dollar_count' end, case when regexp_matches(t, '\[MATH_MASK_[0-9]+\]') then 'placeholder_residue' end, case when regexp_matches(o, '[\^_]') then 'script_token_leak' end], lambda x: x is not null), ',') end as issues from p""")
register("f31_clean_output", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.clean_output("text").alias("clean")))
register("f32_meta_output", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.meta_output(F.lit(""), "text").alias("meta"), T.meta_output("text", "text").alias("meta_same")), "select conv_id, turn, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 32 as meta, false as meta_same from conversations")
register("f22_latex_unicode", lambda s, d: blocks(s, d).select(*_KEY, T.latex_to_unicode("text").alias("plain"), T.balance_braces("text").alias("balanced")), W + f" select doc_id, idx, {SQ.format(chr(114) + 'eplace(text, chr(36), chr(0))').replace('chr(0)', chr(39) * 2)} as plain, text as balanced from blocks")
register("f18_sanitize_math", lambda s, d: blocks(s, d).where(F.contains("text", F.lit("$"))).select(*_KEY, latex.sanitize_math("text").alias("sane")))
register("f30_similarity", lambda s, d: blocks(s, d).where("idx < 3").select(*_KEY, latex.similarity("text", "translated").alias("ratio")))
register("d6_render_units", lambda s, d: blocks(s, d).select(*_KEY, F.size(T.render_units("text")).cast("long").alias("units")), W + rf" select doc_id, idx, {cnt('text', rf'(?s){_FORM}|\s+|[0-9A-Za-z]+(?:[/_-][0-9A-Za-z]+)*|[\x{{4e00}}-\x{{9fff}}]|.')} as units from blocks")
register("d8_split_weight", lambda s, d: blocks(s, d).select(*_KEY, F.greatest(F.lit(1), F.when((F.col("width") < 120) | (F.col("height") < 16), F.least(F.lit(24), F.length(T.compact(T.without_formulas("text"))) + F.size(T.formulas("text")) * 6)).otherwise(F.length(T.compact(T.without_formulas("text"))) + F.size(T.formulas("text")) * 6)).cast("long").alias("weight")),
         W + rf""", p as (select *, length(regexp_replace(regexp_replace(text, '{_FORM}', ' ', 'g'), '\s+', '', 'g')) + {cnt('text', _FORM)} * 6 as n from blocks) select doc_id, idx, cast(greatest(1, case when width < 120 or height < 16 then least(24, n) else n end) as bigint) as weight from p""")
_CAND = '{"text": "'
register("f38_candidate_text", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.candidate_text(F.concat(F.lit('```json\n{"text": "'), F.regexp_replace("text", r'[\n"\\]', " "), F.lit('"}\n```'))).alias("text")), r"""select conv_id, turn, trim(regexp_replace(text, '[\n"\\]', ' ', 'g')) as text from conversations""")
register("f45_unpack_color", lambda s, d: blocks(s, d).select(*_KEY, T.unpack_color((F.col("doc_id") * 7919 + F.col("idx") * 104729) % 16777216).alias("c")).select(*_KEY, "c.*"), W + ", p as (select *, (doc_id * 7919 + idx * 104729) % 16777216 as v from blocks) select doc_id, idx, ((v >> 16) & 255) / 255.0::double as r, ((v >> 8) & 255) / 255.0::double as g, (v & 255) / 255.0::double as b from p")

# Classification --------------------------------------------------------------------------
register("p1_bucket", lambda s, d: blocks(s, d).select(*_KEY, C.bucket().alias("bucket")), W + f" select doc_id, idx, {C.bucket_sql()} as bucket from blocks")
register("p8_preserved", lambda s, d: blocks(s, d).select(*_KEY, C.preserved().alias("render"), C.preserved(C.REWRITE_PRESERVE).alias("rewrite"), F.expr(C.TEXT_LIKE_SQL).alias("text_like")), W + f" select doc_id, idx, {C.any_part(C.RENDER_PRESERVE, 'type', 'detected_type')} as render, {C.any_part(C.REWRITE_PRESERVE, 'type', 'detected_type')} as rewrite, {C.TEXT_LIKE_SQL} as text_like from blocks")
register("p22_correct_type", lambda s, d: C.correct_type(blocks(s, d).withColumn("text_level", F.when(F.col("idx") % 17 == 3, F.lit(1)).when(F.col("idx") % 23 == 5, F.lit(0))), 9.5).select(*_KEY, "corrected"), W + r""",
  p as (select *, case when idx % 17 = 3 then 1 when idx % 23 = 5 then 0 end as text_level from blocks)
  select doc_id, idx, case when type = 'equation' then type when type = 'reference' and length(text) > 50 and not regexp_matches(text, '\[[0-9]+\]') and not regexp_matches(text, '[0-9]+\.') then 'text'
    when page_idx = 0 and size > 13.3 then 'title' when text_level = 0 then 'title' when text_level = 1 then case when size > 13.3 then 'title' else 'section_header' end
    when size > 9.5 * 1.15 and type <> 'title' then 'section_header' when size < 9.5 * 0.85 then 'footnote' else type end as corrected from p""")
register("p16_references", lambda s, d: blocks(s, d).select(*_KEY, C.reference_heading("text").alias("heading"), C.reference_entry("text").alias("entry"), C.reference_fragment("text").alias("fragment")))
_FIT = """
fit as (select b.*, case when doc_id % 3 = 0 then 'double_col' else 'single_col' end as layout_mode, case when type = 'text' then 'body' when type = 'title' then 'title' else 'caption' end as font_key, type = 'title' as is_title,
  (doc_id + idx) % 5 = 0 as multi_box, (doc_id + idx) % 3 <> 0 as safe_prose, doc_id % 2 = 0 as prose_heavy, idx % 9 = 8 as fragile_meta, case idx % 3 when 0 then 'OVERFLOW' when 1 then 'UNDERFLOW' else 'OPTIMAL' end as issue, idx % 10 = 9 as is_final,
  (doc_id + idx) % 100 / 80.0 as fill_ratio, idx % 4 = 1 as risky, idx % 8 = 1 as risky_double, idx % 8 = 1 as mathy, 0.9 as threshold, length(text) as chars, idx % 3 as math_segments from blocks b)"""
_RULES = {"underflow": C.UNDERFLOW_SQL, "fill_target": C.FILL_TARGET_SQL, "severe": C.SEVERE_SQL, "min_growth": C.MIN_GROWTH_SQL, "max_growth": C.MAX_GROWTH_SQL, "safe_fill": C.SAFE_FILL_SQL}


def _rules(spark, d):
    blocks(spark, d).createOrReplaceTempView("blocks")
    f = spark.sql("with" + _FIT + " select * from fit")
    out = f.select("*", *(F.expr(v).cast("boolean" if k == "severe" else "double").alias(k) for k, v in _RULES.items()))
    return out.select(*_KEY, *_RULES, F.expr(C.ATTEMPTS_SQL).cast("long").alias("attempts"))


_LIST = ", ".join(f"cast({v} as {'boolean' if k == 'severe' else 'double'}) as {k}" for k, v in _RULES.items())
register("p24_fill_rules", _rules, W + "," + _FIT + f", r as (select *, {_LIST} from fit) select doc_id, idx, {', '.join(_RULES)}, cast({C.ATTEMPTS_SQL} as bigint) as attempts from r")


def _feedback(spark, d):
    blocks(spark, d).createOrReplaceTempView("blocks")
    f = C.feedback(spark.sql("with" + _FIT + " select doc_id, idx, issue, is_title, is_final from fit"))
    return f.select(*_KEY, "decision", "rewrite_mode", F.array_join("actions", "+").alias("actions"))


register("i3_feedback", _feedback, W + "," + _FIT + """ select doc_id, idx, case when issue = 'OPTIMAL' then 'skip' when is_title then 'micro_tune' when issue = 'OVERFLOW' and is_final then 'force_fit' else 'rewrite_and_tune' end as decision,
  case when issue = 'OPTIMAL' or is_title or (issue = 'OVERFLOW' and is_final) then null when issue = 'OVERFLOW' then 'shorten' else 'lengthen' end as rewrite_mode,
  case when issue = 'OPTIMAL' then '' when is_title or (issue = 'OVERFLOW' and is_final) then 'CharSpacing' else 'Rewriting+CharSpacing' end as actions from fit""")
register("p32_sanitize_render", lambda s, d: blocks(s, d).select(*_KEY, C.sanitize_render(F.concat(F.lit("† ‡ "), F.col("text"))).alias("shown")), W + " select doc_id, idx, case when type = 'footnote' then ltrim(text, ' ' || chr(9) || '†‡§¶‖') else '† ‡ ' || text end as shown from blocks")
register("p23_meaningful", lambda s, d: blocks(s, d).select(*_KEY, C.meaningful_token(F.substring("text", 1, 3)).alias("keep")), W + rf""", p as (select doc_id, idx, {SQ.format('substring(text, 1, 3)')} as t from blocks)
  select doc_id, idx, t <> '' and not regexp_full_match(t, '[^\pL\pN\pM\p{{Nd}}]+') and length(replace(t, ' ', '')) > 1 as keep from p""")

# Order -----------------------------------------------------------------------------------
register("w1_reading_order", lambda s, d: order.reading_order(blocks(s, d)).select(*_KEY, "lid", "place"), W + """,
  a as (select *, greatest(1, max(x1) over w - min(x0) over w) as span, max((x0 + x1) / 2) over w - min((x0 + x1) / 2) over w as spread, avg((x0 + x1) / 2) over w as middle, count(*) over w as n from blocks where lid is not null window w as (partition by doc_id, lid, page_idx)),
  b as (select *, sum(case when x1 - x0 <= span * 0.72 then 1 else 0 end) over (partition by doc_id, lid, page_idx) as narrow from a),
  c as (select *, case when not (n >= 2 and narrow >= 2 and spread >= span * 0.22) then 0 when x1 - x0 >= span * 0.78 then -1 when (x0 + x1) / 2 <= middle then 0 else 1 end as col from b)
  select doc_id, idx, lid, cast(row_number() over (partition by doc_id, lid order by page_idx, col, y0, x0, idx) as int) as place from c""")
register("w7_contexts", lambda s, d: order.contexts(blocks(s, d)), W + f" select doc_id, lid, trim(string_agg({SQ.format('text')}, ' ' order by page_idx, y0, x0, idx)) as context from blocks where lid is not null group by all")
register("w3_first_blocks", lambda s, d: order.first_blocks(blocks(s, d)), W + " select doc_id, lid, arg_min(idx, {'a': page_idx, 'b': y0, 'c': idx}) as first_idx, count(*) as boxes from blocks where lid is not null group by all")
register("w5_columns", lambda s, d: blocks(s, d).groupBy("doc_id", "page_idx", order.column_of(PAGE_WIDTH).alias("col")).agg(F.count("*").alias("n")), W + " select doc_id, page_idx, case when (x0 + x1) / 2 < 252 then 'left' when (x0 + x1) / 2 > 348 then 'right' else 'full' end as col, count(*) as n from blocks group by all")


def recovered_rows(spark, d):
    b = blocks(spark, d).withColumns({"local_md": F.concat(F.lit("**"), F.col("text"), F.lit("**")), "pdf_text": F.when(F.col("idx") % 2 == 0, F.col("text")), "text": F.when(F.col("idx") % 3 == 0, F.lit("(1) (2)")).otherwise(F.col("text"))})
    return order.recover(b)


register("f8_recover", lambda s, d: recovered_rows(s, d).select(*_KEY, "recovered", "source"))

# Statistics ------------------------------------------------------------------------------
_PROF = "select doc_id, count(*) as block_count, count(*) filter (t) as text_block_count, coalesce(avg(n) filter (t), 0) as avg_text_length, coalesce(median(area / greatest(1, n)) filter (t and area > 0), 0) as median_source_density, coalesce(avg(area) filter (t and area > 0), 0) as avg_bbox_area from p group by doc_id"
register("a7_document_profile", lambda s, d: stats.document_profile(blocks(s, d)), W + rf", p as (select doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as n, true as t, width * height as area from blocks) {_PROF}")
_FACTS = rf"""
_o as (select *, {C.TEXT_LIKE_SQL} as text_like, {C.bucket_sql()} as bucket from blocks where lid is not null),
_f as (select doc_id, lid, count(*) as boxes, arg_min(type, {{'a': page_idx, 'b': y0, 'c': idx}}) as type, arg_min(bucket, {{'a': page_idx, 'b': y0, 'c': idx}}) as bucket, arg_min(coalesce(detected_type, type), {{'a': page_idx, 'b': y0, 'c': idx}}) as detected_type, arg_min(height, {{'a': page_idx, 'b': y0, 'c': idx}}) as height,
  bool_and(text_like) as all_text_like, string_agg(text, ' ' order by page_idx, y0, idx) as text from _o group by doc_id, lid),
_g as (select *, length({CM.format('text')}) as chars, {cnt('text', '[$]')} // 2 + {cnt('text', r'\\[\[(]')} as math, {cnt('text', r'\\[A-Za-z]+')} as latex, regexp_matches(text, '(?i)\b(claim|corollary|definition|example|lemma|proof|proposition|remark|theorem)\b') as theorem, height > 0 and height <= 22 as compact_box, boxes > 1 as multi_box from _f),
facts as (select *, chars >= 20 and math = 0 and latex = 0 and not theorem and not compact_box as plain, multi_box and boxes <= 3 and all_text_like as multi_ok from _g),
_r as (select doc_id, count(*) as logical_blocks, count(*) filter (math > 0 or latex >= 2) as math_blocks, count(*) filter (theorem) as theorem_blocks, count(*) filter (multi_box) as multi_blocks, count(*) filter (type in ('text', 'abstract', '') and plain and (not multi_box or multi_ok)) as safe_blocks
  from facts where type not in ('code', 'curve', 'equation', 'figure', 'image', 'line', 'rect', 'table') group by doc_id),
_q as (select *, math_blocks / logical_blocks as math_ratio, theorem_blocks / logical_blocks as theorem_ratio, multi_blocks / logical_blocks as multi_ratio, safe_blocks / logical_blocks as safe_ratio from _r),
risk as (select *, ({stats.RISK_SQL['conservative_base']}) or ({stats.RISK_SQL['overridden']}) as conservative, ({stats.RISK_SQL['disabled_base']}) and not ({stats.RISK_SQL['overridden']}) as disabled from _q)"""


def _facts(spark, d):
    return stats.paragraph_facts(blocks(spark, d))


register("a8_document_risk", lambda s, d: stats.document_risk(_facts(s, d)), W + "," + _FACTS + " select * from risk")


def _block_risk(spark, d):
    f = _facts(spark, d)
    return stats.block_risk(f, stats.document_risk(f)).withColumn("risk_flags", F.array_join("risk_flags", ","))


register("a9_block_risk", _block_risk, W + "," + _FACTS + f""",
  j as (select f.*, coalesce(conservative, false) as cons, coalesce(disabled, false) as dis, bucket = 'body' and plain and multi_ok as sm, bucket = 'body' and plain and (not multi_box or multi_ok) as sp from facts f left join risk using (doc_id)),
  k as (select *, list_sort(list_filter([case when multi_box then 'multi_box' end, case when sm then 'safe_multibox_body' end, case when math > 0 then 'contains_math' end, case when latex > 0 then 'contains_latex_commands' end, case when theorem then 'theorem_like' end, case when compact_box then 'compact_box' end,
    case when chars >= 360 then 'long_text' end, case when sp then 'safe_prose_body' end, case when dis then 'doc_global_rewrite_disabled' end, case when dis and sp then 'safe_prose_rewrite_override' end, case when cons and (multi_box or math > 0 or latex > 0 or theorem or compact_box) then 'doc_conservative_mode' end,
    case when bucket in ('caption', 'footer', 'footnote', 'header', 'section_header', 'title') then 'bucket_' || bucket end], lambda x: x is not null)) as flags from j)
  select doc_id, lid, bucket, array_to_string(flags, ',') as risk_flags, case when math > 0 or latex > 0 or theorem or multi_box then 'high' when len(flags) > 0 then 'medium' else 'low' end as risk_level,
    not {C.any_part(C.REWRITE_PRESERVE, 'type', 'detected_type')} and bucket not in ('title', 'section_header', 'header', 'footer') as rewrite_allowed from k""")
register("a11_freeze_series", lambda s, d: stats.freeze_series(blocks(s, d).withColumns({"bucket": C.bucket(), "line": 1.1 + (F.col("idx") % 7) * 0.05}), ["doc_id", "bucket"], "line", 0.05, "line"), W + f""",
  r as (select doc_id, {C.bucket_sql()} as bucket, round_even((1.1 + (idx % 7) * 0.05::double) / 0.05::double, 0) as r from blocks), c as (select doc_id, bucket, r, count(*) as c from r group by all), t as (select *, max(c) over w as top, sum(c) over w as n from c window w as (partition by doc_id, bucket)),
  m as (select doc_id, bucket, median(r) as m from t where c = top and n >= 4 group by all union all select doc_id, bucket, median(r) as m from (select doc_id, bucket, r, unnest(range(c)) from t where n < 4) group by all) select doc_id, bucket, round_even(m, 0) * 0.05::double as line from m""")
register("a12_freeze_size", lambda s, d: stats.freeze_body_size(blocks(s, d).withColumn("v", F.col("size") + (F.col("idx") % 6) * 0.4), ["doc_id"], "v", "size"), W + """,
  r as (select doc_id, list_sort(list(round_even((size + (idx % 6) * 0.4::double) * 2, 0) / 2)) as a from blocks group by doc_id), q as (select *, len(a) as n, case when a[-1] - a[1] >= 2.5 then 0.15::double when a[-1] - a[1] >= 1.5 then 0.2::double else 0.25::double end as q from r),
  p as (select *, (n - 1) * q as pos, cast(floor((n - 1) * q) as bigint) as lo from q)
  select doc_id, round_even((case when n < 6 then a[(n - 1) // 2 + 1] else a[lo + 1] + (a[least(n - 1, lo + 1) + 1] - a[lo + 1]) * (pos - lo) end) * 2, 0) / 2 as size from p""")
register("a14_guardrails", lambda s, d: stats.char_guardrails(blocks(s, d).withColumn("char", (F.col("idx") % 9) * 0.01), ["doc_id"], "char"), W + """,
  g as (select doc_id, median((idx % 9) * 0.01::double) as c from blocks group by doc_id), h as (select doc_id, c, greatest(0, c - 0.06 / 2) as lo, least(0.2, c + 0.06 / 2) as hi from g)
  select doc_id, round_even(lo / 0.005::double, 0) * 0.005::double as global_min, round_even(hi / 0.005::double, 0) * 0.005::double as global_max, round_even(c / 0.005::double, 0) * 0.005::double as center from h""")
_MODE = """
mode as (select doc_id, case when p is null or p > 0.15 then 'single_col' when m / 600 < 0.55 then 'double_col' else 'single_col' end as layout_mode from (select doc_id, avg(case when x0 < 270 and x1 > 330 then 1.0 else 0.0 end) filter (type = 'text' and length(text) > 20) as p,
  avg(x1 - x0) filter (type = 'text' and length(text) > 20) as m from blocks group by doc_id))"""
register("a17_layout_mode", lambda s, d: stats.layout_mode(blocks(s, d), PAGE_WIDTH), W + "," + _MODE + " select * from mode")


def _targets(spark, d):
    b = blocks(spark, d)
    return stats.body_targets(b, stats.layout_mode(b, PAGE_WIDTH), PAGE_WIDTH)


_TARGETS = f"""
_b as (select *, regexp_matches(text, '[$]|\\\\[A-Za-z]+') as math, row_number() over (partition by doc_id order by length(text) desc, idx) as nth from blocks where type = 'text' and length(text) > 20),
_t as (select doc_id, median(width * height / length(text)) filter (nth <= 15) as density, median(size) filter (nth <= 15) as body_size, avg(greatest(1, x1 - x0)) / 600 as wr, avg(math::int) as mr from _b group by doc_id),
_u as (select *, cast({stats._T['line']} as double) as l, cast({stats._T['fill']} as double) as target from _t join mode using (doc_id)), _v as (select * exclude (l), case when layout_mode = 'single_col' then round_even(l * 20, 0) / 20 else l end as line from _u),
_w as (select *, 0.6 * pow(body_size, 2) * line * 1.1 / density as nat from _v), _x as (select *, case when nat < target then least(sqrt(target / nat), case when layout_mode = 'single_col' then 1.72 else 1.58 end) else 1.0 end as upscale from _w),
targets as (select doc_id, layout_mode, density, cast(body_size as double) as body_size, line, target, cast(upscale as double) as upscale, round_even(greatest(10, least(13.5, body_size * upscale)) * 2, 0) / 2 as golden_size from _x)"""
register("a18_body_targets", _targets, W + "," + _MODE + "," + _TARGETS + " select * from targets")
_SCALES = ", ".join(f"('{k}', {v}::double)" for k, v in stats.STYLE_SCALES.items())
register("a19_golden_sizes", lambda s, d: stats.golden_sizes(blocks(s, d), _targets(s, d)), W + "," + _MODE + "," + _TARGETS + f""", n(style, scale) as (values {_SCALES}), seen as (select doc_id, style, median(size) as m from blocks, n where contains(lower(type), style) group by all),
  z as (select t.doc_id, n.style, coalesce(m * upscale, golden_size * scale) as size from targets t cross join n left join seen s on s.doc_id = t.doc_id and s.style = n.style) select doc_id, style, round_even(case when contains(style, 'title') then least(size, 26.0) else size end * 2, 0) / 2 as size from z""")
register("a6_guard_summary", lambda s, d: stats.guard_summary(blocks(s, d)), W + """, l as (select doc_id, lid, bool_or(fallback_used) as f from blocks where lid is not null group by all), g as (select doc_id, count(*) as guarded, count(*) filter (f) as fallbacks from l group by doc_id)
  select *, fallbacks / greatest(1, guarded) as fallback_ratio, fallbacks >= 3 or fallbacks / greatest(1, guarded) >= 0.08 as disable_rewrite from g""")
register("a16_flag_mode", lambda s, d: blocks(s, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", (F.col("idx") * 7 % 4).alias("v")))), lambda x: x["v"]).alias("a"), F.max("size").alias("size")).select("doc_id", stats.mode_first(F.col("a")).alias("flags"), "size"),
         W + ", c as (select doc_id, idx * 7 % 4 as v, count(*) as c, min(idx) as f from blocks group by all), s as (select doc_id, cast(max(size) as double) as size from blocks group by doc_id) select c.doc_id, arg_max(v, {'a': c, 'b': -f}) as flags, any_value(size) as size from c join s using (doc_id) group by c.doc_id")

# Spatial ---------------------------------------------------------------------------------
def _best_fill(spark, d):
    b = blocks(spark, d)
    return spatial.best_fill(b, drawings(b))


register("j4_best_fill", _best_fill, W + "," + DRAWINGS_SQL + """,
  j as (select b.doc_id, b.idx, d.*, greatest(1, (b.x1 - b.x0) * (b.y1 - b.y0)) as box, greatest(0, least(x1, dx1) - greatest(x0, dx0)) * greatest(0, least(y1, dy1) - greatest(y0, dy0)) as inter, greatest(1, (dx1 - dx0) * (dy1 - dy0)) as cand,
    dx0 <= x0 - 0.2 and dy0 <= y0 - 0.2 and dx1 >= x1 + 0.2 and dy1 >= y1 + 0.2 as inside from blocks b join drawings d on b.doc_id = d.doc_id and b.page_idx = d.page_idx),
  k as (select *, inter / box as ov, cand / box as times from j), l as (select * from k where inter > 0 and not (r >= 0.97 and g >= 0.97 and b >= 0.97) and times <= 2.6 and not (ov < 0.86 and times > 1.6) and ov >= 0.72),
  m as (select *, row_number() over (partition by doc_id, idx order by (inside or ov >= 0.995)::int desc, round(ov, 6) desc, round(greatest(0, times - 1), 6), draw_idx) as nth from l) select doc_id, idx, r::double as r, g::double as g, b::double as b from m where nth = 1""")
register("j5_bottom_limits", lambda s, d: spatial.bottom_limits(blocks(s, d)), W + """,
  n as (select a.doc_id, a.idx, min(b.y0) as top from blocks a join blocks b on a.doc_id = b.doc_id and a.page_idx = b.page_idx and b.y0 > a.y0 and b.y0 <= a.y1 + 27 and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= greatest(8, least(a.x1 - a.x0, b.x1 - b.x0) * 0.18) group by all)
  select a.doc_id, a.idx, case when top is null then a.y1 + 3 else least(a.y1 + 3, greatest(a.y1, top - 0.8)) end as bottom_limit from blocks a left join n on n.doc_id = a.doc_id and n.idx = a.idx""")


def _column_pairs(spark, d):
    b = blocks(spark, d).withColumns({"issue": F.element_at(F.array(F.lit("OVERFLOW"), F.lit("UNDERFLOW"), F.lit("OPTIMAL")), ((F.col("idx") * 5 + F.col("doc_id")) % 3 + 1).cast("int")), "chars": F.length("text")})
    return spatial.column_pairs(b, PAGE_WIDTH)


register("j7_column_pairs", _column_pairs, W + """,
  e as (select *, case (idx * 5 + doc_id) % 3 when 0 then 'OVERFLOW' when 1 then 'UNDERFLOW' else 'OPTIMAL' end as issue, length(text) as chars, case when (x0 + x1) / 2 < 252 then 'left' when (x0 + x1) / 2 > 348 then 'right' else 'full' end as col from blocks where lid is not null),
  f as (select *, row_number() over (partition by doc_id, page_idx, col, issue order by idx) as nth from e where issue <> 'OPTIMAL'),
  p as (select o.doc_id, o.page_idx, o.col, o.nth, o.lid as ol, u.lid as ul, o.chars as oc, u.chars as uc, greatest(o.idx, u.idx) as m from f o join f u on o.doc_id = u.doc_id and o.page_idx = u.page_idx and o.col = u.col and o.nth = u.nth and o.issue = 'OVERFLOW' and u.issue = 'UNDERFLOW'),
  s as (select doc_id, ol as lid, page_idx || ':' || col as column_id, ul as partner_lid, 'shorten' as mode, greatest(1, oc * 9 // 10) as target_chars, m, nth from p union all select doc_id, ul, page_idx || ':' || col, ol, 'lengthen', greatest(uc + 6, uc * 112 // 100), m, nth from p),
  t as (select *, row_number() over (partition by doc_id, lid order by m desc, nth desc, mode desc) as k from s) select doc_id, lid, column_id, partner_lid, mode, cast(target_chars as bigint) as target_chars from t where k = 1""")


def _spans(spark, d):
    b = blocks(spark, d)
    return spatial.clip_text(b.select("doc_id", "page_idx", "x0", "y0", "x1", "y1", "text"), b)


register("j6_clip_text", _spans, W + f""", j as (select b.doc_id, b.idx, s.y0, s.x0, s.text from blocks b join blocks s on b.doc_id = s.doc_id and b.page_idx = s.page_idx and (s.x0 + s.x1) / 2 between b.x0 - 0.5 and b.x1 + 0.5 and (s.y0 + s.y1) / 2 between b.y0 - 0.5 and b.y1 + 0.5)
  select doc_id, idx, {SQ.format("string_agg(text, ' ' order by y0, x0, text)")} as pdf_text from j group by doc_id, idx""")
register("f42_merged_ranges", lambda s, d: spatial.merged_length(blocks(s, d).select("doc_id", (F.col("idx") * 13 % 50).alias("start"), (F.col("idx") * 13 % 50 + 1 + F.col("idx") % 6).alias("end")), ["doc_id"]), W + """,
  i as (select doc_id, idx * 13 % 50 as s, idx * 13 % 50 + 1 + idx % 6 as e from blocks), p as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as m from i),
  q as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by doc_id order by s, e rows unbounded preceding) as k from p), r as (select doc_id, k, max(e) - min(s) as n from q group by all) select doc_id, cast(sum(n) as bigint) as covered, count(*) as stretches from r group by doc_id""")

# State machine ---------------------------------------------------------------------------
TR = "with recursive " + TRANSITIONS_SQL
_EDGE = ", ".join(f"'{e}'" for e in state._EDGES)
_REPLAY = f""",
walk(lid, seq, to_state, round, from_state, accepted, st) as (
  select lid, seq, status, round, 'REGISTERED', 'REGISTERED>' || status in ({_EDGE}), case when 'REGISTERED>' || status in ({_EDGE}) then status else 'REGISTERED' end from transitions_in where seq = 1
  union all select t.lid, t.seq, t.status, t.round, w.st, w.st || '>' || t.status in ({_EDGE}), case when w.st || '>' || t.status in ({_EDGE}) then t.status else w.st end from walk w join transitions_in t on t.lid = w.lid and t.seq = w.seq + 1)"""


def _log(spark, d):
    return state.replay(transitions_in(spark, d))


register("i1_replay", _log, TR + _REPLAY + " select lid, cast(seq as int) as seq, to_state, cast(round as bigint) as round, from_state, accepted from walk")
register("i2_final_states", lambda s, d: state.final_states(_log(s, d)), TR + _REPLAY + " select lid, coalesce(arg_max(to_state, seq) filter (accepted), 'REGISTERED') as state, cast(coalesce(arg_max(round, seq) filter (accepted), 0) as bigint) as round, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as rejected from walk group by lid")
register("i2_skippable", lambda s, d: state.skippable(state.final_states(_log(s, d)), 2).select("lid", "state"), TR + _REPLAY + ", f as (select lid, coalesce(arg_max(to_state, seq) filter (accepted), 'REGISTERED') as state, coalesce(arg_max(round, seq) filter (accepted), 0) as r from walk group by lid) select lid, state from f where state in ('OPTIMAL', 'FORCE_FIT') and r < 2")
register("a20_round_summary", lambda s, d: state.round_summary(_log(s, d)), TR + _REPLAY + " select cast(round as bigint) as round, count(distinct lid) as processed, count(*) as steps, count(*) filter (to_state in ('OPTIMAL', 'FORCE_FIT')) as settled from walk where accepted group by round")
register("a5_attribution", lambda s, d: state.attribution(action_log(transitions_in(s, d))), "with " + TRANSITIONS_SQL + "," + ACTION_LOG_SQL + """,
  k as (select 'stage' as kind, coalesce(stage, 'unknown') as name from action_log union all select 'action', unnest(actions) from action_log union all select 'issue', issue from action_log where issue is not null) select kind, name, count(*) as n from k group by all""")

# Layout ----------------------------------------------------------------------------------
def boxes(spark, d):
    return blocks(spark, d).withColumns({"line": F.lit(1.35), "char": F.lit(0.05), "locked": F.lit(True)})


def _simulated(spark, d):
    s = layout.simulate(boxes(spark, d).where(~F.contains("text", F.lit("$"))))
    return s.select(*_KEY, F.col("line_count").cast("long").alias("line_count"), F.round("needed_height", 6).alias("needed_height"), "is_overflow")


#: Texts without formulas (c1_formulas has those with): the same greedy wrap as a fold over characters: struct of pen position and lines so far.
register("c1_simulate", _simulated, W + """,
  c as (select doc_id, idx, size, width, height, list_transform(string_split(text, ''), lambda x: {'a': case when x in (' ', chr(9), chr(13)) then 0.3 * size else 0.6 * size end::double, 'n': 1::bigint}) as cs from blocks where not contains(text, '$')),
  f as (select *, list_reduce(cs, lambda s, x: case when s.a > 0 and s.a + x.a > width + 1e-9 then {'a': x.a + 0.05::double, 'n': s.n + 1} else {'a': s.a + x.a + 0.05::double, 'n': s.n} end, {'a': 0::double, 'n': 1::bigint}) as r from c)
  select doc_id, idx, r.n as line_count, round(r.n * size * 1.35, 6)::double as needed_height, r.n * size * 1.35 > height as is_overflow from f""")


def _probe_rows(spark, d):
    b = blocks(spark, d)
    p = stats.document_profile(b).select("doc_id", F.col("median_source_density").alias("density"), F.col("avg_text_length").alias("avg_length"))
    r = b.repartition("doc_id").join(p, "doc_id").join(stats.layout_mode(b, PAGE_WIDTH), "doc_id").withColumns({"bucket": C.bucket(), "line": F.lit(1.35), "char": F.lit(0.05), "math_segments": T.math_segments("text")})
    return r.withColumn("dense", F.expr(C.dense_probe_sql()))


register("c2_probe", lambda s, d: layout.probe(_probe_rows(s, d), _KEY))
register("a10_frozen_styles", lambda s, d: stats.freeze_series(layout.probe(_probe_rows(s, d), [*_KEY, "bucket"]), ["doc_id", "bucket"], "size", 0.5, "size"))


def _tuned(spark, d):
    b = boxes(spark, d).join(stats.layout_mode(blocks(spark, d), PAGE_WIDTH), "doc_id")
    extra = {"font_key": F.when(C.bucket() == "title", "title").otherwise("body"), "is_title": C.bucket() == "title", "fragile_meta": F.lit(False), "multi_box": F.lit(False), "safe_prose": F.lit(True), "prose_heavy": F.lit(False), "chars": F.length(T.compact("text")), "math_segments": F.lit(0), "global_min": F.lit(0.02), "global_max": F.lit(0.08), "max_delta": F.lit(0.035), "can_rewrite": F.col("lid").isNotNull()}
    r = b.withColumns(extra)
    return r.withColumns({"threshold": F.expr(C.UNDERFLOW_SQL).cast("double"), "limit": F.expr(C.SAFE_FILL_SQL).cast("double"), "mathy": F.lit(False)})


register("c6_micro_tune", lambda s, d: layout.micro_tune(_tuned(s, d), _KEY))
register("i4_rounds", lambda s, d: reflow.round_stats(reflow.run_rounds(_tuned(s, d), reflow.length_rewriter, 3)[1]))
register("d2_capacity_shares", lambda s, d: distribute.capacity_shares(blocks(s, d)), W + """, r as (select doc_id, lid, idx, greatest(1, greatest(4, width / greatest(1, size * 0.92 + 0.04)) * greatest(1, height / greatest(1, size * 1.35)))::double as room from blocks where lid is not null)
  select doc_id, lid, idx, room / sum(room) over (partition by doc_id, lid) as share from r""")


def _distributed(by_fit: bool):
    def query(spark, d):
        b = blocks(spark, d)
        return distribute.distribute(order.reading_order(b), order.contexts(b).withColumnRenamed("context", "new_text"), by_fit)

    return query


register("d1_spread", _distributed(False))
register("d4_fit", _distributed(True))
