"""Queries over paragraphs, references, segments and styles, each SQL written apart from the operator's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import classify as C
from quire.operators import layout, order, state
from quire.plans import block_queries as B
from quire.plans.block_queries import SQ, W
from quire.plans.catalog import register
from quire.sources.tables import ACTION_LOG_SQL, TRANSITIONS_SQL, action_log, blocks, transitions_in

_KEY = ["doc_id", "idx"]

#: Blocks with their place in the paragraph.
_PLACES = """,
  pa as (select *, greatest(1, max(x1) over w - min(x0) over w) as span, max((x0 + x1) / 2) over w - min((x0 + x1) / 2) over w as spread, avg((x0 + x1) / 2) over w as middle, count(*) over w as n
    from blocks where lid is not null window w as (partition by doc_id, lid, page_idx)),
  pb as (select *, sum(case when x1 - x0 <= span * 0.72 then 1 else 0 end) over (partition by doc_id, lid, page_idx) as narrow from pa),
  pc as (select *, case when n < 2 or narrow < 2 or spread < span * 0.22 then 0 when x1 - x0 >= span * 0.78 then -1 when (x0 + x1) / 2 <= middle then 0 else 1 end as col from pb),
  places as (select *, row_number() over (partition by doc_id, lid order by page_idx, col, y0, x0, idx) as place from pc)"""
_PARAGRAPHS = f", paragraphs as (select doc_id, lid, trim(string_agg({SQ.format('text')}, ' ' order by page_idx, y0, x0, idx)) as context from blocks where lid is not null group by all)"

register("j3_siblings", lambda s, d: order.siblings(blocks(s, d)), W + _PLACES + """
  select doc_id, lid, type, list(idx order by place) as idxs, string_agg(coalesce(text, ''), ' ' order by place) as source, string_agg(coalesce(translated, ''), '' order by place) as translated from places group by doc_id, lid, type""")

register("p18_sure_entries", lambda s, d: blocks(s, d).select(*_KEY, C.reference_entry_strong("text").alias("sure")), W + rf""",
  q as (select doc_id, idx, {SQ.format('text')} as t from blocks),
  n as (select *, len(regexp_extract_all(t, '\b(?:19|20)[0-9][0-9][a-z]?\b')) as years, len(regexp_extract_all(t, '[A-Z][a-zA-Z''`-]+,\s*([A-Z]\.){{1,3}}')) as authors from q)
  select doc_id, idx, length(t) >= 32 and years > 0 and (authors > 1 or regexp_matches(t, '\bet\s+al\b', 'i'))
    and (years > 1 or regexp_matches(t, '\b(ApJ|ApJS|A&A|MNRAS|AJ|arXiv|doi|Proc\.|Proceedings|Journal|Conference|Vol\.|pp\.)\b', 'i')) as sure from n""")

register("p20_reference_sections", lambda s, d: order.reference_sections(blocks(s, d)), W + _PARAGRAPHS + """,
  firsts as (select doc_id, lid, bool_or(lower(coalesce(type, '')) like '%reference%') as any_typed, min({'p': page_idx, 'y': y0, 'i': idx, 't': lower(coalesce(type, '')) like '%reference%'}) as f from blocks where lid is not null group by all),
  marked as (select *, lower(context) in ('references', 'reference', 'bibliography', 'works cited') as heading from firsts join paragraphs using (doc_id, lid))
  select doc_id, lid, heading or any_typed as preserve, bool_or(heading or f.t) over (partition by doc_id order by f.p, f.y) as in_section from marked""")


def _gated(spark, d):
    b = blocks(spark, d)
    font = F.when(F.col("type") == "text", "body").when(F.col("type") == "title", "title").otherwise("caption")
    return b.withColumns({"font_key": font, "can_rewrite": F.col("idx") % 7 != 6, "fallback_used": F.col("idx") % 11 == 10, "fragile_meta": F.col("idx") % 9 == 8})


register("p9_rewrite_allowed", lambda s, d: _gated(s, d).select(*_KEY, F.expr(C.REWRITE_ALLOWED_SQL).alias("allowed")), W + """,
  k as (select *, lower(coalesce(type, '')) as raw, lower(coalesce(nullif(detected_type, ''), type, '')) as kind from blocks)
  select doc_id, idx, coalesce(text, '') <> '' and lid is not null and idx % 7 < 6 and idx % 11 < 10 and idx % 9 < 8
    and not regexp_matches(raw || ' ' || lower(coalesce(detected_type, '')), 'affiliation|aside_text|author|code|equation|page_footer|page_header|page_number|reference|url')
    and type <> 'title' and not regexp_matches(kind, 'title|section_header') as allowed from k""")

_MODES = "case doc_id % 3 when 0 then 'double_col' when 1 then 'single_col' else 'mixed' end as layout_mode, case when idx % 5 = 4 then 'title' else 'body' end as font_key, (doc_id + idx) % 3 <> 0 as safe_prose, (doc_id * 7 + idx * 3) % 100 / 80.0 as fill_ratio, 0.5 + idx % 6 * 0.08 as threshold"


def _severe(spark, d):
    return blocks(spark, d).selectExpr(*_KEY, "height", *_MODES.split(", ")).select(*_KEY, F.expr(C.SEVERE_SQL).alias("severe"))


#: The least fill that isn't severe, by layout: its floor, the distance to the threshold, and those of tall boxes and safe prose.
register("p12_severe_underflow", _severe, W + f""", m as (select *, {_MODES} from blocks),
  l as (select * from (values ('single_col', 0.70, 0.16, 96, 0.80, 0.82), ('double_col', 0.74, 0.14, 72, 0.81, 0.83)) as t(layout_mode, low, gap, tall, tall_low, prose_low))
  select doc_id, idx, font_key = 'body' and fill_ratio < case when low is null then 0.68 else greatest(low, 0.01, threshold - gap, case when height >= tall then tall_low else 0 end, case when safe_prose then prose_low else 0 end) end as severe
  from m left join l using (layout_mode)""")

register("f17_segments", lambda s, d: blocks(s, d).select(*_KEY, F.posexplode(T.segments("text")).alias("nth", "p")).select(*_KEY, "nth", "p.kind", "p.piece"), W + """,
  m as (select doc_id, idx, string_split('t' || regexp_replace(coalesce(text, ''), '\\$[^$]+\\$', chr(1) || 'm\\0' || chr(1) || 't', 'g'), chr(1)) as ps from blocks),
  u as (select doc_id, idx, list_filter(ps, lambda p: length(p) > 1) as ps from m),
  v as (select doc_id, idx, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as nth from u)
  select doc_id, idx, cast(nth as int) as nth, case when p[1] = 'm' then 'math' else 'text' end as kind, p[2:] as piece from v""")

register("a20_round_counts", lambda s, d: state.round_counts(state.replay(transitions_in(s, d)), action_log(transitions_in(s, d))), "with recursive " + TRANSITIONS_SQL + "," + ACTION_LOG_SQL + B._REPLAY + """,
  k as (select round, 'action' as kind, unnest(actions) as name from action_log union all select round, 'issue', issue from action_log where issue is not null
    union all select round, 'result', to_state from walk where accepted union all select round, 'transition', from_state || '->' || to_state from walk where accepted)
  select cast(round as bigint) as round, kind, name, count(*) as n from k group by all""")

register("t3_recovery_examples", lambda s, d: order.recovery_examples(B.recovered_rows(s, d)))


def _open_styles(spark, d):
    return blocks(spark, d).withColumns({"line": F.lit(1.35), "char": F.lit(0.05), "locked": F.col("idx") % 10 == 9})


register("c12_accordion", lambda s, d: layout.accordion(_open_styles(s, d), _KEY))
register("c1_formulas", lambda s, d: layout.simulate(B.boxes(s, d).where("contains(text, '$')")).select(*_KEY, F.col("line_count").cast("long").alias("line_count"), F.round("needed_height", 6).alias("needed_height"), "is_overflow"))
