"""Classification of blocks: buckets, types, and predicates of what may be rewritten.

Rule tables are kept as SQL expressions that name the columns they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

REWRITE_PRESERVE = tuple("affiliation aside_text author code equation page_footer page_header page_number reference url".split())
RENDER_PRESERVE = (*REWRITE_PRESERVE, *"curve figure image line rect table".split())
_BUCKETS = {"body": "abstract body text", "caption": "caption figure_caption table_caption", "footer": "footer page_footer", "footnote": "footnote", "header": "header page_header", "section_header": "section_header", "title": "title"}
_ALIASES = {name: bucket for bucket, names in _BUCKETS.items() for name in names.split()}


def bucket_sql(kind: str = "lower(coalesce(nullif(detected_type, ''), type, ''))", font_key: str = "'body'") -> str:
    """The style bucket: exact names first, then parts of names, then the style's font key."""
    exact = " ".join(f"when {kind} = '{k}' then '{v}'" for k, v in _ALIASES.items())
    parts = " ".join(f"when contains({kind}, '{k}') then '{k}'" for k in "section_header title caption footnote header footer".split())
    return f"case {exact} {parts} when {font_key} = 'heading' then 'section_header' when {font_key} in ('title', 'caption') then {font_key} else 'body' end"


def bucket(kind: Column | None = None) -> Column:
    return F.expr(bucket_sql())


def any_part(kinds: tuple[str, ...], *columns: str) -> str:
    """Whether a type of `kinds` is part of the lower-cased text of any column."""
    return "(" + " or ".join(f"contains(lower(coalesce({c}, '')), '{k}')" for c in columns for k in kinds) + ")"


def preserved(kinds: tuple[str, ...] = RENDER_PRESERVE) -> Column:
    return F.expr(any_part(kinds, "type", "detected_type"))


TEXT_LIKE_SQL = f"""(not {any_part(REWRITE_PRESERVE, 'type', 'detected_type')} and lower(coalesce(type, '')) in ('abstract', 'paragraph', 'text', '')
  and lower(coalesce(nullif(detected_type, ''), type, '')) in ('abstract', 'body', 'paragraph', 'text', ''))"""


def correct_type(blocks: DataFrame, body_size: float) -> DataFrame:
    """corrected: the type after a look at size, level and text (columns type, text, text_level, size, page_idx)."""
    b = float(body_size)
    kind = "lower(coalesce(type, 'text'))"
    rules = f"""case when {kind} = 'page_footnote' then 'footer'
      when {kind} in ('aside_text', 'code', 'curve', 'equation', 'figure', 'formula', 'image', 'line', 'page_number', 'rect', 'table') then {kind}
      when contains({kind}, 'author') and (length(text) > 150 or contains(substring(lower(text), 1, 50), 'abstract')) then 'text'
      when contains({kind}, 'reference') and length(text) > 50 and not bracketed and not numbered then 'text'
      when page_idx = 0 and size > {b} * 1.4 then 'title' when text_level = 0 then 'title'
      when text_level = 1 then case when size > {b} * 1.4 then 'title' else 'section_header' end
      when size > {b} * 1.15 and not contains({kind}, 'title') then 'section_header'
      when size < {b} * 0.85 then case when contains({kind}, 'caption') then 'caption' else 'footnote' end else {kind} end"""
    marked = blocks.withColumns({"bracketed": F.regexp_like(T.text_of("text"), F.lit(r"\[\d+\]")), "numbered": F.regexp_like(T.text_of("text"), F.lit(r"\d+\."))})
    return marked.withColumn("corrected", F.expr(rules)).drop("bracketed", "numbered")


def reference_heading(c: Column | str) -> Column:
    return F.lower(T.squeeze(c)).isin("bibliography", "reference", "references", "works cited")


_YEAR = r"\b(?:20|19)\d\d[a-z]?\b"
_AUTHOR = r"[A-Z][-`'a-zA-Z]+,\s*(?:[A-Z][.]){1,3}"
_INITIALS = r"(?:[&;,\s]|^)(?:[A-Z][.]\s*){1,3}[A-Z][-`'a-zA-Z]+"
_ADDRESS = r"(?i)@|https?://|Email address:"


def reference_entry(c: Column | str) -> Column:
    """Whether a text looks like an entry of a bibliography, by any of five signs."""
    t = T.squeeze(c)
    like = lambda p: F.regexp_like(t, F.lit(p))
    year = like(r"\b(20|19)\d\d\b")
    venue = like(r"(?i)\b(Cambridge|Journal|Press|Proc[.]|Springer|Univ[.]|University|arXiv|doi|pp[.]|vol[.])\b")
    return (F.length(t) >= 24) & (like(r"(?:\s|^)\[(?:[^\]])+\]\s") | like(r"(?:\s|^)\d+[.]\s+[A-Z]") | like(_ADDRESS) | (venue & year) | (like(_AUTHOR) & year))


def reference_fragment(c: Column | str) -> Column:
    """The same for a part of an entry."""
    t = T.squeeze(c)
    like = lambda p: F.regexp_like(t, F.lit(p))
    years, authors, initials = T.count_of(t, _YEAR), T.count_of(t, _AUTHOR), T.count_of(t, _INITIALS)
    named = (authors >= 1) | (initials >= 2)
    venue = like(r"(?i)\b(?:A&A|AJ|ApJ|ApJS|Conference|Journal|MNRAS|Nature|Proc[.]|Proceedings|Science|Vol[.]|arXiv|doi|pp[.])\b")
    listed = (T.count_of(t, ",") >= 3) | F.contains(t, F.lit("&")) | F.contains(F.lower(t), F.lit(" and "))
    paged = like(r"\b\d{1,4}\b")
    return (F.length(t) >= 20) & ~like(_ADDRESS) & (((years >= 1) & named) | ((years >= 1) & venue & listed) | (venue & named & paged))


def reference_entry_strong(c: Column | str) -> Column:
    """A sure entry: of 32 characters or more, with a year, two authors or `et al`, and a venue or another year."""
    t = T.squeeze(c)
    like = lambda p: F.regexp_like(t, F.lit(p))
    years = T.count_of(t, _YEAR)
    venue = like(r"(?i)\b(?:A&A|AJ|ApJ|ApJS|Conference|Journal|MNRAS|Proc[.]|Proceedings|Vol[.]|arXiv|doi|pp[.])\b")
    return (F.length(t) >= 32) & (years >= 1) & ((T.count_of(t, _AUTHOR) >= 2) | like(r"(?i)\bet\s+al\b")) & (venue | (years >= 2))


#: Whether a block may be rewritten (columns text, lid, can_rewrite, fallback_used, type, detected_type, font_key, fragile_meta).
REWRITE_ALLOWED_SQL = f"""(coalesce(text, '') <> '' and lid is not null and can_rewrite and not fallback_used and not {any_part(REWRITE_PRESERVE, 'type', 'detected_type')}
  and font_key not in ('title', 'heading') and not contains(lower(coalesce(nullif(detected_type, ''), type, '')), 'title') and not contains(lower(coalesce(nullif(detected_type, ''), type, '')), 'section_header') and not fragile_meta)"""


def dense_probe_sql(text: str = "text") -> str:
    """Whether a body block is crowded: much text, formulas, or hardly two lines of room (columns bucket, height, size, line)."""
    chars = f"length(replace(replace({text}, ' ', ''), chr(10), ''))"
    return f"(bucket = 'body' and ({chars} >= 70 or math_segments >= 2 or height / greatest(size * line, 1.0) <= 1.6))"


UNDERFLOW_SQL = """case when is_title then 0.66 when fragile_meta then 0.42
  when (font_key = 'body' or font_key = '') and multi_box and not safe_prose then case when layout_mode = 'double_col' then 0.88 else 0.92 end
  when layout_mode = 'double_col' and font_key = 'body' then case when safe_prose then case when prose_heavy then 0.992 else 0.982 end when prose_heavy then 0.972 else 0.952 end
  when layout_mode = 'double_col' then case when prose_heavy then 0.9 else 0.86 end
  when layout_mode = 'single_col' and font_key = 'body' then case when safe_prose then case when prose_heavy then 0.998 else 0.988 end when prose_heavy then 0.984 else 0.968 end
  when layout_mode = 'single_col' then 0.875 else 0.68 end"""

FILL_TARGET_SQL = """case when issue = 'OVERFLOW' then case when layout_mode = 'single_col' then 0.991 else 0.979 end
  when font_key = 'body' and safe_prose then case when layout_mode = 'single_col' then 0.999 else 0.996 end
  when layout_mode = 'double_col' then case when font_key = 'body' then 0.993 else 0.972 end
  when layout_mode = 'single_col' then case when font_key = 'body' then 0.996 else 0.982 end else 0.92 end"""

SEVERE_SQL = """(font_key = 'body' and case
  when layout_mode = 'single_col' then fill_ratio < 0.70 or fill_ratio < greatest(0.01, threshold - 0.16) or (height >= 96 and fill_ratio < 0.80) or (safe_prose and fill_ratio < 0.82)
  when layout_mode = 'double_col' then fill_ratio < 0.74 or fill_ratio < greatest(0.01, threshold - 0.14) or (height >= 72 and fill_ratio < 0.81) or (safe_prose and fill_ratio < 0.83) else fill_ratio < 0.68 end)"""

#: `risky`: formulas, LaTeX commands, theorem words or several boxes; `risky_double` leaves theorem words out.
ATTEMPTS_SQL = """case when font_key <> 'body' then 1 when safe_prose and layout_mode in ('single_col', 'double_col') then case when severe then 5 else 4 end
  when layout_mode = 'single_col' then case when fallback_used then 1 when severe then case when risky then 2 else 4 end when risky then 1 else 3 end
  when layout_mode = 'double_col' and not risky_double then case when severe then 4 else 3 end else 1 end"""

MIN_GROWTH_SQL = """case when font_key <> 'body' then 1.0
  when layout_mode = 'single_col' then least(1.96, case when safe_prose then 1.28 else 1.20 end + case when fill_ratio < greatest(0.01, threshold - 0.05) then 0.08 else 0 end
    + case when fill_ratio < 0.72 then 0.14 else 0 end + case when fill_ratio < 0.60 then 0.16 else 0 end + case when height >= 96 then 0.10 else 0 end)
  when layout_mode = 'double_col' then least(1.82, case when safe_prose then 1.28 else 1.22 end + case when fill_ratio < 0.70 then 0.16 else 0 end + case when fill_ratio < 0.60 then 0.14 else 0 end + case when height >= 72 then 0.08 else 0 end)
  else 1.05 end"""

MAX_GROWTH_SQL = """case when font_key <> 'body' then 1.18
  when layout_mode = 'single_col' then least(2.02, case when safe_prose then 1.88 when mathy then 1.54 else 1.76 end + case when fill_ratio < 0.60 then 0.12 when fill_ratio < 0.72 then 0.08 else 0 end + case when height >= 96 then 0.06 else 0 end)
  when layout_mode = 'double_col' then least(1.86, 1.62 + case when safe_prose then 0.1 else 0 end + case when fill_ratio < 0.70 then 0.1 else 0 end + case when height >= 72 then 0.06 else 0 end) else 1.24 end"""

SAFE_FILL_SQL = """greatest(0.89, least(0.994, case when font_key in ('title', 'heading') then 0.985 when layout_mode = 'single_col' and font_key = 'body' then case when prose_heavy then 0.99 else 0.982 end
  when font_key = 'body' then case when prose_heavy then 0.986 else 0.977 end else 0.98 end - case when chars >= 80 or math_segments >= 2 then 0.025 else 0 end - case when height <= 18 then 0.02 else 0 end))"""

FORMULA_DENSE_SQL = "(conservative or disabled or math_ratio >= 0.16 or multi_ratio >= 0.18 or theorem_ratio >= 0.14)"
PROSE_HEAVY_SQL = f"(not {FORMULA_DENSE_SQL} and math_ratio <= 0.06 and multi_ratio <= 0.08 and median_density >= 58.0 and avg_length >= 380.0)"

FEEDBACK_SQL = """case when issue = 'OPTIMAL' then 'skip' when is_title then 'micro_tune' when issue = 'OVERFLOW' and is_final then 'force_fit' when issue in ('OVERFLOW', 'UNDERFLOW') then 'rewrite_and_tune' else 'observe' end"""


def feedback(rows: DataFrame) -> DataFrame:
    """The decision for an issue (columns issue, is_title, is_final): decision, rewrite_mode, planned actions."""
    decided = rows.withColumn("decision", F.expr(FEEDBACK_SQL))
    mode = F.when(F.col("decision") == "rewrite_and_tune", F.when(F.col("issue") == "OVERFLOW", "shorten").otherwise("lengthen"))
    actions = F.when(F.col("decision").isin("skip", "observe"), F.array().cast("array<string>")).when(F.col("decision") == "rewrite_and_tune", F.array(F.lit("Rewriting"), F.lit("CharSpacing"))).otherwise(F.array(F.lit("CharSpacing")))
    return decided.withColumns({"rewrite_mode": mode, "actions": actions})


def sanitize_render(text: Column) -> Column:
    """Footers and footnotes lose the marks and blanks that they begin with (columns type, detected_type)."""
    foot = F.expr(any_part(("footer", "footnote"), "type", "detected_type"))
    return F.when(foot, F.regexp_replace(T.text_of(text), "^[\\s†‡§¶‖]+", "")).otherwise(T.text_of(text))


def meaningful_token(c: Column | str) -> Column:
    """Whether a styled word says something: not signs alone, nor one character, nor two CJK ones."""
    t = T.squeeze(c)
    n = F.length(T.compact(t))
    return (t != "") & ~F.regexp_like(t, F.lit(r"(?U)^[\W_]+$")) & (n > 1) & ~((n <= 2) & F.regexp_like(t, F.lit(f"^{T.CJK}+$")))
