"""The supplied tables, and the layout views derived from them.

Each view exists twice: as a DataFrame and as a DuckDB common table expression with the
same columns, so that queries over it can be compared. Rules use integer arithmetic and
literals only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a block that follow from doc_id, idx and text, in SQL that both engines read.
_BLOCK_COLUMNS = {
    "page_idx": "cast(floor(idx / 8) as int)",
    "type": """case when idx = 0 then 'title' when contains(text, '$$$') or contains(text, '%%%') then 'equation'
      when contains(text, '@') or contains(text, 'http') then 'reference' when length(text) < 20 then 'section_header' when idx % 11 = 10 then 'footnote' else 'text' end""",
    "x0": "cast(case when doc_id % 3 = 0 and idx % 2 = 1 then 310 else 50 end as double)",
    "y0": "cast(40 + 90 * (case when doc_id % 3 = 0 then floor((idx % 8) / 2) else idx % 8 end) as double)",
    "width": "cast(case when doc_id % 3 = 0 then 240 else 500 end as double)",
    "height": "cast(12 * (1 + (doc_id + idx) % 6) as double)",
    "lid": "case when idx % 7 = 6 then null else cast(floor(idx / 2) as int) end",
    "translated": "case doc_id % 4 when 0 then concat(text, ' ', text) when 1 then text when 2 then '' else substring(text, 1, cast(floor(length(text) / 2) as int)) end",
    "fallback_used": "contains(text, '$$$')",
    "detected_type": "case when idx % 5 = 4 then 'text' when idx % 13 = 12 then 'section_header' else null end",
    "size": "9 + 0.5 * (doc_id % 5)",
}
_BLOCKS_TAIL = f"select *, x0 + width as x1, y0 + height as y1 from (select *, {', '.join(f'{v} as {k}' for k, v in _BLOCK_COLUMNS.items())} from _lines)"

BLOCKS_SQL = f"""
_lines as (select doc_id, cast(idx as bigint) as idx, text from (
  select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents) where regexp_replace(text, '[ \\t\\r\\f]', '', 'g') <> ''),
blocks as ({_BLOCKS_TAIL})"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks: one for each line of a document that isn't blank; idx keeps the line's number."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")).where(F.regexp_replace("text", r"[ \t\r\f\x0B]", "") != "")
    return as_blocks(lines.select("doc_id", F.col("idx").cast("long").alias("idx"), "text"))


def as_blocks(lines: DataFrame) -> DataFrame:
    """The block columns over rows (doc_id, idx, text)."""
    kinds = {"page_idx": "int", "lid": "int", "type": "string", "translated": "string", "detected_type": "string", "fallback_used": "boolean"}
    named = lines.select("*", *(F.expr(v).cast(kinds.get(k, "double")).alias(k) for k, v in _BLOCK_COLUMNS.items()))
    return named.select("*", (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"))


PDF_PAGES_SQL = """
pdf_pages as (select doc_id, page_idx + 1 as page_no, 600.0::double as page_width, 800.0::double as page_height,
  coalesce(string_agg(text, chr(10) order by idx) filter ((doc_id + idx) % 4 <> 0), '') as page_text from blocks group by doc_id, page_idx)"""


def pdf_pages(blocks: DataFrame) -> DataFrame:
    """Page facts: size, and the text that an extractor finds (some lines are lost)."""
    seen = F.when((F.col("doc_id") + F.col("idx")) % 4 != 0, F.struct("idx", "text"))
    grouped = blocks.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(seen)).alias("found"))
    return grouped.select("doc_id", (F.col("page_idx") + 1).alias("page_no"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.array_join(F.transform("found", lambda x: x["text"]), "\n").alias("page_text"))


DRAWINGS_SQL = """
_first_boxes as (select *, row_number() over (partition by doc_id, page_idx order by idx) as nth from blocks),
drawings as (select doc_id, page_idx, nth * 2 + k as draw_idx, x0 - pad as dx0, y0 - pad as dy0, x1 + pad as dx1, y1 + pad as dy1,
  case doc_id % 3 when 0 then 0.9 when 1 then 0.99 else 0.1 end as r, case doc_id % 3 when 0 then 0.9 when 1 then 0.98 else 0.2 end as g, case doc_id % 3 when 0 then 0.9 when 1 then 0.99 else 0.8 end as b
  from _first_boxes, (values (0, 2.0), (1, 60.0)) as v(k, pad) where nth <= 2)"""


def drawings(blocks: DataFrame) -> DataFrame:
    """Filled rectangles around the first two boxes of a page, close and wide."""
    from pyspark.sql import Window

    first = blocks.select("doc_id", "page_idx", "x0", "y0", "x1", "y1", F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("idx")).alias("nth")).where("nth <= 2")
    pads = first.select("*", F.inline(F.array(F.struct(F.lit(0).alias("k"), F.lit(2.0).alias("pad")), F.struct(F.lit(1).alias("k"), F.lit(60.0).alias("pad")))))
    fill = lambda a, b, c: F.when(F.col("doc_id") % 3 == 0, a).when(F.col("doc_id") % 3 == 1, b).otherwise(c)
    return pads.select("doc_id", "page_idx", (F.col("nth") * 2 + F.col("k")).cast("long").alias("draw_idx"), (F.col("x0") - F.col("pad")).alias("dx0"), (F.col("y0") - F.col("pad")).alias("dy0"), (F.col("x1") + F.col("pad")).alias("dx1"), (F.col("y1") + F.col("pad")).alias("dy1"), fill(0.9, 0.99, 0.1).alias("r"), fill(0.9, 0.98, 0.2).alias("g"), fill(0.9, 0.99, 0.8).alias("b"))


TRANSITIONS_SQL = """
transitions_in as (select concat(cast(user_id as varchar), ':', cast(cast(ts as date) as varchar)) as lid, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as seq, event_id, user_id, event_type, value,
  case event_type when 'signup' then 'TRANSLATED' when 'view' then 'PENDING' when 'click' then 'OVERFLOW' when 'error' then 'UNDERFLOW' when 'purchase' then 'OPTIMAL' end as status,
  cast(json_extract_string(props, '$.k') as bigint) % 4 as round from events)"""


def transitions_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested state changes: a block for each user and day, in order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    status = F.create_map(*(F.lit(x) for kv in {"signup": "TRANSLATED", "view": "PENDING", "click": "OVERFLOW", "error": "UNDERFLOW", "purchase": "OPTIMAL"}.items() for x in kv))
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), day.cast("string")).alias("lid"), F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id")).alias("seq"), "event_id", "user_id", "event_type", "value", status[F.col("event_type")].alias("status"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("round"))


ACTION_LOG_SQL = """
action_log as (select *, case event_type when 'signup' then 'translate' when 'purchase' then 'render' when 'view' then null else 'reflow' end as stage,
  list_filter([case when value > 50 then 'Rewriting' end, case when cast(floor(value) as bigint) % 2 = 0 then 'CharSpacing' end, case when value < 20 then 'FontSize' end], lambda x: x is not null) as actions,
  case when status in ('OVERFLOW', 'UNDERFLOW') then status end as issue from transitions_in)"""


def action_log(transitions: DataFrame) -> DataFrame:
    """Events of a processing log with their stage, applied actions and issue."""
    stage = F.when(F.col("event_type") == "signup", "translate").when(F.col("event_type") == "purchase", "render").when(F.col("event_type") == "view", None).otherwise("reflow")
    actions = F.array_compact(F.array(F.when(F.col("value") > 50, "Rewriting"), F.when(F.floor("value") % 2 == 0, "CharSpacing"), F.when(F.col("value") < 20, "FontSize")))
    return transitions.select("*", stage.alias("stage"), actions.alias("actions"), F.when(F.col("status").isin("OVERFLOW", "UNDERFLOW"), F.col("status")).alias("issue"))
