"""Corpora of papers on disk: configuration, discovery of papers and their files, block JSON, and sinks."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names in order of preference; {id} is the paper's.
JSON_NAMES = ("{id}_enriched.json", "{id}_content_list_customize.json", "{id}_content_list.json", "{id}_content_list_v2.json")
PDF_NAMES = ("{id}_origin.pdf", "{id}.pdf")
SPAN = "array<struct<text:string,font:string,size:double,flags:int,color:int>>"
BLOCK_JSON = f"type string, text string, text_level int, bbox array<double>, page_idx int, page int, logical_para_id int, context string, local_md string, translated string, detected_type string, rich_spans {SPAN}"


def expand_environment(value):
    """Values that are exactly ${NAME} become the variable's, or the empty text; dicts are walked, lists are not."""
    if isinstance(value, dict):
        return {k: expand_environment(v) for k, v in value.items()}
    m = re.fullmatch(r"\$\{(.+)\}", value) if isinstance(value, str) else None
    return os.environ.get(m.group(1), "") if m else value


def load_settings(path: str) -> dict | list:
    """A JSON or YAML file; only JSON's values and environment marks need no further library."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return expand_environment(json.loads(text))
    import yaml

    return expand_environment(yaml.safe_load(text) or {})


def missing_keys(config: dict) -> list[str]:
    """Required keys without a value; those of `reflow` are required where it is enabled."""
    wanted = ["translation.base_url", "translation.api_key", "translation.model"]
    value = lambda key: (config.get(key.partition(".")[0]) or {}).get(key.partition(".")[2])
    if value("reflow.enabled"):
        wanted += ["reflow.base_url", "reflow.api_key", "reflow.model"]
    return [k for k in wanted if not value(k)]


def requested(wanted: list[str] | None, available: list[str], aliases: dict[str, str]) -> list[str]:
    """Those of `wanted` that exist, after aliases, in order and once; all if none of them does."""
    found = list(dict.fromkeys(aliases.get(w, w) for w in wanted or ()))
    return [w for w in found if w in available] or list(available)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, category, layout, doc_id, name and inside (the folder below the paper's) of files under root/category/layout/doc_id."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    parts = F.split(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", ""), "/")
    inside = F.when(F.size(parts) > 4, F.array_join(F.slice(parts, 4, F.size(parts) - 4), "/")).otherwise("")
    return listed.select("path", F.get(parts, 0).alias("category"), F.get(parts, 1).alias("layout"), F.get(parts, 2).alias("doc_id"), F.element_at(parts, -1).alias("name"), inside.alias("inside")).where(F.size(parts) >= 4)


def _rank(names: tuple[str, ...]) -> Column:
    rank = F.lit(None).cast("int")
    for k, n in reversed(list(enumerate(names))):
        rank = F.when(F.col("name") == F.replace(F.lit(n), F.lit("{id}"), F.col("doc_id")), k).otherwise(rank)
    return rank


def papers(listing: DataFrame) -> DataFrame:
    """category, layout, doc_id, json_path, pdf_path: of each paper the best JSON and PDF of one folder, hybrid_auto before its own."""
    key = ["category", "layout", "doc_id", "inside"]
    r = listing.where("inside in ('', 'hybrid_auto')").withColumns({"j": _rank(JSON_NAMES), "p": _rank(PDF_NAMES)})
    best = r.groupBy(*key).agg(F.min_by("path", "j").alias("json_path"), F.min_by("path", "p").alias("pdf_path")).where("json_path is not null and pdf_path is not null")
    root = F.when(F.col("inside") == "hybrid_auto", 0).otherwise(1)
    return best.groupBy(*key[:3]).agg(F.min_by(F.struct("json_path", "pdf_path"), root).alias("f")).select(*key[:3], "f.*")


def translated_pairs(listing: DataFrame) -> DataFrame:
    """pdf_path, json_path of every *_translated.pdf that has its JSON beside it."""
    stem = F.regexp_replace("path", r"\.(pdf|json)$", "")
    s = listing.where(F.regexp_like("name", F.lit(r"_translated\.(pdf|json)$"))).select("path", stem.alias("stem"), F.regexp_extract("name", r"\.(pdf|json)$", 1).alias("kind"))
    pdf, js = (s.where(F.col("kind") == k).select("stem", F.col("path").alias(f"{k}_path")) for k in ("pdf", "json"))
    return pdf.join(js, "stem").drop("stem")


def read_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks from JSON arrays: path, idx (place in the array) and BLOCK_JSON, bbox as x0, y0, x1, y1 (NULL unless it has four values)."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{BLOCK_JSON}>>").alias("a"))
    b = text.select("path", F.posexplode("a").alias("idx", "b")).select("path", "idx", "b.*")
    four = F.size("bbox") == 4
    corners = {c: F.when(four, F.get("bbox", k)) for k, c in enumerate(("x0", "y0", "x1", "y1"))}
    return b.withColumns(corners | {"page_idx": F.coalesce("page_idx", "page", F.lit(0))}).withColumnRenamed("logical_para_id", "lid").drop("page")


def with_spans(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """rich_spans of blocks that have none yet: the page's spans (keys, page_idx, x0.., text, font, size, flags, color) whose centre lies in the box."""
    s = spans.toDF(*(c if c in (*keys, "page_idx") else f"s_{c}" for c in spans.columns))
    cx, cy = (F.col("s_x0") + F.col("s_x1")) / 2, (F.col("s_y0") + F.col("s_y1")) / 2
    bare = blocks.where("rich_spans is null or size(rich_spans) = 0").select(*keys, "page_idx", "idx", "x0", "y0", "x1", "y1")
    j = bare.join(s, [*keys, "page_idx"]).where(cx.between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1")))
    one = F.struct("s_y0", "s_x0", F.struct(*(F.col(f"s_{c}").alias(c) for c in ("text", "font", "size", "flags", "color"))).alias("span"))
    found = j.groupBy(*keys, "idx").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["span"]).cast(SPAN).alias("found"))
    return blocks.join(found, [*keys, "idx"], "left").withColumn("rich_spans", F.coalesce(F.when(F.size("rich_spans") > 0, F.col("rich_spans")), "found", F.array().cast(SPAN))).drop("found")


def read_action_logs(spark: SparkSession, root: str) -> DataFrame:
    """The action_log entries of all *_planner.json files under root (or of one file)."""
    entry = "lid string, round int, stage string, event_type string, state_before string, state_after string, planned_actions array<string>, applied_actions array<string>, metadata struct<issue:string>"
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(f"action_log array<struct<{entry}>>")
    df = reader.json(root) if root.endswith(".json") else reader.option("pathGlobFilter", "*_planner.json").json(root)
    return df.select(F.col("_metadata.file_path").alias("path"), F.inline("action_log")).select("*", F.col("applied_actions").alias("actions"), F.nullif("metadata.issue", F.lit("")).alias("issue"))


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("category", "layout")) -> None:
    """JSON lines, in folders by the given columns as far as the table has them."""
    df.write.mode("overwrite").partitionBy(*(c for c in by if c in df.columns)).json(path)


def coverage_report(coverage: DataFrame, top: DataFrame) -> str:
    """The Markdown report: a table for each label, and the pages to look at first. Both inputs are small aggregates."""
    totals = coverage.groupBy("label").agg(F.count("*").alias("pages")).orderBy("label").toPandas()
    lines = ["| label | pages |", "| --- | ---: |", *(f"| {r.label} | {r.pages} |" for r in totals.itertuples()), "", "| document | page | label | expected | actual |", "| --- | ---: | --- | ---: | ---: |"]
    lines += [f"| {r.doc_id} | {r.page_no} | {r.label} | {r.expected_chars} | {r.actual_chars} |" for r in top.orderBy("place").toPandas().itertuples()]
    return "\n".join(lines) + "\n"
