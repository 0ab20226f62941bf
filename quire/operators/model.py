"""Operators around a language model. The model is a client that is passed in; everything before and after it is columns.

A client is any picklable object with complete(prompt, temperature) -> str; it is called
from executors. Its failures count as an empty answer after `tries` attempts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quire.functions import latex
from quire.functions import text as T


class Client(Protocol):
    def complete(self, prompt: str, temperature: float) -> str: ...


def ask(client: Client, prompt: str, temperature: float = 0.2, tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """One answer; waits `wait`, then twice that, ... between attempts that fail."""
    for k in range(tries):
        try:
            return client.complete(prompt, temperature) or ""
        except Exception:  # whatever a client raises counts as a failed attempt
            if k + 1 < tries:
                sleep(wait * (k + 1))
    return ""


def answers(client: Client, temperature: float = 0.2, tries: int = 3, wait: float = 2.0):
    """A column function prompt -> answer. NULL and empty prompts aren't asked."""

    @F.arrow_udf(S.StringType())
    def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            yield pa.array([ask(client, p, temperature, tries, wait) if p else "" for p in prompts.to_pylist()], pa.string())

    return asked


def translate(paragraphs: DataFrame, client: Client, target: str = "Chinese", direct: dict[str, str] | None = None) -> DataFrame:
    """translated, issues, fallback_used and mode of paragraphs (column text; keep marks those left as they are).

    Kept, empty and directly mapped texts aren't asked for. Formulas are masked before and
    put back after; an answer that lost a mask, looks unfinished or talks about the task
    gives way to the source. Answers with unsafe formulas are flagged by their issues.
    """
    known = F.create_map(*(F.lit(x) for kv in direct.items() for x in kv)) if direct else None
    plain = T.squeeze("text")
    mapped = known[plain] if known is not None else F.lit(None).cast("string")
    r = paragraphs.withColumns({"_d": mapped, "_m": T.mask("text")})
    skip = F.col("keep") | (plain == "") | F.col("_d").isNotNull()
    prompt = F.concat(F.lit(f"Translate into {target}; keep every [MATH_MASK_n] as it is.\n\n"), F.col("_m.text"))
    r = r.withColumn("_a", answers(client, 0.3)(F.when(~skip, prompt))).withColumn("_c", T.clean_output("_a"))
    r = r.withColumn("_u", latex.sanitize_math(T.unmask("_c", F.col("_m.formulas"))))
    lost = T.count_of(F.col("_c"), r"MATH[\s_]*M?ASK[\s_]*\d+") != F.size("_m.formulas")
    bad = (F.col("_c") == "") | lost | T.meta_output("text", "_c")
    r = r.withColumns({"fallback_used": ~skip & bad, "translated": F.when(F.col("_d").isNotNull(), F.col("_d")).when(skip | bad, T.text_of("text")).otherwise(F.col("_u"))})
    issues = F.when(skip, F.array().cast("array<string>")).otherwise(T.formula_issues("text", "translated"))
    r = r.withColumn("issues", issues)
    mode = F.when(skip, "kept").when(F.col("fallback_used"), "formula_safe_fallback").when(F.size("issues") > 0, "unsafe_kept").otherwise("direct")
    return r.withColumn("mode", mode).drop("_d", "_m", "_a", "_c", "_u")


def unfinished(rows: DataFrame, source: str = "text", output: str = "translated") -> DataFrame:
    """unfinished: whether an output is still (mostly) the source language, by likeness, words and signal."""
    s, o = T.squeeze(source), T.squeeze(output)
    r = rows.withColumns({"_s": s, "_o": o, "_like": latex.similarity(s, o)})
    sl, ol, oc = T.latin_words("_s"), T.latin_words("_o"), T.cjk_chars("_o")
    few = oc < F.greatest(F.lit(8), F.floor(sl / 3))
    run = F.regexp_like("_o", F.lit(r"(?:\b[a-zA-Z]{3,}\b[-\s():;,]*){12,}")) & (oc < F.greatest(F.lit(18), sl))
    still = (F.col("_o") == F.col("_s")) | ((F.col("_like") > 0.88) & few) | (few & (ol >= F.greatest(F.lit(8), F.floor(sl * 0.55)))) | run
    weak = (sl >= 8) & (T.signal_score("_s") >= 36) & (T.signal_score("_o") <= F.greatest(F.lit(10), F.floor(T.signal_score("_s") * 0.18))) & (F.length(T.without_formula_like("_o")) <= 12)
    return r.withColumn("unfinished", (F.col("_s") == "") | (F.col("_o") == "") | ((sl >= 4) & (still | weak))).drop("_s", "_o", "_like")


def rewriter(client: Client) -> Callable[[DataFrame], DataFrame]:
    """A rewriter for reflow.run_rounds: asks for a shorter or longer text and takes it only if it is one and its formulas are whole."""

    def rewrite(asked: DataFrame) -> DataFrame:
        r = asked.withColumn("_m", T.mask("text", "MATH_", tags=False))
        prompt = F.concat(F.lit("Rewrite to about "), F.col("target_chars").cast("string"), F.lit(" characters ("), "mode", F.lit("), keep every [MATH_n]:\n\n"), F.col("_m.text"))
        r = r.withColumn("_a", T.candidate_text(answers(client)(prompt))).withColumn("_u", T.unmask("_a", F.col("_m.formulas"), "MATH_"))
        n, k, t = F.length(T.compact("text")), F.length(T.compact("_u")), F.col("target_chars")
        shorter = (k <= F.greatest(t + 16, F.floor(n * 0.98))) | (k < n)
        longer = k >= F.greatest(n + 10, F.floor(n * 1.06))
        whole = (T.count_of(F.col("_a"), r"\[MATH_\d+\]") == F.size("_m.formulas")) & (F.size(T.formula_issues("text", "_u")) == 0)
        good = (F.col("_a") != "") & whole & F.when(F.col("mode") == "shorten", shorter).otherwise(longer)
        return r.select("doc_id", "idx", F.when(good, F.col("_u")).otherwise(F.col("text")).alias("new_text"))

    return rewrite


class Renderer(Protocol):
    def render(self, doc_id, blocks: list[dict]) -> bytes: ...


def render(blocks: DataFrame, renderer: Renderer, path: str) -> DataFrame:
    """One file for each document at path/doc_id.pdf, by a renderer that is passed in: doc_id, bytes.

    A document's blocks go to one call in order of (page, top, left). A file appears under
    its name only when it is whole.
    """

    def run(pdf):
        import os
        import pathlib

        import pandas as pd

        doc = pdf["doc_id"].iloc[0]
        data = renderer.render(doc, pdf.sort_values(["page_idx", "y0", "x0"], kind="stable").to_dict("records"))
        folder = pathlib.Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        part = folder / f".{doc}.{os.getpid()}"
        part.write_bytes(data)
        os.replace(part, folder / f"{doc}.pdf")
        return pd.DataFrame({"doc_id": [doc], "bytes": [len(data)]})

    kind = dict(blocks.dtypes)["doc_id"]
    return blocks.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, bytes long")
