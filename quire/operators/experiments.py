"""Experiment cases: policies, overrides of a base configuration, and summaries of runs."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWITCHES = ("rewriting", "line_spacing", "char_spacing", "font_size")


def cases(spark: SparkSession) -> DataFrame:
    """case_no, name and one column for each switch: everything on, and three cases with one switch off."""
    off = (None, "rewriting", "char_spacing", "font_size")
    rows = [(k, f"no_{x}" if x else "all_enabled", *(s != x for s in SWITCHES)) for k, x in enumerate(off)]
    return spark.createDataFrame(rows, "case_no int, name string, " + ", ".join(f"allow_{s} boolean" for s in SWITCHES))


def with_overrides(base: dict, case: dict, sections: tuple[str, ...] = ("translation", "reflow")) -> dict:
    """The base configuration with a case's values laid over the given sections."""
    out = copy.deepcopy(base)
    for name in sections:
        out[name] = {**out.get(name, {}), **case.get(name, {})}
    return out


def case_summary(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """name, total, succeeded for each case that has runs (case_no, success)."""
    return runs.join(cases, "case_no").groupBy("name").agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"))
