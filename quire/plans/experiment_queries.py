"""Queries over experiment cases: the policies and what the runs under them amount to."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import experiments
from quire.plans.catalog import register
from quire.sources.tables import TRANSITIONS_SQL, transitions_in


def _runs(spark, d):
    """A run for each block state request under the case that its number falls to."""
    t = transitions_in(spark, d)
    return t.select((F.col("event_id") % 4).cast("int").alias("case_no"), F.col("lid").alias("doc_id"), (F.col("status") != "UNDERFLOW").alias("success"))


register("a22_case_summary", lambda s, d: experiments.case_summary(_runs(s, d), experiments.cases(s)), "with " + TRANSITIONS_SQL + """,
  c(case_no, name) as (values (0, 'all_enabled'), (1, 'no_rewriting'), (2, 'no_char_spacing'), (3, 'no_font_size'))
  select name, count(*) as total, count(*) filter (status <> 'UNDERFLOW') as succeeded from transitions_in join c on case_no = event_id % 4 group by name""")
register("j11_cases", lambda s, d: experiments.cases(s).drop("case_no"), """select * from (values ('all_enabled', true, true, true, true), ('no_rewriting', false, true, true, true), ('no_char_spacing', true, true, false, true), ('no_font_size', true, true, true, false))
  as t(name, allow_rewriting, allow_line_spacing, allow_char_spacing, allow_font_size)""")
