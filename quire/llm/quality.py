"""Quality rules, line first: lines are judged one by one, then documents by what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick

#: Share of a document's characters that may be removed before it is rejected.
MAX_LOSS = 0.5
#: Characters from which the shape rules hold.
MIN_SHAPE = 20

NAVIGATION = r"^(home|about|about us|login|log in|sign in|sign up|menu|search|next|previous|back|share|read more|contact|contact us|help|faq|sitemap|site map)$"
LABEL = r"^[^ ]+( [^ ]+){0,2}$"
BOILERPLATE = r"(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|javascript is (disabled|required)|subscribe to our|lorem ipsum|click here|powered by|^(released|licensed) under |^this work is licensed under )"
SYMBOLS = r"[%$#&*]{3}|!!|[|]"


def _rules() -> dict[str, str]:
    """Each rule as an expression over a trimmed line `l`; the first that holds names the reason."""
    items = r"filter(transform(split(lower(l), '[|/>\\t]+'), x -> trim(BOTH ' ' FROM x)), x -> x <> '')"
    sentences = "split(lower(l), '[.!?;]+ +')"
    return {
        "empty": "l = ''",
        "navigation": f"exists({items}, x -> x rlike '{NAVIGATION}') and forall({items}, x -> x rlike '{LABEL}') and size(filter({items}, x -> x rlike '{NAVIGATION}')) * 2 >= size({items})",
        "boilerplate": f"lower(l) rlike '{BOILERPLATE}' and aggregate({sentences}, 0, (s, x) -> s + if(x rlike '{BOILERPLATE}', 1, -1) * length(x)) >= 0",
        "symbols": f"length(l) >= {MIN_SHAPE} and regexp_count(l, '{SYMBOLS}') * 5 > regexp_count(l, '[^ ]+')",
        "punctuation": f"length(l) >= {MIN_SHAPE} and regexp_count(l, '[^ ]+') > 8 and not l rlike '[.!?:;,]'",
    }


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_lines, n_kept, kept_chars, rejected, text (the kept lines).

    Lines end at a newline and are judged without spaces, tabs and carriage returns at
    their ends. A line goes if it is empty; if its items, cut at pipes, slashes, angles and
    tabs, are all of up to three words and half of them or more are navigation words; if
    half or more of it are sentences with boilerplate such as rights, licence or cookie
    notes; if it has a decorating symbol, pipe or shout for every fifth word; or if it is a
    run of more than 8 words without any punctuation. The last two hold from MIN_SHAPE
    characters on. A line that repeats an earlier line of its document goes too. `rejected`
    holds if more than max_loss of the characters in non-empty lines is removed, or no line
    is left; a loss of just max_loss doesn't reject.

    NULL and empty texts are rejected, with counts of 0 and text ''. A NULL doc_id is kept
    as such. Every input row gives one row, also if rows repeat; very long texts and lines
    take part whole, under the same rules. Other columns of docs, whatever their names,
    aren't read. An empty table gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.expr(r"transform(split(coalesce(text, ''), '\n'), x -> trim(BOTH ' \t\r' FROM x))").alias("lines"))
    bad = " or ".join(f"({r})" for k, r in _rules().items() if k != "empty")
    uniq = base.select("doc_id", F.expr("filter(lines, l -> l <> '')").alias("full")).withColumn("kept", F.expr(f"filter(array_distinct(full), l -> not ({bad}))"))
    out = uniq.select("doc_id", F.size("full").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"),
                      F.expr("aggregate(full, 0L, (a, l) -> a + length(l))").alias("had"), F.expr("aggregate(kept, 0L, (a, l) -> a + length(l))").alias("kept_chars"), F.array_join("kept", "\n").alias("text"))
    rejected = (F.col("n_kept") == 0) | ((F.col("had") - F.col("kept_chars")) > F.lit(float(max_loss)) * F.col("had"))
    return out.select("doc_id", "n_lines", "n_kept", "kept_chars", rejected.alias("rejected"), "text")


def clean_lines_sql(max_loss: float = MAX_LOSS) -> str:
    count = lambda p: f"len(regexp_extract_all(l, '{p}'))"
    items = r"list_filter(list_transform(string_split_regex(lower(l), '[|/>\t]+'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    nav = f"list_filter({items}, lambda x: regexp_matches(x, '{NAVIGATION}'))"
    return rf"""
with lines as (select rid, doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(13)) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select row_number() over () as rid, doc_id, text from documents)),
seen as (select *, row_number() over (partition by rid, l order by pos) as nth from lines),
judged as (select *, l <> '' as solid, l <> '' and nth = 1
  and not (len({nav}) > 0 and len(list_filter({items}, lambda x: not regexp_matches(x, '{LABEL}'))) = 0 and len({nav}) * 2 >= len({items}))
  and not (regexp_matches(lower(l), '{BOILERPLATE}') and list_sum(list_transform(string_split_regex(lower(l), '[.!?;]+ +'), lambda x: case when regexp_matches(x, '{BOILERPLATE}') then length(x) else -length(x) end)) >= 0)
  and not (length(l) >= {MIN_SHAPE} and {count(SYMBOLS)} * 5 > {count('[^ ]+')})
  and not (length(l) >= {MIN_SHAPE} and {count('[^ ]+')} > 8 and not regexp_matches(l, '[.!?:;,]')) as kept from seen),
per as (select rid, any_value(doc_id) as doc_id, count(*) filter (solid) as n_lines, count(*) filter (kept) as n_kept, coalesce(sum(length(l)) filter (solid), 0) as had,
  coalesce(sum(length(l)) filter (kept), 0) as kept_chars, coalesce(string_agg(l, chr(10) order by pos) filter (kept), '') as text from judged group by rid)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_kept as bigint) as n_kept, cast(kept_chars as bigint) as kept_chars,
  n_kept = 0 or had - kept_chars > cast({max_loss} as double) * had as rejected, text from per"""
