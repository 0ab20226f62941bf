"""Mixing sources to target weights: hash-random keys, prefix sums of tokens, a cut at each budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD_COUNT_SQL, hash_key, hash_key_sql, materialise, pick, prefix_sums, word_count

#: Shares of the sources in the production mixture; others have DEFAULT_WEIGHT.
WEIGHTS = {"src0": 6}
DEFAULT_WEIGHT = 1
SEED = 17


def weight_of(weights: dict[str, int], default: int):
    w = F.lit(default)
    for name, value in sorted(weights.items()):
        w = F.when(F.col("source") == name, F.lit(value)).otherwise(w)
    return w.cast("long")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, total_tokens: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each document and epoch in which it is taken.

    Columns: doc_id, source, epoch (from 0), n_tokens, take_tokens. Tokens are words. The
    budget of a source is total * weight div (sum of weights of the sources present);
    total is the corpus's own count unless given. Within a source documents follow a key
    hashed from the seed and doc_id; whole epochs are taken while they fit and the last
    one is cut where the budget is met, so that take_tokens of a source adds up to its
    budget exactly; only the document at the cut has take_tokens below n_tokens.

    NULL is a source of its own. Rows that share doc_id and source count as one document
    of their summed length; equal keys are told apart by doc_id. Documents without words
    (NULL, empty or blank texts), sources of weight 0 and sources without any word give no
    row; the budget of the latter stays unused. Very long texts count whole. Other columns
    of docs, whatever their names, aren't read. An empty table gives an empty result.
    """
    sizes = pick(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count().alias("n_tokens"))
    sizes = materialise(sizes.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("has")).withColumn("w", weight_of(weights or {}, default_weight))
    whole = per_source.agg(F.sum("has").alias("total"), F.sum("w").alias("all_w"))
    total = F.col("total") if total_tokens is None else F.lit(total_tokens).cast("long")
    budget = F.when(F.col("all_w") > 0, F.expr("bigint(total) * w div all_w") if total_tokens is None else F.expr(f"{int(total_tokens)}L * w div all_w")).otherwise(F.lit(0))
    plan = per_source.crossJoin(whole).withColumn("budget", budget).where((F.col("has") > 0) & (F.col("budget") > 0)).select(F.col("source").alias("p_source"), F.expr("budget div has").alias("epochs"), F.expr("budget % has").alias("rest"))
    placed = prefix_sums(sizes.where("n_tokens > 0").withColumn("k", hash_key(F.lit(str(seed)), "doc_id")), "source", "k", "n_tokens", ["doc_id"])
    taken = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    times = F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), times - 1))
    take = F.when(F.col("epoch") < F.col("epochs"), F.col("n_tokens")).otherwise(F.least("n_tokens", F.col("rest") - F.col("before")))
    return taken.where(times > 0).withColumn("epoch", epoch).select("doc_id", "source", "epoch", "n_tokens", take.alias("take_tokens"))


def mix_sql(weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, seed: int = SEED) -> str:
    cases = " ".join(f"when source = '{k}' then {v}" for k, v in sorted((weights or {}).items()))
    w = f"case {cases} else {default_weight} end" if cases else str(default_weight)
    return f"""
with sizes as (select doc_id, source, cast(sum({WORD_COUNT_SQL}) as bigint) as n_tokens from documents group by all),
per_source as (select source, cast(sum(n_tokens) as bigint) as has, {w} as w from sizes group by source),
plan as (select source, has, cast((select sum(has) from per_source) as bigint) * w // cast((select sum(w) from per_source) as bigint) as budget from per_source),
placed as (select *, cast(coalesce(sum(n_tokens) over (partition by source order by {hash_key_sql(f"'{seed}'", 'doc_id')}, doc_id
  rows between unbounded preceding and 1 preceding), 0) as bigint) as before_t from sizes where n_tokens > 0),
taken as (select d.*, budget // has as epochs, budget % has as rest from placed d join plan p on d.source is not distinct from p.source where has > 0 and budget > 0),
rows_ as (select *, unnest(range(0, cast(epochs + case when before_t < rest then 1 else 0 end as bigint))) as epoch from taken)
select doc_id, source, cast(epoch as bigint) as epoch, n_tokens,
  cast(case when epoch < epochs then n_tokens else least(n_tokens, rest - before_t) end as bigint) as take_tokens from rows_"""


def cut_words(docs: DataFrame, take: str) -> DataFrame:
    """docs with `text` cut after its first `take` words, and n_chars to match."""

    def cut(batches):
        import re

        for pdf in batches:
            for k, (text, n) in enumerate(zip(pdf["text"], pdf[take])):
                at = 0
                for at, m in enumerate(re.finditer(r"[^ \t\n\r\f]+", text or ""), 1):
                    if at == n:
                        text = text[: m.end()]
                        break
                pdf.iat[k, pdf.columns.get_loc("text")] = text
            pdf["n_chars"] = pdf["text"].str.len().astype("Int64")
            yield pdf

    return docs.mapInPandas(cut, docs.schema)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as it is taken; the one at a cut is shortened to its share.

    Columns: those of documents. Rows that share doc_id and source are one document to
    mix(); where its last epoch is cut, they are taken in order of (text, lang, n_chars)
    until its share is met, so that the words of a source add up to its budget exactly,
    repeats of a row included. NULL texts have no words: such rows, like blank ones, come
    only with others of their document. Very long texts are cut by words like all others.
    Other columns, whatever their names, aren't read. An empty table gives an empty one.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    chosen = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(
        F.sum((F.col("take_tokens") == F.col("n_tokens")).cast("int")).alias("_whole"), F.min(F.when(F.col("take_tokens") < F.col("n_tokens"), F.col("take_tokens"))).alias("_cut"))
    both = docs.select(*columns).join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    whole = both.where("_whole > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_whole").cast("int"))).alias("_k")).drop("_k")
    earlier = Window.partitionBy("doc_id", "source").orderBy("text", "lang", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    cut = both.where("_cut is not null").withColumn("_words", word_count())
    cut = cut.withColumn("_take", F.least("_words", F.col("_cut") - F.coalesce(F.sum("_words").over(earlier), F.lit(0)))).where("_take > 0")
    return whole.unionByName(cut_words(cut.select(*columns, F.col("_take").cast("long")), "_take").drop("_take"))
