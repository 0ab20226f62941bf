"""Packing by power-of-two decomposition: pieces of binary lengths, bucketed by length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD_COUNT_SQL, hash_key, hash_key_sql, materialise, pick, prefix_sums, word_count

MAX_LENGTH = 4096
BATCH_TOKENS = 65536
SEED = 5


def _bits(max_length: int) -> int:
    bits = max_length.bit_length() - 1
    if max_length < 1 or 1 << bits != max_length:
        raise ValueError("max_length must be a power of two")
    return bits


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each training sequence, all of it from one document.

    Columns: doc_id, copy (tells rows of the same doc_id and text apart, from 0), start
    (first token's position), length, slot (place within the bucket of that length, in
    hash-random order from 0), batch (slot div sequences per batch of batch_tokens), text
    (the tokens joined by a space). Tokens are words. A document of n tokens gives n div
    max_length pieces of max_length, then one piece for each binary digit of the rest,
    longest first: no token is lost, padded or shared.

    A NULL or empty text gives no row. A NULL doc_id is kept as such. Rows that repeat,
    as documents do that a mixture takes twice, are packed as often, each by itself.
    """
    bits = _bits(max_length)
    rows = pick(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("row_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    sizes = materialise(rows.select("row_key", word_count().alias("n")).where("n > 0").groupBy("row_key", "n").agg(F.count("*").alias("copies")), "sizes")
    at = sizes.select("row_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.expr(f"n div {max_length}").alias("full"), F.expr(f"n % {max_length}").alias("rest"))
    longest = F.expr(f"if(full > 0, transform(sequence(1L, full), i -> struct((i - 1) * {max_length} as start, {max_length}L as length)), array())")
    digits = F.expr(f"transform(filter(sequence({bits}, 0, -1), k -> shiftright(rest, k) % 2 = 1), k -> struct(full * {max_length} + shiftleft(shiftright(rest, k + 1), k + 1) as start, shiftleft(1L, k) as length))")
    pieces = at.select("row_key", "copy", F.inline(F.concat(longest, digits)))
    pieces = pieces.withColumn("k", hash_key(F.lit(str(seed)), "row_key", "copy", "start")).withColumn("one", F.lit(1).cast("long"))
    numbered = prefix_sums(pieces, "length", "k", "one", ["row_key", "copy", "start"], "slot")
    plan = numbered.groupBy("row_key").agg(F.collect_list(F.struct("copy", "start", "length", "slot")).alias("plan"))
    copy = F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(0))) - 1
    words = F.expr(r"filter(split(text, '[ \\t\\n\\r\\f]+'), w -> w <> '')")
    mine = rows.withColumn("copy", copy.cast("long")).join(plan, "row_key").select("doc_id", words.alias("words"), F.expr("filter(plan, p -> p.copy = copy)").alias("plan")).select("doc_id", "words", F.inline("plan"))
    per_batch = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(batch_tokens)}L div length"))
    return mine.select("doc_id", "copy", "start", "length", "slot", F.floor(F.col("slot") / per_batch).cast("long").alias("batch"), F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("text"))


def pack_sql(max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS, seed: int = SEED) -> str:
    bits = _bits(max_length)
    return rf"""
with sized as (select doc_id, md5(coalesce(cast(doc_id as varchar), '') || ':' || text) as row_key, row_number() over (partition by doc_id, text) - 1 as copy,
  regexp_extract_all(text, '[^ \t\n\r\f]+') as words, {WORD_COUNT_SQL} as n from documents where text is not null),
pieces as (
  select doc_id, row_key, copy, words, unnest(range(0, n // {max_length})) * {max_length} as start, {max_length} as length from sized
  union all
  select doc_id, row_key, copy, words, (n // {max_length}) * {max_length} + ((n % {max_length}) >> (k + 1) << (k + 1)) as start, 1 << k as length
  from (select *, unnest(range(0, {bits})) as k from sized) where ((n % {max_length}) >> k) % 2 = 1),
numbered as (select *, row_number() over (partition by length order by {hash_key_sql(f"'{seed}'", 'row_key', 'copy', 'start')}, row_key, copy, start) - 1 as slot from pieces)
select doc_id, cast(copy as bigint) as copy, cast(start as bigint) as start, cast(length as bigint) as length, cast(slot as bigint) as slot,
  cast(slot // greatest(1, {batch_tokens} // length) as bigint) as batch,
  array_to_string(words[cast(start + 1 as bigint):cast(start + length as bigint)], ' ') as text from numbered"""
