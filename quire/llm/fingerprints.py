"""Document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, pick

#: Lanes of 32 bits; a document's vector is their sum modulo 2**32, 1024 bits in all.
LANES = 32
MODULUS = 2**32
SALTS = [f"{k}:".encode() for k in range(LANES // 8)]
TEXTS = 512


def paragraph_vector(text: Column) -> Column:
    """LANES numbers below 2**32 from SHA-256 of the paragraph under LANES / 8 salts."""
    digests = F.concat(*(F.sha2(F.concat(F.lit(f"{k}:"), text), 256) for k in range(LANES // 8)))
    return F.array(*(F.conv(F.substring(digests, 8 * k + 1, 8), 16, 10).cast("long") for k in range(LANES)))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets: insertion."""
    return F.zip_with(a, b, lambda x, y: (x + y) % MODULUS)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a multiset after deletion of b's members."""
    return F.zip_with(a, b, lambda x, y: (x - y + MODULUS) % MODULUS)


def _prints(batches):
    """For Arrow batches (doc_id, text): doc_id, n_paragraphs, fingerprint; the sums of a batch are taken at once."""
    for whole in batches:
        for k in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(k, TEXTS)
            lines = pc.split_pattern(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), "\n")
            owner = pc.list_parent_indices(lines).to_numpy()
            trimmed = pc.utf8_trim(lines.flatten(), characters=" \t\r").cast(pa.large_binary())
            solid = pc.greater(pc.binary_length(trimmed), 0)
            owner, paragraphs = owner[solid.to_numpy(zero_copy_only=False)], trimmed.filter(solid).to_pylist()
            digests = b"".join([sha256(salt + p).digest() for p in paragraphs for salt in SALTS])
            vectors = np.frombuffer(digests, ">u4").reshape(-1, LANES).astype(np.uint64)
            n = np.bincount(owner, minlength=batch.num_rows)
            sums = np.zeros((batch.num_rows, LANES), np.uint64)
            has = np.flatnonzero(n)
            if len(has):
                sums[has] = np.add.reduceat(vectors, (np.cumsum(n) - n)[has], axis=0)
            texts = [row.tobytes().hex() for row in (sums % np.uint64(MODULUS)).astype(">u4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(texts, pa.string())], names=["doc_id", "n_paragraphs", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_paragraphs, fingerprint (256 hex digits), first_id.

    Paragraphs are lines, trimmed of spaces, tabs and carriage returns; blank ones don't
    count. Equal fingerprints mean equal multisets of paragraphs, in whatever order;
    first_id is the least doc_id that has the fingerprint (NULL if all are NULL), so equal
    ids tie without harm. A NULL, empty or blank text has no paragraphs and the zero
    fingerprint. Very long texts take part whole. Every input row gives one row, also if
    rows repeat. Other columns of docs, whatever their names, aren't read. An empty table
    gives an empty result.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    prints = base.mapInArrow(_prints, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, fingerprint string")
    return first_of(materialise(prints, "prints"))


def first_of(prints: DataFrame) -> DataFrame:
    """Adds first_id. Only fingerprints that several rows have are joined back; however many have one, they meet as partial minima."""
    shared = prints.groupBy(F.col("fingerprint").alias("_print")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    joined = prints.join(shared, F.col("fingerprint") == F.col("_print"), "left")
    return joined.select("doc_id", "n_paragraphs", "fingerprint", F.when(F.col("_rows").isNotNull(), F.col("_first")).otherwise(F.col("doc_id")).alias("first_id"))


def fingerprints_sql() -> str:
    digests = " || ".join(f"sha256('{k}:' || p)" for k in range(LANES // 8))
    lanes = ", ".join(f"coalesce(sum(cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)), 0) % {MODULUS} as v{k}" for k in range(LANES))
    text = " || ".join(f"lpad(lower(to_hex(cast(v{k} as bigint))), 8, '0')" for k in range(LANES))
    return f"""
with ps as (select rid, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) as p
  from (select row_number() over () as rid, text from documents)),
hs as (select rid, {digests} as h from ps),
vs as (select d.rid, any_value(d.doc_id) as doc_id, count(h) as n, {lanes} from (select row_number() over () as rid, doc_id from documents) d left join hs using (rid) group by d.rid),
fs as (select doc_id, cast(n as bigint) as n_paragraphs, {text} as fingerprint from vs)
select *, min(doc_id) over (partition by fingerprint) as first_id from fs"""
