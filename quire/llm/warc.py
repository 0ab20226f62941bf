"""WARC archives: reading, revisit resolution by payload digest, and writing without duplicates."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, pick

VERSION = "WARC/1.1"
DATE, AGAIN = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, type string, uri string, date string, digest string, refers_to string, payload binary"
COLUMNS = ["record_id", "type", "uri", "date", "digest", "refers_to", "payload"]


def captures(pages: DataFrame, date: str = DATE, again: str = AGAIN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as the records of two crawls (columns of SCHEMA, payload as text). A NULL page is an empty payload.

    The first crawl has a response for each page. The second one, at `again`, found all
    unchanged: of the remainder of page_id by four, 0 gives a revisit with its digest, 1 a
    revisit that only refers to the first record, 2 the whole response once more, and 3
    (like a NULL page_id) no record.
    """
    base = pick(pages, page_id=id_col, uri=url_col, payload=html_col).withColumn("payload", F.coalesce("payload", F.lit("")))
    base = base.withColumn("id", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).withColumn("sha", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    nothing = F.lit(None).cast("string")
    page, kind = F.concat(F.lit("page:"), "id"), F.pmod("page_id", F.lit(4))
    first = F.struct(page.alias("record_id"), F.lit("response").alias("type"), "uri", F.lit(date).alias("date"), F.col("sha").alias("digest"), nothing.alias("refers_to"), "payload")
    second = F.struct(F.concat(F.lit("again:"), "id").alias("record_id"), F.when(kind == 2, "response").otherwise("revisit").alias("type"), "uri", F.lit(again).alias("date"), F.when(kind != 1, F.col("sha")).alias("digest"), F.when(kind < 2, page).alias("refers_to"), F.when(kind == 2, F.col("payload")).alias("payload"))
    return base.select(F.explode(F.when(kind < 3, F.array(first, second)).otherwise(F.array(first))).alias("r")).select("r.*")


def resolve(records: DataFrame, content_type: str = "application/octet-stream") -> DataFrame:
    """The records of a deduplicated archive: record_id, type, uri, date, digest, refers_to, n_bytes, header, payload.

    Only headers are shuffled by digest; payloads travel once, to the headers of those that
    stay. For each digest the original is the first of its
    response records that has a payload, in order of (date, record_id, uri); it stays a
    response. Every other response of that digest and every revisit that has it becomes a
    revisit without payload that refers to the original. A revisit without a digest takes
    the digest of the record that it refers to. Without any original a revisit stays as it
    is, with refers_to kept, and a response keeps its own payload. Headers are written
    anew: lengths, digests and references are those of the new archive.

    A response without a digest gets one from its payload. NULL payloads of responses are
    empty ones, and originals only where no response of the digest has its payload. Records
    of other types pass through. Of response rows that are equal in (date, record_id, uri,
    digest) one is the original; exact repeats of it are dropped. Payloads are text or
    binary, of any length, and stay what they are. Other columns of records, whatever their
    names, aren't read. An empty table gives an empty result.
    """
    kind = dict(records.dtypes)["payload"]
    empty, response = F.lit("").cast(kind), F.col("type").eqNullSafe("response")
    digest = F.when(response, F.coalesce("digest", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("payload", empty), 256)))).otherwise(F.col("digest"))
    base = records.select("record_id", "type", "uri", "date", digest.alias("digest"), "refers_to", F.when(response, F.coalesce("payload", empty)).otherwise(F.col("payload")).alias("payload"), F.col("payload").isNotNull().alias("present"))
    heads = materialise(base.groupBy("record_id", "type", "uri", "date", "digest", "refers_to").agg(F.max("present").alias("present")), "heads")
    lone = heads.where("type = 'revisit' and digest is null and refers_to is not null")
    known = heads.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("digest").alias("found"))
    filled = heads.where("not (type <=> 'revisit' and digest is null and refers_to is not null)").unionByName(lone.join(known, "refers_to", "left").withColumn("digest", F.col("found")).select(*heads.columns))
    order = [F.col("date").asc_nulls_last(), F.col("record_id").asc_nulls_last(), F.col("uri").asc_nulls_last()]
    first = Window.partitionBy("digest").orderBy((F.col("type") == "response").cast("int").desc(), F.col("present").desc(), *order)
    marked = filled.where("type in ('response', 'revisit') and digest is not null").select("*", F.row_number().over(first).alias("nth"), F.first(F.when(F.col("type") == "response", F.struct("record_id", "uri", "date"))).over(first).alias("original"))
    marked = materialise(marked, "marked")
    name = F.unhex(F.sha2(F.to_json(F.struct("record_id", "uri", "date", "digest", "present")), 256)).alias("k")
    kept = marked.where("type = 'response' and nth = 1").select(name)
    found = base.where("type = 'response'").withColumn("k", name).join(kept, "k")
    originals = found.withColumn("copy", F.row_number().over(Window.partitionBy("k").orderBy("refers_to"))).where("copy = 1").select(*COLUMNS)
    bare = F.lit(None).cast(kind)
    revisits = marked.where("not (type = 'response' and nth = 1)").select("record_id", F.lit("revisit").alias("type"), "uri", "date", "digest", F.coalesce("original.record_id", "refers_to").alias("refers_to"), bare.alias("payload"), F.col("original.uri").alias("to_uri"), F.col("original.date").alias("to_date"))
    rest = filled.where("type = 'revisit' and digest is null").withColumn("payload", bare).drop("present").unionByName(base.where("type is null or type not in ('response', 'revisit')").drop("present"))
    nothing = F.lit(None).cast("string")
    rows = originals.withColumn("refers_to", nothing).unionByName(rest).withColumns({"to_uri": nothing, "to_date": nothing}).unionByName(revisits)
    n = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    one = lambda c: F.regexp_replace(F.col(c), r"[\r\n]+", " ")
    parts = [
        line("WARC-Type", one("type")), line("WARC-Record-ID", F.concat(F.lit("<urn:quire:"), one("record_id"), F.lit(">"))), line("WARC-Target-URI", one("uri")),
        line("WARC-Date", one("date")), line("WARC-Payload-Digest", one("digest")), line("WARC-Profile", F.when(F.col("type") == "revisit", F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:quire:"), one("refers_to"), F.lit(">"))), line("WARC-Refers-To-Target-URI", one("to_uri")), line("WARC-Refers-To-Date", one("to_date")),
        line("Content-Type", F.when(response, F.lit(content_type))), line("Content-Length", n.cast("string")),
    ]
    header = F.concat(F.lit(f"{VERSION}\r\n"), *parts, F.lit("\r\n"))
    return rows.select("record_id", "type", "uri", "date", "digest", "refers_to", n.alias("n_bytes"), header.alias("header"), "payload")


def resolve_pages_sql(date: str = DATE, again: str = AGAIN, content_type: str = "text/html") -> str:
    """resolve(captures(pages), content_type) in DuckDB."""
    nl = "chr(13) || chr(10)"
    one = lambda c: f"regexp_replace({c}, '[\\r\\n]+', ' ', 'g')"
    return f"""
with p as (select distinct page_id, coalesce(cast(page_id as varchar), 'none') as id, url as uri, 'sha256:' || sha256(coalesce(html, '')) as sha, coalesce(html, '') as payload from pages),
recs as (
  select 'page:' || id as record_id, 'response' as type, uri, '{date}' as date, sha as digest, null as refers_to, payload from p
  union all
  select 'again:' || id, case when page_id % 4 = 2 then 'response' else 'revisit' end, uri, '{again}', case when page_id % 4 <> 1 then sha end,
    case when page_id % 4 < 2 then 'page:' || id end, case when page_id % 4 = 2 then payload end from p where page_id % 4 < 3),
firsts as (select record_id, min(digest) as found from recs where type = 'response' group by record_id),
c as (select r.record_id, r.type, r.uri, r.date, coalesce(r.digest, f.found) as digest, r.refers_to, r.payload from recs r left join firsts f on r.digest is null and f.record_id = r.refers_to),
m as (select *, row_number() over w as nth, first(record_id) over w as o_id, first(uri) over w as o_uri, first(date) over w as o_date
  from c window w as (partition by digest order by case when type = 'response' then 0 else 1 end, date, record_id, uri nulls last)),
r as (select record_id, case when nth = 1 then 'response' else 'revisit' end as type, uri, date, digest, case when nth > 1 then o_id end as refers_to,
  case when nth = 1 then octet_length(encode(payload)) else 0 end as n_bytes, case when nth = 1 then payload end as payload, o_uri, o_date from m)
select record_id, type, uri, date, digest, refers_to, cast(n_bytes as bigint) as n_bytes,
  '{VERSION}' || {nl} || 'WARC-Type: ' || type || {nl} || 'WARC-Record-ID: <urn:quire:' || record_id || '>' || {nl} || coalesce('WARC-Target-URI: ' || {one('uri')} || {nl}, '') || 'WARC-Date: ' || date || {nl} || 'WARC-Payload-Digest: ' || digest || {nl}
  || case when type = 'revisit' then 'WARC-Profile: {PROFILE}' || {nl} || 'WARC-Refers-To: <urn:quire:' || refers_to || '>' || {nl} || coalesce('WARC-Refers-To-Target-URI: ' || {one('o_uri')} || {nl}, '') || 'WARC-Refers-To-Date: ' || o_date || {nl}
     else 'Content-Type: {content_type}' || {nl} end
  || 'Content-Length: ' || cast(n_bytes as varchar) || {nl} || {nl} as header, payload from r"""


def write_archive(resolved: DataFrame, path: str, files: int) -> DataFrame:
    """Writes gzip WARC files (one member for each record) to `path`, a folder that all executors share.

    Returns (file, records, bytes). A file appears under its name only when it is whole,
    so a task that is lost and run again leaves no partial file.
    """

    def write(batches):
        import os
        import pathlib

        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        part = pathlib.Path(path, f".{name}.{TaskContext.get().taskAttemptId()}")
        part.parent.mkdir(parents=True, exist_ok=True)
        n = 0
        with part.open("wb") as out:
            for pdf in batches:
                for header, payload in zip(pdf["header"], pdf["payload"]):
                    body = payload.encode() if isinstance(payload, str) else bytes(payload or b"")
                    out.write(gzip.compress(header.encode() + body + b"\r\n\r\n", mtime=0))
                    n += 1
        size = part.stat().st_size
        os.replace(part, pathlib.Path(path, name))
        import pandas as pd

        yield pd.DataFrame({"file": [name], "records": [n], "bytes": [size]})

    return resolved.repartition(files, "digest").mapInPandas(write, "file string, records long, bytes long")


def parse(data: bytes) -> list[dict]:
    """The records of one archive file, gzip or not, as dicts of SCHEMA; raises ValueError on a broken one."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head[1:]))
        size = int(fields["content-length"])
        body = data[end + 4 : end + 4 + size]
        if len(body) < size:
            raise ValueError("a record is cut short")
        name = lambda k: re.sub(r"^<(urn:quire:)?|>$", "", fields[k]) if k in fields else None
        kind = fields.get("warc-type")
        out.append({"record_id": name("warc-record-id"), "type": kind, "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": fields.get("warc-payload-digest"), "refers_to": name("warc-refers-to"), "payload": None if kind == "revisit" else body})
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2
    return out


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records (SCHEMA) of all *.warc and *.warc.gz files under path; a task holds one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", True).load(path).select("content")

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(parse(content), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(read, SCHEMA)
