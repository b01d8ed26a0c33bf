"""WARC archives: writing, reading, and resolving revisits by payload digest."""

from __future__ import annotations

import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, read

#: Payloads of fewer bytes are always stored in full.
MIN_BYTES = 1000
#: Date of every record: these tables have none, and reruns must agree.
DATE = "2024-01-01T00:00:00Z"
#: Parts that a hot digest's rows are dealt to in the join that finds its original.
SALTS = 16
#: Originals that are sent to every task instead of shuffling the records to them; about 10 MB.
MOST_SENT = 50_000
#: A gzip member of nothing, as Latin-1 text: it cannot be in a member's UTF-8 literals, and by chance nowhere.
EMPTY = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest); a null payload is empty, a null url an empty URI."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))


def originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(payload_digest, first_id, first_url) for digests of several records: the record with the largest page_id.

    Only headers are shuffled, combined by digest before they are, so a hot digest costs a row per task.
    """
    seen = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    return seen.filter((F.col("n") > 1) & F.col("top.page_id").isNotNull()).select("payload_digest", F.col("top.page_id").alias("first_id"), F.col("top.url").alias("first_url"))


def resolve(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``records`` with record_type and refers_to (and refers_url): copies of a payload revisit its original.

    Headers alone find the originals. Where there are at most MOST_SENT of them they are sent to the records, which then
    stay where they are; else records are dealt to a salt by their id and meet the originals repeated for each of SALTS
    salts, so that no digest meets in one task.
    """
    first = materialise(originals(records, min_bytes), "originals").withColumnRenamed("payload_digest", "digest_")
    same = F.col("payload_digest") == F.col("digest_")
    if first.limit(MOST_SENT + 1).count() <= MOST_SENT:
        joined = records.join(F.broadcast(first), same, "left")
    else:
        first = first.withColumn("salt_", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = records.join(first, same & (F.pmod(F.xxhash64("page_id"), F.lit(SALTS)) == F.col("salt_")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= min_bytes)
    return joined.select(*records.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _gzip(data: bytes) -> bytes:
    """A gzip member with no time in it, so that reruns agree."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Write resolved records as WARC/1.1 files under ``path``, one per task, a gzip member per record, by Spark's committed text output.

    Revisits hold headers only. The line end of the text output is an empty gzip member, so a file is members throughout
    and readers can seek to any of them; a file grows with what its task read (spark.sql.files.maxPartitionBytes).
    """
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.col("url"), r"[\r\n\x00-\x20]", "%20")
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("refers_to"))),
                line("WARC-Refers-To-Target-URI", F.regexp_replace(F.col("refers_url"), r"[\r\n\x00-\x20]", "%20")),
                line("WARC-Refers-To-Date", F.lit(DATE)),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ]

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_gzip(r.as_py()) for r in batch.column(0)], pa.binary())], ["member"])

    members = records.select(F.concat(*head, F.lit("\r\n\r\n")).cast("binary").alias("record")).mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY).text(path)


def parse(stream, chunk: int = 1 << 20):
    """Records of an archive as (headers, length of the HTTP head, block length, digest of the payload, payload bytes)."""
    import hashlib

    held = b""

    def need(n: int) -> bytes:
        nonlocal held
        parts, have = [held], len(held)
        while have < n and (more := stream.read(max(chunk, n - have))):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        out, held = held[:n], held[n:]
        return out

    while True:
        head = b""
        while b"\r\n\r\n" not in head:
            more = need(2048)
            if not more:
                break
            head += more
        if not head.strip():
            return
        raw, _, rest = head.partition(b"\r\n\r\n")
        held = rest + held
        lines = raw.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = need(int(headers["Content-Length"]))
        if need(4) != b"\r\n\r\n" or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        payload = block.partition(b"\r\n\r\n")[2]
        yield headers, len(payload), hashlib.sha1(payload).hexdigest()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, record_type, refers_id, header_digest, payload_bytes, payload_digest) of every record under ``path``.

    Bytes and digest are recomputed from what the archive holds: of a revisit, nothing. Files are split between members
    and stream through the tasks member by member.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for member in batch.column(0):
                for h, n, digest in parse(io.BytesIO(zlib.decompress(member.as_py(), 31))):
                    rows.append((int(h["X-Page-ID"]) if "X-Page-ID" in h else None, h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), h["WARC-Payload-Digest"].removeprefix("sha1:"), n, digest))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "record_id", "record_type", "refers_id", "header_digest", "payload_bytes", "payload_digest"])

    members = spark.read.option("encoding", "ISO-8859-1").option("lineSep", EMPTY).text(path)
    return members.select(F.col("value").cast("binary")).mapInArrow(work, "page_id long, record_id string, record_type string, refers_id string, header_digest string, payload_bytes long, payload_digest string")


def resolved_headers(records: DataFrame) -> DataFrame:
    """Every archived record with its full payload's size and digest: revisits get them from the response they refer to.

    The referred responses are repeated for each salt, as in ``resolve``.
    """
    revisits = records.filter("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    wanted = revisits.select(F.col("refers_id").alias("wanted_")).distinct()
    found = records.filter("record_type = 'response'").join(wanted, F.col("record_id") == F.col("wanted_"), "left_semi")
    found = found.groupBy("record_id").agg(F.first("page_id").alias("to_"), F.first("payload_bytes").alias("bytes_"), F.first("payload_digest").alias("digest_"))
    found = found.select("to_", "bytes_", "digest_", F.col("record_id").alias("id_"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt_"))
    got = revisits.join(found, (F.col("refers_id") == F.col("id_")) & (F.col("salt") == F.col("salt_")), "left")
    got = got.select("page_id", F.col("bytes_").alias("payload_bytes"), F.col("digest_").alias("payload_digest"), "record_type", F.col("to_").alias("refers_to"))
    kept = records.filter("record_type != 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return kept.unionByName(got)


def deduplicate(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write every page to deduplicated archives under ``path``.

    Of equal payloads of ``min_bytes`` or more the record with the largest id is a response and the others revisit it;
    smaller ones are all responses. Null payloads are empty; rows without an id revisit an original with one; rows that
    repeat the original's id are responses too; an empty table writes no record. Ids are integers.
    """
    write_archives(resolve(payload_digests(pages, id_col, url_col, payload_col), min_bytes), path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the deduplicated archives written to the shared folder."""
    path = fresh_path(spark, "warc")
    deduplicate(read(spark, sf_dir, "pages"), path)
    return resolved_headers(materialise(read_archives(spark, path), "warc-headers"))


#: Digest, size and type of each page's record.
OP7_SQL = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(encode(h)) as payload_digest from p
), m as (
  select *, max(page_id) over (partition by payload_digest) as top from d
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from m
"""
