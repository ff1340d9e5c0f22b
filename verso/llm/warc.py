"""WARC archives: writing through Spark's text writer, reading with segment reassembly.

A record is ASCII headers and a UTF-8 block, so the text writer with the
record separator as line separator writes true archive files on any file
system that Spark can reach, committed by its usual protocol. Responses carry
their payload in chunked transfer framing; long blocks are cut into a first
segment and continuation records.

Reading parses the files by Content-Length, groups continuation records by
origin identifier, orders them by segment number, verifies the total length
and the block digest, and decodes the chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.llm.common import even_join, shared_dir, stored, table, with_few

CRLF = "\r\n"
#: Payloads below this many bytes are not worth a revisit record.
REVISIT_BYTES = 100

RECORD = "id string, type string, uri string, origin string, segment int, total long, refers string, digest string, block binary"


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def deduplicated(pages: DataFrame, key: str, payload: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """``key, uri, payload, digest, size`` with ``refers_to``: the smallest key among equal payloads of at
    least ``least`` bytes, null for that record itself and for smaller ones.

    The smallest key of a digest is a partial aggregate; only payloads that
    occur more than once are shuffled to find it. ``uid`` tells rows apart whose
    keys are equal, and ``refers_uid`` which of them a repeat refers to.
    """
    row = pages.select(F.col(key).alias("key"), F.col("url").alias("uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("uid"))
    row = row.withColumns({"size": _bytes(F.col("payload")), "digest": F.sha2(F.col("payload"), 256)})
    first = row.filter((F.col("size") >= least) & F.col("key").isNotNull()).groupBy("digest").agg(F.min(F.struct("key", "uid")).alias("first"), F.max("key").alias("last"))
    first = stored(first.filter("first.key < last").select("digest", F.col("first.key").alias("refers_to"), F.col("first.uid").alias("refers_uid")), "warc-repeats")
    out = with_few(row, first, "digest", ("uid",))
    repeats = F.col("refers_to") < F.col("key")
    return out.select("key", "uid", "uri", "payload", "digest", "size", F.when(repeats, F.col("refers_to")).alias("refers_to"), F.when(repeats, F.col("refers_uid")).alias("refers_uid"))


def _record_id(c: Column) -> Column:
    return F.concat(F.lit("urn:verso:"), c.cast("string"))


def chunked(payload: Column, chunk_chars: int) -> Column:
    """Chunked transfer framing: hexadecimal byte counts, pieces cut between code points."""
    starts = F.when(F.length(payload) > 0, F.sequence(F.lit(1), F.length(payload), F.lit(chunk_chars))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.substring(payload, s, F.lit(chunk_chars)))
    framed = F.transform(pieces, lambda p: F.concat(F.lower(F.hex(_bytes(p))), F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + CRLF + CRLF))


def records(rows: DataFrame, chunk_chars: int = 8192, segment_chars: int = 32768) -> DataFrame:
    """Rows of :func:`deduplicated` to the text of their WARC records, column ``value``.

    Record identifiers join the key to the number that tells equal keys apart,
    so that repeated rows stay records of their own, and a repeat names the
    record that it refers to.
    """
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}")
    revisit = F.col("refers_to").isNotNull()
    row = rows.withColumn("id", F.concat(F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit("/"), F.col("uid").cast("string")))
    row = row.withColumn("refers_to", F.concat(F.col("refers_to").cast("string"), F.lit("/"), F.col("refers_uid").cast("string")))
    row = row.withColumn("block", F.when(revisit, F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}X-Payload-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))).otherwise(F.concat(head, chunked(F.col("payload"), chunk_chars))))
    row = row.withColumns({"total": _bytes(F.col("block")), "sum": F.sha2(F.col("block"), 256)})
    starts = F.sequence(F.lit(1), F.length("block"), F.lit(segment_chars))
    row = row.withColumn("parts", F.transform(starts, lambda s: F.substring("block", s, F.lit(segment_chars))))
    # a block is never empty; before the other explode Spark filters for that, and makes the blocks three times more
    row = row.select("id", "key", "uri", "digest", "refers_to", "total", "sum", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("at", "part"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(CRLF))

    def where(test: Column, *cols: Column) -> Column:
        return F.when(test, F.concat(*cols)).otherwise(F.lit(""))

    first, split, final = F.col("at") == 0, F.col("n") > 1, F.col("at") == F.col("n") - 1
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", " ")
    value = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("id")), where(~first, F.lit("/"), F.col("at").cast("string")), F.lit(">"))),
        line("WARC-Target-URI", uri),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        where(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("sum")))),
        where(first & F.col("refers_to").isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.coalesce(F.col("refers_to"), F.lit(""))), F.lit(">")))),
        where(split, line("WARC-Segment-Number", (F.col("at") + 1).cast("string"))),
        where(~first, line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), _record_id(F.col("id")), F.lit(">")))),
        where(split & final, line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line("Content-Length", _bytes(F.col("part")).cast("string")),
        F.lit(CRLF),
        F.col("part"),
    )
    return row.select(value.alias("value"))


def write_archives(rows: DataFrame, path: str, records_per_file: int = 512) -> None:
    """Write records to gzip archive files of bounded size; segments hold at most ``segment_chars`` code points."""
    rows.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _parse(content: bytes) -> Iterator[tuple]:
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = content[stop + 4 : stop + 4 + size]
        if len(block) != size:
            raise ValueError("truncated WARC record")
        at = stop + 4 + size + 4
        bare = lambda k: head.get(k, "").strip("<>") or None
        number = head.get("warc-segment-number")
        total = head.get("warc-segment-total-length")
        yield (bare("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), bare("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None, bare("warc-refers-to"), head.get("warc-block-digest"), block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive files under ``path``, continuation records as they stand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for r in _parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    out.append(r)
                    held += len(r[-1])
                    if held > 8 << 20:
                        yield pd.DataFrame(out, columns=names).astype({"segment": "Int32", "total": "Int64"})
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"segment": "Int32", "total": "Int64"})

    return files.mapInPandas(parse, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered, and checked to be all there.

    Records without a segment number pass by; only segments are shuffled. A
    gap in the numbers, a missing last segment or a wrong total length is an
    error that stops the job.
    """
    whole = found.filter("segment is null").select("id", "type", "uri", "refers", "digest", "block")
    parts = found.filter("segment is not null").withColumn("origin", F.coalesce("origin", "id"))
    one = parts.groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("type", "uri", "refers", "digest"))).alias("head"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        F.max("total").alias("total"),
    )
    numbers = F.transform("segments", lambda s: s["segment"])
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s["block"]))
    good = (numbers == F.sequence(F.lit(1), F.size("segments"))) & (size == F.col("total")) & F.col("head").isNotNull()
    block = F.unhex(F.array_join(F.transform("segments", lambda s: F.hex(s["block"])), ""))
    fault = F.raise_error(F.concat(F.lit("incomplete segments of "), F.col("origin"))).cast("binary")
    joined = one.select(F.col("origin").alias("id"), "head.*", F.when(F.coalesce(good, F.lit(False)), block).otherwise(fault).alias("block"))
    return whole.unionByName(joined)


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        if len(out[-1]) != size or body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("broken chunked framing")
        at = stop + 4 + size


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``id, type, uri, refers, payload, payload_bytes, payload_digest`` of the reassembled records.

    Payloads of responses are decoded and hashed; a revisit has none and
    states length and digest of the one it refers to.
    """
    schema = "id string, type string, uri string, refers string, payload binary, payload_bytes long, payload_digest string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.digest and r.digest.startswith("sha256:") and hashlib.sha256(r.block).hexdigest() != r.digest[7:]:
                    raise ValueError(f"block digest of {r.id} does not hold")
                head, _, body = r.block.partition(b"\r\n\r\n")
                size, digest, payload = None, None, None
                if r.type == "response":
                    payload = _dechunk(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                elif m := re.search(rb"\r\nX-Payload-Length: (\d+)", head):
                    size = int(m[1])
                rows.append((r.id, r.type, r.uri, r.refers, payload, size, digest))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"payload_bytes": "Int64"})

    return reassemble(read_records(spark, path)).mapInPandas(decode, schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back. Null html is an empty payload; the archives stay in the
    shared folder for the reader. A revisit's digest comes from the response that it refers to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = shared_dir(spark, "warc")
    write_archives(records(deduplicated(pages, "page_id", F.coalesce("html", F.lit("")))), path)
    back = read_pages(spark, path).drop("payload")
    row = back.select("id", key_of(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers")
    return resolve_revisits(stored(row, "warc-read"))


def key_of(record_id: Column) -> Column:
    """The page of a record; null where it had none."""
    return F.substring_index(F.element_at(F.split(record_id, ":"), -1), "/", 1).try_cast("long")


def resolve_revisits(row: DataFrame) -> DataFrame:
    """Fill the digests of revisits from the records that they refer to; a frequent one is dealt to several tasks."""
    revisits = row.filter("record_type = 'revisit'")
    known = row.filter("record_type = 'response'").select(F.col("id").alias("refers"), F.col("payload_digest").alias("known"))
    known = known.join(revisits.select("refers").distinct(), "refers", "left_semi")
    found = even_join(revisits, known, "refers", ("id",), "left").withColumn("payload_digest", F.col("known"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", key_of(F.col("refers")).alias("refers_to")]
    return row.filter("record_type = 'response'").select(*names).unionByName(found.select(*names))


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS r FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN r < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r < page_id THEN r END AS refers_to
FROM f
"""
