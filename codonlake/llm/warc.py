"""WARC archives with revisit resolution.

Headers alone are shuffled by payload digest; where several records share one, the
record of the largest key is the response and the others become revisits that
refer to it. Archives are written by Spark's text sink, one record a row, so
they go to any file system Spark knows; the end of a record is the sink's line
separator. Reading splits at the start of the next record and checks each
payload against its Content-Length; an archive in which a payload holds that very
mark is read again as a whole, record by record.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codonlake.llm.words import bound
from codonlake.operators.binding import compute_once
from codonlake.session import scratch_path, stored

DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to_id": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "page_key": "WARC-Page-Key",
    "payload_length": "WARC-Payload-Length",
    "length": "Content-Length",
}


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""

    def letters(digest: Column) -> Column:
        out = []
        for k in range(8):
            bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
            out += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*out)

    return bound(F.sha1(payload), letters)


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(key.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def headers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, digest, bytes)`` of every page; a null page has an empty payload."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(key).alias("key"), base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))


def originals(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(digest, original)``: the largest key of each digest that several records of at least ``min_bytes`` share."""
    large = heads.filter(F.col("bytes") >= min_bytes)
    shared = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("original"))
    return shared.filter("n > 1").select("digest", "original")


def records(pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """One WARC record a row, without its end: fresh headers, and the payload unless it is a revisit.

    Records that share payload and largest key are all responses; if all keys of a
    payload are null, all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    binary = F.encode("__payload", "UTF-8")
    known = originals(headers(pages), min_bytes)
    one = pages.select("page_id", "url", payload.alias("__payload"))
    one = compute_once(one, digest=base32_sha1(binary), bytes=F.octet_length(binary).cast("long"))
    joined = one.join(known, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Page-Key", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(
            revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("original"))))
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    )
    return joined.select(F.concat(head, F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("__payload"))).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    """Write records as gzipped archives, one for each partition."""
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of archives: header fields, size and digest of the block as read, and the ``payload`` if wanted.

    Archives may come from elsewhere if they are UTF-8; fields they lack are
    null. Without payloads the archives are read once.
    """
    mark = f"{END}{VERSION}\r\n"
    first = f"{VERSION}\r\n"
    lines = spark.read.option("lineSep", mark).text(path).withColumn("file", F.col("_metadata.file_path"))
    whole = F.when(F.startswith("value", F.lit(first)), F.substring("value", F.lit(len(first) + 1), F.length("value")))
    cut = lines.select("file", F.coalesce(whole, "value").cast("binary").alias("record"))
    head_bytes = F.octet_length(F.substring_index(F.col("record").cast("string"), END, 1))
    cut = compute_once(cut, at=head_bytes + 1)
    head = F.substring("record", F.lit(1), F.col("at") - 1).cast("string")
    block = F.substring("record", F.col("at") + len(END), F.octet_length("record"))
    parsed = _fields(cut.select("file", head.alias("head"), block.alias("block")))
    fits = F.octet_length("block") - F.col("length")
    parsed = parsed.withColumns(
        {"fits": F.coalesce(fits.isin(0, len(END)), F.lit(False)), "block": F.substring("block", F.lit(1), F.col("length").cast("int"))}
    )
    if not payloads:
        parsed = stored(_measured(parsed).drop("block", "head"), "archive-headers")
    misfits = parsed.filter(~F.col("fits")).select("file").distinct().collect()
    whole_files = [r[0] for r in misfits]  # rare, and at most as many as the list of archives that the driver holds
    good = parsed.filter(~F.col("file").isin(whole_files)) if whole_files else parsed
    good = _measured(good) if payloads else good
    if whole_files:
        rows = spark.read.format("binaryFile").load(whole_files).select(F.col("path").alias("file"), "content")
        again = _measured(_fields(rows.mapInPandas(_walk, "file string, head string, block binary")))
        good = good.unionByName(again if payloads else again.drop("block", "head"), allowMissingColumns=True)
    if payloads:
        good = good.withColumn("payload", F.decode("block", "UTF-8"))
    return good.drop("head", "block", "file", "length", "fits")


def _measured(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {"block_bytes": F.octet_length("block").cast("long"), "block_digest": base32_sha1(F.col("block"))}
    )


def _fields(rows: DataFrame) -> DataFrame:
    field = lambda name: F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    out = rows.select("*", *[F.nullif(field(name), F.lit("")).alias(c) for c, name in _FIELDS.items()])
    return out.withColumns(
        {
            "length": F.col("length").cast("long"),
            "payload_length": F.col("payload_length").cast("long"),
            "payload_digest": F.regexp_replace("payload_digest", "^sha1:", ""),
        }
    )


def _walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of whole archives by Content-Length."""
    for part in parts:
        for file, content in zip(part["file"], part["content"]):
            data, at, rows = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0, []
            while (start := data.find(VERSION.encode(), at)) >= 0:
                stop = data.index(END.encode(), start)
                head = data[start:stop].decode()
                size = int(re.search(r"(?im)^content-length:\s*(\d+)", head)[1])
                rows.append((file, head, data[stop + len(END) : stop + len(END) + size]))
                at = stop + 2 * len(END) + size
            yield pd.DataFrame(rows, columns=["file", "head", "block"])


def resolved(archive: DataFrame) -> DataFrame:
    """Records with the page, size and digest of their payload; revisits get theirs by a join with the responses.

    The digest of a response is that of the payload as read.
    """
    key = F.col("page_key").cast("long").alias("page_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = archive.filter("record_type = 'response'").select(
        key, "record_id", F.col("block_bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest")
    )
    again = archive.filter("record_type = 'revisit'").select(key, F.col("refers_to_id").alias("record_id"))
    wanted = again.select("record_id").distinct()
    found = own.join(wanted, "record_id", "left_semi").groupBy("record_id").agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")
    )
    revisits = again.join(found, "record_id", "left").withColumn("record_type", F.lit("revisit")).select(*columns)
    responses = own.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*columns)
    return responses.unionByName(revisits)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of ``pages`` to the shared folder, and resolve them as read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(records(pages, min_bytes), path)
    return resolved(read_archives(pages.sparkSession, path, payloads=False))
