"""WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest; the largest id of each payload is its response and the
others revisit it. Archives are ordinary WARC/1.1 text files: Spark's text writer puts one record a row, its line
separator is the record's end, so that any store Spark writes to will do. Reading splits at the next record's version
line and joins pieces until Content-Length is met, so that a payload may hold anything, even another archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import bounded, shared_dir

END = "\r\n\r\n"
#: Where the next record begins; what follows is the version's last digit.
NEXT = END + "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Any date will do; a fixed one keeps archives the same on every run.
DATE = "2024-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits, ten of them (forty bits) at a time."""
    parts = [F.lpad(F.conv(F.substr(hex40, F.lit(1 + 10 * i), F.lit(10)), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column, digest: Column) -> Column:
    """A UUID by page and payload."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def resolve(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page, url, payload, bytes, digest, refers_to): refers_to is the response's id for revisits, else null.

    Payloads of at least ``min_bytes`` bytes that are equal have one response, the row with the largest id. A null
    payload is empty. A row with a null id refers to the largest id there is, and is a response where there is none. Rows that
    repeat the largest id and its payload are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\x00-\x20]", "%20").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32(F.sha1(F.col("payload").cast("binary"))))
    heads = rows.where(F.col("bytes") >= min_bytes).select("page", "digest")
    last = heads.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    visits = heads.join(last, "digest").where("page is null or page <> refers_to").select("page", "digest", "refers_to").distinct()
    visits = visits.select(F.col("page").alias("v_page"), F.col("digest").alias("v_digest"), "refers_to")
    return rows.join(visits, rows["page"].eqNullSafe(visits["v_page"]) & (rows["digest"] == visits["v_digest"]), "left").drop("v_page", "v_digest")


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0, rows_per_file: int = 20_000, **columns: str) -> str:
    """Write gzipped WARC files to ``path`` (a new folder in the shared one by default) and return it."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/cladeforge/warc-{uuid.uuid4().hex}"
    rows = resolve(pages, min_bytes, **columns)
    visit = F.col("refers_to").isNotNull()
    head = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(visit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <"), record_id(F.col("page"), F.col("digest")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("X-Page-ID: "), F.col("page").cast("string")),
        F.when(visit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(visit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(END), F.when(visit, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)
    return path


def _joined(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(file, piece) in order -> (header, payload)."""
    file, held = None, b""
    for name, piece in pieces:
        if name != file:
            if held:
                raise ValueError(f"{file} ends within a record")
            file, held = name, b""
            if not piece.startswith(b"WARC/1."):
                raise ValueError(f"{name} isn't a WARC file")
            piece = piece[7:]
        held = held + NEXT.encode() + piece if held else piece
        head, _, body = held.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
        need = int(fields["content-length"])
        if len(body) < need:
            continue
        rest = body[need:].strip(b"\r\n")
        if rest:
            raise ValueError(f"{name} has bytes between records")
        held = b""
        yield fields, body[:need]
    if held:
        raise ValueError(f"{file} ends within a record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page, url, digest, computed_digest, bytes, refers_to) of every record under ``path``.

    computed_digest is of the payload as read. Files aren't split, since they are gzipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for f, body in _joined((n, bytes(v)) for b in batches for n, v in zip(b["file"], b["value"], strict=True)):
            page = f.get("x-page-id")
            rows.append((f["warc-record-id"], f["warc-type"], int(page) if page else None, f.get("warc-target-uri"), f["warc-payload-digest"].removeprefix("sha1:"), b32encode(hashlib.sha1(body).digest()).decode(), len(body), f.get("warc-refers-to")))
            if len(rows) == 2000:
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int64"})

    names = ["record_id", "record_type", "page", "url", "digest", "computed_digest", "bytes", "refers_to"]
    text = spark.read.option("lineSep", NEXT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return bounded(text).mapInPandas(run, "record_id string, record_type string, page long, url string, digest string, computed_digest string, bytes long, refers_to string")


def read_back(path: str, spark: SparkSession | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined to their responses."""
    records = read_records(spark or SparkSession.active(), path)
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page").alias("r_page"), F.col("bytes").alias("r_bytes"), F.col("computed_digest").alias("r_digest")).dropDuplicates(["refers_to"])
    visits = records.where("record_type = 'revisit'").join(first, "refers_to", "left")
    visits = visits.select(F.col("page").alias("page_id"), F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), "record_type", F.col("r_page").alias("refers_to"))
    own = records.where("record_type <> 'revisit'").select(F.col("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("computed_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(visits)
