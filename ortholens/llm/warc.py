"""WARC archives: segmented records with chunked transfer framing, written and read by Spark.

Writing: records become rows and Spark's text writer ends each with CRLF CRLF, which is what ends a WARC record. Payloads
are framed as chunked HTTP bodies; blocks over `segment_bytes` are cut into a first record and `continuation` records that
name their origin. Records with equal payloads of at least 100 bytes are stored once; the others become `revisit` records.

Reading: files are parsed record by record by Content-Length inside the tasks. Whole records are decoded where they are
read; only segments are shuffled: grouped by origin, put in order of segment number, checked against the total length.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ortholens.llm.common import shared_dir, stash

#: Production parameters.
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
LEAST_SHARED = 100
RECORDS_PER_FILE = 2_000
BROADCAST_DIGESTS = 200_000

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _chunked(payload: Column, chunk: int) -> Column:
    """The payload in chunked transfer framing: hexadecimal length, CRLF, bytes, CRLF; a zero chunk ends it."""
    n = F.octet_length(payload)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / F.lit(chunk)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        size = F.least(F.lit(chunk), n - i * chunk)
        return F.concat(
            F.lower(F.hex(size)).cast("binary"), F.lit(END).cast("binary"), F.substring(payload, i * chunk + 1, size), F.lit(END).cast("binary")
        )

    body = F.aggregate(
        F.array(F.transform(starts, one)), F.lit(b""), lambda a, parts: F.concat(a, F.unhex(F.array_join(F.transform(parts, F.hex), "")))
    )
    return F.concat(body, F.lit(f"0{END}{END}").cast("binary"))


def records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row `value` (string of raw bytes) per WARC record of pages(page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    numbered = pages.select("page_id", "url", html.alias("payload"), F.monotonically_increasing_id().alias("row"))
    base = numbered.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    shared = stash(
        base.where(F.col("n") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("d", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row")),
        "warc-shared",
    )
    # payloads stay where they are while the digests that several pages share are few; beyond that both sides are shuffled
    few = shared.count() <= BROADCAST_DIGESTS
    typed = base.join(F.broadcast(shared) if few else shared, F.col("digest") == F.col("d"), "left").select(
        "*", (F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit")
    )
    urn = lambda id_, row: F.concat(F.lit("urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"))
    ident = urn(F.col("page_id"), F.col("row"))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")
    named = typed.withColumn("ident", ident).withColumn("url_line", F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(END))))
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    block = F.when(F.col("revisit"), F.lit(f"{http}{END}").cast("binary")).otherwise(
        F.concat(F.lit(f"{http}Transfer-Encoding: chunked{END}{END}").cast("binary"), _chunked(F.col("payload"), chunk_bytes))
    )
    framed = named.select("page_id", "ident", "url_line", "digest", "n", "revisit", urn(F.col("first_id"), F.col("first_row")).alias("first"), block.alias("block"))
    total = F.octet_length("block")
    n_segments = F.greatest(F.lit(1), F.ceil(total / F.lit(segment_bytes))).cast("int")
    cut = framed.select("*", total.alias("total"), n_segments.alias("n_seg"), F.explode(F.sequence(F.lit(1), n_segments)).alias("seg"))
    part = F.substring(F.col("block"), (F.col("seg") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    maybe = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    many = F.col("n_seg") > 1
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("seg") > 1, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("ident"), F.when(F.col("seg") > 1, F.concat(F.lit(":"), F.col("seg").cast("string"))).otherwise(""), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.col("url_line"),
        maybe(F.col("seg") == 1, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        maybe(F.col("seg") == 1, line("X-Payload-Length", F.col("n").cast("string"))),
        maybe(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(F.lit("<"), F.col("first"), F.lit(">"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"))),
        maybe(many, line("WARC-Segment-Number", F.col("seg").cast("string"))),
        maybe(many & (F.col("seg") > 1), line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("ident"), F.lit(">")))),
        maybe(many & (F.col("seg") == F.col("n_seg")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(END),
    )
    return cut.select(F.concat(head.cast("binary"), part).cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes gzip WARC files under path; no file holds more than RECORDS_PER_FILE records of bounded size."""
    writer = records(pages, segment_bytes, chunk_bytes).write
    writer.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, gzip members or plain, read one record at a time; a record cut short
    raises ValueError."""
    source = io.BytesIO(data)
    f = gzip.GzipFile(fileobj=source) if data[:2] == b"\x1f\x8b" else source
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:20]!r} stands")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.lower()] = value.strip()
        n = int(headers["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("record is cut short")
        yield headers, block


def dechunk(body: bytes) -> bytes:
    """The body without its chunked transfer framing; framing that is broken or has no end raises ValueError."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunked body has no end")
        n = int(body[at:stop].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        piece = body[stop + 2 : stop + 2 + n]
        if len(piece) < n or body[stop + 2 + n : stop + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(piece)
        at = stop + 4 + n


def payload_of(block: bytes) -> bytes:
    """What an HTTP response block carries."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


#: Numbers that may be null travel as strings: pandas turns long columns with a null into doubles.
RECORD = "ident string, kind string, page_id string, origin string, segment int, total long, stated_bytes string, digest string, refers_to string, block binary"
PAGE = "page_id string, payload_bytes string, payload_digest string, record_type string, refers_to string, intact boolean"


def _page(urn: str | None) -> str | None:
    part = (urn or "").strip("<>").split(":")
    return part[2] if len(part) > 2 and part[2].lstrip("-").isdigit() else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for data in batch["content"]:
            rows, held = [], 0
            for h, block in parse(data):
                ident = h["warc-record-id"].strip("<>")
                segment = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                rows.append((
                    ident, h["warc-type"], _page(ident), h.get("warc-segment-origin-id", ident).strip("<>"), segment,
                    int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                    h.get("x-payload-length"),
                    h.get("warc-payload-digest", "").removeprefix("sha256:") or None, _page(h.get("warc-refers-to")), block,
                ))
                held += len(block)
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PAGE.split(", ")]
    for batch in batches:
        rows = []
        for x in batch.itertuples(index=False):
            if x.kind == "revisit":
                rows.append((x.page_id, x.stated_bytes, x.digest, "revisit", x.refers_to, True))
                continue
            if x.length_ok:
                body = payload_of(x.block)
                digest = hashlib.sha256(body).hexdigest()
                rows.append((x.page_id, str(len(body)), digest, "response", None, digest == x.digest))
            else:
                rows.append((x.page_id, None, None, "response", None, False))
        yield pd.DataFrame(rows, columns=names, dtype=object)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact: one row per response or revisit record.

    intact is false where segments are missing, their total length is wrong or the payload's digest is another one.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInPandas(_parsed, RECORD)
    whole = found.where("segment is null").select("kind", "page_id", "stated_bytes", "digest", "refers_to", F.lit(True).alias("length_ok"), "block")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    joined = (
        found.where("segment is not null")
        .groupBy("origin")
        .agg(
            F.max("page_id").alias("page_id"), F.max("stated_bytes").alias("stated_bytes"), F.max("digest").alias("digest"),
            F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"), F.max("refers_to").alias("refers_to"),
            F.max("total").alias("total"), F.max("segment").alias("last"), F.count(F.lit(1)).alias("n"), parts.alias("parts"),
        )
        .select(
            F.coalesce("kind", F.lit("response")).alias("kind"), "page_id", "stated_bytes", "digest", "refers_to",
            (F.col("n") == F.col("last")).alias("all"), "total", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), "")).alias("block"),
        )
        .select("kind", "page_id", "stated_bytes", "digest", "refers_to", F.coalesce(F.col("all") & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("length_ok"), "block")
    )
    out = whole.unionByName(joined).mapInPandas(_decoded, PAGE)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "payload_bytes", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    Null html is an empty payload; null urls are left out of the record; payloads under 100 bytes are always responses.
    Repeated rows each have a record: copies of the page_id that others refer to are all responses. A null page_id never
    is what others refer to unless all are null. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path)
