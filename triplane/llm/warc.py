"""WARC archives: written as text files of records, read back by segment reassembly.

A record ends in CRLF CRLF, which is the writer's line separator, so a Spark text file is a WARC file. Files
are gzip, which Spark doesn't split: a task sees a file's records in order. Blocks over ``segment_bytes`` are
cut into continuation records, which may land in other files; reading groups them by origin identifier, orders
them by segment number, verifies the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, removed, shuffles_removed

END = "\r\n\r\n"
START = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer framing. Chunks also end inside any CRLF CRLF, so no payload can look like
    the end of a record (the reader would cope, but files stay plain to split)."""
    out, at = [], 0
    while at < len(payload):
        stop = min(at + size, len(payload))
        found = payload.find(b"\r\n\r\n", at, stop + 3)
        stop = min(stop, found + 2) if found >= 0 and found + 2 < stop else stop
        out.append(b"%x\r\n%b\r\n" % (stop - at, payload[at:stop]))
        at = stop
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        out.append(body[at : at + n])
        at += n + 2


def header(fields: dict[str, object], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields.items() if v is not None]
    return (START + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block


def records(page: dict, segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The records of a page, without the CRLF CRLF that ends each."""
    common = {
        "WARC-Type": page["record_type"], "WARC-Record-ID": f"<urn:x-page:{page['record']}>", "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]+", " ", page["uri"] or ""),
        "WARC-Payload-Digest": f"sha256:{page['payload_digest']}", "Content-Type": "application/http; msgtype=response",
    }
    if page["record_type"] == "revisit":
        yield header(common | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{page['refers_to']}>"}, HTTP.encode())
        return
    block = HTTP.encode() + chunked(page["payload"], chunk_bytes)
    if len(block) <= segment_bytes:
        yield header(common, block)
        return
    origin = common["WARC-Record-ID"]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield header(common | {"WARC-Segment-Number": 1}, pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:x-segment:{page['record']}/{n}>", "WARC-Date": date, "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": n}
        yield header(more | {"WARC-Segment-Total-Length": len(block) if n == len(pieces) else None}, piece)


def planned(pages: DataFrame, key: str, html: str, uri: str, least_revisit: int) -> DataFrame:
    """``record, uri, payload, payload_bytes, payload_digest, record_type, refers_to`` for each distinct key.

    Digests are grouped without their payloads (a map-side minimum), then meet the pages by key, which is
    unique: a payload that many pages share makes no hot join key for the payloads."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    facts = pages.select(key, F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    facts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("f")).select(key, "f.*")
    first = facts.where(F.col("payload_bytes") >= least_revisit).groupBy("payload_digest").agg(F.min(key).alias("_first"))
    facts = facts.join(first, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & (F.col("_first") != F.col(key))
    facts = facts.select(F.col(key).alias("_key"), "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))
    rows = pages.select(F.col(key).alias("_key"), F.col(uri).alias("uri"), payload.alias("payload")).join(facts, "_key")
    rows = rows.where((F.col("record_type") == "revisit") | (F.sha2("payload", 256) == F.col("payload_digest")))
    return rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload"))).withColumnRenamed("_key", "record")


def write(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", uri: str = "url", least_revisit: int = 100, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, date: str | None = None) -> None:
    """Archives of all pages in ``folder``: gzip files of WARC/1.1 records. Equal payloads of at least
    ``least_revisit`` bytes are stored once, at the least key; other pages revisit it. ``date``: of the records, by
    default the time of the call."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page in batch.to_pylist():
                for r in records(page, segment_bytes, chunk_bytes, date):
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    with shuffles_removed(pages.sparkSession):
        rows = planned(pages, key, html, uri, least_revisit).mapInArrow(each, "record binary")
        rows.select(F.col("record").cast("string")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(folder)


FIELDS = "kind string, id string, origin string, segment int, total long, digest string, refers_to string, block binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives. Spark hands a file's text over in pieces, in order and not split; put together
    again, a header ends at CRLF CRLF and a block at its Content-Length, so blocks may hold any bytes."""
    pieces = spark.read.option("lineSep", END).text(folder).select(F.col("value").cast("binary").alias("piece"), F.input_file_name().alias("file"))

    def parsed(head: bytes) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if lines[0] + "\r\n" != START:
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def row(h: dict[str, str], block: bytes) -> dict:
        number = lambda k: int(h[k]) if k in h else None
        return {
            "kind": h.get("warc-type"), "id": h.get("warc-record-id"), "origin": h.get("warc-segment-origin-id", h.get("warc-record-id")), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
            "digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"), "block": block,
        }

    kinds = pa.schema([("kind", pa.string()), ("id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])

    end = END.encode()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, text, out, held = None, None, bytearray(), [], 0
        for batch in batches:
            for piece, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != file and (head is not None or text.strip()):
                    raise ValueError(f"{file} ends inside a record")
                file = now
                text += piece + end
                while True:
                    if head is None:
                        at = text.find(end)
                        if at < 0:
                            break
                        if at:
                            head = parsed(bytes(text[:at]))
                        del text[: at + len(end)]
                        continue
                    n = int(head["content-length"])
                    if len(text) < n + len(end):
                        break
                    if text[n : n + len(end)] != end:
                        raise ValueError(f"a record in {file} doesn't end with its Content-Length")
                    out.append(row(head, bytes(text[:n])))
                    del text[: n + len(end)]
                    head, held = None, held + n
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, held = [], 0
        if head is not None or text.strip():
            raise ValueError(f"{file} ends inside a record")
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return pieces.mapInArrow(each, FIELDS)


@F.arrow_udf(T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]))
def _payload(column: pa.Array) -> pa.Array:
    sizes, digests = [], []
    for block in column.to_pylist():
        head, _, body = (block or b"").partition(b"\r\n\r\n")
        payload = dechunked(body) if b"chunked" in head.lower() else body
        sizes.append(len(payload))
        digests.append(hashlib.sha256(payload).hexdigest())
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["payload_bytes", "payload_digest"])


def whole_blocks(rows: DataFrame) -> DataFrame:
    """Responses with their whole blocks, ``id, digest, block``: only segmented ones are grouped (by origin),
    a record at most in a group; the segments must be 1 to n and have the total length the last one states."""
    single = rows.where("kind = 'response' AND segment IS NULL").select("id", "digest", "block")
    parts = rows.where("segment IS NOT NULL").select("origin", "segment", "digest", "total", "block").dropDuplicates(["origin", "segment"])
    joined = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.max("segment").alias("last")
    )
    block = F.aggregate("parts.block", F.lit(b""), lambda a, b: F.concat(a, b))
    sound = (F.size("parts") == F.col("last")) & (F.octet_length("block") == F.col("total"))
    whole = joined.select(F.col("origin").alias("id"), "digest", block.alias("block"), "total", "parts", "last")
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("id"))))
    return single.union(whole.select("id", "digest", checked))


#: Shares of the pages that revisit one response.
SALTS = 16


def read(rows: DataFrame, keep: Scratch) -> DataFrame:
    """``record, payload_bytes, payload_digest, record_type, refers_to`` (keys as text) from the records of archives.

    A response's size and digest are those of its decoded payload, which must match the digest in its header; a
    revisit has those of the decoded payload that it refers to, which must match its own header too. A response
    that many pages revisit is met by so many shares of them."""
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1)

    def checked(found: Column, stated: Column, name: Column) -> Column:
        return F.when(F.concat(F.lit("sha256:"), found) == stated, found).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest in "), name)))

    full = whole_blocks(rows).select("id", "digest", _payload("block").alias("p"))
    full = keep.stored(full.select(page("id").alias("record"), "p.payload_bytes", checked(F.col("p.payload_digest"), F.col("digest"), F.col("id")).alias("payload_digest")))
    revisits = rows.where("kind = 'revisit'").select(page("id").alias("record"), "digest", page("refers_to").alias("refers_to"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    targets = full.join(revisits.select("refers_to").distinct(), full["record"] == F.col("refers_to"), "left_semi")
    targets = targets.select(F.col("record").alias("refers_to"), "payload_bytes", "payload_digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = revisits.join(targets, ["refers_to", "salt"], "left")
    missing = F.raise_error(F.concat(F.lit("nothing to revisit for "), F.col("record")))
    digest = F.when(F.col("payload_digest").isNull(), missing).otherwise(checked(F.col("payload_digest"), F.col("digest"), F.col("record")))
    met = met.select("record", "payload_bytes", digest.alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to")).union(met)


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back: one row per distinct key. The archives go
    when they are read.

    A null payload is empty. Rows with a null key have no identifier and are left out; rows that repeat a key
    count once, with the payload of least digest. Payloads may hold anything, CRLF CRLF and WARC headers too.
    An empty table gives an empty one.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    with Scratch(spark) as keep:
        folder = keep.folder()
        write(pages, folder, key=key, **options)
        records_table = keep.stored(read_records(spark, folder))  # parsed once
        removed(spark, folder)
        rows = read(records_table, keep).dropDuplicates(["record"])
        return cut(rows.select(F.col("record").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
