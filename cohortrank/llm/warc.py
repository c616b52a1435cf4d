"""WARC archives: writing pages as segmented, chunk-framed records, and putting the segments together again.

A record longer than a segment is cut into a first record and continuation records. Reading groups these by the
record id of the first, orders them by segment number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrank.llm.common import shared_dir, slices

VERSION = b"WARC/1.1\r\n"
#: Payloads from this size on may be stored once; segments and chunks are cut at these sizes.
REVISIT_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 1000, 8192, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk also ends inside each version line that the payload holds, so that no
    record's block can be taken for the start of another record."""
    out, at, n = [], 0, len(payload)
    while at < n:
        stop = min(at + size, n)
        found = payload.find(VERSION, at, min(stop + len(VERSION) - 1, n))
        if found >= 0:
            stop = min(stop, found + 4)
        out += [b"%x\r\n" % (stop - at), payload[at:stop], b"\r\n"]
        at = stop
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload in a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return VERSION + f"{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def uri(url: str | None) -> str:
    """The url without characters that would end a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def page_records(page_id, url: str | None, payload: bytes, digest: str, refers_to, own_id: str) -> Iterator[bytes]:
    """The record of one page, or its first segment and continuations."""
    common = [("WARC-Page-ID", "" if page_id is None else page_id), ("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own_id), *common, *more], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = list(range(0, len(block), SEGMENT_BYTES))
    for k, at in enumerate(cuts):  # a cut inside a version line moves back before it
        for shift in range(1, len(VERSION)):
            if block[at - shift : at - shift + len(VERSION)] == VERSION:
                cuts[k] = at - shift
    if len(cuts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own_id), *common], block)
        return
    for k, at in enumerate(cuts):
        part = block[at : cuts[k + 1] if k + 1 < len(cuts) else len(block)]
        if not k:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", own_id), *common, ("WARC-Segment-Number", 1)], part)
            continue
        more = [("WARC-Segment-Number", k + 1), ("WARC-Segment-Origin-ID", own_id)]
        if k + 1 == len(cuts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own_id[:-1]}:{k + 1}>"), *more], part)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row to gzip-compressed archives under path.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the largest id become responses and the
    others revisits of it. A null payload is an empty one. Null urls become empty. Rows with a null id are never
    revisits and never referred to. Rows that repeat id and payload all get records. The payload crosses one
    shuffle, keyed by id, so equal payloads don't meet in one task. Payloads of any length are taken whole, other
    columns, whatever their names, do not come along, and an empty table gives archives without records.
    """
    spark = pages.sparkSession
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    keys = page.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    owner = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to")
    revisits = keys.distinct().join(owner, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to")
    marked = page.join(revisits, ["page_id", "digest"], "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            out = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                own = f"<urn:page:{page_id}:{part}-{n}>"
                out += (x[:-1] for x in page_records(page_id, url, payload, digest, refers_to, own))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer ends each value with the "\n" that was cut off above, so the files hold exact records
    marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(build, "value binary").select(
        F.col("value").cast("string")
    ).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records from the archives under path, segments put together.

    Returns record_id, page_id, url, record_type, payload binary (null for revisits), payload_bytes,
    payload_digest, refers_to, and intact: false if segments are missing, a length or digest differs or the
    framing is broken. Records without segments cross no shuffle; segments are grouped by their record only.
    Records are told apart by the line that starts them, which write_warc() never lets stand inside a block. So this
    reads archives of that writer: a foreign one whose blocks hold that line, or of another version, is misread.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                head, _, rest = value.partition(b"\r\n\r\n")
                h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
                length = int(h.get("content-length", -1))
                block = rest[:length] if length >= 0 else rest
                number = int(h.get("warc-segment-number", 0))
                rows.append({
                    "record_id": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "segment": number, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                    "page_id": int(h["warc-page-id"]) if h.get("warc-page-id") else None, "url": h.get("warc-target-uri"),
                    "record_type": h.get("warc-type"), "digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
                    "refers_to": int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", h.get("warc-refers-to", ""))) else None,
                    "block": block, "whole": len(block) == length,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=PARSED)

    records = raw.mapInArrow(parse, PARSED_DDL)
    segment = F.struct("segment", "total", "page_id", "url", "record_type", "digest", "refers_to", "block", "whole")
    grouped = (
        records.where("segment > 0").groupBy("record_id").agg(F.array_sort(F.collect_list(segment)).alias("s"))
        .select(
            "record_id", F.col("s")[0]["page_id"].alias("page_id"), F.col("s")[0]["url"].alias("url"), F.col("s")[0]["record_type"].alias("record_type"),
            F.col("s")[0]["digest"].alias("digest"), F.col("s")[0]["refers_to"].alias("refers_to"),
            F.aggregate("s.block", F.lit(b""), lambda a, b: F.concat(a, b)).alias("block"),
            (F.forall("s.whole", lambda x: x) & (F.element_at("s", -1)["segment"] == F.size("s")) & F.element_at("s", -1)["total"].isNotNull()
             & (F.element_at("s", -1)["total"] == F.aggregate("s.block", F.lit(0), lambda a, b: a + F.octet_length(b)))).alias("whole"),
        )
    )
    columns = ["record_id", "page_id", "url", "record_type", "digest", "refers_to", "block", "whole"]
    whole = records.where("segment = 0").select(*columns).unionByName(grouped.select(*columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.to_pydict()
            payloads, sizes, digests, intact = [], [], [], []
            for kind, said, block, ok in zip(rows["record_type"], rows["digest"], rows["block"], rows["whole"], strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                payload = None
                if kind == "revisit":
                    size, digest = int(fields.get(b"content-length", 0)), said
                else:
                    try:
                        payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                    except ValueError:
                        payload, ok = b"", False
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                payloads.append(payload)
                sizes.append(size)
                digests.append(digest)
                intact.append(bool(ok) and said == digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_id"), batch.column("page_id"), batch.column("url"), batch.column("record_type"), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column("refers_to"), pa.array(intact, pa.bool_())],
                ["record_id", "page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "intact"],
            )

    return whole.mapInArrow(decode, "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean")


PARSED = pa.schema([("record_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())])
PARSED_DDL = "record_id string, segment int, total long, page_id long, url string, record_type string, digest string, refers_to long, block binary, whole boolean"


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
