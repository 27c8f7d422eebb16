"""WARC archives: segmented writing, and reassembly of segments when they are read.

Records are rows of a text file whose line separator is the two empty lines that end a record, so Spark's own writer
makes valid archives on any file system.  A file holds at most `records_per_file` blocks of at most `segment_bytes`,
so reading whole files needs bounded memory.  When archives are read, a record in one piece is decoded where it is
found; continuation records are grouped by the identifier of their first segment, put in the order of their segment
numbers, verified against the total length, and only then freed of the chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import narrow, read
from .storage import shared_dir

END = "\r\n\r\n"
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
RAW = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, origin_id string, segment int, total long, block binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = 8192) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = (body[i : i + size] for i in range(0, len(body), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body; extensions and trailers are left out.  ValueError if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(framed[at : at + size])
        at += size + 2


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the empty lines at its end; fields that are None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}{END}".encode() + block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def http_message(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and body, freed of chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _uri(text: str | None) -> str | None:
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 32_768, records_per_file: int = 1_024, revisit_bytes: int = 0) -> None:
    """A record per row of pages (page_id, url, html; other columns are left out) under `path`.

    Of rows with equal payloads of at least `revisit_bytes` bytes, those with the smallest page_id are responses and
    the others revisit records, which refer to the first of these responses; a null page_id comes last.  A null html is
    the empty payload, a null url leaves the target out.  Rows that repeat a page_id with the same payload have the same
    type but records of their own.  Records are named by page_id and the place of the row in the table, which is read
    twice and must come in the same order, as files do.
    """
    rows = narrow(pages, page_id="page_id", url="url", html="html").withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).drop("html")
    rows = rows.withColumns({"sha": F.sha1("payload"), "row": F.monotonically_increasing_id()})
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row"))
    shared = rows.where(F.length("payload") >= revisit_bytes).groupBy("sha").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    # a payload may be that of a third of all pages: its rows meet its entry under one of several salts
    shared = shared.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(shared, ["sha", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = rows.select("page_id", "url", "payload", "row", F.when(again, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                out += _page_records(r, segment_bytes)
                held += len(r["payload"])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    out = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _name(page: dict) -> str:
    """A record's identifier, of page_id and row."""
    return f"<urn:page:{'' if page['page_id'] is None else quote(str(page['page_id']), safe='')}:{page['row']}>"


def _page_records(r: dict, segment_bytes: int) -> list[bytes]:
    name = _name(r)
    common = {"WARC-Record-ID": name, "WARC-Target-URI": _uri(r["url"]), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest(r['payload'])}", "Content-Type": "application/http;msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if r["first"]:
        extra = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _name(r["first"])}
        return [record({"WARC-Type": "revisit"} | common | extra, head + b"Content-Length: %d\r\n\r\n" % len(r["payload"]))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"])
    if len(block) <= segment_bytes:
        return [record({"WARC-Type": "response"} | common, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record({"WARC-Type": "response"} | common | {"WARC-Segment-Number": "1"}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:{k}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": str(k)}
        out.append(record(fields | ({"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}), part))
    return out


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under `path`, as it stands; origin_id is set for records in several segments."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_buffer().to_pybytes()
                out, held = [], 0
                for f, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    number, name = f.get("warc-segment-number"), f["warc-record-id"]
                    sha = f.get("warc-payload-digest")
                    out.append((name, f["warc-type"], f.get("warc-target-uri"), sha and sha.removeprefix("sha1:"), f.get("warc-refers-to"), f.get("warc-segment-origin-id", name) if number else None, number and int(number), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RAW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest of each record.

    payload is null for a revisit record, whose payload_bytes and digest are those it states.  A missing segment, a
    wrong total length, broken framing or a digest that doesn't fit ends the job with an error.
    """
    raw = read_segments(spark, path)
    whole = raw.where("origin_id is null").select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", F.array("block").alias("blocks"))
    piece = F.struct("segment", "total", "block", "record_type", "target_uri", "payload_digest", "refers_to")
    groups = raw.where("origin_id is not null").groupBy(F.col("origin_id").alias("record_id")).agg(F.array_sort(F.collect_list(piece)).alias("parts"))  # the segments of one record
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"]))
    fits = in_order & (last["total"] == length)
    blocks = F.when(fits, F.transform("parts", lambda p: p["block"])).otherwise(F.raise_error(F.concat(F.lit("segments are missing or don't have the total length: "), "record_id")).cast("array<binary>"))
    joined = groups.select("record_id", first["record_type"].alias("record_type"), first["target_uri"].alias("target_uri"), first["payload_digest"].alias("payload_digest"), first["refers_to"].alias("refers_to"), blocks.alias("blocks"))
    rows = whole.unionByName(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, sizes = [], []
            for kind, name, sha, blocks in zip(*(batch.column(c) for c in ("record_type", "record_id", "payload_digest", "blocks")), strict=True):
                fields, body = http_message(b"".join(b.as_buffer() for b in blocks.values))
                kind, name, sha = kind.as_py(), name.as_py(), sha.as_py()
                if kind == "revisit":
                    payloads.append(None)
                    sizes.append(int(fields["content-length"]))
                    continue
                if digest(body) != sha:
                    raise ValueError(f"the payload of {name} doesn't have its digest")
                payloads.append(body)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to")), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), batch.column("payload_digest")], names=["record_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest"])

    return rows.mapInArrow(run, "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def page_of(name: str, kind: T.DataType):
    """The page_id in a record's identifier; null for the null one (and for the empty text)."""
    text = F.url_decode(F.regexp_extract(name, r"^<urn:page:([^>:]*)", 1))
    return F.when(text != "", text).cast(kind)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each of all `pages`, written and read back; see `write_archives` and `read_archives` for nulls, repeated rows, ties and empty tables."""
    pages = read(spark, sf_dir, "pages")
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page_of("refers_to", kind)).alias("refers_to"))


QUERIES = {"op1_warc": op1_warc}
