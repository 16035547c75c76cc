"""WARC archives: written by Spark's text writer, read line by line, assembled into one nested row per capture.

A capture is three records: a request, a response (or a revisit, where an earlier response has the same payload) and
a metadata record.  Request and metadata name the response in ``WARC-Concurrent-To``; the assembly joins on that.

Archives are gzip-compressed files whose records end, as the format asks, with two line ends.  Spark's writer puts
them there as its line separator, so any file system that Spark can write to will do.  They are read as lines that
end with CR LF; a gzip file is never split, so one task sees the lines of a file in order and puts each block
together again by its ``Content-Length``, one record at a time in memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
RECORDS_PER_FILE = 100_000
PRIMARY = ("response", "revisit", "resource", "conversion")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to_id string,"
    " payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def base32_of_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1: five hexadecimal digits are four letters."""
    letters = []
    for k in range(8):
        value = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(value, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def record_uuid(kind: str, key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), key.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """Text of a record without the two line ends after it; a header with a null value is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines.append(F.concat(F.lit("WARC-Record-ID: "), record_id))
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def write_archives(
    captures: DataFrame, folder: str, id_column: str, uri_column: str, payload_column: str,
    date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0,
) -> None:
    """Three records a row.  Of equal payloads of at least ``min_revisit_bytes``, that with the smallest id is the
    response and the others revisit it; smaller payloads are all responses.

    A null payload is empty.  Rows equal in id and payload are one capture when read back; rows with the same id and
    other payloads are captures of their own.  A null id gets no ``page-id`` field.  Line ends in a URI are escaped.
    """
    payload = text_of(payload_column)
    uri = F.regexp_replace(F.regexp_replace(F.col(uri_column), "\r", "%0D"), "\n", "%0A")
    rows = captures.select(F.col(id_column).alias("id"), uri.alias("uri"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    # Grouped by the binary digest and joined on its letters: both sides of the join are then exchanged for it, and
    # Spark can split a payload that many rows share.
    firsts = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy(F.unhex("sha1").alias("raw"))
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select(F.lower(F.hex("raw")).alias("of_sha1"), "first_id")
    )
    found = rows.join(firsts, F.col("sha1") == F.col("of_sha1"), "left")
    revisit = F.coalesce(~F.col("first_id").eqNullSafe(F.col("id")) & F.col("first_id").isNotNull(), F.lit(False))
    digest = base32_of_sha1(F.col("sha1"))
    found = found.withColumns({"digest": digest, "revisit": revisit})
    main_id = record_uuid("capture", F.col("id"), F.col("digest"))
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    same = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.lit(date))]
    linked = [*same, ("WARC-Concurrent-To", main_id)]
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    main = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), main_id,
        [*same, ("Content-Type", F.lit("application/http; msgtype=response")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)),
         ("WARC-Refers-To", F.when(F.col("revisit"), record_uuid("capture", F.col("first_id"), F.col("digest"))))],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        "request", record_uuid("request", F.col("id"), F.col("digest")),
        [*linked, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)),
    )
    fields = F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit(""))
    metadata = _record(
        "metadata", record_uuid("metadata", F.col("id"), F.col("digest")),
        [*linked, ("Content-Type", F.lit("application/warc-fields"))], fields,
    )
    text = F.concat_ws(END + END, request, main, metadata)
    found.select(text.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(folder)


class _Reader:
    """Lines of one file to records; lines come without their CR LF."""

    def __init__(self) -> None:
        self.header: list[bytes] | None = None
        self.block: list[bytes] | None = None
        self.need = self.have = 0

    def idle(self) -> bool:
        return self.header is None and self.block is None

    def feed(self, line: bytes) -> tuple[dict[str, list[str]], bytes] | None:
        if self.block is not None:
            self.have += len(line) + (2 if self.block else 0)
            self.block.append(line)
            if self.have < self.need:
                return None
            if self.have > self.need:
                raise ValueError("a WARC block is longer or shorter than its Content-Length")
            out = self.fields, b"\r\n".join(self.block)
            self.block = None
            return out
        if self.header is None:
            if line.startswith(b"WARC/"):
                self.header = []
            elif line:
                raise ValueError("a WARC record does not begin with its version")
            return None
        if line:
            self.header.append(line)
            return None
        self.fields = _fields(self.header)
        self.header, self.block, self.have = None, [], 0
        self.need = int(self.fields["content-length"][0])
        return None


def _fields(lines: list[bytes]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found.setdefault(name.strip().lower(), []).append(value.strip())
    return found


def _row(fields: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    one = lambda name: fields.get(name, [None])[0]
    kind, content, extra, payload = one("warc-type"), one("content-type") or "", {}, None
    digest, size = (one("warc-payload-digest") or "").removeprefix("sha1:") or None, None
    if content.startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        first, *rest = head.split(b"\r\n")
        http = _fields(rest)
        extra = {"start-line": first.decode("utf-8", "replace"), **{k: v[0] for k, v in http.items()}}
        if kind == "revisit":
            size = int(http.get("content-length", ["0"])[0])
        else:
            payload = body
    elif content.startswith("application/warc-fields"):
        extra = {k: v[0] for k, v in _fields([x for x in block.split(b"\r\n") if x]).items()}
    else:
        payload = block
    if payload is not None and kind in PRIMARY:
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest is not None and digest != real:
            raise ValueError(f"payload of {one('warc-record-id')} does not have its digest")
        digest, size = real, len(payload)
    return (
        one("warc-record-id"), kind, one("warc-target-uri"), fields.get("warc-concurrent-to", []), one("warc-refers-to"),
        digest, size, list(extra.items()), payload if with_payload else None,
    )


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row a record.  Digest and size are those of the payload that was read (a revisit: those it states); a block
    that is not as long as it says, or not what its digest says, fails the job.  Only ``*.gz`` files are read."""
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(folder).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file")
    )
    kinds = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())),
        ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = _Reader(), None
        for batch in batches:
            out = []
            files = batch.column(1).dictionary_encode()
            names, codes = files.dictionary.to_pylist(), files.indices.to_pylist()
            for line, code in zip(batch.column(0).to_pylist(), codes):
                if names[code] != file:
                    if not reader.idle():
                        raise ValueError(f"{file} ends inside a record")
                    file = names[code]
                if (record := reader.feed(line)) is not None:
                    out.append(_row(*record, with_payload))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        if not reader.idle():
            raise ValueError(f"{file} ends inside a record")

    return lines.mapInArrow(parse, RECORD)


def assemble(records: DataFrame, hops: int = 1) -> DataFrame:
    """One nested row a capture; ``records`` is read twice and should be stored first.  A capture is the response or revisit with arrays of its requests, metadata and other records.

    Records find their response through ``concurrent_to``.  With ``hops`` above 0 a record may also be named by its
    response, or name another request or metadata record that is so many links from it.  Records without a
    response form captures with null response columns, so none is lost; repeated records are kept once.
    """
    primary = F.col("record_type").isin(*PRIMARY)
    mains = records.where(primary).dropDuplicates(["record_id"])
    others = records.where(~primary | F.col("record_type").isNull()).dropDuplicates(["record_id"]).select(
        "record_id", "record_type", "target_uri", "fields", F.get("concurrent_to", F.lit(0)).alias("root")
    )
    if hops:
        named = mains.select(F.explode("concurrent_to").alias("of_id"), F.col("record_id").alias("main_id")).groupBy("of_id").agg(F.min("main_id").alias("main_id"))
        others = others.join(named, F.col("record_id") == F.col("of_id"), "left").withColumn("root", F.coalesce("main_id", "root")).drop("of_id", "main_id")
    for _ in range(hops):
        onward = others.where("root is not null").groupBy(F.col("record_id").alias("of_id")).agg(F.min("root").alias("onward"))
        others = others.join(onward, F.col("root") == F.col("of_id"), "left").withColumn("root", F.coalesce("onward", "root")).drop("of_id", "onward")
    item = F.struct("record_id", "record_type", "target_uri", "fields")
    of_kind = lambda kind: F.filter("items", lambda x: x.record_type == kind)
    grouped = (
        others.groupBy(F.coalesce("root", "record_id").alias("of_root")).agg(F.collect_list(item).alias("items"))
        .select(
            "of_root", of_kind("request").alias("requests"), of_kind("metadata").alias("metadata"),
            F.filter("items", lambda x: ~F.coalesce(x.record_type, F.lit("")).isin("request", "metadata")).alias("others"),
        )
    )
    joined = mains.join(grouped, F.col("record_id") == F.col("of_root"), "full")
    return joined.select(
        F.coalesce("record_id", "of_root").alias("capture_id"), "record_type", "target_uri", "payload_digest", "payload_bytes",
        "refers_to_id", F.col("fields").alias("http"), "payload", "requests", "metadata", "others",
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """Digest columns of captures that carry a ``page-id``; a revisit gets the page of the response it names."""
    page = F.element_at(F.get("metadata", F.lit(0)).getField("fields"), "page-id").cast("long")
    rows = captures.select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "capture_id", "refers_to_id", "target_uri"
    )
    bare = lambda c: F.substring(c, 11, 36)  # noqa: E731  also makes both sides exchanged for the join, so that Spark can split a hot one
    named = rows.where("record_type = 'response'").select(bare("capture_id").alias("of_id"), F.col("page_id").alias("refers_to"))
    joined = rows.join(named, bare(F.col("refers_to_id")) == F.col("of_id"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
