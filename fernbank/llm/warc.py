r"""WARC archives: written, read back, and assembled into one nested row for each capture.

A capture is a transaction of three records: a request, a response (or a revisit,
whose payload an earlier response holds) and a metadata record. Request and
metadata name the response's record id in ``WARC-Concurrent-To``.

Archives are written by Spark's text writer: a row is one record and the line
separator is the blank line that ends a record, so files are ordinary WARC 1.1 in
gzip and are committed like any other output. They are read as binary files, unpacked
record by record, parsed by ``Content-Length`` alone (a payload may hold anything), and
their records are joined through the concurrent-to ids. Only record heads meet in the joins
unless payloads are asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .memory import stream

#: Equal payloads of fewer bytes than this are stored again, not revisited.
REVISIT_BYTES = 100
#: Records and, about, payload bytes in one archive file.
FILE_RECORDS, FILE_BYTES = 3000, 64 << 20
_FLUSH = 8 << 20
CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ANCHORS = ("response", "revisit", "resource")


def _uuid(kind: str, key: Column) -> Column:
    """A record id made from the capture's key, the same whenever it is made."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # concat_ws leaves out headers that are null
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def captures(pages: DataFrame, *, page: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, bytes, digest, original``: ``original`` is the page that holds the payload, null for its own.

    Of pages with equal payloads of at least ``revisit_bytes``, the one with the
    smallest id holds it (a page without an id never does, unless all lack one: then
    each holds its own). All rows of the holder's id hold it.
    """
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original")
    joined = rows.join(first, "digest", "left")
    own = F.col("original").isNull() | F.col("original").eqNullSafe(F.col("page_id"))
    return joined.withColumn("original", F.when(~own, F.col("original")))


def records(found: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``value``: three rows for each capture, each one whole WARC record without its closing blank line.

    Record ids are made from page id, payload digest and ``nth``, which numbers rows
    that repeat both.
    """
    key = F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.col("nth").cast("string"))
    rid = {k: _uuid(k, key) for k in ("request", "response", "metadata")}
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")  # no header can be broken by a page's address
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    host = F.coalesce(F.try_parse_url(F.regexp_extract("url", r"^https?://[A-Za-z0-9.:-]+", 0), F.lit("HOST")), F.lit("-"))
    request = _record("request", rid["request"], [*common, ("WARC-Concurrent-To", rid["response"]), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", rid["response"], [*common, digest, kind], F.concat(http, F.col("payload")))
    first_id = _uuid("response", F.concat_ws("\x1f", F.col("original").cast("string"), "digest", F.lit("0")))
    revisit = _record("revisit", rid["response"], [*common, ("WARC-Refers-To", first_id), ("WARC-Profile", F.lit(_PROFILE)), digest, kind], http)
    fields = F.concat_ws(CRLF, F.concat(F.lit("page_id: "), F.col("page_id").cast("string")), F.concat(F.lit("nth: "), F.col("nth").cast("string")))
    metadata = _record("metadata", rid["metadata"], [*common, ("WARC-Concurrent-To", rid["response"]), ("Content-Type", F.lit("application/warc-fields"))], fields)
    answer = F.when(F.col("original").isNull(), response).otherwise(revisit)
    return found.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_archives(pages: DataFrame, target: str, *, page: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write every page as a transaction of three records into gzip WARC files under ``target``.

    A null payload is an empty one. A null address is left out of the headers, and
    white space and control characters in one become ``_``. Repeated rows are
    captures of their own. An empty table writes no record.
    """
    found = captures(pages, page=page, url=url, payload=payload, revisit_bytes=revisit_bytes)
    ids = pages.select(F.col(page).cast("long").alias("page_id"), F.xxhash64(F.coalesce(F.col(payload), F.lit(""))).alias("h"), F.octet_length(F.col(payload)).alias("bytes"))
    rows, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not ids.groupBy("page_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # a page without an id is no record's original, so any number of its own will do and no window gathers such pages
        lone, named = found.where("page_id is null").withColumn("nth", F.monotonically_increasing_id()), found.where("page_id is not null")
        found = named.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")).cast("long") - 1).unionByName(lone)
    else:
        found = found.withColumn("nth", F.lit(0))
    in_file = max(1, min(file_records, 3 * rows * FILE_BYTES // max(1, size)))
    records(found).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", in_file).text(target)


def _unpacked(data, step: int) -> Iterator[bytes]:
    """The archive's bytes in pieces; gzip members are unpacked one after the other."""
    view, packed = memoryview(data), bytes(memoryview(data)[:2]) == b"\x1f\x8b"
    member = zlib.decompressobj(31)
    for at in range(0, len(view), step):
        piece = view[at : at + step]
        if not packed:
            yield bytes(piece)
            continue
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def parse(data, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of one archive, gzip members and all.

    Linear in the archive, which may be any buffer; no more than one record and a piece
    of ``step`` bytes is unpacked at once.
    """
    pieces, held = _unpacked(data, step), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while True:
            while len(held) < 2 and more():
                pass
            if held[:2] != b"\r\n":
                break
            del held[:2]
        if not held:
            return
        seen = 0
        while (head := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("a record's head is cut short")
        lines = held[:head].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record but {lines[0][:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        stop = head + 4 + int(headers["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError("a record is cut short")
        yield headers, bytes(held[head + 4 : stop])
        del held[:stop]


_HEADS = "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, block_bytes long, payload_bytes long, payload_sha256 string, fields string, payload binary"


def _parsed(with_payload: bool):
    names = [x.split()[0] for x in _HEADS.split(", ")]
    kinds = {"block_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def made(cols: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[n], kinds.get(n, pa.string())) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                cols: dict[str, list] = {n: [] for n in names}
                size = 0
                for h, block in parse(content.as_buffer()):
                    kind = h.get("warc-type")
                    body, fields = None, None
                    if "msgtype=response" in h.get("content-type", ""):
                        body = block.partition(b"\r\n\r\n")[2]
                    elif kind == "resource":
                        body = block
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    stored = body if kind != "revisit" else None
                    row = (
                        kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                        h.get("warc-payload-digest", "").removeprefix("sha256:") or None, len(block), None if stored is None else len(stored),
                        None if stored is None else hashlib.sha256(stored).hexdigest(), fields, stored if with_payload else None,
                    )
                    for n, v in zip(names, row):
                        cols[n].append(v)
                    size += 1000 + len(stored or b"") * with_payload
                    if size >= _FLUSH:
                        yield made(cols)
                        cols, size = {n: [] for n in names}, 0
                yield made(cols)

    return run


def read_records(spark: SparkSession, target: str, *, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under ``target``. Payload lengths and hashes are of the stored payload itself."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("content")
    return files.mapInArrow(stream(_parsed(with_payload)), _HEADS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``id, uri, date, response, requests, metadata``.

    A request or metadata record belongs to the response, revisit or resource that its
    concurrent-to id names, directly or through one other record of the transaction.
    A record whose capture is not in the archives belongs to none. A revisit's
    ``response`` has the payload length of the response that it refers to.
    """
    heads = records.where(F.col("id").isNotNull())
    anchor = F.col("type").isin(*_ANCHORS)
    anchors = heads.where(anchor)
    others = heads.where(~anchor & F.col("concurrent_to").isNotNull()).select("type", "id", F.col("concurrent_to").alias("to"), "uri", "date", "fields")
    # an id that names another record of the transaction, not the capture, is followed once
    via = others.select(F.col("id").alias("via"), F.col("to").alias("next"))
    anchor_links = anchors.where(F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("via"), F.col("id").alias("next"))
    hops = via.unionByName(anchor_links)
    targets = others.select("type", "id", "to", "uri", "date", "fields").unionByName(
        others.join(hops, others["to"] == hops["via"]).select("type", "id", F.col("next").alias("to"), "uri", "date", "fields")
    )
    own = others.join(anchor_links, others["id"] == anchor_links["via"]).select("type", "id", F.col("next").alias("to"), "uri", "date", "fields")
    targets = targets.unionByName(own).distinct()
    part = F.struct("id", "uri", "date", "fields")
    grouped = targets.groupBy(F.col("to").alias("capture")).agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", part))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", part))).alias("metadata"),
    )
    stored = anchors.where(F.col("type") != "revisit").select(F.col("id").alias("original"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_sha256").alias("original_sha256"))
    full = anchors.join(stored, anchors["refers_to"] == stored["original"], "left")
    response = F.struct(
        "type", "id", "refers_to", "digest",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("payload_sha256", "original_sha256").alias("payload_sha256"),
        "payload",
    )
    none = F.array().cast("array<struct<id:string,uri:string,date:string,fields:string>>")
    nested = full.join(grouped, full["id"] == grouped["capture"], "left")
    return nested.select("id", "uri", "date", response.alias("response"), F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def metadata_field(name: str) -> Column:
    """A field of the capture's first metadata record, or null."""
    value = F.regexp_extract(F.get("metadata", F.lit(0))["fields"], rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)
