"""WARC archives: records written from rows, and read back with their segments put together.

Writing: a row's payload is the body of an HTTP response in chunked framing. Of rows with equal payloads one is written
as a response, the others as revisits of it. A record larger than segment_bytes becomes a first segment and continuation
records, which may lie anywhere in the archive. Files are written by Spark's own text writer, a record a line, so
they appear as a whole or not at all, and a lost executor costs its own files only.

Reading: a file is parsed by the lengths that its records state. Continuation records meet by the identifier of the
record that they go on with, in the order of their segment numbers; what they make has to have the total length that the
last one states. Then chunks are joined and the payload is held against its digest. What fails has a status that says so.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Saved, join_unique, shared_folder, until_exit
from millrace.ship import ship

#: Fixed values of the format: the end of a line and of a record, and what a revisit of an equal payload refers to.
EOL, GAP = b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A chunk of a response's body.
CHUNK = 8192
#: Rows go between Python and Spark in batches of about so many bytes.
BATCH = 4_000_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes | None:
    """The body in chunked framing, None if the framing is broken or cut off. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(EOL, at)
        if end < 0:
            return None
        try:
            n = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or data[at + n : at + n + 2] != EOL:
            return None
        out.append(data[at : at + n])
        at += n + 2


def _name(row_id: object, digest: str, uri: str | None) -> str:
    """The identifier of a row's record, the same wherever it is worked out; the id stands as it does in an archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join((repr(row_id if row_id is None else _clean(row_id)), digest, repr(uri))))}>"


def _clean(value: object) -> str:
    """A header's value: line ends and percent signs are escaped."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + EOL + block


def records_of(row_id: object, uri: str | None, payload: bytes, first: object, first_uri: str | None, date: str, segment_bytes: int, revisit: bool) -> Iterator[bytes]:
    """The records of a row, without the gap that ends each: one, or a first segment and its continuations."""
    digest = base32_sha1(payload)
    name = _name(row_id, digest, uri)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Row", row_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        of = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(first, digest, first_uri)), ("WARC-Refers-To-Row", first)]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *of, kind], HTTP + EOL)
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(block) <= segment_bytes:
        yield _record([*head, kind], block)
        return
    yield _record([*head, ("WARC-Segment-Number", 1), kind], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = at + segment_bytes >= len(block)
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", _name(f"{row_id} {number}", digest, uri)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        yield _record([*own, ("WARC-Segment-Total-Length", len(block) if last else None)], block[at : at + segment_bytes])


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 200
        if size >= BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def write_warc(rows: DataFrame, path: str, id_col: str, uri_col: str, text_col: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, segment_bytes: int = 1 << 20, records_per_file: int = 1000) -> None:
    """A record for each row, in gzip files of at most records_per_file records below path, which must not exist.

    Of rows whose payloads of at least min_bytes are equal, those of the greatest id are responses and the others
    revisit one of them; of ids that are all null all are responses. A null text is an empty payload; a null id or
    address is left out; repeated rows are written each; an empty table makes an empty archive; other columns are not
    read. The writer has no clock: date is the records' own.
    """
    spark = ship(rows.sparkSession)
    if segment_bytes < 1:
        raise ValueError("a segment has a byte at least")
    own = rows.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("same", F.sha2("payload", 256))
    sizes = own.filter(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.max(F.struct("id", "uri")).alias("first"), F.count("*").alias("n"))
    first = Saved(sizes.filter("n > 1 and first.id is not null"))
    copies = join_unique(own, first.df, ["same"], how="left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")))
    dealt = copies.select(F.col("id").cast("string").alias("id"), "uri", "payload", F.col("first.id").cast("string").alias("of"), F.col("first.uri").alias("of_uri"), "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row_id, uri, payload, of, of_uri, revisit = (c[i].as_py() for c in batch.columns)
                    for record in records_of(row_id, uri, payload, of, of_uri, date, segment_bytes, revisit):
                        yield (record,)

        yield from _batches(found(), ["record"], [pa.binary()], lambda r: len(r[0]))

    lines = dealt.mapInArrow(write, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", GAP.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)
    first.drop()


def _inflated(content: bytes) -> tuple[bytes, bool]:
    """The content of a plain or gzip file of one or more members, and whether it is whole."""
    if content[:2] != b"\x1f\x8b":
        return content, True
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            return b"".join(out), False
        if not member.eof:
            return b"".join(out), False
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out), True


def parsed(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(fields by lower-cased name, block) of each record; None for a stretch that is no record or is cut off, whose block it is."""
    at = 0
    while at < len(data):
        end = data.find(GAP, at)
        head = data[at:end].split(EOL) if end >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in head[1:])}
        size = fields.get("content-length", "")
        if head and head[0].startswith(b"WARC/1.") and size.isdecimal() and end + 4 + int(size) <= len(data):
            begin = end + 4
            yield fields, data[begin : begin + int(size)]
            at = begin + int(size)
            while data[at : at + 2] == EOL:
                at += 2
            continue
        after = data.find(GAP + b"WARC/1.", at)
        stop = len(data) if after < 0 else after + 4
        yield None, data[at:stop]
        at = stop


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP response without its transfer framing, None if it is no whole response."""
    head, gap, body = block.partition(GAP)
    if not gap or not head.startswith(b"HTTP/"):
        return None
    coding = next((v for k, _, v in (line.partition(b":") for line in head.split(EOL)[1:]) if k.strip().lower() == b"transfer-encoding"), b"")
    return dechunked(body) if coding.strip().lower() == b"chunked" else body


COLUMNS = "record string, type string, row string, uri string, digest string, of string, of_row string, number int, total long, bytes long, status string, block binary, payload binary"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in COLUMNS.split(", ")]


def _judged(digest: str | None, block: bytes, payloads: bool) -> tuple[str | None, int | None, str, bytes | None]:
    """(digest, bytes, status, payload) of a whole response's block whose record states the digest."""
    payload = payload_of(block)
    if payload is None:
        return digest, None, "framing", None
    found = base32_sha1(payload)
    return found, len(payload), "ok" if digest in (None, found) else "digest", payload if payloads else None


def _read(payloads: bool) -> Callable:
    def rows(data: bytes, whole: bool) -> Iterator[tuple]:
        for fields, block in parsed(data):
            if fields is None:
                yield (*[None] * 10, "malformed", None, None)
                continue
            get = fields.get
            digest = (get("warc-payload-digest") or "").removeprefix("sha1:") or None
            number = int(n) if (n := get("warc-segment-number", "")).isdecimal() else None
            total = int(n) if (n := get("warc-segment-total-length", "")).isdecimal() else None
            kind, of = get("warc-type"), get("warc-segment-origin-id") or get("warc-refers-to")
            n_bytes, status, held, payload = None, "ok", None, None
            if number is not None:
                held, n_bytes, status = block, None, "segment"
            elif kind == "response":
                digest, n_bytes, status, payload = _judged(digest, block, payloads)
            yield get("warc-record-id"), kind, _plain(get("warc-row")), _plain(get("warc-target-uri")), digest, of, _plain(get("warc-refers-to-row")), number, total, n_bytes, status, held, payload
        if not whole:
            yield (*[None] * 10, "malformed", None, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    yield from rows(*_inflated(content.as_py()))

        yield from _batches(found(), _NAMES, _TYPES, lambda r: len(r[-1] or b"") + len(r[-2] or b""))

    return read


def _reassemble(payloads: bool) -> Callable:
    def join(segments: pa.Table) -> pa.Table:
        """The record of a group of (origin, number, copies, record, ...) segments; copies of the record are told by the first's."""
        parts = sorted(segments.to_pylist(), key=lambda s: s["number"])
        first, block = parts[0], b"".join(s["block"] for s in parts)
        if [s["number"] for s in parts] != list(range(1, len(parts) + 1)) or first["type"] == "continuation":
            judged = first["digest"], None, "segments", None
        elif parts[-1]["total"] != len(block):
            judged = first["digest"], None, "length", None
        elif first["type"] != "response":
            judged = first["digest"], None, "ok", None
        else:
            judged = _judged(first["digest"], block, payloads)
        digest, n_bytes, status, payload = judged
        row = {**first, "digest": digest, "bytes": n_bytes, "status": status, "block": None, "payload": payload}
        return pa.table([pa.array([row[n]], t) for n, t in zip([*_NAMES, "copies"], [*_TYPES, pa.int64()], strict=True)], [*_NAMES, "copies"])

    return join


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each whole record, and for each stretch of a file that is none:

    record: its identifier; type; row, uri: the row's id as text and its address; digest: of the payload, bare SHA-1 in
    base32; of, of_row: what a revisit refers to; bytes: of the whole payload, of a revisit those of what it refers to,
    null where that is not there; payload: only if asked for, and none of revisits; status: ok, malformed (no record, or
    cut off), segments (some are missing), length (not the stated total), framing (broken chunks, or no response),
    digest (not the stated one), dangling (a revisit of nothing).

    A record that occurs again gives a row again. Files are plain or gzip, each read as a whole, so they should be of a
    moderate size; an archive without files gives no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    read = Saved(files.select("content").mapInArrow(_read(payloads), COLUMNS)).df
    segments = read.filter("number is not null").withColumn("origin", F.when(F.col("type") == "continuation", F.col("of")).otherwise(F.col("record")))
    # a record that occurs often is put together once
    rest = F.min(F.struct(*[c for c in _NAMES if c != "number"])).alias("rest")
    astray = segments.filter("origin is null").withColumn("status", F.lit("segments")).drop("origin")
    once = segments.filter("origin is not null").groupBy("origin", "number").agg(F.count("*").alias("copies"), rest).select("origin", "number", "copies", "rest.*")
    joined = once.groupBy("origin").applyInArrow(_reassemble(payloads), f"{COLUMNS}, copies long")
    again = Saved(joined).df.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "nth")
    records = read.filter("number is null").unionByName(again).unionByName(astray).drop("number", "total", "block")
    revisits = records.filter("type = 'revisit'").withColumnRenamed("of", "target").drop("bytes", "status")
    uses = revisits.groupBy("target").agg(F.count("*").alias("uses"))
    aims = records.filter("type = 'response' and bytes is not null").groupBy(F.col("record").alias("target")).agg(F.max("bytes").alias("bytes"))
    aims = uses.join(aims, "target", "left").withColumn("status", F.when(F.col("bytes").isNull(), "dangling").otherwise("ok"))
    known = join_unique(revisits, aims, ["target"], n="uses").withColumnRenamed("target", "of")
    lost = revisits.filter("target is null").select("*", F.lit(None).cast("long").alias("bytes"), F.lit("dangling").alias("status")).withColumnRenamed("target", "of")
    return records.filter("type is null or type != 'revisit'").unionByName(known).unionByName(lost)


def archived(rows: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 0, segment_bytes: int = 1 << 20, records_per_file: int = 1000) -> DataFrame:
    """rows written to an archive in the shared folder and read back: (id, payload_bytes, payload_digest, record_type, refers_to), a row for each.

    What is written, and how nulls, empty texts and repeated rows are, is said at write_warc. A record that cannot be read back is an error.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(rows, path, id_col, uri_col, text_col, min_bytes=min_bytes, segment_bytes=segment_bytes, records_per_file=records_per_file)
    until_exit(spark, path)
    kind = dict(rows.select(id_col).dtypes)[id_col]
    read = read_warc(spark, path)
    good = F.when(F.col("status") == "ok", F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("a record was read back as "), "status")).cast("long"))
    return read.select(F.col("row").cast(kind).alias(id_col), good.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_row").cast(kind).alias("refers_to"))
