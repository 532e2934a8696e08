"""Conversion of legacy ARC web archives into WARC: version-specific header lines, declared lengths, revisits of equal payloads."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemrank.llm.common import materialize, table
from tandemrank.llm.registry import query
from tandemrank.session import scratch_dir

# The record fields that the version blocks of ARC 1 and ARC 2 announce.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NEEDED = {"URL", "Archive-date", "Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_PAYLOAD, SALTS, OUT_BYTES = 1000, 64, 4 << 20
RANK_HEADER = "X-Page-Id"


def write_arcs(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped ARC files, one for each task, in turn of version 1 and 2.

    Each record is an HTTP answer whose body is the html's UTF-8 bytes (null: none); ``page_id`` travels in the header
    X-Page-Id (null: empty). White space in a url becomes %20 and a null or empty one "-". Files begin with their version
    block; Spark's text writer ends every record with the line feed that the format asks for. Dates follow from page_id.
    """
    html, number = F.coalesce("html", F.lit("")), F.spark_partition_id()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{RANK_HEADER}: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"),
    )
    url = F.coalesce(F.nullif(F.regexp_replace("url", r"[\s\p{Cntrl}]", "%20"), F.lit("")), F.lit("-"))
    when = F.date_format(F.timestamp_seconds(F.lit(820454400) + F.pmod(F.xxhash64("page_id"), F.lit(315360000))), "yyyyMMddHHmmss")
    name = F.concat(F.lit("pages-"), F.lpad(number.cast("string"), 6, "0"), F.lit(".arc"))
    second = number % 2 == 1
    size = F.octet_length("head") + F.octet_length("html")
    line = F.when(second, F.concat_ws(" ", "url", F.lit("0.0.0.0"), "when", F.lit("text/html 200"), F.md5(F.col("html").cast("binary")), F.lit("- 0"), "name", size))
    line = line.otherwise(F.concat_ws(" ", "url", F.lit("0.0.0.0"), "when", F.lit("text/html"), size))
    block = {v: f"{v} 0 tandemrank\n{FIELDS[v]}\n" for v in FIELDS}
    opening = lambda v, more: F.concat(F.lit("filedesc://"), "name", F.lit(" 0.0.0.0 19960101000000 text/plain"), F.lit(more), F.lit(f" {len(block[v])}\n{block[v]}\n"))
    first = F.when(F.col("nth") != 0, F.lit("")).when(second, opening(2, " 200 - - 0 -")).otherwise(opening(1, ""))
    rows = pages.select(
        html.alias("html"), head.alias("head"), url.alias("url"), when.alias("when"), name.alias("name"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"),
    )
    _write(rows.select(F.concat(first, line, F.lit("\n"), "head", "html")), path, "\n")


def _write(records: DataFrame, path: str, end: str) -> None:
    records.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _unpacked(data: bytes) -> io.BufferedReader:
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, 1 << 16)


def _taken(file: io.BufferedReader, size: int) -> bytes:
    """The next ``size`` bytes, fewer at the file's end; a wrong size costs no memory."""
    parts = []
    while size and (part := file.read(min(size, 1 << 22))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def warc_date(digits: str) -> str | None:
    """An ARC date of 8, 12, 14 or 17 digits as a WARC date; None if it is no date."""
    if len(digits) not in (8, 12, 14, 17) or not (digits.isascii() and digits.isdigit()):
        return None
    try:
        return datetime.datetime.strptime(digits[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def arc_records(data: bytes):
    """Records of an ARC file: ``(offset, fields, block, state)``, the version block first.

    ``fields`` maps the names that the version block announces to texts; they are taken from the line's right end, as urls may
    hold spaces. A block has its declared length. ``state`` is "ok", "truncated" (the file ends within the block) or
    "resumed" (what followed the record before was no header line and was passed over up to one). Without a version
    block the fields of version 1 hold. Damaged compression ends the file where it begins.
    """
    file, names, offset, state = _unpacked(data), FIELDS[1].split(" "), 0, "ok"
    try:
        while True:
            at, line = offset, file.readline()
            offset += len(line)
            if not line:
                return
            if not line.strip():
                continue
            here = FIELDS[2].split(" ") if line.startswith(b"filedesc:") and len(line.split()) == 10 else FIELDS[1].split(" ") if line.startswith(b"filedesc:") else names
            parts = line.decode("utf-8", "replace").strip().rsplit(" ", len(here) - 1)
            fields = dict(zip(here, parts))
            date, size = fields.get("Archive-date", ""), fields.get("Archive-length", "")
            if len(parts) != len(here) or not (date.isdigit() and 8 <= len(date) <= 17 and size.isascii() and size.isdigit() and len(size) < 19):
                state = "resumed"
                continue
            block = _taken(file, int(size))
            offset += len(block)
            if line.startswith(b"filedesc:"):
                told = block.decode("utf-8", "replace").split("\n")
                if len(told) > 1 and NEEDED <= set(told[1].strip().split(" ")):
                    names = told[1].strip().split(" ")
            yield at, fields, block, state if len(block) == int(size) else "truncated"
            state = "ok"
    except (EOFError, OSError, zlib.error):
        return


def _http(block: bytes) -> tuple[bytes, bytes] | None:
    """Head (with its empty line) and body of an HTTP answer, None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    cut = sum(min(ends)) if ends else len(block)
    return block[:cut], block[cut:]


def _header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.decode("utf-8", "replace").strip()
    return None


def _number(text: str | None) -> int | None:
    try:
        n = int(text) if text and len(text) < 21 else None
    except ValueError:
        return None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def synthesise(name: str, date: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    """What the WARC record of an ARC record has: identifier, date, type, media type, head and payload.

    The identifier follows from the archive's name and the record's offset, so a task that runs again gives the same one. The
    version block becomes "warcinfo", HTTP answers "response", all else (such as dns lookups) "resource".
    """
    kind, head, payload, media = "resource", b"", block, fields.get("Content-type") or "application/octet-stream"
    if fields["URL"].startswith("filedesc:"):
        kind, media = "warcinfo", "application/warc-fields"
        payload = f"software: tandemrank\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name}\r\n".encode()
    elif parts := _http(block):
        kind, media, (head, payload) = "response", "application/http; msgtype=response", parts
    seed = hashlib.sha1(f"{name}\0{offset}".encode("utf-8", "replace")).digest()[:16]
    return {
        "id": f"<urn:uuid:{uuid.UUID(bytes=seed, version=5)}>", "uri": fields["URL"], "date": warc_date(fields["Archive-date"]) or date,
        "kind": kind, "media": media, "ip": fields.get("IP-address", ""), "head": head, "payload": payload,
    }


def warc_record(made: dict, refers: tuple[str, str, str] | None = None) -> bytes:
    """The bytes of a record up to the end of its block; a revisit keeps the head and names the record it ``refers`` to."""
    block = made["head"] if refers else made["head"] + made["payload"]
    kind = "revisit" if refers else made["kind"]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {made['id']}", f"WARC-Date: {made['date']}"]
    if kind != "warcinfo":
        lines.append(f"WARC-Target-URI: {made['uri']}")
        if made["ip"] not in ("", "0.0.0.0", "-"):
            lines.append(f"WARC-IP-Address: {made['ip']}")
    if kind in ("response", "revisit"):
        lines.append(f"WARC-Payload-Digest: {_sha1(made['payload'])}")
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {refers[2]}"]
    lines += [f"WARC-Block-Digest: {_sha1(block)}", f"Content-Type: {made['media']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block


def warc_records(data: bytes):
    """``(headers, block)`` of each record of a WARC file, by its declared lengths; a cut last record is left out."""
    file = _unpacked(data)
    try:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers = {}
            while (line := file.readline()).strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                headers[key.strip().lower()] = value.strip()
            size = _number(headers.get("content-length"))
            if size is None or size < 0 or len(block := _taken(file, size)) < size:
                return
            yield headers, block
    except (EOFError, OSError, zlib.error):
        return


def _converted(data: bytes):
    """``(offset, state, made)`` of an ARC file's records; dates that are none become the version block's."""
    name, date = "", "1970-01-01T00:00:00Z"
    for offset, fields, block, state in arc_records(data):
        if fields["URL"].startswith("filedesc:"):
            name, date = fields["URL"].removeprefix("filedesc://"), warc_date(fields["Archive-date"]) or date
        yield offset, state, synthesise(name, date, offset, fields, block)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_index(spark: SparkSession, path: str, rank_header: str = RANK_HEADER) -> DataFrame:
    """One row for each record of the ARC files: place, state, WARC identifiers, and of HTTP answers what tells payloads apart."""
    schema = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("state", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("uri", pa.string()),
        ("date", pa.string()), ("bytes", pa.int64()), ("same", pa.binary()), ("turn", pa.int64()),
    ])

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                rows = []
                for offset, state, m in _converted(content.as_py()):
                    same = hashlib.sha256(m["payload"]).digest() if m["kind"] == "response" else None
                    turn = _number(_header(m["head"], rank_header))
                    rows.append((path.as_py(), offset, state, m["kind"], m["id"], m["uri"], m["date"], len(m["payload"]), same, turn))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    ddl = "path string, offset bigint, state string, kind string, id string, uri string, date string, bytes bigint, same binary, turn bigint"
    return _files(spark, path).mapInArrow(run, ddl)


def _lookup(rows: DataFrame, found: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` left joined to ``found`` on ``key``; a key that owns many rows is dealt to SALTS parts by ``spread``."""
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    asked = salted.filter(F.col(key).isNotNull()).select(key, "_salt").distinct().join(found, key)
    return salted.join(asked, [key, "_salt"], "left").drop("_salt")


def revisits(index: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``(path, offset, refers)`` of the answers whose payload, of ``least`` bytes or more, another answer stores.

    Of equal payloads the record with the largest ``turn`` is stored (none is the smallest; then the later date, path and
    offset).
    """
    own = index.filter((F.col("kind") == "response") & (F.col("bytes") >= least))
    last = F.max(F.struct("turn", "date", "path", "offset", "id", "uri")).alias("last")
    found = own.groupBy("same").agg(F.count("*").alias("n"), last).filter("n > 1").select("same", "last")
    each = _lookup(own.select("path", "offset", "same", "id"), found, "same", F.xxhash64("path", "offset"))
    return each.filter(F.col("last").isNotNull() & (F.col("last.id") != F.col("id"))).select(
        "path", "offset", F.struct("last.id", "last.uri", "last.date").alias("refers")
    )


def convert(spark: SparkSession, arcs: str, warcs: str, least: int = LEAST_PAYLOAD, rank_header: str = RANK_HEADER) -> None:
    """Write the WARC records of all ARC files of the folder ``arcs`` into gzipped files in the folder ``warcs``.

    Archives are read twice: once for the narrow index that finds equal payloads, once to write, together with the list
    of each archive's revisits. Records keep their order within an archive. Bytes of any encoding pass unchanged.
    """
    index = materialize(arc_index(spark, arcs, rank_header))
    lists = revisits(index, least).groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("revisits"))

    def run(batches):
        for b in batches:
            for content, own in zip(b.column("content"), b.column("revisits")):
                known = {r["offset"]: (r["refers"]["id"], r["refers"]["uri"], r["refers"]["date"]) for r in own.as_py() or []}
                rows, size = [], 0
                for offset, _, made in _converted(content.as_py()):
                    rows.append(warc_record(made, known.get(offset)))
                    size += len(rows[-1])
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    records = _files(spark, arcs).join(lists, "path", "left").select("content", "revisits").mapInArrow(run, "record binary")
    _write(records.select(F.col("record").cast("string")), warcs, "\r\n\r\n")


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of a folder, without blocks.

    ``id, kind, uri, date, refers`` (the identifier that a revisit names), ``turn`` (its X-Page-Id), ``payload_bytes`` and
    ``sha1`` (hex; of the payload as read, of revisits as stated), ``sound`` (block and payload have the stated digests).
    """
    schema = pa.schema([
        ("id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers", pa.string()), ("turn", pa.int64()),
        ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("sound", pa.bool_()),
    ])

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for h, block in warc_records(content.as_py()):
                    kind, stated = h.get("warc-type", ""), h.get("warc-payload-digest", "")
                    head, payload = _http(block) or (b"", block)
                    sha1 = hashlib.sha1(payload).hexdigest()
                    if kind == "revisit":
                        sha1 = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else None
                    sound = h.get("warc-block-digest") == _sha1(block) and (kind != "response" or stated == _sha1(payload))
                    rows.append((
                        h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), _number(_header(head, RANK_HEADER)),
                        None if kind == "revisit" else len(payload), sha1, sound,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    ddl = "id string, kind string, uri string, date string, refers string, turn bigint, payload_bytes bigint, sha1 string, sound boolean"
    return _files(spark, path).mapInArrow(run, ddl)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_turn`` of the record that a revisit refers to; a revisit takes its payload_bytes from there."""
    asked = F.struct("turn", "payload_bytes").alias("_found")
    targets = records.filter("kind = 'response'").select(F.col("id").alias("refers"), asked)
    each = _lookup(records, targets, "refers", F.xxhash64("id"))
    return each.withColumn("payload_bytes", F.coalesce("payload_bytes", "_found.payload_bytes")).withColumn("refers_turn", F.col("_found.turn")).drop("_found")


def convert_pages(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what is read back: the columns of ``resolved`` for each page.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns may have any names. Null html is an empty payload, null ids stay
    null and come before all others, a null url is "-". Repeated rows are records of their own: of equal payloads one is stored,
    also among equal ids. An empty table gives archives without records and no rows.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    write_arcs(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", least)
    back = materialize(read_warcs(spark, f"{folder}/warc"))
    return resolved(back).filter("kind <> 'warcinfo'")


_SQL = """
WITH each AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM each
"""


@query("op11_arc_to_warc", _SQL)
def op11(spark, sf_dir):
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    got = convert_pages(table(spark, sf_dir, "pages"), folder)
    return got.select(
        F.col("turn").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.col("refers_turn")).alias("refers_to"),
    )
