"""Legacy archives: ARC files are written, converted to WARC, and read back.

An ARC file opens with a version block that names its version and the fields of its record
headers; version 1 has five fields, version 2 ten.  The converter parses header lines by
the fields so declared, takes blocks by their declared lengths, and synthesises what WARC
has and ARC lacks: record ids (UUIDs of archive name and offset), ISO timestamps, record
types, and payload and block digests.  Among records of equal payloads of at least
``min_revisit`` bytes, that of the largest page id stays a response; the others become
revisits without payload that name it.

Archives are gzip files of one member a record, of about FILE_BYTES of blocks each, in the
shared folder.  Tasks write files under names of their own and return them as rows; only
files named in the written table of rows count, so a task that is run again leaves no
trace.  Payloads are never shuffled: the deduplication joins digests alone, and the
converter reads each archive again beside its decisions.

Defined results.  A null html is an empty payload.  A null url is ``unknown:``; white space
in urls is percent-encoded.  A null page id is written without its header, read back as
null, and counts as smaller than any other.  Among rows of equal payload and page id the
later archive record stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_path, written

FILE_BYTES = 8 << 20
MIN_REVISIT = 1000
_WINDOW = 1 << 16

# The header fields of both versions, as the format names them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str, write: bool):
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    system, path = fs.FileSystem.from_uri("s3://" + rest if scheme in ("s3a", "s3n") else uri)
    if write:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(uri: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, one at a time."""
    with _open(uri, False) as f:
        rest, at, offset = b"", 0, 0
        while True:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                window = rest or f.read(_WINDOW)
                if not window:
                    if parts:
                        raise ValueError(f"{uri}: the member at {offset} is cut off")
                    return
                parts.append(z.decompress(window))
                rest = z.unused_data
                at += len(window) - len(rest)
            yield offset, b"".join(parts)
            offset = at


# --- ARC ---------------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 heliogrid\n{ARC_FIELDS[version]}\n\n".encode()
    tail = {1: "", 2: "200 - - 0 " + name + " "}[version]
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, mime: str, block: bytes, version: int, offset: int, name: str) -> bytes:
    url = "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "unknown:"
    fields = [url, "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", zlib.crc32(block).to_bytes(4, "big").hex(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def parse_arc(content: bytes, fields: list[str]) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one ARC record, by the declared fields and length."""
    line, _, rest = content.partition(b"\n")
    words = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)  # only the url could hold a space
    if len(words) != len(fields):
        raise ValueError(f"an ARC header of {len(words)} fields; {len(fields)} are declared")
    header = dict(zip(fields, words))
    length = int(header["Archive-length"])
    if len(rest) < length:
        raise ValueError("an ARC block is shorter than its declared length")
    return header, rest[:length]


def read_arc(uri: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of every document record of an ARC file of either version."""
    records = members(uri)
    _, opening = next(records)
    head, _, body = opening.partition(b"\n")
    if not head.startswith(b"filedesc://"):
        raise ValueError(f"{uri}: no version block")
    version_line, names = body.decode().split("\n")[:2]
    version = int(version_line.split(" ")[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"{uri}: ARC version {version}")
    fields = names.split(" ")
    for offset, content in records:
        header, block = parse_arc(content, fields)
        yield offset, header, block


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), its fields and the payload of an HTTP response."""
    at = block.find(b"\r\n\r\n")
    head, payload = (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.lower()] = value.strip()
    return head, fields, payload


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Write pages as ARC files, their versions in turn.  Returns a row per file: file, records."""
    folder = fresh_path(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, records, size, n_files = None, "", 0, 0, 0

        def close():
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records], pa.int64())], names=["file", "records"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                payload = (html.as_py() or "").encode()
                own = "" if page.as_py() is None else f"X-Page-Id: {page.as_py()}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
                if out is not None and size + len(block) > FILE_BYTES:
                    yield close()
                if out is None:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    version = versions[n_files % len(versions)]
                    uri, records, size, n_files = f"{folder}/{name}", 0, 0, n_files + 1
                    out = _open(uri, True)
                    opening = _member(arc_version_block(name, version, date))
                    out.write(opening)
                    written_bytes = len(opening)
                data = _member(arc_record(url.as_py() or "", date, "text/html", block, version, written_bytes, name))
                out.write(data)
                written_bytes += len(data)
                records, size = records + 1, size + len(block)
        if out is not None:
            yield close()

    return written(pages.select(id_col, url_col, html_col).mapInArrow(run, "file string, records long"), "arc-files")


# --- WARC --------------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = WARC_VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, blank, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def iso_date(date: str) -> str:
    """ARC's digits, from 8 to 14 of them, as WARC's timestamp."""
    d = (date + "000000")[:14] if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _on_files(files: DataFrame, run, schema: str) -> DataFrame:
    """Apply run to file names, about one file a task."""
    n = max(1, min(files.count(), 20_000))
    return files.select("file").repartition(n).mapInArrow(run, schema)


def index(arcs: DataFrame) -> DataFrame:
    """file, offset, page_id, payload_bytes and SHA-1 of every record of ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for offset, _, block in read_arc(uri):
                    _, http, payload = split_http(block)
                    page = http.get("x-page-id")
                    rows.append((uri, offset, None if page is None else int(page), len(payload), hashlib.sha1(payload).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "offset", "page_id", "size", "digest"])

    return _on_files(arcs, run, "file string, offset long, page_id long, size long, digest string")


def convert(arcs: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Convert ARC files to WARC files.  Returns a row per file: file, records."""
    records = written(index(arcs), "arc-index")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "file", "offset"))
    keeper = records.filter(F.col("size") >= min_revisit).groupBy("digest", "size").agg(best.alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keeper = written(keeper.select("digest", "size", F.col("k.page_id").alias("to_page"), F.col("k.file").alias("to_file"), F.col("k.offset").alias("to_offset")), "arc-keepers")
    joined = records.join(keeper, ["digest", "size"], "left")
    is_revisit = F.col("to_file").isNotNull() & ~((F.col("file") == F.col("to_file")) & (F.col("offset") == F.col("to_offset")))
    decided = written(joined.select("file", "offset", F.coalesce(is_revisit, F.lit(False)).alias("revisit"), "to_page", "to_file", "to_offset"), "arc-decided")
    folder = fresh_path(arcs.sparkSession, "warc")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        uri = key[0].as_py()
        name = uri.rsplit("/", 1)[1]
        decisions = {r["offset"]: r for r in table.to_pylist()}
        target, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        with _open(target, True) as out:
            info = f"software: heliogrid\r\nformat: {WARC_VERSION}\r\nconverted-from: {name}\r\n".encode()
            out.write(_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", iso_date("")), ("Content-Type", "application/warc-fields")], info)))
            for offset, header, block in read_arc(uri):
                head, _, payload = split_http(block)
                d = decisions[offset]
                fields = [("WARC-Type", "revisit" if d["revisit"] else "response"), ("WARC-Record-ID", record_id(name, offset)), ("WARC-Date", iso_date(header["Archive-date"])), ("WARC-Target-URI", header["URL"]), ("WARC-IP-Address", header["IP-address"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _sha1(payload))]
                if d["revisit"]:
                    block = head
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(d["to_file"].rsplit("/", 1)[1], d["to_offset"])), ("WARC-Truncated", "length")]
                    if d["to_page"] is not None:
                        fields.append(("X-Refers-To-Page", str(d["to_page"])))
                fields.append(("WARC-Block-Digest", _sha1(block)))
                out.write(_member(warc_record(fields, block)))
                n += 1
        return pa.table({"file": [target], "records": pa.array([n], pa.int64())})

    # As many partitions as there are files, twice: Spark would put so small a table into one.
    dealt = decided.repartition(max(1, min(2 * arcs.count(), 20_000)), "file")
    return written(dealt.groupBy("file").applyInArrow(run, "file string, records long"), "warc-files")


def read_warc(warcs: DataFrame) -> DataFrame:
    """The page records of WARC files.

    Returns page_id, payload_bytes, payload_digest (hexadecimal SHA-1), record_type,
    refers_to (a page id), record_id, target_uri, warc_date, payload (null for revisits).
    A payload that does not match its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date", "payload"]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for _, content in members(uri):
                    f, block = parse_warc(content)
                    if f["WARC-Type"] not in ("response", "revisit"):
                        continue
                    _, http, payload = split_http(block)
                    page, to, full = http.get("x-page-id"), f.get("X-Refers-To-Page"), f["WARC-Type"] == "response"
                    if full and _sha1(payload) != f["WARC-Payload-Digest"]:
                        raise ValueError(f"{uri}: a payload does not match its digest")
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((None if page is None else int(page), len(payload) if full else int(http["content-length"]), digest, f["WARC-Type"], None if to is None else int(to), f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"], payload if full else None))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return _on_files(warcs, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, payload binary")
