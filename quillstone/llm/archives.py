"""Legacy web archives: ARC files of version 1 and 2 become WARC files.

An ARC file starts with a `filedesc:` record that names its version; that version says
which fields stand in the header line of each record, of which the last is the declared
length. The converter reads by those lines and lengths, and synthesises for every record
what WARC wants: type (warcinfo for the filedesc record, response or revisit for HTTP
captures, resource for others), a record id that follows from file, place and digest, an
ISO date from the 14-digit one, and SHA-1 digests of block and payload in base32.

Equal payloads: a first pass over the ARC files returns one small row per record; rows
are summed up by digest before they are dealt out, and each learns which record stays
the response. The second pass writes, for each ARC file, its WARC file; a payload never
leaves the task that reads it.

Recovery: names and contents follow from the input; finished files are moved into place.

Defined results: null html is an empty payload, empty payloads equal one another; a
payload below `min_revisit_bytes` is always a response; of repeated rows of one page the
last in the archives stays; a null or unprintable URL is replaced or percent-encoded; a
declared length that the file can't fill raises ValueError; an empty table gives no
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, one_per_task, opened, publish, work_dir

#: Fixed values of the format: fields of a record's header line, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_DATE = "20080101000000"
KEY = "X-Page-Id"
MIN_REVISIT_BYTES = 0
#: Rows in a batch that a task returns.
ROWS = 4096


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Member:
    """Writes a file of gzip members, one per record, under a name of this attempt until it is finished.

    A record is held whole, so the largest one must fit in a task's memory.
    """

    def __init__(self, uri: str, name: str):
        self.system, folder = opened(uri)
        self.system.create_dir(folder, recursive=True)
        self.final, self.part = f"{folder}/{name}", f"{folder}/.{name}.{os.urandom(8).hex()}"
        self.out = self.system.open_output_stream(self.part, compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(gzip.compress(data, compresslevel=1, mtime=0))

    def close(self) -> None:
        self.out.close()
        publish(self.system, self.part, self.final)


def unpacked(uri: str) -> IO[bytes]:
    system, path = opened(uri)
    return gzip.GzipFile(fileobj=system.open_input_file(path), mode="rb")


# --- ARC ------------------------------------------------------------------------------------------


def arc_url(url: str | None, key: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{key}"


def arc_head(version: int, name: str) -> bytes:
    about = f"{version} 0 Quillstone\n{ARC_LINES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": ARCHIVE_DATE, "type": "text/plain", "length": len(about)}
    return arc_line(version, fields) + about + b"\n"


def arc_line(version: int, fields: dict) -> bytes:
    return (" ".join(str(fields.get(f, "-")) for f in ARC_FIELDS[version]) + "\n").encode()


def http_block(payload: bytes, key: int | None) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY}: {key}\r\n" if key is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def write_arcs(pages: DataFrame, uri: str) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC files, half of the pages in either version; returns their paths (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, Member] = {}
        n = 0
        for b in batches:
            for key, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                version = 1 + n % 2
                n += 1
                if version not in out:
                    name = f"part-{TaskContext.get().partitionId():06d}-v{version}.arc.gz"
                    out[version] = Member(uri, name)
                    out[version].add(arc_head(version, name))
                block = http_block(html or b"", key)
                fields = {"url": arc_url(url, key), "ip": "0.0.0.0", "date": ARCHIVE_DATE, "type": "text/html", "result": 200, "length": len(block)}
                out[version].add(arc_line(version, fields) + block + b"\n")
        for member in out.values():
            member.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{os.path.basename(member.final)}"]})

    return cut(pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary")).mapInArrow(run, "path string"))


def read_arc(f: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and content of each record, the filedesc record first."""
    version, at = 0, 0
    while line := f.readline():
        if line in (b"\n", b"\r\n"):  # what separates records
            continue
        words = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        length = int(words[-1]) if words[-1].isdigit() else -1
        content = f.read(length) if length >= 0 else b""
        if length < 0 or len(content) != length:
            raise ValueError(f"ARC record {at}: a length of {words[-1]!r} is declared, {len(content)} bytes are there")
        if not version:
            if not words[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a filedesc record")
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = dict(zip(ARC_FIELDS[1], [*words[:4], words[-1]], strict=True))
        else:
            names = ARC_FIELDS[version]
            if len(words) != len(names):
                raise ValueError(f"ARC record {at}: {len(words)} fields, version {version} has {len(names)}")
            fields = dict(zip(names, words, strict=True))
        yield fields, content
        at += 1


# --- WARC -----------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes] | None:
    """Head, its fields by lower-case name, and payload of an HTTP capture."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    end = m.end() if m else len(block)
    fields = (x.split(":", 1) for x in block[:end].decode("latin-1").splitlines()[1:] if ":" in x)
    return block[:end], {k.strip().lower(): v.strip() for k, v in fields}, block[end:]


def warc_date(date: str) -> str:
    d = date[:14].ljust(14, "0") if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, nth: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{nth}#{digest}')}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read_warc(f: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields by lower-case name and block of each record."""
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = f.read(n := int(fields["content-length"]))
        if len(block) != n:
            raise ValueError(f"WARC record {fields.get('warc-record-id')}: {n} bytes are declared, {len(block)} are there")
        yield fields, block


# --- conversion -----------------------------------------------------------------------------------


INDEX = "path string, nth int, key long, uri string, date string, digest string, bytes long, id string"


def index_arcs(paths: DataFrame) -> DataFrame:
    """One row (INDEX) per HTTP capture in the ARC files (path)."""

    def rows(path: str) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        with unpacked(path) as f:
            for nth, (fields, content) in enumerate(read_arc(f)):
                if nth and (http := split_http(content)):
                    digest, key = sha1(http[2]), http[1].get(KEY.lower())
                    yield path, nth, key and int(key), fields["url"], fields["date"], digest, len(http[2]), record_id(name, nth, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from _batches(rows(path), types, INDEX)

    return one_per_task(paths).mapInArrow(run, INDEX)


def _batches(rows: Iterator[tuple], types: list[pa.DataType], schema: str) -> Iterator[pa.RecordBatch]:
    names, held = [x.split()[0] for x in schema.split(",")], []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield make()
            held.clear()
    if held:
        yield make()


def convert(arcs: DataFrame, uri: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a WARC file for each ARC file (path) and returns their paths (path)."""
    index = cut(index_arcs(arcs))
    # of equal payloads the largest key stays; without keys, the last in the archives
    last = index.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("key", "path", "nth", "uri", "date", "id")).alias("kept"))
    found = index.select("path", "nth", "digest", "bytes").join(last, ["digest", "bytes"], "left")
    mine = (F.col("kept.path") == F.col("path")) & (F.col("kept.nth") == F.col("nth"))
    kept = F.when(~mine, F.col("kept"))
    plan = found.select("path", "nth", kept["key"].alias("key"), kept["uri"].alias("uri"), kept["date"].alias("date"), kept["id"].alias("id")).where("id is not null")
    # every file has a row, so that files without revisits are written as well
    # with their number given, Spark does not put the partitions together: as many tasks as archives
    plan = plan.unionByName(arcs.select("path", F.lit(0).alias("nth")), allowMissingColumns=True).repartition(max(1, arcs.count()), "path").sortWithinPartitions("path", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, revisits, written = None, {}, []
        for b in batches:
            for p, nth, *kept in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if p != path:
                    if path:
                        written.append(_convert_file(path, uri, revisits))
                    path, revisits = p, {}
                if nth:
                    revisits[nth] = kept
        if path:
            written.append(_convert_file(path, uri, revisits))
        if written:
            yield pa.RecordBatch.from_pydict({"path": written})

    return cut(plan.select("path", "nth", "key", "uri", "date", "id").mapInArrow(run, "path string"))


def _convert_file(path: str, uri: str, revisits: dict[int, list]) -> str:
    name = path.rsplit("/", 1)[-1]
    out = Member(uri, target := re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz")
    with unpacked(path) as f:
        for nth, (fields, content) in enumerate(read_arc(f)):
            http = split_http(content) if nth else None
            payload = http[2] if http else content
            digest = sha1(payload)
            block, kept = content, revisits.get(nth)
            kind, mime = ("response", "application/http; msgtype=response") if http else ("resource", fields["type"])
            more: list[tuple[str, object]] = [("WARC-Target-URI", fields["url"]), ("WARC-IP-Address", fields["ip"])]
            if not nth:
                kind, mime = "warcinfo", "application/warc-fields"
                block = f"software: quillstone\r\nformat: WARC File Format 1.1\r\ndescription: from {name}\r\n".encode()
                more, digest = [("WARC-Filename", target)], ""
            elif kept:
                kind, block = "revisit", http[0]
                key, ref_uri, ref_date, ref_id = kept
                more += [("WARC-Profile", REVISIT), ("WARC-Refers-To", ref_id), ("WARC-Refers-To-Target-URI", ref_uri), ("WARC-Refers-To-Date", warc_date(ref_date)), ("X-Refers-To-Key", key), ("WARC-Truncated", "length")]
            out.add(warc_record([
                ("WARC-Type", kind), ("WARC-Record-ID", record_id(name, nth, digest)), ("WARC-Date", warc_date(fields["date"])), *more,
                ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}" if digest else None), ("Content-Type", mime),
            ], block))
    out.close()
    return f"{uri}/{target}"


CAPTURES = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(warcs: DataFrame) -> DataFrame:
    """One row (CAPTURES) per response and revisit in the WARC files (path); a digest that doesn't fit raises ValueError."""

    def rows(path: str) -> Iterator[tuple]:
        with unpacked(path) as f:
            for fields, block in read_warc(f):
                kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                if fields["warc-block-digest"] != f"sha1:{sha1(block)}":
                    raise ValueError(f"{path}: the block of {fields['warc-record-id']} was changed")
                if kind not in ("response", "revisit"):
                    continue
                _, http, payload = split_http(block)
                if kind == "response" and digest != sha1(payload):
                    raise ValueError(f"{path}: the payload of {fields['warc-record-id']} was changed")
                key, ref = http.get(KEY.lower()), fields.get("x-refers-to-key")
                yield key and int(key), len(payload) if kind == "response" else int(http["content-length"]), digest, kind, ref and int(ref)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from _batches(rows(path), types, CAPTURES)

    return one_per_task(warcs).mapInArrow(run, CAPTURES)


def archive(pages: DataFrame, uri: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC, converts to WARC below uri, and returns what the WARC files hold."""
    uri = uri or work_dir(pages.sparkSession, "warc")
    arcs = write_arcs(pages, f"{uri}/arc")
    warcs = convert(arcs, f"{uri}/warc", min_revisit_bytes)
    return read_captures(warcs)
