"""Legacy web archives: ARC files are parsed and converted to WARC, of which equal payloads are stored once.

An ARC file opens with a version block, whose second line names the version and
whose third line names the fields of the header lines that follow; a header line
ends with the declared length of its document. The converter reads records by
that length alone and gives them what WARC wants beside it: record ids from the
place in the archive, full timestamps, types, and block and payload digests.
Both kinds of files hold one gzip member per record, so that a record is found by
its place. Spark joins and exchanges an index of records, never their payloads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.text import batches, staged
from fluxframe.session import shared_folder

# Fixed values of the formats: fields of a header line by version, media types, and the profile of revisits.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
HTTP_RESPONSE, DNS, WARC_FIELDS = "application/http;msgtype=response", "text/dns", "application/warc-fields"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(map(chr, range(33, 127)))

#: Payloads of fewer bytes are stored with every record.
LEAST_REVISIT = 1000
FILE_BYTES = 64 << 20
#: Date of records whose source has none.
NO_DATE = "20000101000000"


def gzip_member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def members(source) -> Iterator[tuple[int, int, bytes]]:
    """(place, size, content) of the gzip members of an open file, one at a time."""
    held, place = b"", 0
    while True:
        held = held or source.read(1 << 20)
        if not held:
            return
        expand, size, parts = zlib.decompressobj(31), 0, []
        while not expand.eof:
            if not held:
                raise ValueError(f"the member at {place} is cut off")
            parts.append(expand.decompress(held))
            size += len(held) - len(expand.unused_data)
            held = expand.unused_data if expand.eof else source.read(1 << 20)
        yield place, size, b"".join(parts)
        place += size


def sha1_text(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


# ---- ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 fluxframe\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    middle = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join(["filedesc://" + name, "0.0.0.0", date, "text/plain", *middle, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, document: bytes, offset: int, name: str, media: str = "text/html") -> bytes:
    """A record with its header line; what a URL must not hold there is percent-encoded, a missing URL is ``-``."""
    middle = [] if version == 1 else ["200", hashlib.md5(document).hexdigest(), "-", str(offset), name]
    head = [quote(url, safe=PRINTABLE) if url else "-", "0.0.0.0", date, media, *middle, str(len(document))]
    return " ".join(head).encode() + b"\n" + document + b"\n"


def split_arc_record(raw: bytes, names: list[str] | None) -> tuple[dict[str, str], bytes]:
    """Header fields and document of one record. Without ``names`` it is a version block, whose line has the fields of either version.

    URLs may hold blanks, so the line is cut from its end; the document has the declared length.
    """
    start = len(raw) - len(raw.lstrip(b"\r\n"))
    end = raw.index(b"\n", start)
    line = raw[start:end].rstrip(b"\r").decode("utf-8", "replace")
    if names is None:
        names = ARC_FIELDS[2] if line.count(" ") >= 9 else ARC_FIELDS[1]
    values = line.rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit():
        raise ValueError(f"no ARC header line: {line[:200]!r}")
    head, length = dict(zip(names, values)), int(values[-1])
    document = raw[end + 1 : end + 1 + length]
    if len(document) != length:
        raise ValueError(f"a document of {length} bytes was declared, {len(document)} follow")
    return head, document


def arc_names(block: bytes) -> list[str]:
    """Field names by which the header lines of a file are read: its own, else those of its version."""
    lines = block.decode("utf-8", "replace").split("\n")
    version = int(lines[0].split(" ")[0])
    names = lines[1].strip().split(" ") if len(lines) > 1 and lines[1].strip() else ARC_FIELDS.get(version)
    if version not in ARC_FIELDS or names[0] != "URL" or names[-1] != "Archive-length":
        raise ValueError(f"unknown ARC version {lines[0][:100]!r}")
    return names


def split_http(document: bytes) -> tuple[dict[str, str] | None, bytes]:
    """HTTP header fields in lower case and payload; None and the whole document where it is no HTTP response."""
    if not document.startswith(b"HTTP/"):
        return None, document
    at, gap = min((x for x in ((document.find(b"\r\n\r\n"), 4), (document.find(b"\n\n"), 2)) if x[0] >= 0), default=(len(document), 0))
    lines = document[:at].decode("latin-1").splitlines()[1:]
    pairs = [line.split(":", 1) for line in lines if ":" in line]
    return {k.strip().lower(): v.strip() for k, v in pairs}, document[at + gap :]


# ---- what WARC wants beside it


def warc_date(digits: str) -> str:
    """Timestamp of an archive date; missing parts are the earliest, and what is no date becomes the date of records without one."""
    full = (digits + "00000101000000"[len(digits) :])[:14]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return warc_date(NO_DATE)


def record_id(place: str) -> str:
    """The same id whenever the record at a place in an archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", sha1_text(block)), ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def split_warc_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block; the block has the declared length and digest."""
    at = raw.index(b"\r\n\r\n")
    first, *lines = raw[:at].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:100]!r}")
    head = dict(line.split(": ", 1) for line in lines)
    block = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    if len(block) != int(head["Content-Length"]) or head.get("WARC-Block-Digest", sha1_text(block)) != sha1_text(block):
        raise ValueError(f"record {head.get('WARC-Record-ID')} is damaged")
    return head, block


def converted(head: dict[str, str], document: bytes, own_id: str, revisits: str | None) -> bytes:
    """The WARC record of an ARC record; with ``revisits``, the id of a record of the same payload, it keeps its HTTP header alone."""
    url = None if head["URL"] == "-" else head["URL"]
    http, payload = split_http(document)
    kind = "response" if http is not None or (url or "").startswith("dns:") else "resource"
    media = HTTP_RESPONSE if http is not None else DNS if (url or "").startswith("dns:") else head["Content-type"]
    block = document
    if revisits is not None:
        kind, block = "revisit", document[: len(document) - len(payload)]
    address = head["IP-address"] if head["IP-address"] not in ("0.0.0.0", "-") else None
    return warc_record([
        ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", warc_date(head["Archive-date"])), ("WARC-Target-URI", url), ("WARC-IP-Address", address),
        ("WARC-Payload-Digest", sha1_text(payload)), ("WARC-Profile", IDENTICAL if revisits else None), ("WARC-Refers-To", revisits), ("Content-Type", media),
    ], block)


# ---- Spark


class _Roll:
    """Files of bounded size in a folder; an attempt of a task writes files of its own."""

    def __init__(self, folder: str, part: int, ending: str, most: int):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.base, recursive=True)
        self.part, self.ending, self.most, self.number, self.out = part, ending, most, 0, None
        self.done: list[dict] = []

    def open(self) -> str:
        self.name = f"{self.part:06d}-{self.number:06d}-{uuid.uuid4().hex}{self.ending}"
        self.out = self.store.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.size, self.records = 0, -1  # the first record describes the file
        return self.name

    def write(self, raw: bytes) -> None:
        packed = gzip_member(raw)
        self.out.write(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"path": f"{self.base}/{self.name}", "records": self.records, "bytes": self.size})
            self.out, self.number = None, self.number + 1

    def listed(self) -> pa.RecordBatch:
        out, self.done = pa.RecordBatch.from_pylist(self.done, _FILES), []
        return out


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
FILES = "path string, records bigint, bytes bigint"


def _folder(spark, folder: str | None, kind: str) -> str:
    return folder or f"{shared_folder(spark)}/{kind}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def write_arc(pages: DataFrame, folder: str | None = None, versions: tuple[int, ...] = (1, 2), file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Legacy archives of ``pages`` (page_id, url, html) and their folder: (path, records, bytes) per file; versions alternate from file to file.

    A document is an HTTP response whose header names the page. NULL html is an
    empty payload, a NULL page_id is not named. Files are listed by the successful
    attempts of tasks alone, in a written table.
    """
    spark = pages.sparkSession
    root = _folder(spark, folder, "arc")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(root, TaskContext.get().partitionId(), ".arc.gz", file_bytes)
        for b in batches(source, "html"):
            for page_id, url, html in zip(*[b.column(i).to_pylist() for i in range(3)]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                document = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
                if roll.out is None:
                    name = roll.open()
                    version = versions[(roll.part + roll.number) % len(versions)]
                    roll.write(arc_version_block(version, name, NO_DATE))
                roll.write(arc_record(version, url, NO_DATE, document, roll.size, name))
            if roll.done:
                yield roll.listed()
        roll.close()
        yield roll.listed()

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return staged(rows.mapInArrow(run, FILES)), root


def _dealt(files: DataFrame) -> DataFrame:
    """Files over as many tasks as there are files or, if fewer, cores; ranges of the path, so none has many more than another."""
    tasks = max(1, min(files.count(), max(files.sparkSession.sparkContext.defaultParallelism, files.count() // 4)))
    return files.select("path").repartitionByRange(tasks, "path")


_INDEX = pa.schema([("path", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("names", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.binary())])
INDEX = "path string, place bigint, size bigint, names string, page_id bigint, payload_bytes bigint, digest binary"


def index_arc(files: DataFrame, folder: str) -> DataFrame:
    """Where each record of listed ARC files lies, the field names it is read by, and its payload's size and digests (SHA-1 and BLAKE2)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in source:
            for path in b.column("path").to_pylist():
                out, names = [], None
                with store.open_input_stream(path, compression=None) as f:
                    for place, size, raw in members(f):
                        head, document = split_arc_record(raw, names)
                        if names is None:
                            names = arc_names(document)
                            continue
                        http, payload = split_http(document)
                        named = (http or {}).get("x-page-id")
                        out.append({"path": path, "place": place, "size": size, "names": " ".join(names), "page_id": None if named is None else int(named), "payload_bytes": len(payload),
                                    "digest": hashlib.sha1(payload).digest() + hashlib.blake2b(payload, digest_size=16).digest()})
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, _INDEX)
                            out = []
                yield pa.RecordBatch.from_pylist(out, _INDEX)

    return staged(_dealt(files).mapInArrow(run, INDEX))


def revisited(index: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``index`` with the place of the record that each one revisits: of equal payloads of ``least`` bytes or more, that with the largest page_id.

    Of rows with the same page_id the last place wins; NULL page_ids come before
    all others. Copies are counted by a partial aggregate, whose rows are joined
    back, so a payload that a third of all records has is not gathered.
    """
    by = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "path", "place")
    kept = index.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(by).alias("kept")).filter("n > 1")
    kept = kept.select(F.col("digest").alias("d"), F.col("payload_bytes").alias("p"), F.col("kept.path").alias("to_path"), F.col("kept.place").alias("to_place"))
    met = index.join(kept, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("p")), "left").drop("d", "p")
    own = (F.col("path") == F.col("to_path")) & (F.col("place") == F.col("to_place"))
    return met.select("path", "place", "size", "names", *[F.when(~own, F.col(c)).alias(c) for c in ("to_path", "to_place")])


def convert_arc(index: DataFrame, source: str, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """WARC files of all records of ``index`` (as from ``revisited``), which are fetched by their place, and their folder: (path, records, bytes) per file."""
    spark = index.sparkSession
    root = _folder(spark, folder, "warc")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(source)
        roll, now, file = _Roll(root, TaskContext.get().partitionId(), ".warc.gz", file_bytes), None, None
        for b in rows:
            for path, place, size, names, to_path, to_place in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if path != now:
                    if file is not None:
                        file.close()
                    now, file = path, store.open_input_file(path)
                file.seek(place)
                head, document = split_arc_record(zlib.decompress(file.read(size), 31), names.split(" "))
                if roll.out is None:
                    name = roll.open()
                    roll.write(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", warc_date(NO_DATE)), ("WARC-Filename", name), ("Content-Type", WARC_FIELDS)],
                                           b"software: fluxframe\r\nformat: WARC File Format 1.1\r\n"))
                own = [record_id(f"{p.rsplit('/', 1)[-1]}#{x}") if p else None for p, x in ((path, place), (to_path, to_place))]
                roll.write(converted(head, document, *own))
            if roll.done:
                yield roll.listed()
        if file is not None:
            file.close()
        roll.close()
        yield roll.listed()

    total = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, int(total // file_bytes) + 1)
    return staged(index.repartitionByRange(tasks, "path", "place").sortWithinPartitions("path", "place").mapInArrow(run, FILES)), root


_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
RECORDS = "record_id string, record_type string, target_uri string, date string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def read_warc(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of listed WARC files but their descriptions; digests in bare lower-case hex, payload_bytes NULL for revisits, payloads only on request.

    Lengths and digests that do not fit their record are an error.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in source:
            for path in b.column("path").to_pylist():
                out, held = [], 0
                with store.open_input_stream(path, compression=None) as f:
                    for _, _, raw in members(f):
                        head, block = split_warc_record(raw)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, payload = split_http(block) if head["Content-Type"] == HTTP_RESPONSE else (None, block)
                        again = head["WARC-Type"] == "revisit"
                        if not again and sha1_text(payload) != head["WARC-Payload-Digest"]:
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                        named = (http or {}).get("x-page-id")
                        out.append({
                            "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "target_uri": head.get("WARC-Target-URI"), "date": head["WARC-Date"],
                            "page_id": None if named is None else int(named), "payload_bytes": None if again else len(payload),
                            "payload_digest": base64.b32decode(head["WARC-Payload-Digest"].split(":")[1]).hex(), "refers_to": head.get("WARC-Refers-To"), "payload": payload if payloads and not again else None,
                        })
                        held += 200 + (len(payload) if payloads else 0)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, _RECORDS)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _RECORDS)

    return _dealt(files).mapInArrow(run, RECORDS).select(*[c for c in _RECORDS.names if payloads or c != "payload"])


def archive_pages(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, date and record_id of every page, read back from its WARC archives.

    ``pages`` (page_id, url, html) go to legacy archives of both versions, which
    are indexed and converted. NULL html is an empty payload and NULL urls are
    left out of the records. Rows with repeated or NULL page_ids keep a record
    each. The bytes of a revisit, and the page it refers to, come from the record
    whose id it names. Other columns are not read; an empty table gives an empty
    result. Payloads are read and written in place and never exchanged.
    """
    arcs, arc_folder = write_arc(pages)
    warcs, folder = convert_arc(revisited(index_arc(arcs, arc_folder), least), arc_folder)
    records = staged(read_warc(warcs, folder))
    kept = records.filter("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    again = records.filter("record_type = 'revisit'").join(kept, (F.col("refers_to") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left")
    found = again.select("page_id", F.col("to_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("to_page").alias("refers_to"), "target_uri", "date", "record_id")
    plain = records.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "target_uri", "date", "record_id")
    return plain.union(found)
