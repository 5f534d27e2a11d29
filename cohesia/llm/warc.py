"""Converter from legacy ARC archives to WARC.

Pages are first written as legacy archives, each file in version 1 or 2 of the format (their header lines differ in the
fields).  The converter parses the version block, then each record's header line for that version and exactly its
declared length, and synthesises WARC identifiers, timestamps, types and digests.  Equal payloads are found through the digests of
the parsed records; a copy becomes a ``revisit``.  Only narrow index rows are shuffled: payloads go from file to file.

Archives are gzip members of bounded files under the shared folder, reached by ``pyarrow.fs`` (local mounts, HDFS, object
stores).  A file name is used once; only names that a finished task returned are read, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.storage import cut, drop, new_path, remove

#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
#: Most tasks over archives; more archives are shared among them.
TASKS = 8192
#: Payloads below this size are never deduplicated.
LEAST_REVISIT = 1000
CAPTURED = "20240101000000"
V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")


def _field(s: str | None) -> str:
    """A header field: no white space or controls; empty or null: ``-``."""
    return quote(s or "", safe="!#$%&'()*+,/:;=?@[]~-._|") or "-"


def arc_version_block(name: str, version: int) -> bytes:
    fields = V1 if version == 1 else V2
    body = f"{version} 0 cohesia\n{' '.join(fields)}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain"
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{head}{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(name: str, version: int, url: str | None, block: bytes, offset: int, mime: str = "text/html", code: int = 200) -> bytes:
    head = [_field(url), "0.0.0.0", CAPTURED, mime]
    if version == 2:
        head += [str(code), hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return (" ".join([*head, str(len(block))]) + "\n").encode() + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an HTTP response block; no header: all of it is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(":", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in fields.items()}, payload


def read_arc(stream):
    """``(offset, header fields by name, block)`` of each record after the version block.

    The version block says which header line follows; a header line with another number of fields or a length that the file
    can't satisfy is an error."""
    line = stream.readline().decode("utf-8")
    if not line.startswith("filedesc://"):
        raise ValueError("no ARC version block")
    body = stream.read(int(line.split(" ")[-1]))
    version, names = body.split(b"\n")[0].split(b" ")[0], body.split(b"\n")[1].decode().split(" ")
    if (version, tuple(names)) not in ((b"1", V1), (b"2", V2)):
        raise ValueError(f"unknown ARC version {version!r}")
    offset = len(line.encode()) + len(body) + 1
    stream.read(1)
    while line := stream.readline():
        if line == b"\n":
            offset += 1
            continue
        values = line.decode("utf-8").rstrip("\n").split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC header of {len(values)} fields at {offset}")
        head = dict(zip(names, values, strict=True))
        block = stream.read(int(head["Archive-length"]))
        if len(block) != int(head["Archive-length"]):
            raise ValueError(f"ARC record at {offset} is cut short")
        yield offset, head, block
        stream.read(1)
        offset += len(line) + len(block) + 1


def record_id(archive: str, offset: int) -> str:
    """The same identifier whenever the same archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_type(url: str) -> str:
    return {"http": "response", "https": "response", "filedesc": "warcinfo"}.get(url.split(":", 1)[0].lower(), "resource")


def sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def warc_record(archive: str, offset: int, head: dict, block: bytes, refers_to: tuple[str, str] | None) -> bytes:
    """The WARC record of a parsed ARC record; ``refers_to``: id and URL of the response of which it is a revisit."""
    d = head["Archive-date"].ljust(14, "0")
    fields, payload = parse_http(block)
    kind = "response" if fields else warc_type(head["URL"])
    digest = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    extra = []
    body = block
    if refers_to:
        kind, body = "revisit", block[: len(block) - len(payload)]
        extra = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(archive, offset)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {head['URL']}",
        f"WARC-IP-Address: {head['IP-address']}",
        f"WARC-Payload-Digest: {digest(payload)}",
        f"WARC-Block-Digest: {digest(body)}",
        *extra,
        "Content-Type: " + ("application/http; msgtype=response" if fields else head["Content-type"]),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_warc(stream):
    """``(fields, block)`` of each record."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, v = line.decode("utf-8").split(":", 1)
            fields[k.lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("WARC record is cut short")
        yield fields, block


def _open(uri: str, write: bool = False):
    system, path = fs.FileSystem.from_uri(uri)
    if not write:
        return gzip.GzipFile(fileobj=system.open_input_file(path))
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def write_arcs(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row into archives under ``folder``; returns ``(archive, records)``.  Null html: empty payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))

    def run(batches):
        out, made, name, size = None, [], "", 0
        for batch in batches:
            for page_id, u, h in zip(*(batch.column(i) for i in range(3)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.arc.gz"
                    version = 1 + int(name[0], 16) % 2
                    out, size = _open(f"{folder}/{name}", True), 0
                    first = arc_version_block(name, version)
                    out.write(gzip.compress(first, 1))
                    size += len(first)
                    made.append([name, 0])
                record = arc_record(name, version, u.as_py(), http_block(page_id.as_py(), h.as_py() or b""), size)
                out.write(gzip.compress(record, 1))
                size += len(record)
                made[-1][1] += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"])

    return rows.mapInArrow(run, "archive string, records long")


def tasks(archives: int) -> int:
    """Tasks for so many archives.  Rows that name archives are few and short, so their bytes say nothing of the work behind them,
    and adaptive execution would join all of them into one task if the number were left open."""
    return max(1, min(archives, TASKS))


def index_arcs(archives: DataFrame, folder: str) -> DataFrame:
    """``(archive, offset, url, page_id, payload_bytes, digest)`` of every record of the archives."""

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                got = []
                with _open(f"{folder}/{name}") as stream:
                    for offset, head, block in read_arc(stream):
                        fields, payload = parse_http(block)
                        got.append((name, offset, head["URL"], int(fields["x-page-id"]) if "x-page-id" in fields else None, len(payload), sha1(payload)))
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX, g, strict=True)) for g in got], schema=pa.schema(list(zip(INDEX, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))))

    return archives.select("archive").repartition(tasks(archives.count())).mapInArrow(run, "archive string, offset long, url string, page_id long, payload_bytes long, digest string")


INDEX = ("archive", "offset", "url", "page_id", "payload_bytes", "digest")


def find_revisits(index: DataFrame) -> DataFrame:
    """Append ``to_archive, to_offset, to_url`` of the response that a record revisits (null: none).

    Among equal payloads of at least LEAST_REVISIT bytes the record of the largest page_id (null: smallest; ties: the
    largest archive name and offset) is the response."""
    best = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "archive", "offset", "url")
    large = index.where(F.col("payload_bytes") >= LEAST_REVISIT)
    groups = large.groupBy("digest", "payload_bytes").agg(F.max(best).alias("to"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("payload_bytes").alias("size"), "to")
    own = F.col("to.archive").eqNullSafe(F.col("archive")) & F.col("to.offset").eqNullSafe(F.col("offset"))
    joined = index.alias("i").join(groups.alias("g"), (F.col("i.digest") == F.col("g.digest")) & (F.col("i.payload_bytes") == F.col("g.size")), "left")
    to = F.when(F.col("to").isNotNull() & ~own, F.col("to"))
    return joined.select("i.*", to.alias("to")).select(*INDEX, F.col("to.archive").alias("to_archive"), F.col("to.offset").alias("to_offset"), F.col("to.url").alias("to_url"))


def convert(decided: DataFrame, archives: DataFrame, arc_folder: str, warc_folder: str) -> DataFrame:
    """Convert every archive to a WARC file; returns ``(archive, records)`` with the names of the new files.

    Every attempt of a task writes files of its own, and only those of attempts that finished are named."""
    # Two places for each archive, so that few tasks get more than one by chance.
    places = tasks(2 * archives.count())
    rows = decided.select("archive", "offset", "to_archive", "to_offset", "to_url").repartition(places, "archive").sortWithinPartitions("archive", "offset")

    def run(batches):
        made, stream, out, records, current = [], None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != current:
                    if out:
                        out.close()
                        stream.close()
                    current = r["archive"]
                    made.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    stream, out = _open(f"{arc_folder}/{current}"), _open(f"{warc_folder}/{made[-1][0]}", True)
                    records = read_arc(stream)
                offset, head, block = next(records)
                if offset != r["offset"]:
                    raise ValueError(f"{current}: record at {offset}, not {r['offset']}")
                to = (record_id(r["to_archive"], r["to_offset"]), r["to_url"]) if r["to_archive"] else None
                out.write(gzip.compress(warc_record(current, offset, head, block, to), 1))
                made[-1][1] += 1
        if out:
            out.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"])

    return rows.mapInArrow(run, "archive string, records long")


def scan_warcs(archives: DataFrame, folder: str) -> DataFrame:
    """``(record, page_id, url, payload_bytes, payload_digest, record_type, to)`` of every record read back.

    A response's digest is computed from its payload and must equal its header; a revisit has that of its header, and the length its
    HTTP header declares."""

    names = ("record", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "to")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                got = []
                with _open(f"{folder}/{name}") as stream:
                    for fields, block in read_warc(stream):
                        http, payload = parse_http(block)
                        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if fields["warc-type"] != "revisit" and sha1(payload) != declared:
                            raise ValueError(f"{name}: {fields['warc-record-id']} has another digest than it declares")
                        page = int(http["x-page-id"]) if "x-page-id" in http else None
                        size = int(http["content-length"]) if "content-length" in http else len(payload)
                        got.append((fields["warc-record-id"], page, fields["warc-target-uri"], size, declared, fields["warc-type"], fields.get("warc-refers-to")))
                yield pa.RecordBatch.from_pylist([dict(zip(names, g, strict=True)) for g in got], schema=pa.schema(list(zip(names, kinds, strict=True))))

    return archives.select("archive").repartition(tasks(archives.count())).mapInArrow(run, "record string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, to string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as legacy archives, convert them, and read the WARC files back.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` for every row; repeated rows are records of
    their own, so of two rows with one page_id and payload one is a revisit of the other.  An empty table gives an empty table.
    Both folders of archives are deleted when they have been read for the last time; :func:`write_arcs` and :func:`convert` by themselves
    leave theirs."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    archives = cut(write_arcs(pages, arc, id_col, url, html), "arc-list")
    index = cut(index_arcs(archives, arc), "arc-index")
    made = cut(convert(find_revisits(index), archives, arc, warc), "warc-list")
    remove(spark, arc)
    records = cut(scan_warcs(made, warc), "warc-index")
    remove(spark, warc)
    for x in (archives, index, made):
        drop(x)
    to = records.where("record_type = 'response'").select(F.col("record").alias("_to"), F.col("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(to, F.col("to") == F.col("_to"), "left")
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rest = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.select(*cols).unionAll(revisits.select(*cols))


ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
m as (select h, max(page_id) top from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h)::bigint payload_bytes, sha1(p.h) payload_digest,
       case when m.top is null or m.top = page_id then 'response' else 'revisit' end record_type,
       case when m.top <> page_id then m.top end refers_to
from p left join m on p.h = m.h
"""
