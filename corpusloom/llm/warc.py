"""WARC archives as a PySpark data source ("warc"), for reading and for writing.

Writing: one archive of gzip members (a record each) per task, and beside it an index of the members' places. The
commit lists the archives of the tasks that counted in a manifest, so what lost tasks left is never read. Reading:
the archives are cut into ranges of records of about split_bytes; of each record the headers are unpacked and parsed
first; predicates on the record type and on headers are applied there, and a record that fails them, or whose payload
isn't asked for, is left packed: the next one's place is known.
"""

import atexit
import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import cut, prepare, read as read_table, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Columns that are headers of a record, by which it can be passed over.
HEADER_OF = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST, INDEX = "_records.json", ".idx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BATCH_BYTES = 8 << 20
#: Revisits, about 60 bytes each, up to which they are broadcast.
BROADCAST_ROWS = 1 << 19


def files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """value as a header can hold it: line ends, which no URI has, are escaped; all else stays as it is."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record if refers_to is given: that one has headers only."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:record:{_line(record_id)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if uri is None else _line(uri)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:record:{_line(refers_to)}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    """Headers by name in lower case; a line that begins with a blank goes on with the one before."""
    found, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon:
            found[name] = value.strip()
    return found


#: What a column leaves out of its header's value.
_PREFIX = {"record_id": "urn:record:", "refers_to": "urn:record:", "payload_digest": "sha1:"}


def _value(headers: dict[str, str], column: str) -> str | None:
    """A header as the column has it: without a pair of brackets around it, and without the column's own prefix."""
    value = headers.get(HEADER_OF[column])
    if value is None:
        return None
    if column != "record_type" and value[:1] == "<" and value[-1:] == ">":
        value = value[1:-1]
    return value.removeprefix(_PREFIX.get(column, ""))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int | None


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 64 << 20))
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, top = files(self.path)
        made = []
        listed = system.get_file_info(f"{top}/{MANIFEST}")
        if listed.type == pafs.FileType.File:
            with system.open_input_stream(listed.path) as stream:
                names = [(f"{top}/{x['name']}", x["records"], x["size"]) for x in json.loads(stream.read())]
        else:
            info = system.get_file_info(pafs.FileSelector(top, recursive=True))
            names = [(x.path, None, x.size) for x in sorted(info, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]
        for name, records, size in names:
            if records is None:
                made.append(Range(name, 0, None))
                continue
            step = max(1, -(-records * self.split // max(size, 1)))
            made += [Range(name, k, min(k + step, records)) for k in range(0, records, step)]
        return made or [Range("", 0, 0)]

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, test, value in self.tests:
            found = _value(headers, column)
            if found is None or test == "EqualTo" and found != value or test == "In" and found not in value or test == "StringStartsWith" and not found.startswith(value):
                return False
        return True

    def _indexed(self, system: pafs.FileSystem, part: Range) -> Iterator[tuple[dict, object]]:
        """Headers of each record of the range, and a function that unpacks its block."""
        with system.open_input_stream(part.path + INDEX) as stream:
            places = np.frombuffer(stream.read(), "<u8")[part.first : part.last + 1].tolist()
        with system.open_input_file(part.path) as archive:
            for start, end in zip(places, places[1:]):
                packed = archive.read_at(end - start, start)
                unpack, data = zlib.decompressobj(31), b""
                rest = packed
                while b"\r\n\r\n" not in data:
                    data += unpack.decompress(rest, 2048)
                    rest = unpack.unconsumed_tail
                    if not rest and unpack.eof:
                        break
                head, _, begun = data.partition(b"\r\n\r\n")
                headers = _headers(head)

                def block(begun=begun, unpack=unpack, rest=rest, n=int(headers["content-length"])):
                    return (begun + unpack.decompress(rest) + unpack.flush())[:n]

                yield headers, block

    def _streamed(self, system: pafs.FileSystem, part: Range) -> Iterator[tuple[dict, object]]:
        """The same for an archive without an index: blocks that nobody wants are passed over, not kept."""
        with system.open_input_stream(part.path, compression="gzip" if part.path.endswith(".gz") else None) as stream:
            data = b""

            def fill(n: int) -> bool:
                nonlocal data
                while len(data) < n:
                    more = stream.read(max(1 << 16, n - len(data)))
                    if not more:
                        return False
                    data += more
                return True

            while True:
                while (at := data.find(b"\r\n\r\n")) < 0:
                    if not fill(len(data) + 1):
                        return
                headers, data = _headers(data[:at]), data[at + 4 :]
                left = n = int(headers["content-length"])
                taken = []

                def block(n=n):
                    fill(n)
                    taken.append(True)
                    return data[:n]

                yield headers, block
                while left > len(data):
                    left -= len(data)
                    data = b""
                    if not fill(1):
                        return
                data = data[left:]
                fill(4)
                data = data[4:]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:

        if not part.path:
            return
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        system, _ = files(self.path)
        rows, size = [], 0
        for headers, block in self._streamed(system, part) if part.last is None else self._indexed(system, part):
            if not self._passes(headers):
                continue
            kind, payload = headers.get("warc-type"), None
            length = int(headers["x-payload-length"]) if "x-payload-length" in headers else None
            sha = _value(headers, "payload_digest")
            if kind == "response" and (self.payload or self.verify or length is None or sha is None):
                payload = block().partition(b"\r\n\r\n")[2]
                length = len(payload)
                made = digest(payload)
                if self.verify and sha is not None and sha != made:
                    raise ValueError(f"{part.path}: the payload of {headers.get('warc-record-id')} has digest {made}, not {sha}")
                sha = made if self.verify or sha is None else sha
            rows.append({"record_id": _value(headers, "record_id"), "record_type": kind, "target_uri": _value(headers, "target_uri"), "refers_to": _value(headers, "refers_to"), "payload_digest": sha, "payload_bytes": length, "headers": list(headers.items()), "payload": payload if self.payload else None})
            size += 1000 + (len(payload) if self.payload and payload else 0)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    """Takes columns record_id, target_uri, payload, refers_to."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        system, top = files(self.path)
        if overwrite and system.get_file_info(top).type == pafs.FileType.Directory:
            system.delete_dir_contents(top)
        system.create_dir(top)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = files(self.path)
        name, places, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with system.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "target_uri", "payload", "refers_to")]
                for rid, uri, payload, refers in zip(*columns):
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = record(rid.as_py() or "", uri.as_py(), payload.as_py() or b"", refers.as_py(), self.date)
                    packed = pack.compress(data) + pack.flush()
                    out.write(packed)
                    at += len(packed)
                    places.append(at)
        with system.open_output_stream(f"{top}/{name}{INDEX}", compression=None) as out:
            out.write(np.array(places, "<u8").tobytes())
        return Written(name, len(places) - 1, at)

    def commit(self, messages: list[Written]) -> None:
        system, top = files(self.path)
        old = system.get_file_info(f"{top}/{MANIFEST}")
        listed = []
        if old.type == pafs.FileType.File:
            with system.open_input_stream(old.path) as stream:
                listed = json.loads(stream.read())
        listed += [vars(m) for m in messages if m is not None]
        with system.open_output_stream(f"{top}/{MANIFEST}.new", compression=None) as out:
            out.write(json.dumps(listed).encode())
        system.move(f"{top}/{MANIFEST}.new", f"{top}/{MANIFEST}")

    def abort(self, messages: list[Written]) -> None:
        system, top = files(self.path)
        for m in messages:
            if m is not None:
                for name in (m.name, m.name + INDEX):
                    system.delete_file(f"{top}/{name}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, split_bytes: int = 64 << 20) -> DataFrame:
    """The records of the archives in the folder path. payload: fill that column; verify: unpack payloads and check their digests."""
    prepare(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    options = {"payload": str(payload).lower(), "verify": str(verify).lower(), "split_bytes": str(split_bytes)}
    return spark.read.format("warc").options(**options).load(path)


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """A record per row. Of rows with equal payloads of least_bytes or more, the one with the largest id is a response, and others revisit it.

    Ids and SHA-1 alone are shuffled to find the revisits, with a maximum that combines first. Up to broadcast_rows of them are
    broadcast, and payloads go from the scan to the archives; with more, payloads are joined with them by id and SHA-1,
    so each is shuffled once, and equal ones of different rows don't meet in one task. A null payload is an empty one; rows
    with a null id revisit like others but are never revisited; rows that share the largest id are all responses; an empty
    table gives an archive without records; line ends in ids and URIs are written as %0D and %0A; further columns are left aside.
    """
    spark = prepare(pages.sparkSession)
    spark.dataSource.register(Warc)
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].alias("id"), pages[uri_col].cast("string").alias("target_uri"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha"))
    known = rows.where(F.octet_length("payload") >= least_bytes).select("id", "sha")
    groups = known.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha", "last")
    found = cut(known.join(groups, "sha").where("not id <=> last").distinct())
    small = found.count() <= broadcast_rows
    found = found.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "last")
    joined = rows.join(F.broadcast(found) if small else found.hint("merge"), rows["id"].eqNullSafe(F.col("rid")) & (rows["sha"] == F.col("rsha")), "left")
    out = joined.select(F.col("id").cast("string").alias("record_id"), "target_uri", "payload", F.col("last").cast("string").alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def remove(path: str) -> None:
    system, top = files(path)
    if system.get_file_info(top).type == pafs.FileType.Directory:
        system.delete_dir(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    write(read_table(spark, sf_dir, "pages"), path)
    records = read(spark, path, payload=False, verify=True)
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long").alias("page_id" if c == "record_id" else c)
    return records.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS s FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS m FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_B32}', 1 + ((
      ('0x' || substr(s || '00', 1 + (i * 5) // 4, 3))::INT >> (7 - (i * 5) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM g
"""
