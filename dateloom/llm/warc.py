"""WARC archives as a PySpark Python data source, and archives of pages with revisit records.

Every record is a gzip member of its own whose header carries the member's size (the "sl" field that the WARC
standard's annex on compression describes), so a reader inflates only the first bytes of a member for its headers,
judges them by the predicates that Spark pushed down, and seeks past payloads that nobody wants. Members without that
field are read through. A file with a sidecar index is cut into partitions at the record offsets in it; the driver only
lists files, and each task reads the index of its own. Foreign archives have no such index, and nothing but reading them
from the start tells for sure where their records begin, so each of their files is one partition. Archives that
are written here begin with a warcinfo record.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from dateloom.llm.common import scratch, small, tune, written

#: Columns and the record headers that they hold.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "profile": "WARC-Profile",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
_SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, profile string, refers_to string, payload_length string, content_length long, payload binary"
#: Fixed value: the profile of a revisit record whose payload equals an earlier one's.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in a partition, bytes from which a new file is begun, payload bytes and records in a batch that is read.
_PART, _FILE, _BATCH, _ROWS = 32 << 20, 256 << 20, 4 << 20, 512
_GZIP = "<4BI2B"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def member(headers: dict[str, str | None], payload: bytes) -> bytes:
    """A record as a gzip member; its header tells the member's and the record's size."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in headers.items() if v is not None]
    record = ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = struct.calcsize(_GZIP) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return struct.pack(_GZIP, 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Members:
    """Records of a range of a file: headers first, the payload only when asked for."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.at, self.stop = file, start, stop

    def __iter__(self):
        while self.at < self.stop:
            start = self.at
            self.file.seek(start)
            data = self.file.read(4096)
            if len(data) < 2:
                return
            if data[:2] != b"\x1f\x8b":
                yield from self._plain(start, data)
                return
            size = struct.unpack_from("<I", data, 16)[0] if data[3] & 4 and data[12:14] == b"sl" else None
            inflate = zlib.decompressobj(31)
            text = inflate.decompress(data)
            read = len(data)
            while b"\r\n\r\n" not in text and not inflate.eof:
                more = self.file.read(65536)
                if not more:
                    raise ValueError(f"a record at {start} is cut off")
                text, read = text + inflate.decompress(more), read + len(more)
            head, _, body = text.partition(b"\r\n\r\n")
            headers = parsed(head)
            state = [body, read]

            def payload(inflate=inflate, state=state, headers=headers):
                length, parts, have = int(headers.get("content-length", 0)), [state[0]], len(state[0])
                while have < length and not inflate.eof:
                    more = self.file.read(1 << 18)
                    if not more:
                        raise ValueError("a record is cut off")
                    state[1] += len(more)
                    parts.append(inflate.decompress(more))
                    have += len(parts[-1])
                return b"".join(parts)[:length]

            yield headers, payload
            if size:
                self.at = start + size
            else:  # no size in the header: inflate to the member's end
                while not inflate.eof:
                    more = self.file.read(1 << 18)
                    if not more:
                        return
                    state[1] += len(more)
                    inflate.decompress(more)
                self.at = start + state[1] - len(inflate.unused_data)

    def _plain(self, start: int, data: bytes):
        """Records that are not compressed."""
        while start < self.stop:
            self.file.seek(start)
            data = self.file.read(4096)
            while b"\r\n\r\n" not in data:
                more = self.file.read(65536)
                if not more:
                    return
                data += more
            head = data[: data.index(b"\r\n\r\n")]
            headers = parsed(head)
            length, begins = int(headers.get("content-length", 0)), start + len(head) + 4

            def payload(begins=begins, length=length):
                self.file.seek(begins)
                return self.file.read(length)

            yield headers, payload
            start = begins + length + 4


def parsed(head: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class _Range(InputPartition):
    """Records of a file that begin in part `number` of _PART bytes; the whole file if it has no index."""

    path: str
    size: int
    number: int
    indexed: bool


def _schema() -> pa.Schema:
    text = [pa.field(name, pa.string()) for name in HEADERS]
    return pa.schema([*text, pa.field("content_length", pa.int64()), pa.field("payload", pa.binary())])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.wanted = options["path"], []
        self.payload = options.get("payload", "true").lower() != "false"

    def pushFilters(self, filters):
        """Equality, membership and presence of a header column are judged on headers alone; others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((column, {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, {v for v in f.value if v is not None}))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self):
        """Parts of the files below the folder by their sizes alone; names that begin with _ or . are not committed."""
        from pyarrow.fs import FileSelector

        files, at = _fs(self.folder)
        listed = {f.path: f for f in files.get_file_info(FileSelector(at, recursive=True)) if f.is_file}
        out = []
        for path, info in sorted(listed.items()):
            if not path.endswith((".warc.gz", ".warc")) or path.rpartition("/")[2][0] in "_.":
                continue
            uri = f"{self.folder.rstrip('/')}/{path[len(at.rstrip('/')) + 1 :]}"
            indexed = path + ".idx" in listed
            out += [_Range(uri, info.size, k, indexed) for k in range(max(1, -(-info.size // _PART)) if indexed else 1)]
        return out or [_Range("", 0, 0, False)]

    def read(self, partition):
        if not partition.path:
            return
        files, at = _fs(partition.path)
        ranges = [(0, partition.size)]
        if partition.indexed:
            with files.open_input_stream(at + ".idx") as f:
                cuts = json.loads(f.read())
            ranges = [(a, b) for a, b in zip(cuts, [*cuts[1:], partition.size]) if a // _PART == partition.number]
        kind = _schema()
        rows, size = [], 0
        with files.open_input_file(at) as file:
            for start, stop in ranges:
                for headers, payload in _Members(file, start, stop):
                    values = {column: headers.get(name.lower()) for column, name in HEADERS.items()}
                    if all(values[c] is not None if some is None else values[c] in some for c, some in self.wanted):
                        rows.append(values | {"content_length": int(headers.get("content-length", 0)), "payload": payload() if self.payload else None})
                        size += len(rows[-1]["payload"] or b"")
                        if size >= _BATCH or len(rows) >= _ROWS:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


@dataclass
class _Done(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Files of their own for each attempt, under names that readers skip until the job commits them."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator):
        files, folder = _fs(self.folder)
        files.create_dir(folder, recursive=True)
        done, out, cuts, size = [], None, [0], 0

        def close():
            out.close()
            with files.open_output_stream(name + ".idx") as f:
                f.write(json.dumps(cuts).encode())

        try:
            for batch in iterator:
                names = [n for n in batch.schema.names if n in HEADERS]
                columns = [batch.column(n).to_pylist() for n in names]
                for values, payload in zip(zip(*columns), batch.column("payload")):
                    if out is None or size >= _FILE:
                        if out is not None:
                            close()
                        name, cuts = f"{folder}/_{uuid.uuid4().hex}.warc.gz", [0]
                        out = files.open_output_stream(name, compression=None)
                        done.append(name)
                        about = _about(name.rpartition("/")[2][1:])
                        out.write(about)
                        size = len(about)
                    if size // _PART > cuts[-1] // _PART:
                        cuts.append(size)
                    record = member({HEADERS[n]: v for n, v in zip(names, values)}, payload.as_buffer().to_pybytes() if payload.is_valid else b"")
                    out.write(record)
                    size += len(record)
            if out is not None:
                close()
        except BaseException:
            _removed(files, done)
            raise
        return _Done(done)

    def commit(self, messages):
        files, folder = _fs(self.folder)
        for message in messages:
            for name in message.files if message else ():
                for end in (".idx", ""):
                    files.move(name + end, f"{folder}/{name.rpartition('/')[2][1:]}{end}")

    def abort(self, messages):
        files, _ = _fs(self.folder)
        _removed(files, [name for message in messages for name in (message.files if message else ())])


def _removed(files, names: list[str]) -> None:
    """Deletes archives and their indexes where they are."""
    for name in names:
        for path in (name, name + ".idx"):
            try:
                files.delete_file(path)
            except OSError:  # it was never begun
                pass


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _about(name: str) -> bytes:
    """The warcinfo record of a file."""
    headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _now(), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return member(headers, b"software: dateloom\r\nformat: WARC File Format 1.1\r\n")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder), df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """Records of pages (page_id, url, html) in the columns of the source.

    Of the pages with equal payloads of `least` bytes or more, that with the smallest page_id keeps its payload; the
    others become revisit records of it. Only digests are grouped, and only those of several pages are joined back.
    A null html is empty, a null url has no header; a row without page_id is always a response, and rows that
    repeat a page_id and a payload are told apart by nothing, so each of them is a response. The date is that of a column
    `fetched` (a time in UTC) if pages have one and it is not null, else that of writing. Other columns are ignored; an
    empty table gives no records. How long a revisit's whole payload is, stands in an extension header.
    """
    fetched = F.col("fetched").cast("timestamp_ntz") if "fetched" in pages.columns else F.lit(None).cast("timestamp_ntz")
    date = F.coalesce(F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(_now()))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), date.alias("date"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256), "size": F.octet_length("body").cast("long")})
    first = rows.where(F.col("size") >= least).select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "repeated")
    rows = rows.join(small(first), "digest", "left")
    again = F.col("page_id").isNotNull() & F.col("first").isNotNull() & (F.col("first") != F.col("page_id")) & (F.col("size") >= least)
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "date",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, F.lit(IDENTICAL)).alias("profile"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.col("size").cast("string").alias("payload_length"),
        F.col("size").alias("content_length"),
        F.when(~again, F.col("body")).alias("payload"),
    )


def write_pages(pages: DataFrame, folder: str | None = None) -> str:
    """Archives of pages in folder (a new one in the shared scratch folder if none is given)."""
    spark = pages.sparkSession
    tune(spark, 1024)
    register(spark)
    folder = folder or scratch(spark, "warc")
    plan_records(pages).write.format("warc").mode("append").save(folder)
    return folder


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit in the archives of pages.

    A response's size and digest are those of the payload read back; a revisit's are those in its headers.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    found = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return found.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
