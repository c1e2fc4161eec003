"""WARC archives: a writer over Spark tasks and a Python data source that reads them.

Writing. Pages of equal payloads share one ``response`` record, of the largest page id; the others become
``revisit`` records without payload that refer to it. Each task writes gzip members, one per record, to files
of its own in a folder of the shared file system; a file is named by its partition and attempt, and the names
that a finished task returns are the archive's manifest, so what a failed attempt left is never read.

Reading. ``spark.read.format("warc")`` plans one partition per file, takes predicates on the columns made of headers
(record type, ids, URI, digest, length) from the query and on any header from the ``require`` option, and parses a
record's headers first. The payload of a record that a predicate rejects, and of every record when the ``payload``
option is false, is passed over: by seeking where the file is not compressed or its gzip members say their length
in an extra field, as those written here do; by inflating and forgetting otherwise.

Archives of others are read too: plain or compressed, header names in any case, repeated and folded headers, records
of any type. The payload of an ``application/http`` record is what follows its HTTP header block; of other records,
their whole block; a revisit has none (null).
"""

from __future__ import annotations

import base64
import hashlib
import operator
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from ._shared import Scratch, join_keyed, seen

BLOCK = 1 << 20
#: A gzip header with an extra field of one part, ``sl``: its length, the member's and the data's.
HEAD = struct.Struct("<4BI2BH2sH2I")
ROLL_BYTES = 256 << 20
#: Groups of equal payloads, of some 40 bytes each, that are broadcast at most.
BROADCAST_GROUPS = 200_000
PAGE_ID = "X-Page-ID"
LENGTH = "X-Payload-Length"
COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "page_id": PAGE_ID,
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": LENGTH,
    "refers_to": "WARC-Refers-To",
}
SCHEMA = (
    "file string, record_type string, record_id string, target_uri string, page_id string, payload_digest string, "
    "payload_bytes long, refers_to string, headers map<string,string>, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit's block holds the headers of the response alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"{LENGTH}: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.insert(3, f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"{PAGE_ID}: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` says its own length and that of its data, so that readers can pass it over."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = HEAD.size + len(body) + 8
    if max(whole, len(data)) >> 32:  # too long for the field
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        return gz.compress(data) + gz.flush()
    head = HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, whole, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _filesystem(uri: str):
    """A file system that the executors reach and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> list[str]:
    """Write a record per row and return the archive's files.

    A null html is an empty payload. Of equal payloads of at least ``least`` bytes the row with the largest id is
    the response; a null id never wins against an id, and of rows that repeat id and payload all are responses. An empty
    table writes no file.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-groups")
    whole = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), whole.alias("payload"),
        F.unhex(F.sha2(whole, 256)).alias("key"),
    )
    large = F.octet_length("payload") >= least
    groups = rows.filter(large).groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = scratch.cut(groups.filter("n > 1"), "groups", rows="n")
    # Few groups go to the payloads; with more, payloads of a group of many rows stay where they lie all the same.
    few = seen(groups)["count"] <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups), "key", "left") if few else join_keyed(rows, groups, "key", rows="n", how="left", keep=True)
    revisit = F.col("n").isNotNull() & large & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "url", "payload", "first", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, size, n, names, counts = None, 0, 0, [], []
        for b in batches:
            for i, url, payload, first, again in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{len(names):03d}-{task.taskAttemptId()}.warc.gz"
                    out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    names.append(name)
                    counts.append(0)
                data = member(record(i, url, payload, digest(payload), first, again))
                out.write(data)
                size += len(data)
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    manifest = rows.mapInArrow(run, "file string, records long")
    scratch = Scratch(spark, "manifest")
    return sorted(f"{folder}/{r['file']}" for r in scratch.cut(manifest, "files").collect())  # a row per file


class Headers(list):
    """(name, value) pairs in order; names are found in any case, repeated ones give their values joined by ', '."""

    def __getitem__(self, name):
        if not isinstance(name, str):
            return super().__getitem__(name)
        if (value := self.get(name)) is None:
            raise KeyError(name)
        return value

    def get(self, name: str) -> str | None:
        said = [v for n, v in self if n.lower() == name.lower()]
        return ", ".join(said) if said else None

    @classmethod
    def parse(cls, lines: list[str]) -> Headers:
        out = cls()
        for line in lines:
            if line[:1] in (" ", "\t") and out:  # a folded line goes on with the value before
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
            elif ":" in line:
                name, value = line.split(":", 1)
                out.append((name.strip(), value.strip()))
        return out


class _Bytes:
    """An archive's bytes as its records need them: inflated if it is compressed, else as they are."""

    def __init__(self, file, block: int, on_read: Callable[[int], None] | None):
        self.file, self.block, self.on_read = file, block, on_read
        file.seek(0, 2)
        self.size = file.tell()
        file.seek(0)
        self.raw = file.read(block)
        self.at = len(self.raw)  # where the file goes on after ``raw``
        self.zipped = self.raw[:2] == b"\x1f\x8b"
        self.inflate = None
        self.member_end: int | None = None
        self.data = bytearray()

    def _fill(self) -> bool:
        got = self.file.read(self.block)
        self.raw += got
        self.at += len(got)
        return bool(got)

    def more(self) -> bool:
        """Add bytes to ``data``; False at the end."""
        while True:
            if not self.raw and not self._fill():
                if self.inflate is not None and not self.inflate.eof:
                    raise ValueError("archive ends within a compressed member")
                return False
            if not self.zipped:
                got, self.raw = self.raw, b""
            else:
                if self.inflate is None or self.inflate.eof:
                    self._begin()
                inflate = self.inflate
                got = inflate.decompress(self.raw, self.block)
                self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if got:
                if self.on_read:
                    self.on_read(len(got))
                self.data.extend(got)
                return True

    def _begin(self) -> None:
        self.inflate, self.member_end = zlib.decompressobj(31), None
        while len(self.raw) < HEAD.size and self._fill():
            pass
        if len(self.raw) >= HEAD.size:
            head = HEAD.unpack(self.raw[: HEAD.size])
            if head[3] & 4 and head[8:10] == (b"sl", 8):
                self.member_end = self.at - len(self.raw) + head[10]

    def skip(self, left: int) -> None:
        """Pass over the ``left`` next bytes, which end the member if the archive is compressed and its members say their length."""
        if self.zipped and self.member_end is not None and not self.inflate.eof:
            self.data.clear()
            self._go_to(self.member_end)
            self.inflate = None
            return
        if not self.zipped and left > len(self.data):
            left -= len(self.data)
            self.data.clear()
            self._go_to(self.at - len(self.raw) + left)
            return
        self.take(left, None)

    def _go_to(self, place: int) -> None:
        if place > self.size:
            raise ValueError("archive ends within a record's block")
        if place >= self.at:
            self.file.seek(place)
            self.raw, self.at = b"", place
        else:
            self.raw = self.raw[len(self.raw) - (self.at - place) :]

    def take(self, left: int, into: bytearray | None) -> None:
        while left:
            if not self.data and not self.more():
                raise ValueError("archive ends within a record's block")
            part = min(left, len(self.data))
            if into is not None:
                into += self.data[:part]
            del self.data[:part]
            left -= part


def read_records(
    file, rejected=None, payload: bool = True, block: int = BLOCK, on_read: Callable[[int], None] | None = None
) -> Iterator[tuple[Headers, bytes | None]]:
    """``(headers, payload)`` of each record of an archive, a seekable file.

    Headers come first; ``rejected(headers)`` true skips the record. A payload that is not wanted is passed over, and
    memory holds one block beside the payload wanted. ``on_read`` gets the numbers of bytes inflated or read. An archive
    cut short, or a record without a length, raises ValueError.
    """
    source = _Bytes(file, block, on_read)
    data = source.data
    while True:
        while True:
            lead = 0  # line ends between records
            while lead < len(data) and data[lead] in b"\r\n":
                lead += 1
            del data[:lead]
            if (at := data.find(b"\r\n\r\n")) >= 0:
                break
            if not source.more():
                if data.strip():
                    raise ValueError("archive ends within a record's headers")
                return
        lines = bytes(data[:at]).decode("utf-8", "replace").split("\r\n")
        headers = Headers.parse(lines[1:])
        del data[: at + 4]
        length = headers.get("Content-Length")
        if length is None or not length.isdigit():
            raise ValueError("a record without Content-Length")
        left = int(length) + 4  # the block and the two line ends after it
        skip = rejected is not None and rejected(headers)
        if skip or not payload or (headers.get("WARC-Type") or "").lower() == "revisit":
            source.skip(left)
            if not skip:
                yield headers, None
            continue
        body = bytearray()
        source.take(left, body)
        del body[-4:]
        if (headers.get("Content-Type") or "").lower().startswith("application/http"):
            end = body.find(b"\r\n\r\n")
            body = body[end + 4 :] if end >= 0 else b""
        yield headers, bytes(body)


def value_of(headers: Headers, header: str) -> str | None:
    """A header's value; a payload digest without the name of its algorithm."""
    v = headers.get(header)
    return v.removeprefix("sha1:") if v and header == "WARC-Payload-Digest" else v


COMPARED = {D.EqualTo: "eq", D.EqualNullSafe: "eq", D.GreaterThan: "gt", D.GreaterThanOrEqual: "ge", D.LessThan: "lt", D.LessThanOrEqual: "le"}


def pushed(f: Filter) -> tuple[str, str, tuple] | None:
    """``(header, comparison, values)`` of a predicate that headers decide; None if they cannot."""
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1:
        return None
    name, header = f.attribute[0], COLUMNS.get(f.attribute[0])
    if header is None:
        return None
    if isinstance(f, D.IsNotNull):
        return header, "some", ()
    if isinstance(f, D.StringStartsWith):
        return header, "starts", (f.value,)
    if isinstance(f, D.In) and all(v is not None for v in f.value):
        return header, "in", tuple(str(v) for v in f.value)
    how = COMPARED.get(type(f))
    if how is None or f.value is None or (name != "payload_bytes" and how != "eq"):
        return None
    return header, how, (f.value if name == "payload_bytes" else str(f.value),)


def holds(headers: Headers, header: str, how: str, values: tuple) -> bool:
    v = value_of(headers, header)
    if v is None:
        return False
    if how == "some":
        return True
    if how == "starts":
        return v.startswith(values[0])
    if how == "in":
        return v in values
    return getattr(operator, how)(int(v) if isinstance(values[0], int) else v, values[0])


class WarcSource(DataSource):
    """Options: ``files`` (a JSON list of paths) or ``path`` (a folder of finished archives); ``payload`` (true or false);
    ``require`` (a JSON object of any headers and the values wanted, case of the header's name aside)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.options = options
        require = json.loads(options.get("require", "{}"))
        self.wanted = [(h, "in", tuple(v if isinstance(v, list) else [v])) for h, v in require.items()]

    def pushFilters(self, filters: list[Filter]):
        """What headers decide; the rest stays with Spark."""
        for f in filters:
            test = pushed(f)
            if test is None:
                yield f
            else:
                self.wanted.append(test)

    def partitions(self) -> list[InputPartition]:
        import json

        if "files" in self.options:
            files = json.loads(self.options["files"])
        else:
            from pyarrow.fs import FileSelector

            folder = self.options["path"].rstrip("/")
            fs, root = _filesystem(folder)
            files = [f"{folder}/{f.base_name}" for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith((".warc.gz", ".warc"))]
        return [InputPartition(f) for f in sorted(files)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        fs, path = _filesystem(partition.value)
        payload = str(self.options.get("payload", "true")).lower() != "false"

        def rejected(headers: Headers) -> bool:
            return not all(holds(headers, *test) for test in self.wanted)

        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(path) as file:
            for headers, body in read_records(file, rejected if self.wanted else None, payload):
                every = {n: headers.get(n) for n, _ in headers}
                rows.append((partition.value, *(value_of(headers, h) for h in COLUMNS.values()), list(every.items()), body))
                size += len(body or b"") + 1000
                if size > 4 * BLOCK:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    at = 1 + list(COLUMNS).index("payload_bytes")
    arrays = [pa.array(c, pa.string()) for c in cols[:at]]
    arrays.append(pa.array([int(v) if v and v.isdigit() else None for v in cols[at]], pa.int64()))
    arrays += [pa.array(c, pa.string()) for c in cols[at + 1 : -2]]
    arrays += [pa.array(cols[-2], pa.map_(pa.string(), pa.string())), pa.array(cols[-1], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["file", *COLUMNS, "headers", "payload"])


def read(spark: SparkSession, files: list[str], payload: bool = True, require: dict[str, list[str]] | None = None) -> DataFrame:
    """The archive's records; ``payload`` false reads headers alone, ``require`` only records with these headers.

    Spark offers a Python source its predicates only where ``spark.sql.python.filterPushdown.enabled`` is true, and
    refuses a source that takes predicates where it is not, so this sets it in the session.
    """
    import json

    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("warc").option("files", json.dumps(files)).option("payload", str(payload).lower())
    return source.option("require", json.dumps(require or {})).load()


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write the pages' archive and read it back: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Length and digest of a response are computed from the payload read; a revisit's are those of its headers.
    A null id stays null. An empty table gives no rows.
    """
    spark = pages.sparkSession
    files = write(pages, Scratch(spark, "warc").path("archive"), id_col, url_col, html_col, least)
    records = read(spark, files)

    def measured(batches):
        for b in batches:
            bodies = b.column("payload").to_pylist()
            sizes = [s if p is None else len(p) for s, p in zip(b.column("payload_bytes").to_pylist(), bodies, strict=True)]
            sums = [s if p is None else digest(p) for s, p in zip(b.column("payload_digest").to_pylist(), bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), b.column("record_type"), b.column("refers_to")],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    out = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").mapInArrow(measured, schema)
    return out.select(
        F.col("page_id").cast("long").alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.expr("cast(nullif(regexp_extract(refers_to, '^<urn:page:(-?[0-9]*)>$', 1), '') as long)").alias("refers_to"),
    )
