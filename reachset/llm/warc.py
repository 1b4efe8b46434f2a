"""WARC archives: a distributed writer with payload deduplication and a Python data source that reads them back.

Writer: each task writes one archive of gzip members, one member a record; of equal payloads the record of the smallest
page id holds the payload, the others are revisit records that name it. Reader: ``spark.read.format("warc")`` plans file
partitions, takes over equality and IN predicates on header columns, parses a record's headers first and leaves the
payload undecoded unless the query reads a payload column and the record passes.

Defined results: a null html is an empty payload; a null url is written as ``urn:null``; a null page id has no record that
others can refer to and is always a response; several rows with the smallest page id of a payload: all of them are
responses; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import LongType, StructType

from .store import fresh_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, content_length long, payload_digest string, "
    "refers_to_id string, page_id long, refers_to long, payload_bytes long, payload_sha1 string, payload binary"
)
HEADER_COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest",
    "refers_to_id": "warc-refers-to", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id",
}
#: Archives are cut into partitions of about this many bytes of whole files.
PARTITION_BYTES = 64 << 20
READ = 1 << 16


def _fs(uri: str):
    """File system and path of a URI; plain paths and file: URIs are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:") :])


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: response with the payload, or revisit (refers_to given) with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(url.split()) if url else "urn:null"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def write(batches):
        out = path = None
        records = size = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    fs, base = _fs(folder)
                    path = f"part-{uuid.uuid4().hex}.warc.gz"  # attempts never share a file; only the manifest names what counts
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = packer.compress(encode_record(page_id, url, payload, base32_sha1(payload), refers_to)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the smallest page id of an equal payload, null for that page itself.

    Digests, not payloads, are grouped, with partial aggregation before the shuffle; the join back is an equi-join that
    adaptive execution may split where one digest is common.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    first = p.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    bytes_ = F.octet_length("html")
    refers = F.when((F.col("first") < F.col("page_id")) & (bytes_ >= least_bytes), F.col("first"))
    return p.join(first, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, least_bytes: int = 0) -> tuple[str, str]:
    """Write the archives; returns their folder and the path of the Parquet manifest (path, records, bytes).

    A repeated or speculative task leaves an archive that the manifest doesn't name and that reads therefore pass over.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    manifest = plan_revisits(pages, least_bytes).mapInArrow(_writer(folder), "path string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return folder, f"{folder}/manifest"


class _Files(InputPartition):
    def __init__(self, files: tuple[str, ...]):
        self.files = files


def _members(stream):
    """Readers over the gzip members of an archive; each gives bytes on demand and can pass over its rest."""
    pending = b""
    while True:
        if not pending:
            pending = stream.read(READ)
            if not pending:
                return
        member = _Member(stream, pending)
        yield member
        pending = member.rest()


class _Member:
    def __init__(self, stream, pending: bytes):
        self.stream, self.raw, self.gz, self.out = stream, pending, zlib.decompressobj(31), bytearray()

    def fill(self, most: int = READ) -> bool:
        """Decode at most ``most`` more bytes; False at the member's end."""
        while not self.gz.eof:
            source = self.gz.unconsumed_tail or self.raw
            self.raw = b""
            if not source:
                source = self.stream.read(READ)
                if not source:
                    raise ValueError("truncated archive")
            got = self.gz.decompress(source, most)
            if got:
                self.out += got
                return True
        return False

    def rest(self) -> bytes:
        """Bytes after this member; what is left of it runs through a fixed buffer and is not kept."""
        while self.fill():
            self.out.clear()
        return self.gz.unused_data

    def head(self) -> dict[str, str]:
        """Headers of the record; its block starts at the returned position in ``out``."""
        while (end := self.out.find(b"\r\n\r\n")) < 0:
            if not self.fill(2048):
                raise ValueError("no end of headers")
        lines = bytes(self.out[:end]).decode("utf-8", "replace").split("\r\n")
        del self.out[: end + 4]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def http_length(self) -> int:
        """Content-Length of the HTTP headers at the block's start; the payload follows in ``out``."""
        while (end := self.out.find(b"\r\n\r\n")) < 0:
            if not self.fill(2048):
                return 0
        lines = bytes(self.out[:end]).decode("latin-1").split("\r\n")
        del self.out[: end + 4]
        for x in lines[1:]:
            name, _, value = x.partition(":")
            if name.strip().lower() == "content-length":
                return int(value)
        return 0

    def take(self, n: int) -> bytes:
        while len(self.out) < n and self.fill():
            pass
        return bytes(self.out[:n])


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.folder = options["path"]
        self.manifest = options.get("manifest")
        self.columns = [f.name for f in schema.fields]
        self.types = {f.name: f.dataType for f in schema.fields}
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, EqualTo) and f.value is not None:
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADER_COLUMNS and isinstance(f, In) and None not in f.value:
                self.wanted.append((name, frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = _fs(self.folder)
        if self.manifest:
            from pyarrow import dataset

            mfs, mpath = _fs(self.manifest)
            names = dataset.dataset(mpath, format="parquet", filesystem=mfs, schema=pa.schema([("path", pa.string())])).to_table().column("path").to_pylist()
            infos = fs.get_file_info([f"{base}/{n}" for n in names])
        else:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if ".warc" in i.base_name]
        groups, size = [[]], 0
        for i in sorted(infos, key=lambda i: i.path):
            if size and size + i.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(i.base_name)
            size += i.size
        return [_Files(tuple(g)) for g in groups if g] or [_Files(())]

    def read(self, partition):
        fs, base = _fs(self.folder)
        decode = "payload" in self.columns or "payload_sha1" in self.columns
        http = decode or "payload_bytes" in self.columns
        for name in partition.files:
            with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for member in _members(stream):
                    head = member.head()
                    row = self._header_row(head)
                    if any(row.get(n) not in values for n, values in self.wanted):
                        continue
                    if http:
                        row["payload_bytes"] = member.http_length()
                    if decode and row["record_type"] == "response":
                        payload = member.take(row["payload_bytes"])
                        row |= {"payload": payload, "payload_sha1": base32_sha1(payload)}
                    yield tuple(row.get(c) for c in self.columns)

    def _header_row(self, head: dict[str, str]) -> dict:
        row = {c: head.get(h) for c, h in HEADER_COLUMNS.items()}
        for c in ("page_id", "refers_to"):
            row[c] = int(row[c]) if row[c] is not None else None
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        row |= {"warc_date": head.get("warc-date"), "content_length": int(head.get("content-length", 0)), "payload_bytes": None, "payload": None, "payload_sha1": None}
        return row


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(columns).load(folder)``; option manifest: read only the archives it names.

    The schema given decides the columns; payloads are decoded only where it has ``payload`` or ``payload_sha1``.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, folder: str, columns: str = SCHEMA, manifest: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").schema(columns)
    return (reader.option("manifest", manifest) if manifest else reader).load(folder)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and return what the archives say of each page; a payload that differs from its digest raises."""
    spark = pages.sparkSession
    folder, manifest = write_warc(pages)
    columns = "record_type string, payload_digest string, page_id long, refers_to long, payload_bytes long, payload_sha1 string"
    back = read_warc(spark, folder, columns, manifest)
    sound = F.when(
        (F.col("record_type") == "response") & ~F.col("payload_sha1").eqNullSafe(F.col("payload_digest")),
        F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.col("page_id").cast("string"))),
    ).otherwise(F.col("payload_digest"))
    return back.select("page_id", "payload_bytes", sound.cast("string").alias("payload_digest"), "record_type", "refers_to")


def round_trip_sql(table: str) -> str:
    """DuckDB SQL for warc_round_trip on pages with distinct ids."""
    bit = " + ".join(f"CAST(bits[5 * i + {j + 1}] AS INT) * {16 >> j}" for j in range(5))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM {table}),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', x[i]) - 1), 4, '0')), '') AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[{bit} + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""
