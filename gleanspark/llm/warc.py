"""WARC archives: write them as one gzip stream, normalise to a member per record, read by index."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.shared import byte_views, stored, utf8

ARCHIVE_BYTES = 64 << 20  # of records in an archive before a new one is begun
LEAST_REVISIT = 100  # bytes of payload below which a repeat is kept whole
_CHUNK = 1 << 20
_SIDECAR = ("offset", "length", "id", "type", "uri", "refers_to", "digest")
_DATE = "2000-01-01T00:00:00Z"  # no table has a capture time; a fixed one keeps files reproducible

INDEX = (
    "path string, offset long, length long, record_id string, record_type string, uri string, "
    "refers_to string, payload_digest string"
)
READ = "page_id long, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str, url: str | None = None) -> str:
    """The id of a page's record; a page without an id is told by its address and payload."""
    named = f"page:{page_id}:{digest}" if page_id is not None else f"address:{url}:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>"


def _headers(fields: Iterable[tuple[str, str | None]], first: str) -> bytes:
    # a header is one line, whatever the value holds
    lines = [f"{n}: {' '.join(v.split())}" for n, v in fields if v is not None]
    return "\r\n".join([first, *lines, "", ""]).encode()


def record_bytes(
    rid: str, kind: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, names: dict[str, str | None]
) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that carries its headers alone."""
    http = _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http + (payload if kind == "response" else b"")
    revisit = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None
    head = _headers(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", rid),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", revisit),
            ("WARC-Refers-To", refers_to),
            *names.items(),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
        "WARC/1.1",
    )
    return head + block + b"\r\n\r\n"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Written:
    """A file that takes its name only when it is whole, so a task run again leaves no half of one."""

    def __init__(self, path: str):
        self.files, self.path = _opened(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:
            self.files.delete_file(self.path)  # of an earlier attempt; the content is the same
        self.files.move(self.part, self.path)


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, digest, refers_to`` (page_id or null) as archives; ``path``.

    Each archive is one gzip stream from end to end. A task begins a new archive beyond
    ``archive_bytes`` of records, and holds one record and the compressor at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        out, packer, held = None, None, 0

        def end() -> None:
            if out is not None:
                out.write(packer.flush())
                out.close()

        for batch in batches:
            payloads = byte_views(batch.column(2))
            columns = {n: batch.column(n).to_pylist() for n in ("page_id", "url", "digest", "refers_to", "name")}
            for k in range(len(batch)):
                if out is None or held >= archive_bytes:
                    end()
                    # the first record names the archive, so a task run again writes the same files
                    paths.append(f"{folder}/{columns['name'][k]}-{len(paths)}.warc.gz")
                    out, packer, held = _Written(paths[-1]), zlib.compressobj(4, zlib.DEFLATED, 31), 0
                refers = columns["refers_to"][k]
                data = record_bytes(
                    record_id(columns["page_id"][k], columns["digest"][k], columns["url"][k]),
                    "response" if refers is None else "revisit",
                    columns["url"][k],
                    bytes(payloads[k]),
                    columns["digest"][k],
                    None if refers is None else record_id(refers, columns["digest"][k]),
                    {"X-Page-Id": None if columns["page_id"][k] is None else str(columns["page_id"][k])},
                )
                out.write(packer.compress(data))
                held += len(data)
        end()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    named = records.select(
        "page_id",
        "url",
        "payload",
        "digest",
        "refers_to",
        F.concat_ws("-", F.lit("pages"), F.spark_partition_id().cast("string"), F.col("page_id").cast("string")).alias(
            "name"
        ),
    )
    return named.mapInArrow(write, "path string")


def _inflated(path: str) -> Iterator[bytes]:
    """Pieces of a gzip file's content: one member or many, read once from front to back."""
    files, at = _opened(path)
    with files.open_input_stream(at, compression=None) as source:
        unpack, data, inside = zlib.decompressobj(31), source.read(_CHUNK), False
        while data:
            piece, inside = unpack.decompress(data, _CHUNK), True
            if piece:
                yield piece
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, inside = unpack.unused_data or source.read(_CHUNK), False
                unpack = zlib.decompressobj(31)
            elif not data:
                data = source.read(_CHUNK)
        if inside:
            yield unpack.flush()
            if not unpack.eof:
                raise ValueError(f"{path} ends inside a gzip member")


def header_fields(head: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return fields


class _Source:
    """Reads lines up to an empty one, and counted bytes, from pieces; holds no more than it must."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def head(self) -> bytes | None:
        """Header lines of the next record, without the empty line; None at the end."""
        seen = 0
        while True:
            while self.held[:2] == b"\r\n":
                del self.held[:2]
                seen = 0
            end = self.held.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0 and self.held:
                out = bytes(self.held[:end])
                del self.held[: end + 4]
                return out
            seen = len(self.held)
            more = next(self.pieces, None)
            if more is None:
                if self.held.strip():
                    raise ValueError("an archive ends inside a record")
                return None
            self.held += more

    def bytes_of(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.held:
                more = next(self.pieces, None)
                if more is None:
                    raise ValueError("an archive ends inside a record")
                self.held += more
            part = bytes(self.held[:count])
            del self.held[: len(part)]
            count -= len(part)
            yield part


def normalised(source: str, target: str) -> Iterator[tuple]:
    """Rewrite one archive: every record becomes a gzip member of its own. Yields index rows.

    The stream is inflated once; a record passes through in pieces, so neither a long record nor
    a long archive is held. A sidecar of JSON lines beside the target holds the index.
    """
    out, side = _Written(target), _Written(target.removesuffix(".warc.gz") + ".cdxj")
    source_of = _Source(_inflated(source))
    while (head := source_of.head()) is not None:
        fields = header_fields(head)
        begin, packer = out.size, zlib.compressobj(4, zlib.DEFLATED, 31)
        out.write(packer.compress(head + b"\r\n\r\n"))
        for part in source_of.bytes_of(int(fields["content-length"])):
            out.write(packer.compress(part))
        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        row = (
            target,
            begin,
            out.size - begin,
            fields.get("warc-record-id"),
            fields.get("warc-type"),
            fields.get("warc-target-uri"),
            fields.get("warc-refers-to"),
            fields.get("warc-payload-digest"),
        )
        side.write(json.dumps(dict(zip(_SIDECAR, row[1:], strict=True))).encode() + b"\n")
        yield row
    out.close()
    side.close()


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives in ``path`` to ``folder``, one task each; the index rows of all."""
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for row in normalised(path, f"{folder}/{path.rpartition('/')[2]}"):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, INDEX)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder of normalised archives, with the archive each belongs to."""
    kinds = ", ".join(f"{name} {'long' if name in ('offset', 'length') else 'string'}" for name in _SIDECAR)
    rows = spark.read.schema(kinds).json(f"{folder}/*.cdxj")
    return rows.select(
        F.regexp_replace(F.col("_metadata.file_path"), r"\.cdxj$", ".warc.gz").alias("path"),
        "offset",
        "length",
        F.col("id").alias("record_id"),
        F.col("type").alias("record_type"),
        "uri",
        "refers_to",
        F.col("digest").alias("payload_digest"),
    )


def read_records(index: DataFrame) -> DataFrame:
    """Records by index row: each member is read at its offset and unpacked alone.

    Returns the record's headers, the page_id it names and its payload (null for a revisit).
    A payload that does not have the digest of its header is an error.
    """

    schema = _schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path not in opened:
                    for old in opened.values():
                        old.close()
                    files, at = _opened(path)
                    opened = {path: files.open_input_file(at)}
                opened[path].seek(offset)
                data = zlib.decompress(opened[path].read(length), 31)
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = header_fields(head)
                block = rest[: int(fields["content-length"])]
                payload, digest = None, fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path} at {offset}: the payload does not have its digest")
                rows.append(
                    (
                        int(fields["x-page-id"]) if "x-page-id" in fields else None,
                        fields["warc-record-id"],
                        fields["warc-type"],
                        fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"),
                        digest,
                        payload,
                    )
                )
                held += len(data)
                if held > _CHUNK * 8:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)

    where = index.select("path", "offset", "length")
    return where.sortWithinPartitions("path", "offset").mapInArrow(run, READ)


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), schema, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in columns], schema=schema)


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each page's record is to hold.

    Of pages with equal payloads of at least ``least`` bytes the smallest page_id is stored; the
    others refer to it. Null html is an empty payload. Repeated rows have a record
    each, of the same kind. Rows without a page_id refer to the smallest one with their payload, and
    where no row has one each is stored whole.
    """
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # the smallest page of each payload; only ids and digests travel
    first = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    return rows.join(first, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )


def archived(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as monolithic archives under ``folder``, normalise them, and read the records
    back through the sidecars. Returns what ``read_records`` does, for every page."""
    written = stored(write_monolithic(deduplicated(pages), f"{folder}/whole", archive_bytes), "archives")
    index = stored(normalise(written, f"{folder}/members"), "index")
    spark = pages.sparkSession
    if index.isEmpty():
        return spark.createDataFrame([], READ)
    return read_records(read_index(spark, f"{folder}/members"))


def page_records(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the
    archives; a revisit's length is that of the payload it refers to."""
    read = stored(
        archived(pages, folder, archive_bytes).select(
            "page_id", "record_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").alias("size")
        ),
        "records",
    )
    stores = read.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("size").alias("to_size")
    ).distinct()
    return read.join(stores, "refers_to", "left").select(
        "page_id",
        F.coalesce("size", "to_size").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("to_page").alias("refers_to"),
    )
