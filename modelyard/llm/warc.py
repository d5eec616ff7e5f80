"""Web archives written and read as chunked record tables.

A payload travels as rows of (record, chunk number, bytes), so that neither the writer nor the reader holds a whole record:
the writer takes the sorted chunks of a record one by one into the archive, the reader gives chunks back with the digest
so far. Records whose payload another record already has are written as revisits without a payload.

Archives are gzip members, one per record, in files of bounded size below a shared folder. A task writes files under names of
its own and hands on their paths; the list of archives holds those of finished tasks only, so that a lost executor
leaves at most files that nobody reads.

Defined cases: a null payload is an empty one; payloads below `least` bytes are never revisits; records that repeat the smallest id
of a payload are responses too; a null id is written as `none`, is never referred to and comes back as null; an empty table
gives no archives and no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelyard.session import stored

SCHEME = "urn:record:"


@dataclass(frozen=True)
class ArchiveSettings:
    """chunk: bytes per row. roll: an archive is closed after so many compressed bytes. least: shortest payload that may be revisited."""

    chunk: int = 1 << 18
    roll: int = 1 << 28
    least: int = 100
    level: int = 1


def payload_digest(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256)


def with_references(pages: DataFrame, settings: ArchiveSettings, page_id: str, payload: str) -> DataFrame:
    """page_id, digest, n_bytes, refers_to: the smallest id with the same payload, where that is another record.

    Only ids, digests and lengths are shuffled; copies are counted together before they are.
    """
    narrow = pages.select(
        F.col(page_id).alias("page_id"),
        payload_digest(F.col(payload)).alias("digest"),
        F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("n_bytes"),
    )
    first = (
        narrow.filter(F.col("n_bytes") >= settings.least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    joined = narrow.join(first, F.col("digest") == F.col("_digest"), "left")
    other = F.when(~F.col("refers_to").eqNullSafe(F.col("page_id")), F.col("refers_to"))
    return joined.select("page_id", "digest", "n_bytes", other.alias("refers_to"))


def chunk_table(pages: DataFrame, settings: ArchiveSettings, page_id: str, url: str, payload: str) -> DataFrame:
    """page_id, copy, chunk, n_bytes, digest, refers_to, url, data: row 0 describes a record, rows from 1 on hold its payload.

    `copy` keeps the chunks of rows apart that share id and payload. Those rows share one description, whose copy is -1.
    It is numbered by the task that cuts a row, and no row is cut by two, so that a task that is run again mixes no chunks up.
    """
    references = with_references(pages, settings, page_id, payload)
    empty = F.lit(None)
    heads = references.select(
        "page_id", F.lit(-1).cast("long").alias("copy"), F.lit(0).alias("chunk"), "n_bytes", "digest", "refers_to", empty.cast("string").alias("url"), empty.cast("binary").alias("data")
    )
    whole = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    numbers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.octet_length("whole") / settings.chunk).cast("int")))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload_digest(F.col(payload)).alias("digest"), whole.alias("whole"),
        F.monotonically_increasing_id().alias("copy"),
    )
    cut = rows.withColumn("chunk", F.explode(numbers))
    body = cut.select(
        "page_id", "copy", "chunk", F.octet_length("whole").cast("long").alias("n_bytes"), "digest",
        empty.cast(references.schema["refers_to"].dataType).alias("refers_to"), F.when(F.col("chunk") == 1, F.col("url")).alias("url"),
        F.substring("whole", (F.col("chunk") - 1) * settings.chunk + 1, F.lit(settings.chunk)).alias("data"),
    )
    return heads.unionByName(body)


def _open_shared(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Archive:
    """One open archive file; records are gzip members."""

    def __init__(self, files: pafs.FileSystem, path: str, level: int):
        self.path, self.sink, self.level, self.records, self.packer = path, files.open_output_stream(path, compression=None), level, 0, None

    def begin(self, fields: list[tuple[str, str]], length: int) -> None:
        self.packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {length}", "", ""]
        self.add("\r\n".join(lines).encode())

    def add(self, data: bytes) -> None:
        self.sink.write(self.packer.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self.sink.write(self.packer.flush())
        self.records += 1


def _reference(name) -> str:
    return f"<{SCHEME}none>" if name is None else f"<{SCHEME}id:{quote(str(name), safe='')}>"


def _named(reference: str | None) -> str | None:
    name = reference[1 + len(SCHEME) : -1] if reference else "none"
    return None if name == "none" else unquote(name.removeprefix("id:"))


def _line(text) -> str:
    """A header value on one line."""
    return str(text).replace("\r", " ").replace("\n", " ")


def written(
    pages: DataFrame,
    folder: str,
    settings: ArchiveSettings | None = None,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
) -> DataFrame:
    """Write every row as a record below `folder` and give the list of archives: path, records."""
    settings = settings or ArchiveSettings()
    rows = chunk_table(pages, settings, page_id, url, payload)
    # The digest keeps records apart that share an id; records of a hot payload spread by their ids.
    dealt = rows.repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", "copy", "chunk")

    def write(batches):
        files, root = _open_shared(folder)
        files.create_dir(root, recursive=True)
        done, archive, head, open_record = [], None, None, False
        digest = None

        def start(url):
            nonlocal archive, digest
            if archive is None:
                archive = _Archive(files, f"{root}/{uuid.uuid4().hex}.warc.gz", settings.level)
            revisit = head["refers_to"] is not None
            fields = [
                ("WARC-Type", "revisit" if revisit else "response"),
                ("WARC-Record-ID", _reference(head["page_id"])),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Payload-Digest", f"sha256:{head['digest']}"),
                ("X-Payload-Bytes", str(head["n_bytes"])),
            ]
            if url:
                fields.append(("WARC-Target-URI", _line(url)))
            if revisit:
                fields.append(("WARC-Refers-To", _reference(head["refers_to"])))
                fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
            archive.begin(fields, 0 if revisit else head["n_bytes"])
            digest = None if revisit else hashlib.sha256()

        def finish():
            nonlocal archive, open_record
            if not open_record:
                return
            open_record = False
            if digest is not None and digest.hexdigest() != head["digest"]:
                raise ValueError(f"payload of record {head['page_id']} does not have its digest")
            archive.end()
            if archive.sink.tell() >= settings.roll:
                archive.sink.close()
                done.append((archive.path, archive.records))
                archive = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    finish()
                    head = row
                elif row["chunk"] == 1:
                    finish()  # rows that repeat a record share its description
                    start(row["url"])
                    open_record = True
                if row["chunk"] and digest is not None and row["data"]:
                    digest.update(row["data"])
                    archive.add(row["data"])
        finish()
        if archive is not None:
            archive.sink.close()
            done.append((archive.path, archive.records))
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())}
        )

    listed = dealt.mapInArrow(write, "path string, records long")
    scheme = folder.split(":", 1)[0] + "://" if "://" in folder else ""
    return stored(listed.withColumn("path", F.concat(F.lit(scheme and scheme.rstrip("/") + "//"), "path")), "archives")


def _records(source: io.RawIOBase, chunk: int) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(headers, chunk number, bytes, last) of an open archive, never more than a few chunks in memory."""
    unpacker, data, ended = zlib.decompressobj(31), bytearray(), False

    def more() -> bool:
        """Add some unpacked bytes; false at the end of the file."""
        nonlocal unpacker, ended
        while not ended:
            packed = unpacker.unconsumed_tail or unpacker.unused_data
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
            if not packed:
                packed = source.read(1 << 16)
                if not packed:
                    ended = True
                    break
            found = unpacker.decompress(packed, 1 << 18)
            if found:
                data.extend(found)
                return True
        return False

    while True:
        while (at := data.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = data[:at].decode().split("\r\n")
        del data[: at + 4]
        headers = dict(line.split(": ", 1) for line in lines[1:])
        left, number = int(headers["Content-Length"]), 1
        while True:
            size = min(chunk, left)
            while len(data) < size:
                if not more():
                    raise ValueError("the archive ends within a record")
            own = bytes(data[:size])
            del data[:size]
            left -= size
            yield headers, number, own, left == 0
            number += 1
            if not left:
                break
        while len(data) < 4:
            if not more():
                raise ValueError("the archive ends within a record")
        del data[:4]


def read(archives: DataFrame, id_type: str = "bigint", settings: ArchiveSettings | None = None, payload: bool = False) -> DataFrame:
    """The records of a list of archives as chunk rows.

    page_id, chunk, n_bytes (so far), digest (of the payload so far), last, record_type, refers_to, told_bytes and told_digest
    (from the header), url; and data, if `payload`.
    """
    settings = settings or ArchiveSettings()
    columns = (
        "page_id string, chunk int, n_bytes long, digest string, last boolean, record_type string, refers_to string, "
        "told_bytes long, told_digest string, url string, data binary"
    )
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, own = _open_shared(path)
                with files.open_input_stream(own, compression=None) as source:
                    rows, held = [], 0
                    for headers, chunk, data, last in _records(source, settings.chunk):
                        if chunk == 1:
                            digest, n_bytes = hashlib.sha256(), 0
                        digest.update(data)
                        n_bytes += len(data)
                        rows.append(
                            (
                                _named(headers["WARC-Record-ID"]), chunk, n_bytes, digest.hexdigest(), last, headers["WARC-Type"],
                                _named(headers.get("WARC-Refers-To")), int(headers["X-Payload-Bytes"]),
                                headers["WARC-Payload-Digest"].split(":")[1], headers.get("WARC-Target-URI"), data if payload else None,
                            )
                        )
                        held += len(data) if payload else 200
                        if held > 1 << 22:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names, kinds)

    # One archive per task at most: their size is bounded, their number is not.
    found = archives.select("path").repartition("path").mapInArrow(scan, columns)
    typed = found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
    return typed if payload else typed.drop("data")


def _batch(rows, names, kinds):
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digests(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the bytes read; one that differs from its header stops the job.
    """
    revisit = F.col("record_type") == "revisit"
    same = (F.col("n_bytes") == F.col("told_bytes")) & (F.col("digest") == F.col("told_digest"))
    checked = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("page_id").cast("string"))))
    return chunks.filter("last").select(
        "page_id",
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("told_digest")).otherwise(checked).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
