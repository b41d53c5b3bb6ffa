"""Web archives from pages and back, record by record, in bounded pieces.

A payload never travels whole.  The chunk table has a row per record and piece of
at most ``chunk_bytes``, numbered from 0, each with the length and SHA-1 digest of
the payload up to its end; the last row has those of the whole.  Equal payloads
are found from these last rows alone.  Archive tasks receive the pieces of a record
in order and compress them straight into the file; the reader streams them out
again with digests recomputed on the way.

Archives are written below a folder that all executors share, under names that no
other attempt of a task uses, and only files that a finished task reports are read,
so lost or repeated tasks leave nothing but unlisted files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.llm.common import file_system, in_slices
from stockloom.session import materialize, scratch_path

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CHUNKS = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("digest_so_far", T.StringType()),
    ]
)
_READ = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
_KINDS = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(field.name, _KINDS[field.dataType]) for field in schema])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def chunk_table(
    pages: DataFrame,
    chunk_bytes: int = CHUNK_BYTES,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> DataFrame:
    """Rows (record, page_id, url, chunk_no, is_last, chunk, bytes_so_far, digest_so_far).

    Null payloads are empty and have one empty chunk.  ``record`` tells rows of
    the input apart, repeated ones as well; write the table before using it twice.
    """
    payload = F.coalesce(pages[payload_column].cast("binary"), F.lit(b""))
    pieces = (
        pages.select(
            F.monotonically_increasing_id().alias("record"),
            pages[id_column].cast("string").alias("page_id"),
            pages[url_column].alias("url"),
            payload.alias("payload"),
        )
        .withColumn("chunks", F.greatest(F.ceil(F.length("payload") / chunk_bytes), F.lit(1)).cast("long"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk_no"))
        .select(
            "record",
            "page_id",
            "url",
            "chunk_no",
            (F.col("chunk_no") == F.col("chunks") - 1).alias("is_last"),
            F.substring(F.col("payload"), (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("chunk"),
        )
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            totals, marks = [], []
            for number, chunk in zip(batch["chunk_no"].to_pylist(), batch["chunk"].to_pylist()):
                if number == 0:
                    state, size = hashlib.sha1(), 0
                state.update(chunk)
                size += len(chunk)
                totals.append(size)
                marks.append(base32(state.digest()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(totals, pa.int64()), pa.array(marks, pa.string())], names=_CHUNKS.names
            )

    return pieces.mapInArrow(digests, _CHUNKS)


def decide(chunks: DataFrame, id_type: T.DataType, dedup_min_bytes: int = 0) -> DataFrame:
    """(record, first, first_page): the record with the same payload that is kept whole.

    Of equal payloads of at least ``dedup_min_bytes`` the record of the smallest page
    id is first, nulls last; repeated rows differ by their record number.
    """
    whole = chunks.where("is_last").select("record", "page_id", "bytes_so_far", "digest_so_far")
    same = ["bytes_so_far", "digest_so_far"]
    number = F.col("page_id").cast(id_type)
    firsts = (
        whole.where(F.col("bytes_so_far") >= dedup_min_bytes)
        .groupBy(*same)
        .agg(F.min(F.struct(number.isNull().alias("none"), number.alias("page_id"), "record")).alias("first"))
    )
    return whole.join(firsts, same, "left").select(
        F.col("record").alias("of_record"),
        F.coalesce("first.record", "record").alias("first"),
        F.col("first.page_id").cast("string").alias("first_page"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
    )


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields if value is not None]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


class _Archive:
    """One archive file, a gzip member per record."""

    def __init__(self, system: fs.FileSystem, path: str, date: str):
        self.path, self.records = path, 0
        self.file = system.open_output_stream(path, compression=None)
        body = b"software: stockloom\r\nformat: WARC File Format 1.1\r\n"
        fields = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", date),
            ("Content-Type", "application/warc-fields"),
            ("Content-Length", len(body)),
        ]
        self.begin(_head(fields))
        self.add(body)
        self.end()

    def begin(self, head: bytes) -> None:
        self.zip = zlib.compressobj(level=6, wbits=31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self.file.write(self.zip.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self.file.write(self.zip.flush())

    def close(self) -> tuple[str, int, int]:
        size = self.file.tell()
        self.file.close()
        return self.path, self.records, size


def write_archives(
    chunks: DataFrame,
    decisions: DataFrame,
    folder: str,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write the records of a stored chunk table; rows (path, records, bytes) of the files.

    Write the result once and read the files it names: every evaluation writes anew.
    """
    run = uuid.uuid4()
    needed = (F.col("first") == F.col("record")) | (F.col("chunk_no") == 0)
    # Adaptive execution neither splits nor reads by mapper a shuffle that was asked for,
    # so the rows of a record meet in one task whatever becomes of the join.
    dealt = (
        chunks.repartition("record")
        .join(decisions, F.col("record") == F.col("of_record"))
        .where(needed)
        .select(
            "record", "page_id", "url", "chunk_no", "first", "first_page", "payload_bytes", "payload_digest",
            F.when(F.col("first") == F.col("record"), F.col("chunk")).alias("chunk"),
            (F.col("is_last") | (F.col("first") != F.col("record"))).alias("is_end"),
        )
        .sortWithinPartitions("record", "chunk_no")
    )
    files = T.StructType(
        [T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())]
    )

    def record_id(number: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(run, str(number))}>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        task, archive, written = TaskContext.get(), None, 0

        def opened() -> _Archive:
            system.create_dir(base, recursive=True)
            name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{written:04d}.warc.gz"
            return _Archive(system, name, date)

        def rows():
            nonlocal archive, written
            for batch in batches:
                for row in batch.to_pylist():
                    whole = row["first"] == row["record"]
                    if archive is None:
                        archive = opened()
                        written += 1
                    if row["chunk_no"] == 0:
                        size = len(HTTP_HEAD) + (row["payload_bytes"] if whole else 0)
                        fields = [
                            ("WARC-Type", RESPONSE if whole else REVISIT),
                            ("WARC-Record-ID", record_id(row["record"])),
                            ("WARC-Date", date),
                            ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe=_URI_SAFE)),
                            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
                            ("WARC-Profile", None if whole else PROFILE),
                            ("WARC-Refers-To", None if whole else record_id(row["first"])),
                            ("Page-ID", _quoted(row["page_id"])),
                            ("Refers-To-Page-ID", None if whole else _quoted(row["first_page"])),
                            ("Payload-Length", row["payload_bytes"]),
                            ("Content-Type", "application/http;msgtype=response"),
                            ("Content-Length", size),
                        ]
                        archive.begin(_head(fields))
                        archive.add(HTTP_HEAD)
                    if whole:
                        archive.add(row["chunk"])
                    if row["is_end"]:
                        archive.end()
                        archive.records += 1
                        if archive.file.tell() >= archive_bytes:
                            yield archive.close()
                            archive = None
            if archive is not None:
                yield archive.close()

        yield from in_slices(rows(), _arrow(files), 1)

    return dealt.mapInArrow(write, files)


_URI_SAFE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _quoted(value: str | None) -> str | None:
    """An id as one line of a record's head, whatever signs it holds."""
    return None if value is None else quote(value, safe="")


def _plain(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def read_records(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of the response and revisit records of one uncompressed stream.

    Raises ValueError where a record is not as its head says.
    """
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        left = int(head["content-length"])
        wanted = head["warc-type"] in (RESPONSE, REVISIT)
        while wanted and left:  # the head of the HTTP message
            line = stream.readline(left)
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        state, size, number = hashlib.sha1(), 0, 0
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        whole = head["warc-type"] == RESPONSE
        while True:
            chunk = stream.read(min(left, chunk_bytes)) if left else b""
            if left and not chunk:
                raise ValueError(f"{head['warc-record-id']} ends early")
            left -= len(chunk)
            size += len(chunk)
            state.update(chunk)
            if wanted:
                if whole and not left and base32(state.digest()) != digest:
                    raise ValueError(f"{head['warc-record-id']} does not have its digest")
                yield {
                    "record_id": head["warc-record-id"],
                    "record_type": head["warc-type"],
                    "page_id": _plain(head.get("page-id")),
                    "url": head.get("warc-target-uri"),
                    "refers_to": _plain(head.get("refers-to-page-id")),
                    "chunk_no": number,
                    "is_last": not left,
                    "chunk": chunk if whole else None,
                    "payload_bytes": size if whole else int(head["payload-length"]),
                    "payload_digest": base32(state.digest()) if whole else digest,
                }
            number += 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head['warc-record-id']} is longer than its head says")


def read_archives(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """Chunk rows of all records in the files of ``files`` (path); one task per file.

    ``payload_bytes`` and ``payload_digest`` grow along the chunks of a record; a
    revisit has one row with those of the payload it stands for.  Without
    ``payloads`` the chunks themselves are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    system, name = file_system(path)
                    with system.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                        for row in read_records(stream, chunk_bytes):
                            row["chunk"] = row["chunk"] if payloads else None
                            yield tuple(row[c] for c in _READ.names)

        yield from in_slices(rows(), _arrow(_READ), 8 if payloads else 4096)

    count = max(1, files.count())
    return files.select("path").repartition(count).mapInArrow(read, _READ)


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    dedup_min_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> DataFrame:
    """Write one record per row of ``pages``; rows (path, records, bytes) of the archives.

    Null payloads are empty; null urls have no target; null ids come after all others
    when the first of equal payloads is chosen; each repeated row is a record, all but
    one of them revisits; an empty table gives no file; other columns are not read.
    """
    spark = pages.sparkSession
    stored = scratch_path(spark, "chunks")
    chunk_table(pages, chunk_bytes, id_column, url_column, payload_column).write.option("compression", "zstd").parquet(stored)
    chunks = spark.read.schema(_CHUNKS).parquet(stored)
    decisions = decide(chunks, pages.schema[id_column].dataType, dedup_min_bytes)
    return materialize(write_archives(chunks, decisions, folder or scratch_path(spark, "warc"), archive_bytes))


def archived_records(files: DataFrame, id_type: T.DataType) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    return read_archives(files, payloads=False).where("is_last").select(
        F.col("page_id").cast(id_type).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )
