import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from stockloom.llm import warc as W
from stockloom.session import materialize, scratch_path

SCHEMA = "page_id long, url string, html string, record string, chunk string, first string"
ROWS = [
    (5, "http://a/x y", "same page", "r", "c", "f"),
    (3, "http://b", "same page", "r", "c", "f"),
    (3, "http://b", "same page", "r", "c", "f"),
    (9, None, None, "r", "c", "f"),
    (8, "http://é/\r\nWARC/1.1", "", "r", "c", "f"),
    (7, "http://c", "long é \U0001f600 " * 5000, "r", "c", "f"),
    (None, "http://d", "same page", "r", "c", "f"),
    (6, "http://e", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "r", "c", "f"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk_bytes,archive_bytes", [(7, 1), (1 << 20, 1 << 28)])
def test_round_trip(llm, chunk_bytes, archive_bytes):
    pages = llm.createDataFrame(ROWS, SCHEMA).repartition(3)
    files = W.archive_pages(pages, chunk_bytes=chunk_bytes, archive_bytes=archive_bytes)
    assert sum(r.records for r in files.collect()) == len(ROWS)
    found = W.archived_records(files, pages.schema["page_id"].dataType).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in found) == sorted(
        (page or 0, len((html or "").encode()), digest(html)) for page, _, html, *_ in ROWS
    )
    same = [r for r in found if r.payload_digest == digest("same page")]
    assert [r.page_id for r in same if r.record_type == "response"] == [3]
    assert sorted((r.page_id or 0, r.refers_to) for r in same if r.record_type == "revisit") == [(0, 3), (3, 3), (5, 3)]
    empty = {r.page_id: (r.record_type, r.refers_to) for r in found if r.payload_bytes == 0}
    assert empty == {8: ("response", None), 9: ("revisit", 8)}

    chunks = W.read_archives(files, chunk_bytes=11).collect()
    payloads = {}
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk_no)):
        assert r.chunk is None or len(r.chunk) <= 11
        if r.record_type == "response":
            payloads[r.record_id] = payloads.get(r.record_id, b"") + r.chunk
    assert sorted(payloads.values()) == sorted({(html or "").encode() for _, _, html, *_ in ROWS})


def test_chunks_carry_digests(llm):
    chunks = materialize(W.chunk_table(llm.createDataFrame(ROWS, SCHEMA), 100)).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: (r.record, r.chunk_no)):
        whole[r.record] = whole.get(r.record, b"") + r.chunk
        assert r.digest_so_far == base64.b32encode(hashlib.sha1(whole[r.record]).digest()).decode()
        assert r.bytes_so_far == len(whole[r.record]) and len(r.chunk) <= 100


def test_small_payloads_are_not_revisits_below_the_limit(llm):
    files = W.archive_pages(llm.createDataFrame(ROWS, SCHEMA), dedup_min_bytes=100)
    found = W.archived_records(files, llm.createDataFrame(ROWS, SCHEMA).schema["page_id"].dataType)
    assert found.where("record_type = 'revisit'").count() == 0


def test_files_are_gzip_members_of_records(llm):
    files = W.archive_pages(llm.createDataFrame(ROWS, SCHEMA).coalesce(1)).collect()
    data = gzip.open(files[0].path.removeprefix("file:")).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert data.count(b"\r\nWARC-Type: revisit\r\n") == 4
    assert b"WARC-Target-URI: http://a/x%20y\r\n" in data


def test_damage_is_noticed():
    body = b"HTTP/1.1 200 OK\r\n\r\nabc"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:{digest('abd')}\r\nContent-Length: {len(body)}\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(W.read_records(io.BytesIO(head.encode() + body + b"\r\n\r\n")))
    with pytest.raises(ValueError, match="early"):
        list(W.read_records(io.BytesIO(head.encode() + body[:-2])))


def test_empty_table(llm):
    files = W.archive_pages(llm.createDataFrame([], SCHEMA))
    assert files.count() == 0
    assert W.archived_records(files, llm.createDataFrame([], SCHEMA).schema["page_id"].dataType).count() == 0


def test_records_across_row_groups_stay_whole(llm, tmp_path):
    """A record of a stored table whose splits fall inside it, joined by broadcast."""
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(33, 1000)) for _ in range(30_000)) for _ in range(6)]
    pages = llm.createDataFrame([(k, f"http://{k}", text, "r", "c", "f") for k, text in enumerate(texts)], SCHEMA)
    path = str(tmp_path / "chunks")
    W.chunk_table(pages.coalesce(1), 1000).write.option("parquet.block.size", 20_000).option(
        "parquet.page.size.row.check.min", 5
    ).option("parquet.block.size.row.check.min", 5).parquet(path)
    split = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    # The decisions are small enough for a broadcast, the chunks are not.
    split["spark.sql.autoBroadcastJoinThreshold"] = "20000"
    split["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {key: llm.conf.get(key) for key in split}
    for key, value in split.items():
        llm.conf.set(key, value)
    try:
        chunks = llm.read.parquet(path)
        spread = chunks.select("record", F.spark_partition_id().alias("task")).distinct()
        assert spread.count() > len(texts)
        kind = pages.schema["page_id"].dataType
        files = materialize(W.write_archives(chunks, W.decide(chunks, kind), scratch_path(llm, "warc")))
        found = W.archived_records(files, kind).collect()
    finally:
        for key, value in before.items():
            llm.conf.set(key, value)
    assert sorted((r.page_id, r.payload_digest) for r in found) == [(k, digest(text)) for k, text in enumerate(texts)]


def test_text_ids_of_any_signs(llm):
    ids = ["plain", "two\r\nWARC-Type: warcinfo\r\n", "tab\t% é", "", " ", "a: b", None]
    rows = [(name, f"http://h/{k}", f"page {k % 3}") for k, name in enumerate(ids)]
    pages = llm.createDataFrame(rows, "page_id string, url string, html string")
    found = W.archived_records(W.archive_pages(pages), pages.schema["page_id"].dataType).collect()
    assert sorted((r.page_id or "-", r.payload_bytes) for r in found) == sorted((name or "-", 6) for name in ids)
    assert sum(r.record_type == "response" for r in found) == 3
    assert {r.refers_to for r in found if r.record_type == "revisit"} <= set(ids)
