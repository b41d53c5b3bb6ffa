import zlib

import numpy as np
import pytest

from stockloom.llm import shards as S
from stockloom.llm.queries import vocabulary
from stockloom.llm.tokens import encoder


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    order = S.Permutation(size, key=3)
    there = order.forward(np.arange(size))
    assert sorted(there.tolist()) == list(range(size))
    assert (order.backward(there) == np.arange(size)).all()
    if size > 60:
        assert (there != S.Permutation(size, key=4).forward(np.arange(size))).any()
        assert abs(np.corrcoef(np.arange(size), there)[0, 1]) < 0.3
    with pytest.raises(ValueError):
        order.forward([size])


def stream(texts, window):
    tool = encoder(vocabulary())
    ids = np.concatenate([np.append(tool.encode(t or ""), 1) for t in texts]).astype("<u2")
    return [ids[k : k + window] for k in range(0, len(ids), window)]


@pytest.mark.parametrize("records", [4, 1000])
def test_shards_hold_every_sequence_in_slot_order(llm, documents, tmp_path, records):
    window = 64
    docs = documents.select("text").coalesce(1)
    rows = S.write_shards(docs, vocabulary(), str(tmp_path), window=window, shard_records=records).collect()
    wanted = stream([r.text for r in docs.collect()], window)
    assert sorted(r.slot for r in rows) == list(range(len(wanted)))
    rows.sort(key=lambda r: r.slot)
    order = [r.number for r in rows]
    assert sorted(order) == list(range(len(wanted))) and order != sorted(order)
    last, held = None, None
    for r in rows:
        if r.path != last:
            last, held, index = r.path, S.read_shard(r.path, window, 2), 0
        assert r.byte_offset == index * window * 2
        record = held[index]
        assert zlib.crc32(record.tobytes()) == r.crc32
        assert record[: r.n_tokens].tolist() == wanted[r.number].tolist() and not record[r.n_tokens :].any()
        index += 1
    if records == 4:
        assert len({r.path for r in rows}) > 3
    again = S.read_shard(rows[5].path, window, 2, first=rows[5].byte_offset // (2 * window), records=1)
    assert zlib.crc32(again[0].tobytes()) == rows[5].crc32


def test_odd_rows(odd, nothing):
    rows = S.order_documents(odd, vocabulary()).collect()
    tool = encoder(vocabulary())
    assert sum(r.n_tokens for r in rows) == sum(len(tool.encode(r.text or "")) + 1 for r in odd.collect())
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert S.order_documents(nothing, vocabulary()).count() == 0
