import random
import zlib

import numpy as np
import pytest

from stockloom.llm.packing import choose_cuts, pack_documents, powers_of_two, windows_of
from stockloom.llm.queries import vocabulary
from stockloom.llm.tokens import encoder


def best_cost(positions, prices, window):
    """Shortest path over all pairs of cuts."""
    cost = [0] + [None] * (len(positions) - 1)
    for k in range(1, len(positions)):
        ways = [
            cost[i] + window - (positions[k] - positions[i]) + prices[k]
            for i in range(k)
            if positions[k] - positions[i] <= window
        ]
        cost[k] = min(ways)
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_cheapest(seed):
    rng = random.Random(seed)
    positions, prices = [0], [0]
    for _ in range(rng.randint(1, 60)):
        positions.append(positions[-1] + rng.randint(1, 16))
        prices.append(rng.choice([0, 2, 24]))
    cuts = choose_cuts(positions, prices, 16)
    at, total = 0, 0
    for k in cuts:
        assert positions[k] - positions[at] <= 16
        total += 16 - (positions[k] - positions[at]) + prices[k]
        at = k
    assert at == len(positions) - 1
    assert total == best_cost(positions, prices, 16)


@pytest.mark.parametrize("stretch", [8, 64, 10_000])
def test_windows_keep_every_token_in_order(stretch):
    rng = np.random.default_rng(3)
    documents = [(k, rng.integers(0, 50, n).astype("<u2")) for k, n in enumerate([1, 3, 200, 1, 1, 40, 17, 5])]
    ends = np.zeros(50, dtype=bool)
    ends[:4] = True
    windows = list(windows_of(iter(documents), ends, window=16, stretch=stretch))
    stream = [(d, start + j, t) for parts in windows for d, start, ids, _ in parts for j, t in enumerate(ids.tolist())]
    assert stream == [(d, j, t) for d, ids in documents for j, t in enumerate(ids.tolist())]
    sizes = [sum(len(ids) for _, _, ids, _ in parts) for parts in windows]
    assert max(sizes) <= 16


def test_powers_of_two():
    assert powers_of_two(13) == [8, 4, 1]
    assert powers_of_two(0) == []


def check_pieces(rows, texts):
    """``texts``: (id, text) of every input row; the pieces hold each token once."""
    tool = encoder(vocabulary())
    wanted = sorted(((i is None, i or 0), tuple([*tool.encode(t or "").tolist(), 1])) for i, t in texts)
    pieces = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for r in pieces:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    assert max(at.values(), default=0) <= 2048
    found, current = [], None
    for r in pieces:
        if r.start == 0:
            current = []
            found.append((r, current))
        assert r.start == len(current)
        current += r.ids
    assert all(r.doc_tokens == len(ids) for r, ids in found)
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(ids)) for r, ids in found) == wanted


def test_odd_rows(odd, nothing):
    rows = pack_documents(odd, vocabulary(), keep_ids=True).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert pack_documents(nothing, vocabulary()).count() == 0


def test_documents_with_little_padding(documents):
    rows = pack_documents(documents, vocabulary(), keep_ids=True).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in documents.collect()])
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert padding < 0.03 * sum(sizes.values())


def test_encoder_equals_the_reference():
    tool = encoder(vocabulary())
    rng = random.Random(7)
    signs = "aB1 .,\n'’é²½\t中#$-_́ \x1c"
    texts = ["", " ", "a  b", "<|endoftext|>x", "it's  don't", *["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(3000)]]
    for text in texts:
        assert tool.encode(text).tolist() == tool.reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_bounded_cache_changes_nothing():
    from stockloom.llm.tokens import Encoder

    small, text = Encoder(vocabulary(), limit=3), "one two, three. four five one\ntwo three four"
    assert small.encode(text).tolist() == encoder(vocabulary()).encode(text).tolist()
    assert len(small.words) <= 4
