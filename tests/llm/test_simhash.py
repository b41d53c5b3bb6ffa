import random
import re

import pytest
import xxhash

from stockloom.llm import simhash as S
from stockloom.llm.components import connected_components


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs):
    """Smallest id reachable per id, from all pairs."""
    fps = dict(pairs)
    ids = sorted(fps)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 2 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


@pytest.mark.parametrize("text", ["", "  \n", "One", "one Two", "A b c", "ÄB ä b c d\x0be f", "x y z " * 500])
def test_fingerprint(text):
    assert S.simhash(text) == slow_fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    items = list({rng.getrandbits(12) for _ in range(300)})
    tree = S.BKTree()
    for item in items:
        tree.add(item)
    for query in items[:60] + [rng.getrandbits(12) for _ in range(60)]:
        found = sorted(tree.items[k] for k in tree.within(query, 2))
        assert found == sorted(x for x in items if (x ^ query).bit_count() <= 2)


@pytest.mark.parametrize("limit", [2, 8, 1024])
def test_groups_with_large_shards(llm, limit):
    rng = random.Random(limit)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):  # one dense cloud and a few strangers
        fps.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
        fps.add(rng.getrandbits(64))
    pairs = [(k, fp) for k, fp in enumerate(sorted(fps))]
    rows = [(fp - (1 << 64) if fp >> 63 else fp, k) for k, fp in pairs]
    nodes = llm.createDataFrame(rows, "fp long, node long")
    found = {r.node: r.component for r in connected_components(S.near_links(nodes, 2, limit), "a", "b").collect()}
    assert {k: found.get(k, k) for k, _ in pairs} == groups_of(pairs)


def test_documents(documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(documents).collect()}
    slow = {k: slow_fingerprint(t) for k, t in texts.items()}
    low = groups_of(slow.items())
    assert found == {k: (format(slow[k], "016x"), low[k]) for k in texts}


def test_odd_rows(odd, nothing):
    found = sorted(S.near_duplicates(odd).collect(), key=repr)
    assert len(found) == 11
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[2].component_id == 1
    assert by_id[3].fingerprint == "0" * 16 and by_id[4].component_id == 3
    without = {r.fingerprint: r.component_id for r in found if r.doc_id is None}
    assert without["0" * 16] == 3 and len(without) == 2
    assert [c for fp, c in without.items() if fp != "0" * 16] == [None]
    assert S.near_duplicates(nothing).count() == 0
    kept = S.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7, 8]
    assert kept.where("doc_id IS NULL").count() == 2
    assert S.keep_one_of_each(nothing).count() == 0


def test_components_of_chains_and_hubs(llm):
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(1000, 1200)]
    edges = llm.createDataFrame([*chain, *hub, (5, 5), (None, 3), (1100, 20)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert {found[k] for k in range(100, 161)} == {100}
    assert {found[k] for k in [7, 20, *range(1000, 1200)]} == {7}
    assert 5 not in found and 3 not in found
