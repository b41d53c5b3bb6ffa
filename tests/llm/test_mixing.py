from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockloom.llm import mixing as M
from stockloom.llm.queries import QUERIES, SQL
from tools.check import compare, connect


@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_windows_and_deviation(parts):
    period, slots = sum(parts), M.period_slots(parts)
    assert sorted(s for own in slots for s in own) == list(range(period))
    for n, own in zip(parts, slots):
        assert len(own) == n
        for j, s in enumerate(own):
            assert j * period // n <= s < -(-(j + 1) * period // n)
        for t in range(period + 1):
            assert abs(sum(s < t for s in own) - Fraction(t * n, period)) < 1


def test_schedule(llm):
    rows = [(k, "a" if k % 4 else "b", "t" * (k % 13 + 1)) for k in range(400)]
    docs = llm.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = M.mixture_schedule(docs, parts={"a": 1, "b": 2}, block=50).collect()
    streams, lengths = defaultdict(int), {}
    for k, s, text in rows:
        lengths[k] = (streams[s], s)
        streams[s] += len(text)
    blocks = {s: -(-n // 50) for s, n in streams.items()}
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == {k for k, *_ in rows}
    assert all(copies[k] == 1 for k, s, _ in rows if s == "a") and max(copies.values()) > 1
    taken = defaultdict(set)
    for r in out:
        start, source = lengths[r.doc_id]
        assert (r.start, r.source, r.block) == (start, source, start // 50)
        number = r.epoch * blocks[source] + r.block
        assert r.slot == number // {"a": 1, "b": 2}[source] * 3 + M.period_slots([1, 2])[source == "b"][number % {"a": 1, "b": 2}[source]]
        taken[r.slot].add(source)
    assert all(len(s) == 1 for s in taken.values())


def test_mixed_rows_are_in_order_and_whole(documents):
    mixed = M.mix_sources(documents)
    assert mixed.columns == documents.columns
    wanted = M.mixture_schedule(documents)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {
        r.doc_id: r["count"] for r in wanted.groupBy("doc_id").count().collect()
    }
    slots = {(r.doc_id, r.epoch): r.slot for r in wanted.collect()}
    seen, order = Counter(), []
    for r in mixed.select("doc_id").collect():
        order.append(slots[r.doc_id, seen[r.doc_id]])
        seen[r.doc_id] += 1
    assert order == sorted(order)


def test_sql(llm, small):
    from stockloom.catalog.registry import Query

    query = Query("op4", lambda t: QUERIES["op4_source_mixture"](t.spark, t.directory), SQL["op4_source_mixture"])
    status, detail, _ = compare(query, llm, connect(small), small)
    assert status == "ok", detail


def test_odd_rows(odd, nothing):
    out = M.mixture_schedule(odd, block=16).collect()
    first = [r for r in out if r.epoch == 0]
    assert sum(r.copies for r in first) == 11
    assert {r.source for r in first} == {"a", "b", "c", "", None}
    mixed = M.mix_sources(odd, block=16)
    assert mixed.columns == odd.columns
    assert mixed.distinct().count() == odd.distinct().count()
    assert M.mixture_schedule(nothing).count() == 0 and M.mix_sources(nothing).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        M.mixture_schedule(odd, parts={"a": 1})
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    assert M.mix_sources(empty).count() >= 11
