import hashlib
import re

from pyspark.sql import functions as F

from stockloom.llm import sketches as S


def shingles(text):
    words = [w for w in re.split("[\x20\t-\r]+", text.lower()) if w]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_against_brute_force(documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    ids = sorted(texts)
    rows = {r.doc_id: r for r in S.compare_edits(documents).collect()}
    assert sorted(rows) == ids
    errors = []
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(rows[i].near_edited - jaccard(shingles(text), shingles(edited))))
        errors.append(abs(rows[i].near_next - jaccard(shingles(text), shingles(after))))
    assert sum(errors) / len(errors) < 0.05
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], rows[i].fingerprint) == rows[i].fingerprint


def test_short_texts_are_compared_exactly(llm):
    pairs = [("a b c d e f", "a b c d e g"), ("", ""), ("a", ""), ("A  b", "a b"), ("a b c d e f g h", "b c d e f g h i")]
    df = llm.createDataFrame(pairs, "x string, y string")
    df = S.with_sketch(S.with_sketch(df, "x", "sx"), "y", "sy")
    got = df.select("x", "y", S.likeness(F.col("sx"), F.col("sy")).alias("j"), S.containment(F.col("sx"), F.col("sy")).alias("c"))
    for r in got.collect():
        a, b = shingles(r.x), shingles(r.y)
        assert abs(r.j - jaccard(a, b)) < 1e-12
        assert abs(r.c - (len(a & b) / len(a) if a else 1.0)) < 1e-12


def test_sketches_merge(llm):
    one, two = " ".join(f"w{k}" for k in range(900)), " ".join(f"v{k}" for k in range(40))
    df = llm.createDataFrame([(one, two, f"{one}")], "x string, y string, z string")
    for c in "xyz":
        df = S.with_sketch(df, c, f"s{c}")
    r = df.select(
        "sx", "sy", S.merge(F.col("sx"), F.col("sy")).alias("m"), S.containment(F.col("sx"), F.col("sz")).alias("same")
    ).first()
    limit = -(1 << 63) + (1 << 61)
    assert r.m == sorted({h for h in [*r.sx, *r.sy] if h < limit})
    assert r.same == 1.0


def test_odd_rows(odd, nothing):
    rows = S.compare_edits(odd).collect()
    assert len(rows) == 11
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = next(r for r in rows if r.doc_id == 1)
    assert one.near_next == 1.0  # document 2 has the same text
    empty = next(r for r in rows if r.doc_id == 3)
    assert empty.n_chars == 0 and empty.fingerprint == "" and empty.near_next == 1.0
    assert S.compare_edits(nothing).count() == 0
    assert S.fingerprint_documents(odd).count() == 11


def test_single_document_is_its_own_next(odd):
    row = S.compare_edits(odd.where("doc_id = 8")).first()
    assert row.near_next == 1.0


def test_plan_is_native_and_shares_the_text_shuffle(llm, documents):
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.compare_edits(documents)
        df.collect()
    finally:
        llm.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Python" not in plan and "Arrow" not in plan
