import zlib

import numpy as np

from stockloom.llm import language as L


def test_held_out_documents_are_recognised(documents):
    labels = {r.doc_id: r.lang for r in documents.collect()}
    rows = L.identify(documents).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in labels}
    right = [r.lang_pred == labels[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_vectors_are_as_defined():
    profiles = L.Profiles(256)
    first, second, third = (profiles.letter(ord(c)).astype(int) for c in "abc")
    assert set(first.tolist()) == {-1, 1}
    wanted = np.roll(first, 2) * np.roll(second, 1) * third
    assert (profiles.bound(ord("a") << 42 | ord("b") << 21 | ord("c")) == wanted).all()
    keys, counts = L.trigrams("Ab, ab!")
    assert sorted(counts.tolist()) == [1, 2, 2] and len(keys) == 3  # " ab", "ab ", "b a"
    assert profiles.bundle("1 2 ...") is None


def test_small_table_gives_the_same_bundle(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 3 + "zwölf boxkämpfer jagen viktor"
    whole = L.Profiles(128).bundle(text)
    monkeypatch.setattr(L, "_ROWS", 16)
    assert np.allclose(L.Profiles(128).bundle(text), whole)


def test_brute_force_prediction(documents):
    rows = documents.collect()
    profiles, sums = L.Profiles(L.DIMENSIONS), {}
    for r in rows:
        v = profiles.bundle(r.text or "")
        if v is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] = sums.get(r.lang, 0) + v / np.linalg.norm(v)
    found = {r.doc_id: r for r in L.identify(documents).collect()}
    for r in rows:
        v = profiles.bundle(r.text or "")
        cosines = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in sums.items()}
        best = max(cosines, key=cosines.get)
        assert found[r.doc_id].lang_pred == best
        assert abs(found[r.doc_id].score - max(0, cosines[best])) < 1e-5


def test_odd_rows(odd, nothing):
    rows = L.identify(odd).collect()
    assert len(rows) == 11
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 6)} == {"und"}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert L.identify(nothing).count() == 0
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 7, 8}
    assert not {r.doc_id for r in kept.collect()} & {3, 4, 6}
    assert L.keep_identified(nothing).count() == 0


def test_clean_documents_stay_and_monotony_goes(llm, documents):
    base = documents.select("doc_id", "text", "lang", "source", "n_chars")
    junk = llm.createDataFrame([(-1, "zq " * 400, None, "s", 1), (-2, "++ 12 ++", None, "s", 1)], base.schema)
    kept = {r.doc_id for r in L.keep_identified(base.unionByName(junk)).select("doc_id").collect()}
    assert not kept & {-1, -2}
    assert len(kept) > 0.97 * base.count()


def test_short_texts_are_judged_too(llm, documents):
    base = documents.select("doc_id", "text", "lang", "source", "n_chars").where("lang is not null")
    strange = ["これは学習されていない言語で書かれた短い文章です", "Это короткий текст на незнакомом языке", "zqx jvk qqz xkw vvq zzk"]
    clean = [r.text[200:260] for r in base.where("n_chars > 400").orderBy("doc_id").limit(30).collect()]
    rows = [(-1 - k, text, None, "s", 1) for k, text in enumerate(strange)]
    rows += [(-100 - k, text, None, "s", 1) for k, text in enumerate(clean)]
    kept = {r.doc_id for r in L.keep_identified(base.unionByName(llm.createDataFrame(rows, base.schema))).select("doc_id").collect()}
    assert not kept & {-1, -2, -3}
    assert len(kept & {-100 - k for k in range(len(clean))}) >= 28


def test_marks_belong_to_the_letter_before_them():
    greeting = "नमस्ते दुनिया"
    keys = L.trigram_keys(greeting)
    spaces = sum(chr(int(k) & (1 << 21) - 1) == " " for k in keys)
    assert spaces == 2  # behind each word, not inside one
    assert (L.trigram_keys("e\u0301t") == L.trigram_keys("e\u0301t!")).all()
    assert (L.trigram_keys("a \u0301b") == L.trigram_keys("a b")).all()  # a mark without a letter


def test_rows_without_ids_are_learned_from(llm):
    rows = [(None, f"{text} {k}", lang) for k in range(1000) for text, lang in (("the cat sat on the mat", "en"), ("der hund liegt im garten", "de"))]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, sample = L._sample(docs, 50)
    n = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert languages == ["de", "en"] and all(25 <= n[lang] <= 90 for lang in languages)
    assert set(L.prototypes(docs, per_language=50)) == {"de", "en"}


def test_models_and_cuts_come_from_all_labelled_texts(llm):
    # 6,000 texts of one language; the last thousand alone have these words.
    rows = [(k, "aba cab baca" if k < 5000 else "zqz qzq zzqz", "en") for k in range(6000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = L._sums(docs, 64, None)["en"]
    profiles = L.Profiles(64)
    vectors = {t: profiles.bundle(t) / np.linalg.norm(profiles.bundle(t)) for t in ("aba cab baca", "zqz qzq zzqz")}
    whole = 5000 * vectors["aba cab baca"] + 1000 * vectors["zqz qzq zzqz"]
    assert np.allclose(sums, whole) and np.allclose(L.prototypes(docs, 64)["en"], whole / np.linalg.norm(whole))
    # The medians of pieces are those of all texts, each bundled afresh.
    want = []
    for size in range(4):
        scores = []
        for text, n in (("aba cab baca", 5000), ("zqz qzq zzqz", 1000)):
            keys, others = L.trigram_keys(text), whole - vectors[text]
            start = (len(keys) - (1 << size)) // 2
            piece = profiles.bundle_keys(keys[start : start + (1 << size)])
            scores += [float(piece @ others / np.linalg.norm(piece) / np.linalg.norm(others))] * n
        want.append(sorted(scores)[(len(scores) - 1) // 2])
    got = L.expected_scores(docs, {"en": sums}, 64)
    assert len(got) == 4 and np.allclose(got, want, atol=1e-4)


def test_nested_pieces_fetch_the_vectors_of_a_text_once(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog; zwölf boxkämpfer jagen viktor " * 90
    keys = L.trigram_keys(text)
    for rows, n in ((L._ROWS, 1), (L._ROWS, 2), (L._ROWS, 3), (L._ROWS, 127), (L._ROWS, 256), (300, 1001), (L._ROWS, len(keys))):
        monkeypatch.setattr(L, "_ROWS", rows)
        profiles, fetched, part = L.Profiles(64), [], keys[:n]
        vectors = profiles.vectors
        profiles.vectors = lambda keys: fetched.append(len(keys)) or vectors(keys)
        *pieces, whole = profiles.nested(part)
        # Those of the whole text, and at most 2^7 for the short pieces.
        assert sum(fetched) <= len(np.unique(part)) + 128 and len(pieces) == min(n.bit_length(), L.LENGTHS)
        fresh = L.Profiles(64)
        assert (whole == fresh.bundle_keys(part)).all()
        for size, piece in enumerate(pieces):
            start = (n - (1 << size)) // 2
            assert (piece == fresh.bundle_keys(part[start : start + (1 << size)])).all()
