import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stockloom.llm import phrases as P


def plain(rows, least=10, top=2000):
    f = defaultdict(Counter)
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in often.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], a)
        for g, a in often.items():
            if 100 * longer[g] >= 50 * a and longer[g]:
                continue
            cuts = [(10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, phrase, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def result(docs, **settings):
    return sorted(map(tuple, P.mine_phrases(docs, **settings).collect()))


@pytest.mark.parametrize(
    "settings", [{}, {"trigger": 2}, {"trigger": 10_000}, {"filter_bytes": 1}, {"least": 3}, {"least": 3, "top": 7}], ids=str
)
def test_documents_against_brute_force(documents, settings):
    rows = [(r.lang, r.text) for r in documents.collect()]
    want = plain(rows, settings.get("least", 10), settings.get("top", 2000))
    assert want and result(documents, **settings) == want


@given(st.text(alphabet="ab ,\t", max_size=60), st.integers(1, 9))
def test_chunks_hold_every_phrase_once(text, trigger):
    tokens = P.stream(text)
    own = Counter()
    for chunk, words in P.chunks(tokens, trigger):
        t = chunk.split(b" ")
        assert words == sum(x != P.BREAK for x in t[:-2])
        for i in range(len(t) - 2):
            for k in (1, 2, 3):
                if i + k <= len(t) and P.BREAK not in t[i : i + k]:
                    own[tuple(x.decode() for x in t[i : i + k])] += 1
    want = Counter()
    for piece in text.split(","):
        w = piece.split()
        for k in (1, 2, 3):
            want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    assert own == want


def test_no_chunk_begins_another(documents):
    found = set()
    for r in documents.limit(100).collect():
        found |= {chunk for chunk, _ in P.chunks(P.stream(r.text or ""))}
    ordered = sorted(c.split(b" ") for c in found)
    # A chunk ends with its first trigger, so only the end marks of whole texts repeat.
    assert not any(b[: len(a)] == a for a, b in zip(ordered, ordered[1:]))


def test_copies_share_their_chunks(llm):
    text = " ".join(f"word{k % 37}" for k in range(400))
    docs = llm.createDataFrame([("en", text)] * 50, "lang string, text string").repartition(7)
    parsed = P.dictionary(docs).collect()
    assert len(parsed) <= len(P.chunks(P.stream(text))) and sum(r.n for r in parsed) == 50 * len(P.chunks(P.stream(text)))


def test_large_products_are_exact(llm):
    big = 900_000_000_000_000 - 1
    rows = [("x", "a b", 2, big), ("x", "a", 1, big + 1), ("x", "b", 1, big + 7), ("x", "b c", 2, big // 3), ("x", "a b c", 3, big // 3), ("x", "c", 1, big)]
    counts = llm.createDataFrame(rows, "lang string, phrase string, words int, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in P.score_cuts(counts).collect()}
    assert got["a b"] == (big, big + 1, big + 7, 10**6 * big * big // ((big + 1) * (big + 7)))
    third = big // 3
    cuts = [(10**6 * third**2 // ((big + 1) * third), big + 1, third), (10**6 * third**2 // (big * big), big, big)]
    score, x, y = min(cuts)
    assert got["a b c"] == (third, x, y, score)


def test_odd_rows(odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert result(odd) == plain(rows)
    assert result(odd, least=1) == plain(rows, least=1)
    assert P.mine_phrases(nothing).count() == 0
