import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockloom.llm import lm

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*(w for w in re.split("[\x20\t-\r]+", lowered) if w), "<end>"]


class Plain:
    """The model with dictionaries in place of the filter."""

    def __init__(self, rows):
        texts = [tokens(t) for i, t in rows if not held(i)]
        self.one = Counter(w for t in texts for w in t)
        self.two = Counter(p for t in texts for p in zip(["<end>", *t], t))
        self.n, self.v = sum(self.one.values()), len(self.one)
        q = self.level = lambda c: int(lm.level_of(np.array([c]))[0])
        sums = {}
        for t in texts:
            for v, w in zip(["<end>", *t], t):
                a, b, c = q(self.two[v, w]), q(self.one[v]), q(self.one[w])
                seen, alone = max(lm.LOW[a] - 1, 0) / max(lm.HIGH[b] - 1, 1), max(lm.LOW[c], 1) / (self.n + self.v)
                each = sums.setdefault(b, [0.0] * len(lm.SHARES))
                for k, s in enumerate(lm.SHARES):
                    each[k] += math.log(s * seen + (1 - s) * alone)
        self.share = {b: lm.SHARES[max(range(len(x)), key=x.__getitem__)] for b, x in sums.items()}

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))

    def probability(self, v, w):
        q = self.level
        a, b, c = q(self.two[v, w]), q(self.one[v]), q(self.one[w])
        s = self.share.get(b, 0.0)
        return s * lm.LOW[a] / max(lm.HIGH[b], 1) + (1 - s) * (lm.LOW[c] + 1) / (self.n + self.v + 1)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.probability(v, w)) for v, w in zip(["<end>", *t], t))


def compare(docs, got, score_error, sum_error=1e-9):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = Plain(rows)
    want = sorted(
        (str(i), held(i), len(tokens(t)), sum(model.one[w] > 0 for w in tokens(t)), model.n, model.base(t), model.score(t)) for i, t in rows
    )
    got = sorted((str(r.doc_id), *[r[c] for c in COLUMNS[1:]]) for r in got.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=score_error, abs=1e-6)
    assert sum(a[6] for a in got) == pytest.approx(sum(b[6] for b in want), rel=sum_error)
    return model


def test_documents_against_dictionaries(documents):
    # Very many bits leave no false hit; those of the default shift a score a little.
    model = compare(documents, lm.score_documents(documents, bits_per_entry=20_000), 1e-9)
    compare(documents, lm.score_documents(documents), 0.2, 0.01)
    some = [*list(model.one)[:400], "never seen"]
    for v in ["<end>", *list(model.one)[:5]]:
        assert sum(model.probability(v, w) for w in {*some, *model.one}) <= 1 + 1e-9


def test_rounds_and_rare_words_change_nothing(documents):
    whole = sorted(map(tuple, lm.score_documents(documents).collect()))
    parts = sorted(map(tuple, lm.score_documents(documents, max_bytes=40_000, known_words=500).collect()))
    none = sorted(map(tuple, lm.score_documents(documents, known_words=0).collect()))
    for a, b, c in zip(whole, parts, none):
        assert a[:5] == b[:5] == c[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9) and a[5:] == pytest.approx(c[5:], rel=1e-9)


def test_rounds_respect_the_bound():
    sizes = {c: 10 + c % 7 for c in range(0, lm.CELLS, 3)}
    steps = lm.rounds_of(sizes, 1000)
    assert [a for a, _ in steps] == [0, *(b for _, b in steps[:-1])] and steps[-1][1] == lm.CELLS
    assert all(sum(sizes.get(c, 0) for c in range(a, b)) <= 1000 for a, b in steps)


def test_held_out_texts_are_likelier_than_under_the_base(documents):
    rows = lm.score_documents(documents).where("held_out").collect()
    assert len(rows) > 10 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_levels():
    counts = np.array([0, 1, 2, 3, 4, 5, 6, 7, 100, 10**6, 1 << 61])
    q = lm.level_of(counts)
    assert (lm.LOW[q] <= counts).all() and (counts <= lm.HIGH[q]).all() and q[:6].tolist() == [0, 1, 2, 3, 4, 5]
    assert len(lm.LOW) < 256


def test_filter_has_no_level_too_low_and_few_too_high():
    rng = np.random.default_rng(0)
    keys = (rng.integers(0, 1 << 50, 20_000).astype(np.uint64)) | np.uint64(5 << 50)
    keys = np.unique(keys)
    counts = rng.zipf(1.6, len(keys)).clip(max=10**6)
    cell = int(lm._cell(keys[:1])[0])
    found = lm.Filter(cell, cell + 1, {cell: lm.cell_filter(keys, counts)})
    levels = found.levels(keys)
    truth = lm.level_of(counts)
    assert (levels >= truth).all() and (levels > truth).mean() < 0.03
    others = keys ^ np.uint64(1 << 20)
    others = others[~np.isin(others, keys)]
    assert (found.levels(others) > 0).mean() < 0.03


def test_odd_rows(odd, nothing):
    compare(odd, lm.score_documents(odd, bits_per_entry=20_000), 1e-9)
    assert lm.score_documents(nothing).count() == 0
    unseen = odd.where("doc_id = 2")  # crc32("2") mod 7 decides; one kind of row alone
    row = lm.score_documents(unseen, modulus=1, held_out=0).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score, row.held_out) == (0, 0, 0.0, 0.0, True)
