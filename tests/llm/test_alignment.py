import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockloom.llm import alignment as A
from stockloom.llm.tokens import encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """The definition: whole texts through both libraries, all pairs of ranges compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.raw = encoder(BYTES).token_bytes

    def piece(self, k):
        return bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()

    def links(self, text):
        if not text:
            return None
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        one, two = [self.raw[t] for t in a], [self.piece(t) for t in b]
        if b"".join(one) != f" {text}".encode() or b"".join(two) != f" {text}".encode():
            return None

        def ranges(parts):
            at = 0
            for x in parts:
                yield at, at + len(x)
                at += len(x)

        ra, rb = list(ranges(one)), list(ranges(two))
        starts = [y[0] for y in rb]
        pairs = []
        for i, x in enumerate(ra):
            for j in range(max(0, bisect_right(starts, x[0]) - 1), len(rb)):
                if rb[j][0] >= x[1]:
                    break
                if x[0] < rb[j][1]:
                    pairs.append((a[i], b[j]))
        ends = sorted({y for _, y in ra} & {y for _, y in rb})
        mine = [defaultdict(list), defaultdict(list)]
        for ids, rs, into in ((a, ra, mine[0]), (b, rb, mine[1])):
            for t, r in zip(ids, rs):
                into[bisect_right(ends, r[0])].append(str(t))
        groups = [f"{','.join(mine[0][k])}|{','.join(mine[1][k])}" for k in range(len(ends))]
        return len(a), len(b), groups, pairs


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, texts):
    cache = {t: plain.links(t) for t in set(texts)}
    count = Counter()
    for t in texts:
        if cache[t]:
            count.update(set(cache[t][3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for t in texts:
        if cache[t] is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = cache[t]
        sums = sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs)
        out.append((n_a, n_b, len(groups), len(pairs), *sums, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [
    "plain words, and more", " leading", "trailing ", "two  spaces", "a   b", "\n", " ", "  ", "x\n  y", "x\n y", "tab\tstop", "<|endoftext|> as text",
    "<s> </s> <unk> <0x0A>", "▁ lower", "naïve café 日本語 \U0001f600 é", "don't we'll I'm", "  nbsp　x", "end.\n\nNext  ", "\x00 zero", "x  y", "12345 6.78",
]


def check_one(plain, text):
    tool = A.aligner(BYTES, PIECES)
    want, found = plain.links(text), next(tool.align([text]))
    if want is None:
        assert found is None, text
        return
    n_a, n_b, groups, pairs = want
    assert found.counts() == (n_a, n_b, len(groups), len(pairs)), text
    assert tool.groups(found) == ";".join(groups), text
    assert found.links.tolist() == [a * (1 << 20) + b for a, b in pairs], text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(plain, text):
    check_one(plain, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab zZ.,'\n\t é▁日1 ")), max_size=40))
def test_random_texts(plain, text):
    check_one(plain, text)


@pytest.mark.parametrize("broadcast", [0, 300, 1 << 19])
def test_documents_against_brute_force(llm, documents, plain, broadcast):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], expected(plain, [r.text for r in rows])))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.align_documents(documents, BYTES, PIECES, broadcast).collect()}
    assert got == want


def test_odd_rows(odd, nothing, plain):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *e) for r, e in zip(rows, expected(plain, [r.text for r in rows])))
    got = Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in A.align_documents(odd, BYTES, PIECES).collect())
    assert got == want
    assert A.align_documents(nothing, BYTES, PIECES).count() == 0
    kept = A.align_documents(odd, BYTES, PIECES, keep_groups=True).where("n_a > 0").collect()
    assert kept and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in kept)


def test_each_distinct_text_is_aligned_once(llm, odd):
    aligned = A.aligned_texts(odd.union(odd), BYTES, PIECES)
    assert aligned.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert aligned.agg(F.sum("copies")).first()[0] == 2 * odd.count()
