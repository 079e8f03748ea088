import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kasauti.llm import token_alignment as ta
from kasauti.llm.byte_bpe import BYTE_OF

from . import odd

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
OWN = ta.aligner(A, B)
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("  \n\tabcABC'sdt.,!0९é́ß▁")))) | st.sampled_from(
    ["<|endoftext|> x<s> y</s><unk> <0x41>", " a", "a  b", "a\n b \t c", "x\t \ty", "a \x1c b", "a\x85 b", "\xa0 a", " ", "\n", "कक्षा में  है", "\x00 \x00", "🎉 🎉🎉"]
)


def plain(text):
    """Tokens and groups by a loop over byte offsets; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids
    b = LIBRARY_B.encode(text)
    spelt_a = [bytes(BYTE_OF[c] for c in LIBRARY_A.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(LIBRARY_B.id_to_piece(i)[3:5], 16)]) if LIBRARY_B.is_byte(i) else LIBRARY_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
        return None
    groups, i, j = [], 0, 0
    while i < len(a):
        first_a, first_b, x, y = i, j, len(spelt_a[i]), len(spelt_b[j])
        while x != y:
            if x < y:
                i += 1
                x += len(spelt_a[i])
            else:
                j += 1
                y += len(spelt_b[j])
        i, j = i + 1, j + 1
        groups.append((a[first_a:i], b[first_b:j]))
    return a, b, groups


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_as_libraries_and_a_loop(text):
    truth, got = plain(text), OWN.align([text])[0]
    if truth is None:
        assert got is None
        return
    a, b, groups = truth
    assert (got.n_a, got.n_b, got.n_groups, got.n_links) == (len(a), len(b), len(groups), len(groups))
    assert hashlib.sha256(got.groups.encode()).hexdigest() == digest(groups)
    assert np.frombuffer(got.links, "<i8").tolist() == [x[-1] << 32 | y[-1] for x, y in groups]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_other_links(text):
    truth = plain(text)
    if truth:
        products = [x << 32 | y for g in truth[2] for x in g[0] for y in g[1]]
        assert np.frombuffer(ta.aligner(A, B, "products").align([text])[0].links, "<i8").tolist() == products
        got = ta.aligner(A, B, "overlaps").align([text])[0]
        assert got.n_links == got.n_overlaps <= len(products)


def test_expand():
    assert [x.tolist() for x in ta.expand(np.array([2, 1]), np.array([1, 3]))] == [[0, 1, 2, 2, 2], [0, 0, 1, 2, 3]]
    with pytest.raises(ValueError):
        ta.Aligner(A, B, "none")


def test_tables_that_overflow(monkeypatch):
    monkeypatch.setattr(ta, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(ta, "KEPT_CHARS", 4)
    own = ta.Aligner(A, B)
    for text in ["one two three four five", "one longword six", "two three seven▁", " one", "eight\n \n"] * 2:
        truth, got = plain(text), own.align([text])[0]
        assert (truth is None) == (got is None) and (truth is None or hashlib.sha256(got.groups.encode()).hexdigest() == digest(truth[2]))


def brute(rows):
    found = [(i, plain(t)) for i, t in rows]
    counts = Counter((x[-1], y[-1]) for _, f in found if f for x, y in f[2])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in f[2]]
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest(f[2])))
    return sorted(map(repr, out))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1 << 16, 8])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ta, "HOT_PAIRS", hot)
    monkeypatch.setattr(ta, "GATHERED", 64)
    out = ta.alignment_counts(odd.documents(spark, odd.ODD).repartition(3), A, B)
    assert sorted(map(repr, map(tuple, out.select(COLUMNS).collect()))) == brute(odd.ODD)


def test_query_against_brute_force(spark):
    from kasauti.llm.queries import op11_token_alignment

    from ..compare import SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, op11_token_alignment(spark, SMALL).select(COLUMNS).collect()))) == brute(rows)


def test_groups_of_align_and_empty(spark):
    docs = odd.documents(spark, odd.ODD)
    got = {r["doc_id"]: r for r in ta.align(docs.filter("doc_id in (1, 4, 8)"), A, B).collect()}
    a, b, groups = plain(dict(odd.ODD)[8])
    assert got[8]["a_ids"] == a and got[8]["b_ids"] == b and [(g["n_a"], g["n_b"]) for g in got[8]["groups"]] == [(len(x), len(y)) for x, y in groups]
    assert got[1]["a_ids"] == [] == got[1]["groups"] and got[4]["groups"][-1]["end"] == len(" a b c d e f") and "leaf" in got[4].asDict()
    assert ta.alignment_counts(docs.limit(0), A, B).collect() == []
