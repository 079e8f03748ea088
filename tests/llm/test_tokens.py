import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kasauti.llm import byte_bpe, token_counts

from . import odd

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
CODEC = byte_bpe.codec(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
COUNTER, LIBRARY = token_counts.counter(WORDS), Tokenizer.from_file(WORDS)
TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("  \n\tabcABC'sdt.,!0९é́ß")))) | st.sampled_from(["<|endoftext|> x<|startoftext|>y", "İ ΑΣ don't  stop\n\n\n x", "\x00a \x00 b", "  "])


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encodes_as_tiktoken_and_decodes(text):
    ids = CODEC.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_offsets_as_library(text):
    ids = CODEC.encode([text])[0]
    if ids:
        starts, ends = CODEC.offsets(text, ids)
        assert list(zip(starts.tolist(), ends.tolist())) == CODEC.tokenizer.encode(text, add_special_tokens=False).offsets


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_as_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_counts_of_every_code_point():
    """Between letters, where it parts a word, joins it, is lower-cased or composed."""
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    expected = [len(e.ids) for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
    assert [f"U+{ord(t[1]):04X}" for t, n in zip(texts, expected) if COUNTER.count(t) != n] == []


def test_tables_that_overflow(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_CHARS", 4)
    monkeypatch.setattr(token_counts, "KEPT", 3)
    codec, counter = byte_bpe.Codec(RANKS, P.PATTERN), token_counts.Counter(WORDS)
    texts = ["one two three four five", "one longword six", "two three seven", " one", "eight"] * 2
    for t in texts:
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary(t)
        assert counter.count(t) == len(LIBRARY.encode(t, add_special_tokens=False).ids)
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_operators_on_odd_rows(spark):
    docs = odd.documents(spark, odd.ODD)
    rows = byte_bpe.round_trip(docs, RANKS, P.PATTERN, keep=["doc_id"]).collect()
    expected = []
    for i, t in odd.ODD:
        ids = TIKTOKEN.encode_ordinary(t or "")
        begins = [b[0] for b in TIKTOKEN.decode_tokens_bytes(ids)]
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), sum(b & 0xC0 == 0x80 for b in begins)))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    assert {"id", "leaf", "starts", "ends"} <= set(encoded.columns) and encoded.columns.count("ids") == 1
    back = byte_bpe.decode(encoded.select("doc_id", "ids"), RANKS, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in odd.ODD)
    counts = token_counts.token_counts(docs, WORDS).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    truth = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in odd.ODD]
    assert sorted(map(repr, map(tuple, counts))) == sorted(map(repr, truth))


def test_split_characters_and_empty(spark):
    df = spark.createDataFrame([(1, CODEC.tokenizer.encode("🎉").ids[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in byte_bpe.decode(df, RANKS, P.PATTERN).orderBy("doc_id").collect()][1] == ""
    none = odd.documents(spark, odd.ODD).limit(0)
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).collect() == [] == token_counts.token_counts(none, WORDS).collect()
