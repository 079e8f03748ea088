import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kasauti.llm import suffix_dedup as sd

from . import odd


def brute(texts, least):
    """Removed runs of each text."""
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        edges = [i for i in range(len(t) + 1) if gone[i] != (gone[i - 1] if i else 0)]
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


def copies(rnd, n, alphabet=b"ab\0", longest=120):
    """Texts that share passages, some with edits."""
    passages = [bytes(rnd.choices(alphabet, k=rnd.randint(10, longest))) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = b"".join(rnd.choice([rnd.choice(passages), bytes(rnd.choices(alphabet, k=rnd.randint(0, 30)))]) for _ in range(rnd.randint(0, 4)))
        if t and rnd.random() < 0.3:
            i = rnd.randrange(len(t))
            t = t[:i] + bytes(rnd.choices(alphabet)) + t[i + 1 :]
        texts.append(t)
    return texts


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(32, 60))
def test_anchors_own_each_start_once(rnd, least):
    texts = copies(rnd, 6)
    found = sd.anchors(texts, least)
    starts = [(t, s) for t, a, b in zip(*(c.tolist() for c in found[:3])) for s in range(a, b + 1)]
    assert sorted(starts) == [(n, s) for n, t in enumerate(texts) for s in range(len(t) - least + 1)]
    by_string = {}
    for t, a, b, k in zip(*(c.tolist() for c in found)):
        for s in range(a, b + 1):
            by_string.setdefault(texts[t][s : s + least], set()).add(k)
    assert all(len(keys) == 1 for keys in by_string.values())


@settings(max_examples=400, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 30))
def test_suffix_array_and_repeats(rnd, least):
    strings = list({t for t in copies(rnd, 8) if len(t) >= least})
    if not strings:
        return
    owned = [len(s) - least + 1 for s in strings]
    array = sd.SuffixArray(strings, owned, least)
    suffix = lambda at: strings[k := int(np.searchsorted(array.begins, at, "right")) - 1][at - int(array.begins[k]) :]
    own = [suffix(int(a)) for a in array.suffixes]
    assert own == sorted(suffix(int(b) + i) for b, k in zip(array.begins, owned) for i in range(k))
    for x, y, common in zip(own, own[1:], array.prefixes.tolist()):
        real = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert common == (real if real >= least else 0)
    for r in array.repeats():
        # All occurrences, and not one more; its string can't be longer.
        text = suffix(int(r.starts[0]))[: r.length]
        assert sorted(r.starts.tolist()) == sorted(int(a) for a, s in zip(array.suffixes, own) if s[: r.length] == text)
        assert len({s[r.length : r.length + 1] for s in map(suffix, map(int, r.starts))}) > 1 or any(len(suffix(int(a))) == r.length for a in r.starts)
    covered = [[] for _ in strings]
    for s, low, high in zip(*(c.tolist() for c in array.covered())):
        covered[s].append((low, high))
    assert covered == brute(strings, least)


def test_stretches_of_long_texts(monkeypatch):
    monkeypatch.setattr(sd, "PIECE_BITS", 8)
    rnd = random.Random(2)
    texts = copies(rnd, 20, longest=900)
    found = sd.anchors(texts, 40)
    starts = [(t, s) for t, a, b in zip(*(c.tolist() for c in found[:3])) for s in range(a, b + 1)]
    assert sorted(starts) == [(n, s) for n, t in enumerate(texts) for s in range(len(t) - 39)]
    with pytest.raises(ValueError):
        sd.anchors([b"x" * 60], 31)


def found(spark, texts, least, parts=4, **how):
    df = odd.documents(spark, [(n, t.decode()) for n, t in enumerate(texts)]).repartition(parts)
    rows = {r["doc_id"]: r for r in sd.drop_repeats(df, least, **how).collect()}
    for n, t in enumerate(texts):
        r = rows[n]
        assert r["n_bytes"] == len(t) and r["n_spans"] == len(r["spans"]) and r["n_removed"] == sum(b - a for a, b in r["spans"]) == len(t) - len(r["kept"])
        keep = np.ones(len(t), bool)
        for a, b in r["spans"]:
            keep[a:b] = False
        assert bytes(r["kept"]) == bytes(np.frombuffer(t, np.uint8)[keep])
    return [[tuple(s) for s in rows[n]["spans"]] for n in range(len(texts))]


@pytest.mark.parametrize("most", [None, 2, 0])
def test_against_brute_force(spark, monkeypatch, most):
    """By suffix arrays alone, by digests alone, and both; in leaves of several sizes."""
    monkeypatch.setattr(sd, "LEAF_BYTES", 900)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 300)
    monkeypatch.setattr(sd, "GATHERED", 3000)
    rnd = random.Random(most)
    texts = copies(rnd, 120, b"abcdefgh \n", 200) + [b"word " * 60, b"word " * 40, b"x" * 300, b"", b"short", "é🎉".encode() * 30]
    texts += [texts[3]] * 3
    expected = brute(texts, 36)
    assert sum(map(len, expected)) > 50
    assert found(spark, texts, 36, most=most) == expected


def test_query_against_brute_force(spark):
    from kasauti.llm.queries import op13_suffix_dedup

    from ..compare import SMALL

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: spans for (i, _), spans in zip(docs, brute([t.encode() for _, t in docs], 200))}
    assert sum(map(len, expected.values())) > 20
    for r in op13_suffix_dedup(spark, SMALL).collect():
        spans = expected.pop(r["doc_id"])
        assert (r["n_spans"], r["n_removed"]) == (len(spans), sum(b - a for a, b in spans))
    assert not expected


def test_odd_rows(spark):
    rows = [*odd.ODD, (9, "y" * 200), (9, "y" * 200), (10, "z" * 199), (11, "z" * 199)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sd.drop_repeats(odd.documents(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert {x for x in got if x[0] in (9, 10, 11)} == {(9, 200, 200, 1), (10, 199, 0, 0), (11, 199, 0, 0)}
    assert {x[2] for x in got if x[0] in (6, 7)} == {len(odd.LONG)} and all(x[2] == 0 for x in got if x[0] in (1, 2, 3, 4, 5, 8, None))
    assert sd.drop_repeats(odd.documents(spark, rows).limit(0)).collect() == []
