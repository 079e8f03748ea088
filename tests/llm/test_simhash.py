import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kasauti.llm import simhash as sh

from . import odd


def slow_fingerprint(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius):
    fps = [slow_fingerprint(t, 3) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[label[i]] = min(doc, ids.get(label[i], doc))
    return [ids.get(x) for x in label], fps


def near(seed, n=60):
    r = random.Random(seed)
    base = [r.choice(["sun", "moon", "star", "sky", "sea"]) + str(r.randrange(30)) for _ in range(80)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 else [str(r.random()) for _ in range(20)]
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "x"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sh, "TILE", 7)  # many small tiles, so hot cells are split
    rows = odd.ODD[:8] + [(900, "A B"), (901, "a b")] + near(seed)
    out = sh.near_duplicates(odd.documents(spark, rows).repartition(3)).collect()
    expected, fps = slow_components(rows, 2)
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in out) == sorted(repr((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, expected))


def test_minhash_bits_tell_similarity():
    words = [f"w{i}" for i in range(400)]
    base = sh.shape(" ".join(words), 5)
    for changes, most in ((0, 0), (8, 16)):
        other = list(words)
        for i in range(changes):
            other[20 + 40 * i] = "new"
        assert (base.sig ^ sh.shape(" ".join(other), 5).sig).bit_count() <= most
    assert (base.sig ^ sh.shape(" ".join(f"v{i}" for i in range(400)), 5).sig).bit_count() > 16


def test_shape_is_of_the_set(monkeypatch):
    one, two = "a b c d e f g h " * 3, "a b c d e f g h " * 300
    assert sh.shape(one, 5) == sh.shape(two, 5) and sh.shape(one, 5).size == 8
    assert (sh.shape("", 5).fp, sh.shape("", 5).size) == (0, 0)
    text = " ".join(str(i * i % 997) for i in range(3000))
    whole = sh.shape(text, 5)
    monkeypatch.setattr(sh, "SHINGLES", 100)
    assert sh.shape(text, 5) == whole


def test_long_text_counts_every_shingle(monkeypatch):
    monkeypatch.setattr(sh, "SHINGLES", 16)
    text = " ".join(str(i % 91) for i in range(500))
    assert sh.fingerprint(text, 3) == slow_fingerprint(text, 3)


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_join_all_within_radius(spark, blocks):
    r = np.random.default_rng(7)
    fps = [int(x) for x in r.integers(-(2**63), 2**63, 40)]
    fps += [f ^ (1 << int(r.integers(63))) ^ (1 << int(r.integers(63))) for f in fps for _ in range(3)]
    fps = sorted({*fps, *(f + 2**63 if f < 0 else f - 2**63 for f in fps[::2])})
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    found = sh.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, blocks).collect()
    assert all(apart(x["u"], x["v"]) == x["distance"] <= 3 for x in found)

    def groups(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[max(find(u), find(v))] = min(find(u), find(v))
        return [find(f) for f in fps]

    assert groups([(x["u"], x["v"]) for x in found]) == groups([(a, b) for a in fps for b in fps if a < b and apart(a, b) <= 3])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in sh.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert sh.components(edges.limit(0)).count() == 0


def test_drop_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    changed = words[:50] + ["new"] + words[51:]
    rows = [(3, " ".join(words)), (9, " ".join(changed)), (1, "quite another text of its own kind that says nothing alike"), (3, " ".join(words)), (None, None), (12, "")]
    docs = odd.documents(spark, rows)
    kept = sh.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 12]
    assert sh.drop_near_copies(docs.limit(0)).count() == 0
    assert sh.drop_near_copies(docs.filter(F.col("doc_id") != 3)).count() == 3


def edited_copies(seed, copies, words=200, edits=4):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = [(0, " ".join(base))]
    for i in range(copies):
        changed = list(base)
        for k in r.sample(range(words), edits):
            changed[k] = f"x{r.randrange(5000)}"
        out.append((i + 1, " ".join(changed)))
    return out


def jaccard(x, y):
    one, two = (set(zip(*(w[i:] for i in range(5)))) or ({tuple(w)} if w else set()) for w in (x.lower().split(), y.lower().split()))
    return len(one & two) / len(one | two) if one | two else 1.0


def slow_kept(rows):
    """First ids of the groups that all pairs of enough similarity join: nothing but Jaccard decides."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sh._root(root, i) != sh._root(root, j) and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                p, q = sh._root(root, i), sh._root(root, j)
                root[max(p, q)] = min(p, q)
    return sorted(rows[i][0] for i in range(len(rows)) if sh._root(root, i) == i)


def kept_of(spark, rows):
    return sorted(r["doc_id"] for r in sh.drop_near_copies(odd.documents(spark, rows)).collect())


@pytest.mark.parametrize("block", [256, 20])
def test_star_of_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK", block)  # with 20 a group has several blocks, and large parts have blocks of their own
    monkeypatch.setattr(sh, "SHAPE_TILE", 64 if block == 20 else 8192)
    rows = edited_copies(3, 250)
    assert kept_of(spark, rows) == slow_kept(rows)


def test_texts_that_one_passage_fills_stay(spark):
    """Over half of all shingles repeat one passage, so with repeats both would have its fingerprint."""
    r = random.Random(5)
    rows = [(i, "spam " * 400 + " ".join(str(r.random()) for _ in range(300))) for i in (1, 2, 3)]
    assert sh.fingerprint(rows[0][1], 5) == sh.fingerprint(rows[1][1], 5)
    assert kept_of(spark, rows) == [1, 2, 3]


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    """Whatever fingerprints and MinHash say, unlike texts stay and like ones go."""
    honest = sh.shape
    monkeypatch.setattr(sh, "shape", lambda text, width: honest(text, width)._replace(fp=7, sig=7))
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(200 + i % 3))) for i in range(12)]
    rows += [(20 + i, t + " and more") for i, t in rows[:4]]
    assert kept_of(spark, rows) == list(range(12)) == slow_kept(rows)


def alike(r, words, least):
    """A copy of words whose similarity lies as little over ``least`` as some hundred random edits find."""
    best, text = None, " ".join(words)
    other = list(words)
    for _ in range(len(words)):
        changed = list(other)
        at = r.randrange(len(changed))
        changed[at : at + r.randrange(2)] = [f"n{r.randrange(10**6)}"]
        if jaccard(text, " ".join(changed)) < least:
            break
        other, best = changed, True
    return " ".join(other) if best else None


@pytest.mark.parametrize("repeats", [1, 3, 5])
def test_recall_against_jaccard(spark, repeats):
    """Pairs of similarity 0.8 to 0.9, and with repeats: copies in which a third of the text stands several times."""
    r = random.Random(repeats)
    rows = []
    while len(rows) < 600:
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([25, 60, 150, 400]))]
        third = len(words) // 3
        other = alike(r, words, 0.8) if repeats == 1 else " ".join(words[:third] * repeats + words[third:])
        if other and jaccard(" ".join(words), other) >= 0.8:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, other)]
    kept = kept_of(spark, rows)
    assert set(range(0, 600, 2)) <= set(kept)
    found = 1 - sum(i % 2 for i in kept) / 300
    assert found >= 0.98


def test_rows_that_repeat_an_id_and_null_ids(spark):
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words)
    rows = [(5, text), (5, text + " tail"), (5, text + " other"), (None, text + " last"), (8, text + " more")]
    assert kept_of(spark, rows) == [5]
    assert sh.drop_near_copies(odd.documents(spark, [(None, text), (None, text + " tail"), (None, "x y z")])).count() == 2


def test_empty(spark):
    assert sh.near_duplicates(odd.documents(spark, []).limit(0)).collect() == []
