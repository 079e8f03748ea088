import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kasauti.llm import vector_codes as vc


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label) that count."""
    whole = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(v * 1024) if abs(v) < 2**53 else int(v) * 1024 for v in r[1]] for r in whole]
    dim = len(ints[0]) // parts
    cut = [[x[p * dim : (p + 1) * dim] for x in ints] for p in range(parts)]
    books = [[list(x) for x in own[:entries]] for own in cut]

    def assigned(p):
        out = []
        for x in cut[p]:
            d = [sum((u - v) ** 2 for u, v in zip(x, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            codes = [c for c, _ in assigned(p)]
            for e in set(codes):
                own = [x for x, c in zip(cut[p], codes) if c == e]
                books[p][e] = [sum(v) // len(own) for v in zip(*own)]
    last = [assigned(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(last[p][k][1] for p in range(parts)) for k in range(len(whole))]
    by_label = {}
    for r, e in zip(whole, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    clip = lambda v: min(v, vc.LONG)
    return sorted(repr((r[0], "".join(f"{last[p][k][0]:02x}" for p in range(parts)), clip(errors[k]), clip(by_label[r[2]]), digest)) for k, r in enumerate(whole))


def coded(spark, rows, kind="float", **how):
    extra = [(*r, 1, "c", 2.0, "s", None) for r in rows]
    df = spark.createDataFrame(extra, f"vec_id long, embedding array<{kind}>, label int, leaf int, code string, error double, id string, of int").repartition(3)
    return sorted(repr(tuple(r)) for r in vc.vector_codes(df, **how).collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(1, 3000), st.booleans(), st.randoms(use_true_random=False))
def test_nearest_as_a_loop(m, dim, spread, wide, rnd):
    """Ties, entries of one norm, and numbers beyond doubles among them."""
    scale = 10**200 if wide else 1
    draw = lambda n: np.array([[rnd.randrange(-spread, spread) * scale for _ in range(dim)] for _ in range(n)], object)
    parts, entries = draw(30), draw(m)
    codes, errors = vc.nearest(parts if wide else parts.astype(float), entries)
    for x, c, e in zip(parts.tolist(), codes.tolist(), errors.tolist()):
        d = [sum((u - v) ** 2 for u, v in zip(x, y)) for y in entries.tolist()]
        assert (c, int(e)) == (d.index(min(d)), min(d))


def test_few_entries_are_evaluated(monkeypatch):
    """Entries beyond the annuli never meet a part."""
    rng = np.random.default_rng(1)
    entries = np.sort(rng.integers(0, 100_000, 256))[:, None] * np.ones((1, 4), int)
    parts = rng.integers(0, 100_000, 20_000)[:, None] * np.ones((1, 4), int)
    met = []
    of = vc.Book.of
    # Rows of the codebook that a product takes.
    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            met.append(len(got))
            return np.asarray(got)

    monkeypatch.setattr(vc.Book, "of", staticmethod(lambda e: (b := of(e))._replace(entries=b.entries.view(Counted))))
    vc.nearest(parts.astype(float), entries)
    assert sum(met) < 0.3 * 256 * len(met)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i // 2 if i % 7 else None, [round(rnd.gauss(0, 0.3), 2) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(90)]
    rows += rows[:5] + [(3, [0.0] * 8, 1)] * 4
    odd = [(0, None, 1), (1, [], 1), (2, [1.0] * 7, 2), (3, [None] + [1.0] * 7, 3), (4, [float("nan")] * 8, 1), (5, [float("-inf")] + [0.0] * 7, None)]
    for entries in (256, 16):
        assert coded(spark, rows + odd, "double", entries=entries) == brute(rows, entries=entries)
    f32 = [(i, [float(np.float32(v)) for v in x], b) for i, x, b in rows]
    assert coded(spark, f32 + odd, entries=8, rounds=2) == brute(f32, entries=8, rounds=2)


def test_wide_numbers_few_rows_and_none(spark):
    huge = [(i, [v, -v, 1.0, 2.0**60, v / 3, 0.1, 0.0, -(2.0**52)], i % 2) for i, v in enumerate([1e308, 1e300, 3.0, 1e308, -1e308, 2.0**53])]
    assert coded(spark, huge, "double", entries=3) == brute(huge, entries=3)
    one = [(7, [0.5, 0.25, 0.1, -0.1], None)]
    assert coded(spark, one) == brute([(7, [float(np.float32(v)) for v in one[0][1]], None)])
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    assert [eval(r)[1:3] for r in coded(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0)] * 2
    uneven = coded(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0, 2.0, 3.0, 4.0, 6.0], 1)], entries=2)
    assert [eval(r)[1:3] for r in uneven] == [("00000000", 0), ("00000001", 0)]
    with pytest.raises(ValueError):
        coded(spark, one, entries=257)


def test_query_against_sql(spark):
    from kasauti.llm.queries import ORACLES, op12_vector_codes

    from ..compare import SMALL, same

    same(op12_vector_codes(spark, SMALL), ORACLES["op12_vector_codes"])
