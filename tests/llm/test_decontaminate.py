import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kasauti.llm import decontaminate as d

from . import odd


def nearest(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=120))
def test_myers_distance(pattern, text):
    least, end = d.Pattern(pattern).best(text)
    assert least == nearest(pattern, text)
    assert nearest(pattern, text[:end]) == least


def brute(items, text):
    body = d.plain(text)
    return {n: k for n, t in enumerate(items) if d.plain(t).strip() and (k := nearest(d.plain(t), body)) <= int(d.RATE * len(d.plain(t)))}


def test_against_brute_force():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 12, 25, 40, 60)] + ["", "!?", None]
    finder = d.Finder(items, d.RATE)
    for _ in range(150):
        item = list(r.choice(items[:6]))
        for _ in range(r.randrange(0, 1 + int(0.12 * len(item)))):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice(["", "x", "yz", item[at]])
        text = " ".join([word() for _ in range(r.randrange(30))] + ["".join(item).upper()] + [word() for _ in range(r.randrange(30))])
        assert {h.item: h.distance for h in finder.hits(text)} == brute(items, text)


def test_operators_on_odd_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs into the wide open field today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (None, "zebra")], "item_id long, text string")
    rows = odd.ODD + [(70, f"Say: {item.upper()}!"), (71, item.replace("lazy", "hazy")), (70, f"Say: {item.upper()}!"), (72, "zebras"), (73, "a Zebra.")]
    docs = odd.documents(spark, rows)
    for size in (4 << 20, 60):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = sorted(repr((r["doc_id"], r["item_id"], r["distance"])) for r in d.contaminations(docs, bench).collect())
        assert got == sorted(map(repr, [(70, 1, 0), (70, 4, 0), (70, 1, 0), (70, 4, 0), (71, 1, 1), (71, 4, 1), (73, None, 0)]))
        kept = d.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(i) for i, _ in odd.ODD + [(72, "")])
    assert d.contaminations(docs, bench.limit(0)).collect() == [] and d.contaminations(docs.limit(0), bench).collect() == []
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
