import hashlib

import pytest

from kasauti.llm import line_dedup as ld

from . import odd

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACES).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_chars, min_docs):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max((i for i in d if i is not None), default=None) for k, d in holders.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(map(repr, out))


LINE = "Thís LINE is repeated over and over again"


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_against_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ld, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(ld, "HOT_KEYS", 1)
    rows = odd.ODD + [(50 + i, f"{LINE}\n  {LINE} \nown {i}\n{'x' * 39}{'y' * (i % 2)}\n") for i in range(8)] + [(50, f"{LINE}\nrow with an id again"), (60, "\n\n")]
    out = ld.line_dedup(odd.documents(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"])) for r in out) == brute(rows, 40, 5)


def test_bitmap_and_empty(spark):
    rows = [(i, f"a\n{LINE}\nb\n{LINE}\n{LINE}") for i in range(6)]
    bits = {r["id"]: [tuple(k) for k in r["keep"]] for r in ld.keep_bitmaps(odd.documents(spark, rows)).collect()}
    assert bits == {i: [(0, 1), (2, 1)] for i in range(5)}
    assert ld.line_dedup(odd.documents(spark, rows).limit(0)).collect() == []


def test_no_python_in_plan(spark):
    plan = ld.line_dedup(odd.documents(spark, odd.ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digest_column_of_query(spark):
    from kasauti.llm.queries import QUERIES

    r = QUERIES["op9_line_dedup"](spark, "/root/testdata/sf0.001").first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256().hexdigest())
