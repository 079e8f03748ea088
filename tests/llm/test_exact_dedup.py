import hashlib
import re

import pytest

from kasauti.llm import exact_dedup as e

from . import odd


def expected(rows):
    """keep_id and group_size of each digest; nulls last."""
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(i)
    return {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items()}


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_against_brute_force(spark, parts):
    rows = odd.ODD + [(100 + i, f"t{i % 7} {' ' * (i % 3)}x") for i in range(200)]
    out = e.exact_dedup(odd.documents(spark, rows).repartition(parts)).collect()
    truth = expected(rows)
    assert len(out) == len(rows)
    kept = {}
    for r in out:
        assert (r["keep_id"], r["group_size"]) == truth[r["text_sha256"]]
        kept.setdefault(r["text_sha256"], []).append(r["doc_id"]) if r["kept"] else None
    assert {d: v for d, v in kept.items()} == {d: [k] for d, (k, _) in truth.items()}


def test_merge_keeps_smallest_and_counts():
    import struct

    def entry(key, i, n=1):
        return struct.pack(">32sQQQIQ", key, 1, 1, i, 0, n)

    runs = [b"".join(sorted(entry(k, i) for k, i in run)) for run in ([(b"a", 5), (b"c", 1)], [(b"a", 2), (b"b", 9)], [(b"c", 0)])]
    merged = list(e._combined(e._merged(iter(sorted(runs)))))
    assert [(m[:1], int.from_bytes(m[48:56], "big"), int.from_bytes(m[-8:], "big")) for m in merged] == [(b"a", 2, 2), (b"b", 9, 1), (b"c", 0, 2)]


def test_empty_and_drop(spark):
    docs = odd.documents(spark, odd.ODD)
    assert e.exact_dedup(docs.limit(0)).collect() == []
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(expected(odd.ODD))
    assert e.drop_copies(docs.limit(0)).count() == 0


def test_rows_of_one_id_and_equal_text_that_look_different(spark):
    rows = [(7, "a  b"), (7, "a b"), (7, "a\tb"), (9, "a b")]
    for parts in (1, 3):
        docs = odd.documents(spark, rows).coalesce(1).repartition(parts)
        assert [r["doc_id"] for r in e.drop_copies(docs).collect()] == [7]
    one = {e.drop_copies(odd.documents(spark, rows[k:3] + rows[:k]).coalesce(1)).first()["text"] for k in range(3)}
    assert len(one) == 1
