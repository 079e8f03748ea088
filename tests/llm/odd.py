"""Rows that operators must not trip over."""

from __future__ import annotations

#: Names that operators use inside.
EXTRA = "id string, leaf int, mark string, fp string, n int, kept string, score string, predicted string, ids string, pos string, host string"


def documents(spark, rows):
    """doc_id and text with clashing further columns, nulls in some of them."""
    filled = [(i, t, None, k, "m", None, k, "x", "s", "p", "i", "o", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(filled, f"doc_id long, text string, {EXTRA}")


LONG = "word " * 200_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a  b c d e f"), (None, None), (6, LONG), (7, LONG.upper()), (8, "é\U0001f389 कक्ष \x00\x1c")]
