r"""Text primitives as columns. White space is ASCII \s throughout; put U+00A0 through ``tidy`` first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXTEND = r"\p{Mn}\p{Mc}\p{Me}\p{Cf}\p{Cc}\p{Sk}"
SPACES = " \t\n\x0b\x0c\r"
VIRAMAS = "्্੍્୍்్್്"


def tidy(c: Column) -> Column:
    """U+00A0 becomes a space; none at the ends."""
    return F.trim(F.translate(c, " ", " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clusters(c: Column) -> Column:
    """Grapheme clusters: a character and the marks that follow it; leading marks are a cluster of their own."""
    return F.regexp_extract_all(c, F.lit(f"(?s).[{EXTEND}]*"), F.lit(0))


def is_mark(cluster: Column) -> Column:
    return cluster.rlike(f"^[{EXTEND}]+$")


def has_virama(cluster: Column) -> Column:
    return cluster.rlike(f"[{VIRAMAS}]")


def has_joiner(c: Column) -> Column:
    return c.contains("‍")


def strip_marks(cluster: Column) -> Column:
    return F.regexp_replace(cluster, f"[{EXTEND}]+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def spans(c: Column) -> Column:
    """(token, start, end) of every token, from 0."""
    parts = F.regexp_extract_all(c, F.lit(r"\s*\S+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        token, end = F.regexp_replace(part, r"^\s+", ""), acc["at"] + F.char_length(part)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(token.alias("token"), (end - F.char_length(token)).alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def lead_punct(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{P}+$"), "").otherwise(F.regexp_extract(token, r"^\p{P}*", 0))


def core(token: Column) -> Column:
    """The token without punctuation at its ends; itself when it is nothing else."""
    return F.when(token.rlike(r"^\p{P}+$"), token).otherwise(F.regexp_replace(token, r"^\p{P}+|\p{P}+$", ""))


def trail_punct(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{P}+$"), "").otherwise(F.regexp_extract(token, r"\p{P}*$", 0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a text without white space."""

    def joined(letters: Column) -> Column:
        # From an array, as a substring of a long text is found by counting from its start.
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(letters) - n), lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)])))

    return F.when(F.char_length(c) >= n, _let(F.split(c, ""), joined)).otherwise(F.array().cast("array<string>"))


def _set_f1(s: Column) -> Column:
    shared = F.size(F.array_intersect(s["a"], s["b"]))
    return F.when(shared > 0, 2.0 * shared / (F.size(s["a"]) + F.size(s["b"])))


def char_fscore(a: Column, b: Column) -> Column:
    """Mean set F1 over 2-, 3- and 4-grams, of those n that share any; 0 if none does."""

    def score(s: Column) -> Column:
        sets = F.array(*[F.struct(grams(s["a"], n).alias("a"), grams(s["b"], n).alias("b")) for n in (2, 3, 4)])
        return _let(
            F.filter(F.transform(sets, _set_f1), lambda x: x.isNotNull()),
            lambda f: F.when(F.size(f) == 0, 0.0).otherwise(F.aggregate(f, F.lit(0.0), lambda t, x: t + x) / F.size(f)),
        )

    left, right = (F.regexp_replace(c, r"\s+", "") for c in (a, b))
    return _let(F.struct(left.alias("a"), right.alias("b")), score)


def packed_grams(text: str) -> list[np.ndarray]:
    """The distinct 2-, 3- and 4-grams of a text, each gram as numbers: 21 bits a character, the fourth beside them."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    pack = lambda n: sum(letters[k : len(letters) - n + 1 + k] << np.uint64(21 * (n - 1 - k)) for k in range(n))
    two, three = (np.unique(pack(n)) if len(letters) >= n else letters[:0] for n in (2, 3))
    if len(letters) < 4:
        return [two, three, np.zeros(0, dtype=FOUR)]
    four = np.empty(len(letters) - 3, dtype=FOUR)
    four["head"], four["last"] = pack(3)[:-1], letters[3:]
    order = np.lexsort((four["last"], four["head"]))
    four = four[order]
    return [two, three, four[np.append(True, four[1:] != four[:-1])]]


#: A 4-gram: three packed characters and the last.
FOUR = np.dtype([("head", np.uint64), ("last", np.uint64)])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many rows two sorted sets share: the shorter one looks its rows up in the longer."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0
    if a.dtype != FOUR:
        return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    both = np.concatenate([a, b])
    both = both[np.lexsort((both["last"], both["head"]))]
    return int((both[1:] == both[:-1]).sum())


@F.pandas_udf(DoubleType())
def _char_fscore_of_batches(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for left, right in zip(a, b):
        if left is None or right is None:
            out.append(None)
            continue
        pairs = list(zip(packed_grams(left), packed_grams(right)))
        scores = [2.0 * n / (len(x) + len(y)) for x, y in pairs if (n := _shared(x, y))]
        out.append(sum(scores) / len(scores) if scores else 0.0)
    return pd.Series(out, dtype="float64")


def char_fscore_of_texts(a: Column, b: Column) -> Column:
    """``char_fscore`` of long texts, in Arrow batches: grams are packed into numbers instead of strings of their own; null if a text is."""
    return _char_fscore_of_batches(*(F.regexp_replace(c, r"\s+", "") for c in (a, b)))


def script_ratio(c: Column) -> Column:
    """Share of Devanagari, ASCII and punctuation among the characters that are not white space."""
    solid = F.regexp_replace(c, r"\s+", "")
    return F.char_length(F.regexp_replace(solid, r"[^ऀ-ॿ\x00-\x7F\p{P}]", "")) / F.nullif(F.char_length(solid), F.lit(0))


def orthography(c: Column) -> Column:
    """The first rule that a text breaks, or valid_orthography."""
    return (
        F.when(F.trim(c) == "", "empty_text")
        .when(script_ratio(c) < 0.85, "invalid_script_encoding")
        .when(c.rlike(r"(.)\1{3,}"), "excessive_character_repetition")
        .when(c.rlike("[ा-ौ]{2}"), "illegal_stacked_diacritics")
        .when(F.ltrim(c).startswith("्"), "leading_virama")
        .otherwise("valid_orthography")
    )


def quality_gate(original: Column, changed: Column, mode: Column) -> Column:
    """pass, poor_orthography or meaning_drift, without a model: orthography, and for mode meaning token Jaccard or character F."""
    close = (jaccard(F.array_distinct(tokens(original)), F.array_distinct(tokens(changed))) >= 0.5) | (char_fscore(original, changed) >= 0.6)
    return F.when(mode == "none", "pass").when(orthography(changed) != "valid_orthography", "poor_orthography").when((mode == "meaning") & ~close, "meaning_drift").otherwise("pass")
