"""Text, verdict and statistics columns on literals."""

import random

import pytest
from pyspark.sql import functions as F

from kasauti.functions import picks, stats, text, verdicts
from kasauti.sources import tables
from kasauti.sources.fixed import INJECTED_SEPARATOR


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "clusters"),
    [("क्ष", ["क्", "ष"]), ("राजधानी", ["रा", "ज", "धा", "नी"]), ("abc", ["a", "b", "c"]), ("्क", ["्", "क"]), ("", [])],
)
def test_clusters(spark, word, clusters):
    assert one(spark, text.clusters(F.col("w")), w=word) == clusters


def test_marks_viramas_joiners(spark):
    assert one(spark, text.is_mark(F.col("w")), w="ा") is True
    assert one(spark, text.has_virama(F.col("w")), w="क्") is True
    assert one(spark, text.has_joiner(F.col("w")), w="क‍") is True
    assert one(spark, text.strip_marks(F.col("w")), w="नी") == "न"


def test_tokens_and_spans(spark):
    assert one(spark, text.tokens(F.col("w")), w=" a  bc\td ") == ["a", "bc", "d"]
    assert [tuple(s) for s in one(spark, text.spans(F.col("w")), w=" a  bc")] == [("a", 1, 2), ("bc", 4, 6)]


@pytest.mark.parametrize(("token", "parts"), [("“राम,”", ("“", "राम", ",”")), ("...", ("", "...", "")), ("a-b", ("", "a-b", ""))])
def test_strip_punctuation(spark, token, parts):
    w = F.col("w")
    assert one(spark, F.struct(text.lead_punct(w), text.core(w), text.trail_punct(w)), w=token) == parts


def test_jaccard_and_char_f(spark):
    tokens = lambda c: F.array_distinct(text.tokens(F.col(c)))
    assert one(spark, text.jaccard(tokens("a"), tokens("b")), a="x y z", b="y z w") == 0.5
    assert one(spark, text.jaccard(tokens("a"), tokens("b")), a="", b="y") == 0
    assert one(spark, text.char_fscore(F.col("a"), F.col("b")), a="abcd", b="a b c d") == 1
    # shares "ab" of bigrams alone: the other lengths are skipped, not counted as 0
    assert one(spark, text.char_fscore(F.col("a"), F.col("b")), a="abx", b="aby") == 0.5
    assert one(spark, text.char_fscore(F.col("a"), F.col("b")), a="a", b="b") == 0


@pytest.mark.parametrize(
    ("value", "verdict"),
    [
        ("   ", "empty_text"),
        ("Привет мир", "invalid_script_encoding"),
        ("heyyyy", "excessive_character_repetition"),
        ("किाम", "illegal_stacked_diacritics"),
        ("्राम", "leading_virama"),
        ("राम घर गया।", "valid_orthography"),
    ],
)
def test_orthography(spark, value, verdict):
    assert one(spark, text.orthography(F.col("w")), w=value) == verdict


@pytest.mark.parametrize(("mode", "after", "verdict"), [("none", "b a", "pass"), ("meaning", "x q", "meaning_drift"), ("fluency", "x q", "pass"), ("fluency", "zzzz", "poor_orthography")])
def test_quality_gate(spark, mode, after, verdict):
    assert one(spark, text.quality_gate(F.lit("alpha beta"), F.col("w"), F.lit(mode)), w=after) == verdict


@pytest.mark.parametrize(("reply", "label"), [("NEI or SUP", "NEI"), ("it is refuted", "REF"), ("यह सही है", "SUP"), ("यह गलत", "REF"), ("?", None)])
def test_parse_label(spark, reply, label):
    assert one(spark, verdicts.parse_label(F.col("w")), w=reply) == label


@pytest.mark.parametrize(
    ("reply", "fluency", "meaning"),
    [('{"fluency": 4, "meaning_preserved": true}', 4, True), ('bad "fluency": 2, meaning preserved: FALSE', 2, False), ('{"fluency": "5"}', 5, None), ("none", None, None)],
)
def test_parse_quality(spark, reply, fluency, meaning):
    assert one(spark, verdicts.fluency(F.col("w")), w=reply) == fluency
    assert one(spark, verdicts.meaning(F.col("w")), w=reply) is meaning


@pytest.mark.parametrize(
    ("failed", "verdict", "reason"), [(True, None, "baseline_failure"), (False, None, "unusable_verdict"), (False, "SUP", "no_flip"), (False, "REF", "flip")]
)
def test_decide_order(spark, failed, verdict, reason):
    assert one(spark, verdicts.decide(F.lit(failed), F.lit(verdict).cast("string"), F.lit("SUP"))) == reason


@pytest.mark.parametrize(
    ("mode", "fluency", "kept", "reason"),
    [("none", None, None, "pass"), ("meaning", None, True, "judge_unavailable"), ("meaning", 1, False, "meaning_drift"), ("meaning", 2, None, "poor_fluency"), ("fluency", 3, False, "pass"), ("meaning", 3, None, "pass")],
)
def test_gate_order(spark, mode, fluency, kept, reason):
    assert one(spark, verdicts.gate(F.lit(mode), F.lit(fluency).cast("int"), F.lit(kept).cast("boolean"))) == reason


def test_responses(spark):
    clean = lambda w: one(spark, verdicts.clean_response(verdicts.strip_think(F.col("w"))), w=w)
    assert clean('```json\n"x y"\n```') == "x y"
    assert clean("<think>a</think> b </think> c") == "b </think> c"
    assert clean("<think>a") == ""
    assert one(spark, verdicts.is_usable(F.col("w")), w="__ERROR__ x") is False
    assert one(spark, verdicts.is_usable(F.col("w")), w="ab") is False


def test_injection_route_language_label(spark):
    assert one(spark, verdicts.injected(F.lit("e"), F.lit("x"), F.lit(True))) == f"e{INJECTED_SEPARATOR}x"
    assert one(spark, verdicts.injected(F.lit("e"), F.lit(""), F.lit(True))) == "e"
    none = F.lit(None).cast("string")
    assert one(spark, verdicts.route(none, F.lit("c"), F.lit("e"), F.lit(True))) == "claim"
    assert one(spark, verdicts.route(none, none, F.lit("e"), F.lit(False))) == "replaced_evidence"
    assert one(spark, verdicts.route(F.lit("why"), F.lit("c"), none, F.lit(False))) == "skip"
    assert one(spark, verdicts.language(F.col("w")), w="Hindi") == "hi"
    assert one(spark, verdicts.language(F.col("w")), w="en") is None
    assert one(spark, verdicts.fold_label(F.col("w")), w=" refuted ") == "REF"
    assert one(spark, verdicts.mock_verdict(F.col("w")), w=f"a{INJECTED_SEPARATOR}b") == "REF"


def test_wilson_published(spark):
    ends = one(spark, F.array(*[stats.wilson(F.lit(k), F.lit(832), s) for k in (397, 0) for s in ("lo", "hi")]))
    assert [round(100 * e, 2) for e in ends] == [44.34, 51.11, 0.0, 0.46]


def test_kappa_published(spark):
    for (a, b, c, d), expected in (((251, 6, 4, 39), 0.867), ((246, 14, 6, 34), 0.734)):
        n = a + b + c + d
        got = one(spark, stats.kappa(F.lit((a + d) / n), F.lit(((a + b) * (a + c) + (c + d) * (b + d)) / n**2)))
        assert round(got, 3) == expected


def test_mcnemar(spark):
    assert abs(one(spark, stats.mcnemar_exact(F.lit(1).cast("long"), F.lit(7).cast("long"))) - 2 * 9 / 256) < 1e-12
    assert one(spark, stats.mcnemar_exact(F.lit(0).cast("long"), F.lit(0).cast("long"))) == 1
    assert one(spark, stats.mcnemar_chi2(F.lit(1), F.lit(7))) == 25 / 8


def test_log_factorial_continues(spark):
    import math

    for n in (0, 1, 5, 256, 257, 100000):
        assert math.isclose(one(spark, stats.log_factorial(F.lit(n).cast("long"))), math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-9)


def test_picks_are_stable(spark):
    assert one(spark, picks.pick(F.lit(10), F.lit(7), "x")) == int(__import__("hashlib").md5(b"42:7:x").hexdigest()[:8], 16) % 10


def test_attack_table(spark):
    a = tables.attacks(spark)
    assert a.count() == 22 and a.select("attack_id").distinct().count() == 22


def test_packed_grams_score_as_strings_do(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab कि😀\u2028\t") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 400]))) for _ in range(80)]
    df = spark.createDataFrame([(a, rng.choice([b, a, a[: len(a) // 2]])) for a, b in zip(texts, texts[::-1])] + [(None, "abc"), ("abc", None), ("x" * 50_000, "x" * 3)], "a string, b string")
    for r in df.select("a", "b", text.char_fscore(F.col("a"), F.col("b")).alias("one"), text.char_fscore_of_texts(F.col("a"), F.col("b")).alias("two")).collect():
        assert r.two == (pytest.approx(r.one) if r.a is not None and r.b is not None else None)
