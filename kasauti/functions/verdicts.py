"""Parsing and judging of replies as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fixed import HINDI_HINTS, INJECTED_SEPARATOR, MOCK_SIGN

LANGUAGES = ["hi", "mni", "te", "ur", "pa", "ta", "or", "ml"]


def fold_label(c: Column) -> Column:
    """SUP, REF or NEI of a free-form label, else ''."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("SUP", "SUPPORTED", "SUPPORTS", "TRUE"), "SUP").when(up.isin("REF", "REFUTED", "REFUTES", "FALSE"), "REF").when(up.isin("NEI", "NOT ENOUGH INFO", "NOT ENOUGH INFORMATION"), "NEI").otherwise("")


def normalise_label(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up.contains("SUP"), "SUP").when(up.contains("REF"), "REF").when(up.contains("NEI") | up.contains("NOT ENOUGH"), "NEI")


def language(c: Column) -> Column:
    """A supported language, any other that starts as Hindi does as Hindi, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*LANGUAGES), low).when(low.startswith("hi"), "hi")


def parse_label(reply: Column) -> Column:
    """NEI, SUP or REF, looked for in this order; then the Hindi words; else null."""
    up = F.upper(reply)
    out = F.when(up.contains("NEI"), "NEI").when(up.contains("SUP"), "SUP").when(up.contains("REF"), "REF")
    for label, words in HINDI_HINTS:
        out = out.when(reduce(lambda a, b: a | b, [reply.contains(w) for w in words]), label)
    return out


def strip_think(c: Column) -> Column:
    """What follows the first </think>; nothing of a thought that does not end."""
    return F.when(c.contains("</think>"), F.trim(F.array_join(F.slice(F.split(c, "</think>"), 2, 1 << 20), "</think>"))).when(c.contains("<think>"), "").otherwise(c)


def clean_response(c: Column) -> Column:
    """Without code fences and quotes around it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.trim(F.regexp_replace(F.trim(bare), '^"+|"+$', ""))


def is_usable(c: Column, least: int = 3) -> Column:
    return F.coalesce(~c.startswith("__ERROR__") & (F.char_length(c) >= least), F.lit(False))


def fluency(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(reply, "$.fluency").cast("int"), F.nullif(F.regexp_extract(reply, r'"fluency"\s*:\s*(\d)', 1), F.lit("")).cast("int"))


def meaning(reply: Column) -> Column:
    told = F.coalesce(F.get_json_object(reply, "$.meaning_preserved"), F.nullif(F.regexp_extract(reply, r"(?i)meaning[_ ]preserved[^a-z]*?(true|false)", 1), F.lit("")))
    return F.lower(told) == "true"


def injected(evidence: Column, extra: Column, flag: Column) -> Column:
    return F.when(flag & (F.coalesce(extra, F.lit("")) != ""), F.concat(evidence, F.lit(INJECTED_SEPARATOR), extra)).otherwise(evidence)


def route(skip: Column, claim: Column, evidence: Column, flag: Column) -> Column:
    """What of a record is put to the verifier."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(full(skip), "skip").when(full(claim), "claim").when(full(evidence) & flag, "injected_evidence").when(full(evidence), "replaced_evidence").otherwise("skip")


def decide(baseline_failed: Column, verdict: Column, gold: Column) -> Column:
    return F.when(baseline_failed, "baseline_failure").when(verdict.isNull(), "unusable_verdict").when(verdict == gold, "no_flip").otherwise("flip")


def gate(mode: Column, fluent: Column, kept: Column) -> Column:
    """Why the quality gate lets a flip pass or not."""
    return (
        F.when(mode == "none", "pass")
        .when(fluent.isNull(), "judge_unavailable")
        .when((mode == "meaning") & kept.eqNullSafe(False), "meaning_drift")
        .when(fluent < 3, "poor_fluency")
        .otherwise("pass")
    )


def mock_verdict(prompt: Column) -> Column:
    return F.when(prompt.contains(MOCK_SIGN), "REF").otherwise("SUP")


def tier(asr: Column, high: float = 0.40, middle: float = 0.15) -> Column:
    return F.when(asr >= high, "POS").when(asr >= middle, "MID").otherwise("NEG")
