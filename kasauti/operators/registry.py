"""Perturbations by name and models that write texts: what a caller may run, replace or add to.

A rule is a function of the text it edits and the row's id, as columns; one kind of
rule looks words up in a lexicon. Tables of look-alikes and lexicons belong to a
language; a row whose language has none says so. A model is any function of prompt and
system text, so a test passes one of its own (:func:`echo`) and a client of a service is
a caller's matter; calls, repeats and failures come back as records for the audit log.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import LANGUAGES
from ..sources.fixed import CONFUSABLES, STOPWORDS
from . import perturb


class Languages(NamedTuple):
    """Languages that are known, and their tables of look-alikes. Others that start with ``prefix`` count as it."""

    known: list[str]
    confusables: dict[str, dict[str, str]]
    prefix: str | None = None

    def normal(self, c: Column) -> Column:
        """The language, or null if it is not known."""
        low = F.lower(F.trim(c))
        told = F.when(low.isin(*self.known), low)
        return told.when(low.startswith(self.prefix), self.prefix) if self.prefix else told

    def by_language(self, change: Callable[[dict[str, str]], Column], otherwise: Column) -> Column:
        """``change`` with the table of the row's language."""
        out = F.when(F.lit(False), otherwise)
        for name, twins in self.confusables.items():
            out = out.when(F.col("language") == name, change(twins))
        return out.otherwise(otherwise)


PUBLISHED = Languages(LANGUAGES, CONFUSABLES, "hi")


class Rule(NamedTuple):
    """What is edited (claim or evidence), how (null where it can't be, by languages), and the reason given then."""

    side: str
    change: Callable[[Column, Column, Languages], Column]
    otherwise: Callable[[Column, Column, Languages], Column] | str
    granularity: str = "character"
    target: str = "same_as_gold"
    #: fluency_checked, label_consistent, meaning_preserved of a record.
    flags: tuple[bool, bool, bool] = (False, True, False)
    injected: bool = False
    #: Whether a row of an unknown language is skipped.
    needs_language: bool = True


class Words(NamedTuple):
    """A claim's word becomes an alternative of a lexicon's ``kinds``; ``name`` seeds the draw. ``resource`` is what a language without a lexicon lacks."""

    name: str
    kinds: tuple[str, ...]
    otherwise: str
    resource: str
    spared: tuple[str, ...] = ()
    granularity: str = "word"


def _edit(change: Callable[[Column, Column], Column]) -> Callable[[Column, Column, Languages], Column]:
    return lambda c, row, languages: change(c, row)


def _no_look_alike(c: Column, row: Column, languages: Languages) -> Column:
    missing = F.concat(F.lit("missing_confusables_table_for_"), F.col("language"))
    return languages.by_language(lambda twins: F.lit("no_homoglyph_candidate"), missing)


#: The perturbations that need no model, in canonical order.
REGISTRY: dict[str, Rule | Words] = {
    "CA_CHAR_01_CharacterSwapping": Rule("claim", _edit(perturb.swap), "no_valid_swap_candidate"),
    "CA_CHAR_02_CharacterRepetition": Rule("claim", _edit(perturb.repeat), "no_valid_repetition_candidate"),
    "CA_CHAR_03_CharacterInsertion": Rule("claim", lambda c, row, _: perturb.repeat(c, row, "insert"), "no_valid_insertion_candidate"),
    "CA_CHAR_04_CharacterDeletion": Rule("claim", _edit(perturb.delete), "no_valid_deletion_candidate"),
    "CA_CHAR_05_HomoglyphPerturbation": Rule("claim", lambda c, row, languages: languages.by_language(lambda twins: perturb.replace_char(c, row, twins), F.lit(None).cast("string")), _no_look_alike),
    "CA_WORD_02_EntityDisambiguation": Words("entities", ("entity",), "no_ambiguity_found", "gazetteer"),
    "CA_WORD_03_Jumbling": Rule("claim", _edit(perturb.jumble), lambda c, row, _: perturb.jumble_skip(c), "word"),
    "CA_WORD_04_Typos": Words("typos", ("typo",), "no_applicable_words", "typo_dictionary"),
    "CA_WORD_08_LexicalSubstitution": Words("synonyms", ("synonym",), "no_applicable_candidates", "lexical_resource", tuple(STOPWORDS)),
    "CA_WORD_12_Synonyms": Words("adjectives", ("adjective",), "no_adjectives_found", "lexical_resource"),
    "CA_WORD_13_PhoneticPerturbation": Words("phonetic", ("phonetic",), "no_applicable_words", "phonetic_dictionary"),
    "CA_03_LexicallyInformed": Words("informed", ("synonym", "adjective"), "no_applicable_candidates", "lexical_resource", tuple(STOPWORDS), "sentence"),
    "EA_IMP_01_ImperceptibleVerification": Rule("evidence", lambda c, row, languages: languages.by_language(lambda twins: perturb.imperceptible(c, row, twins), perturb.insert_invisible(c, row)), "no_valid_perturbation", target="REF", flags=(True, True, True)),
    "EA_OMITOMISSION_01_OmissionGeneration": Rule("evidence", _edit(perturb.omit), lambda c, row, _: perturb.omit_skip(c), "sentence", "NEI", (True, True, False)),
    "EA_IMPRET_01_ImperceptibleRetrieval": Rule("evidence", _edit(perturb.invisible_in_words), "no_valid_perturbation", target="NEI", injected=True, needs_language=False),
}

FLAGS = ("fluency_checked", "label_consistent", "meaning_preserved")


def perturb_all(claims: DataFrame, lexicon: DataFrame | None, registry: dict[str, Rule | Words] | None = None, languages: Languages = PUBLISHED) -> DataFrame:
    """A record of each claim and perturbation: row_id, attack_id, language (null if unknown), adversarial_claim or adversarial_evidence, gold_label,
    target_label, edit_granularity, validity_flags, injected_evidence_workaround, and skip_reason where there is no text.

    Rows with an empty claim are left out, as there is nothing to test; a row without
    evidence skips the rules that edit it. ``lexicon`` has word, alternatives, kind and
    language. One pass makes all rules' texts, a second those of the lexicon.
    """
    registry = REGISTRY if registry is None else registry
    there = claims.filter(F.coalesce(F.btrim("claim"), F.lit("")) != "").select("row_id", "claim", "evidence", languages.normal(F.col("language")).alias("language"), F.col("label").alias("gold_label"))
    same = ["row_id", "attack_id", "language", "adversarial_claim", "adversarial_evidence", "gold_label", "target_label", "edit_granularity", "validity_flags", "injected_evidence_workaround", "skip_reason"]
    parts = []
    rules = {name: r for name, r in registry.items() if isinstance(r, Rule)}
    if rules:
        cells = []
        for name, r in rules.items():
            own, row = F.col(r.side), F.col("row_id")
            lacks = [c for c, meant in ((F.coalesce(F.col("evidence"), F.lit("")) == "", r.side == "evidence"), (F.col("language").isNull(), r.needs_language)) if meant]
            missing = lacks[0] if len(lacks) == 1 else lacks[0] | lacks[1] if lacks else F.lit(False)
            lacking = "missing_claim" + "_or_evidence" * (r.side == "evidence") + "_or_unsupported_language" * r.needs_language
            changed = F.when(~missing, r.change(own, row, languages))
            why = F.when(missing, lacking).otherwise(F.lit(r.otherwise) if isinstance(r.otherwise, str) else r.otherwise(own, row, languages))
            flags = F.struct(*[F.lit(v).alias(n) for n, v in zip(FLAGS, r.flags)])
            cells.append(
                F.struct(
                    F.lit(name).alias("attack_id"), F.lit(r.side).alias("side"), changed.alias("changed"), why.alias("why"),
                    F.lit(r.target).alias("target_label"), F.lit(r.granularity).alias("edit_granularity"), flags.alias("validity_flags"), F.lit(r.injected).alias("injected_evidence_workaround"),
                )
            )
        each = there.select("row_id", "language", "gold_label", F.inline(F.array(*cells)))
        sides = {f"adversarial_{side}": F.when(F.col("side") == side, F.col("changed")) for side in ("claim", "evidence")}
        parts.append(each.withColumns(sides | {"skip_reason": F.when(F.col("changed").isNull(), F.col("why"))}).select(*same))
    words = {r.name: (name, r) for name, r in registry.items() if isinstance(r, Words)}
    if words:
        found = perturb.substitute_each(there, lexicon, {n: (list(r.kinds), r.spared) for n, (_, r) in words.items()}, keep=["language", "gold_label"])
        told = lambda what: F.create_map(*[F.lit(x) for n, (name, r) in words.items() for x in (n, what(name, r))])[F.col("attack")]
        # A row for each kind and language of the lexicon at most.
        has: dict[str, set[str]] = {}
        for r in lexicon.select("kind", "language").distinct().collect():
            has.setdefault(r["kind"], set()).add(r["language"])
        able = F.lit(False)
        for n, (_, r) in words.items():
            # Without its first kind a perturbation has no lexicon; the others add to it.
            able = able | ((F.col("attack") == n) & F.col("language").isin(*has.get(r.kinds[0], set())))
        why = F.when(F.col("language").isNull(), "missing_claim_or_unsupported_language").when(~able, F.concat(F.lit("missing_"), told(lambda _, r: r.resource), F.lit("_for_"), F.col("language"))).otherwise(told(lambda _, r: r.otherwise))
        flags = F.struct(*[F.lit(v).alias(n) for n, v in zip(FLAGS, (False, True, False))])
        changed = F.when(able, F.col("changed"))
        parts.append(found.select(
            "row_id", told(lambda name, _: name).alias("attack_id"), "language", changed.alias("adversarial_claim"), F.lit(None).cast("string").alias("adversarial_evidence"), "gold_label", F.lit("same_as_gold").alias("target_label"),
            told(lambda _, r: r.granularity).alias("edit_granularity"), flags.alias("validity_flags"), F.lit(False).alias("injected_evidence_workaround"), F.when(changed.isNull(), why).alias("skip_reason"),
        ))
    if not parts:
        schema = f"row_id long, attack_id string, language string, adversarial_claim string, adversarial_evidence string, gold_label string, target_label string, edit_granularity string, validity_flags struct<{', '.join(f'{n}: boolean' for n in FLAGS)}>, injected_evidence_workaround boolean, skip_reason string"
        return claims.sparkSession.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def echo(prompt: str, system: str | None = None) -> str:
    """A model for tests: says what it was asked."""
    return f"MOCK: {prompt}"


def back_off(failure: Exception, tried: int, base: float = 1.0, most: float = 60.0) -> float:
    """Seconds until the next try: what the failure itself asks for (its ``wait_seconds``), else drawn below a bound that doubles with each try, so tasks don't return together."""
    asked = getattr(failure, "wait_seconds", None)
    return float(asked) if asked is not None else random.uniform(0, min(most, base * 2**tried))


ATTEMPTS = "array<struct<attempt: int, ok: boolean, error: string>>"


def generate(prompts: DataFrame, model: Callable[[str, str | None], str], tries: int = 3, wait: Callable[[float], None] = time.sleep, pause: Callable[[Exception, int], float] = back_off) -> DataFrame:
    """``prompts`` (row_id, attack_id, prompt, system) with text, null where every try failed or there is no prompt, and attempts.

    ``model`` runs in the tasks. A task that is lost asks again, so a model with side
    effects should know its requests.
    """

    def ask(prompt: str | None, system: str | None) -> tuple[str | None, list[dict]]:
        attempts: list[dict] = []
        while prompt is not None and len(attempts) < tries:
            try:
                text = model(prompt, system)
            except Exception as failure:  # any failure of a model is a record, not the job's end
                attempts.append({"attempt": len(attempts) + 1, "ok": False, "error": str(failure)})
                if len(attempts) < tries:
                    wait(pause(failure, len(attempts)))
                continue
            attempts.append({"attempt": len(attempts) + 1, "ok": True, "error": None})
            return text, attempts
        return None, attempts

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            told = [ask(None if pd.isna(q) else q, None if pd.isna(s) else s) for q, s in zip(p["prompt"], p["system"])]
            yield p[["row_id", "attack_id"]].assign(text=[t for t, _ in told], attempts=[a for _, a in told])

    return prompts.select("row_id", "attack_id", "prompt", "system").mapInPandas(batch, f"row_id long, attack_id string, text string, attempts {ATTEMPTS}")


def audit_log(generated: DataFrame, model: str) -> DataFrame:
    """A row for each call: request, model, attempt, ok, error."""
    request = F.concat_ws(":", "row_id", "attack_id").alias("request")
    return generated.select(request, F.lit(model).alias("model"), F.inline("attempts"))


def audit_rates(log: DataFrame) -> DataFrame:
    """model, requests, calls, ok_rate over calls, answered requests, and retries a request."""
    each = log.groupBy("model", "request").agg(F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok"))
    n, calls = F.count(F.lit(1)), F.sum("calls")
    return each.groupBy("model").agg(
        n.alias("requests"), calls.alias("calls"), F.round(F.sum("ok") / calls, 6).alias("ok_rate"), F.count_if(F.col("ok") > 0).alias("answered"), F.round((calls - n) / n, 6).alias("retries")
    )
