"""The registry of perturbations, and models passed in by the caller."""

from pyspark.sql import functions as F

from kasauti.operators import perturb, registry
from kasauti.operators.records import apply_generated
from kasauti.sources.fixed import ATTACKS, LEXICON

CLAIMS = "row_id long, claim string, evidence string, label string, language string"


def test_all_rules_are_registered_in_order():
    names = [a[0] for a in ATTACKS]
    rules = [a[0] for a in ATTACKS if a[2] == "Rule"] + ["EA_IMPRET_01_ImperceptibleRetrieval"]
    assert list(registry.REGISTRY) == rules and set(rules) <= set(names)


def lexicon(spark, language="hi"):
    return spark.createDataFrame([(*e, n, language) for n, e in enumerate(LEXICON)], "word string, alternatives array<string>, kind string, place int, language string")


def test_every_claim_and_perturbation_has_a_row(spark):
    claims = spark.createDataFrame([(1, "the people walked home", "born in 1999 here", "SUP", "Hindi"), (2, "a b", None, None, "ur"), (3, None, "x", "REF", "hi"), (4, "  ", "x", "REF", "hi"), (5, "word", "", "NEI", "hi")], CLAIMS)
    rows = registry.perturb_all(claims, lexicon(spark)).collect()
    assert sorted((r["row_id"], r["attack_id"]) for r in rows) == sorted((i, a) for i in (1, 2, 5) for a in registry.REGISTRY)
    for r in rows:
        assert [r["adversarial_claim"], r["adversarial_evidence"], r["skip_reason"]].count(None) == 2
        assert r["language"] == ("ur" if r["row_id"] == 2 else "hi") and r["injected_evidence_workaround"] == ("IMPRET" in r["attack_id"])


#: What a claim's records say, as published: attack, claim, evidence, language, reason (None: a text is made).
CASES = [
    ("CA_CHAR_01_CharacterSwapping", "abc def", "e", "hi", None),
    ("CA_CHAR_01_CharacterSwapping", "aaa bbb", "e", "hi", "no_valid_swap_candidate"),
    ("CA_CHAR_02_CharacterRepetition", "abc", "e", "te", "no_valid_repetition_candidate"),
    ("CA_CHAR_03_CharacterInsertion", "abc", "e", "te", "no_valid_insertion_candidate"),
    ("CA_CHAR_04_CharacterDeletion", "abc", "e", "te", "no_valid_deletion_candidate"),
    ("CA_CHAR_04_CharacterDeletion", "abcd", "e", "xx", "missing_claim_or_unsupported_language"),
    ("CA_CHAR_04_CharacterDeletion", "abcd", "e", None, "missing_claim_or_unsupported_language"),
    ("CA_CHAR_05_HomoglyphPerturbation", "जल", "e", "hi", None),
    ("CA_CHAR_05_HomoglyphPerturbation", "जल", "e", "ur", "no_homoglyph_candidate"),
    ("CA_CHAR_05_HomoglyphPerturbation", "ک", "e", "ur", None),
    ("CA_CHAR_05_HomoglyphPerturbation", "abc", "e", "hi", "no_homoglyph_candidate"),
    ("CA_CHAR_05_HomoglyphPerturbation", "జ", "e", "te", "missing_confusables_table_for_te"),
    ("CA_WORD_02_EntityDisambiguation", "nothing here", "e", "hi", "no_ambiguity_found"),
    ("CA_WORD_02_EntityDisambiguation", "of it", "e", "pa", "missing_gazetteer_for_pa"),
    ("CA_WORD_03_Jumbling", "a b", "e", "hi", "claim_too_short"),
    ("CA_WORD_03_Jumbling", "a a a", "e", "hi", "shuffle_reproduced_original"),
    ("CA_WORD_04_Typos", "from me", "e", "hi", None),
    ("CA_WORD_04_Typos", "nothing", "e", "hi", "no_applicable_words"),
    ("CA_WORD_04_Typos", "from me", "e", "ml", "missing_typo_dictionary_for_ml"),
    ("CA_WORD_08_LexicalSubstitution", "he was here today", "e", "hi", "no_applicable_candidates"),
    ("CA_WORD_08_LexicalSubstitution", "the end", "e", "hi", "no_applicable_candidates"),
    ("CA_WORD_08_LexicalSubstitution", "with that", "e", "hi", None),
    ("CA_WORD_08_LexicalSubstitution", "with that", "e", "or", "missing_lexical_resource_for_or"),
    ("CA_WORD_12_Synonyms", "he was here today", "e", "hi", None),
    ("CA_WORD_12_Synonyms", "with that", "e", "hi", "no_adjectives_found"),
    ("CA_WORD_13_PhoneticPerturbation", "to them", "e", "hi", None),
    ("CA_WORD_13_PhoneticPerturbation", "nothing", "e", "hi", "no_applicable_words"),
    ("CA_WORD_13_PhoneticPerturbation", "to them", "e", "ta", "missing_phonetic_dictionary_for_ta"),
    ("CA_03_LexicallyInformed", "nothing", "e", "hi", "no_applicable_candidates"),
    ("CA_03_LexicallyInformed", "he was", "e", "hi", None),
    ("CA_03_LexicallyInformed", "he was", "e", "mni", "missing_lexical_resource_for_mni"),
    ("EA_IMP_01_ImperceptibleVerification", "c", "evidence", "te", None),
    ("EA_IMP_01_ImperceptibleVerification", "c", "e", "hi", "no_valid_perturbation"),
    ("EA_IMP_01_ImperceptibleVerification", "c", "", "hi", "missing_claim_or_evidence_or_unsupported_language"),
    ("EA_IMP_01_ImperceptibleVerification", "c", "evidence", "fr", "missing_claim_or_evidence_or_unsupported_language"),
    ("EA_OMITOMISSION_01_OmissionGeneration", "c", "born 1999 here", "hi", None),
    ("EA_OMITOMISSION_01_OmissionGeneration", "c", "born here", "hi", "no_deletable_construct"),
    ("EA_OMITOMISSION_01_OmissionGeneration", "c", "1999", "hi", "deletion_produced_no_change"),
    ("EA_IMPRET_01_ImperceptibleRetrieval", "c", "some words", "fr", None),
    ("EA_IMPRET_01_ImperceptibleRetrieval", "c", None, "hi", "missing_claim_or_evidence"),
    ("EA_IMPRET_01_ImperceptibleRetrieval", "c", "  ", "hi", "no_valid_perturbation"),
]


def test_published_reasons(spark):
    claims = spark.createDataFrame([(n, c, e, "SUP", lang) for n, (_, c, e, lang, _) in enumerate(CASES)], CLAIMS)
    told = {(r["row_id"], r["attack_id"]): r for r in registry.perturb_all(claims, lexicon(spark)).collect()}
    for n, (attack, *_, reason) in enumerate(CASES):
        assert told[n, attack]["skip_reason"] == reason, (attack, CASES[n])
    targets = {a: (told[0, a]["target_label"], told[0, a]["edit_granularity"], tuple(told[0, a]["validity_flags"])) for a in registry.REGISTRY}
    special = {
        "EA_IMP_01_ImperceptibleVerification": ("REF", "character", (True, True, True)),
        "EA_OMITOMISSION_01_OmissionGeneration": ("NEI", "sentence", (True, True, False)),
        "EA_IMPRET_01_ImperceptibleRetrieval": ("NEI", "character", (False, True, False)),
        "CA_03_LexicallyInformed": ("same_as_gold", "sentence", (False, True, False)),
    }
    for a, told_ in targets.items():
        assert told_ == special.get(a, ("same_as_gold", "character" if "CHAR" in a else "word", (False, True, False)))


def test_marks_lie_within_words_and_at_different_places(spark):
    texts = ["ab cd  ef", "x", "ab", "abc", "one  two\tthree four"]
    rows = [(k * 1000 + i, t) for k, t in enumerate(texts) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, t string")
    bare = lambda x: x.replace("\u200b", "").replace("\u200c", "")
    for r in df.select("row_id", "t", perturb.invisible_in_words(F.col("t"), F.col("row_id")).alias("w"), perturb.insert_invisible(F.col("t"), F.col("row_id")).alias("i")).collect():
        assert bare(r["w"]) == " ".join(r["t"].split()) and len(r["w"]) == len(bare(r["w"])) + 2
        assert not any(w[0] in "\u200b\u200c" for w in r["w"].split(" "))
        n = min(3, len(r["t"]) - 1)
        assert r["i"] is None if not n else bare(r["i"]) == r["t"] and len(r["i"]) == len(r["t"]) + n
    spread = {r["i"] for r in df.filter("t = 'abc'").select(F.translate(perturb.insert_invisible(F.col("t"), F.col("row_id"), 2), "\u200b\u200c", "||").alias("i")).collect()}
    assert spread == {"a||bc", "a|b|c"}  # places 1 and 2 in either order, the second counted in what the first left


def test_a_caller_adds_a_rule(spark):
    own = {"LOUD": registry.Rule("claim", lambda c, row, languages: F.nullif(F.upper(c), c), "loud_already")}
    claims = spark.createDataFrame([(1, "ab", None, None, "hi"), (2, "AB", None, None, "hi")], CLAIMS)
    got = {r["row_id"]: (r["adversarial_claim"], r["skip_reason"]) for r in registry.perturb_all(claims, None, own).collect()}
    assert got == {1: ("AB", None), 2: (None, "loud_already")}
    assert registry.perturb_all(claims, None, {}).count() == 0


def flaky(prompt, system=None):
    if "never" in prompt:
        raise ValueError("down")
    return f"{system}: {prompt}" if system else registry.echo(prompt)


def test_models_are_asked_again_and_audited(spark):
    rows = [(1, "CA_16_Colloquial", "say it", None), (2, "CA_16_Colloquial", "never", None), (3, "CA_16_Colloquial", None, None), (4, "CA_16_Colloquial", "say", "kindly")]
    made = registry.generate(spark.createDataFrame(rows, "row_id long, attack_id string, prompt string, system string"), flaky, tries=3, wait=lambda s: None)
    assert {r["row_id"]: r["text"] for r in made.collect()} == {1: "MOCK: say it", 2: None, 3: None, 4: "kindly: say"}
    log = registry.audit_log(made, "m")
    assert [(r["attempt"], r["ok"], r["error"]) for r in log.filter("request = '2:CA_16_Colloquial'").orderBy("attempt").collect()] == [(n, False, "down") for n in (1, 2, 3)]
    assert tuple(registry.audit_rates(log).first()) == ("m", 3, 5, 0.4, 2, 0.666667)
    claims = spark.createDataFrame([(i, "claim", "evidence", "SUP", "hi") for i in range(1, 5)], CLAIMS)
    got = {r["row_id"]: r["skip_reason"] for r in apply_generated(claims, made).filter("attack_id = 'CA_16_Colloquial'").collect()}
    assert got == {1: None, 2: "llm_generation_failed", 3: "llm_generation_failed", 4: None}


class Busy(Exception):
    wait_seconds = 7


def test_pauses():
    assert registry.back_off(Busy(), 1) == 7
    assert all(0 <= registry.back_off(ValueError(), n) <= min(60, 2**n) for n in range(1, 12))
