"""Values that must equal the published ones for results to be comparable."""

from __future__ import annotations

# The 22 measured perturbations in canonical order, with family (which is also the edit granularity),
# arm, whether evidence is injected, measured tier, measured gated success in percent and what the quality gate checks.
ATTACKS = [
    ("CA_CHAR_01_CharacterSwapping", "Char", "Rule", False, "NEG", 1.85, "meaning"),
    ("CA_CHAR_02_CharacterRepetition", "Char", "Rule", False, "NEG", 2.46, "meaning"),
    ("CA_CHAR_03_CharacterInsertion", "Char", "Rule", False, "NEG", 3.63, "meaning"),
    ("CA_CHAR_04_CharacterDeletion", "Char", "Rule", False, "NEG", 3.30, "meaning"),
    ("CA_CHAR_05_HomoglyphPerturbation", "Char", "Rule", False, "NEG", 2.75, "meaning"),
    ("CA_WORD_02_EntityDisambiguation", "Word", "Rule", False, "NEG", 0.00, "meaning"),
    ("CA_WORD_03_Jumbling", "Word", "Rule", False, "NEG", 12.57, "none"),
    ("CA_WORD_04_Typos", "Word", "Rule", False, "NEG", 2.95, "meaning"),
    ("CA_WORD_08_LexicalSubstitution", "Word", "Rule", False, "NEG", 2.47, "meaning"),
    ("CA_WORD_12_Synonyms", "Word", "Rule", False, "NEG", 3.59, "meaning"),
    ("CA_WORD_13_PhoneticPerturbation", "Word", "Rule", False, "NEG", 3.25, "meaning"),
    ("CA_03_LexicallyInformed", "Sentence", "Rule", False, "NEG", 1.39, "meaning"),
    ("EA_IMP_01_ImperceptibleVerification", "Evidence", "Rule", False, "NEG", 0.40, "meaning"),
    ("EA_OMITOMISSION_01_OmissionGeneration", "Evidence", "Rule", False, "MID", 19.62, "fluency"),
    ("CA_06_FactMixing", "Sentence", "LLM", False, "POS", 55.81, "fluency"),
    ("CA_07_AdvTrigger", "Sentence", "LLM", False, "NEG", 4.28, "meaning"),
    ("CA_16_Colloquial", "Sentence", "LLM", False, "NEG", 2.43, "meaning"),
    ("EA_ADVADD_01_AdvAdd", "Evidence", "LLM", True, "POS", 58.47, "fluency"),
    ("EA_CLAIMREWRITE_01_ClaimRewrite", "Sentence", "LLM", False, "MID", 25.39, "fluency"),
    ("EA_CTXREP_01_ContextualizedReplace", "Evidence", "LLM", False, "POS", 59.57, "fluency"),
    ("EA_FACT2FICT_01_Fact2Fiction", "Evidence", "LLM", True, "POS", 57.60, "fluency"),
    ("EA_IMPRET_01_ImperceptibleRetrieval", "Evidence", "LLM", True, "NEG", 0.26, "meaning"),
]

# The tier that each of five models foretold, in the order of ATTACKS.
MODELS = ["gpt4o", "claude", "deepseek", "kimi", "sarvam"]
VOTES = [
    "POS POS MID POS POS",
    "MID POS NEG MID POS",
    "POS MID NEG POS MID",
    "POS POS MID POS POS",
    "POS POS POS POS POS",
    "MID MID NEG MID NEG",
    "MID POS NEG MID POS",
    "POS POS MID POS POS",
    "MID MID NEG MID MID",
    "MID MID NEG MID NEG",
    "POS POS MID POS POS",
    "MID MID NEG MID NEG",
    "MID POS NEG MID MID",
    "MID MID MID MID NEG",
    "POS POS POS POS POS",
    "POS POS MID POS POS",
    "MID POS NEG MID POS",
    "POS POS POS POS POS",
    "MID MID MID MID MID",
    "POS POS POS POS POS",
    "POS POS POS POS POS",
    "MID MID NEG MID NEG",
]

# The policy that tries the five strongest perturbations, in order.
STATIC_TOP5 = [19, 17, 20, 14, 18]

# What joins injected evidence to the original, what verifier and judge are asked, and Hindi words that stand for a verdict.
INJECTED_SEPARATOR = " एक अन्य स्रोत के अनुसार: "
MOCK_SIGN = "एक अन्य स्रोत"
VERIFIER_SYSTEM = "You are an automated fact-checking system. You verify Hindi claims against evidence. Do not show any reasoning or thinking. Output ONLY one label: SUP, REF, or NEI."
VERIFIER_PROMPT = (
    "Classify whether the evidence supports, refutes, or is insufficient for the claim.\n\n"
    'Claim: "{claim}"\n\nEvidence: "{evidence}"\n\n'
    "Labels:\n"
    "- SUP (supported): the evidence fully supports the claim.\n"
    "- REF (refuted): the evidence contradicts the claim.\n"
    "- NEI (not enough info): the evidence is insufficient to decide.\n\n"
    "Examples:\n"
    '1. Claim: "दिल्ली भारत की राजधानी है।" Evidence: "दिल्ली भारत की राजधानी है।" -> SUP\n'
    '2. Claim: "भारत की राजधानी मुंबई है।" Evidence: "दिल्ली भारत की राजधानी है।" -> REF\n'
    '3. Claim: "दिल्ली का मौसम अच्छा है।" Evidence: "दिल्ली भारत की राजधानी है।" -> NEI\n\n'
    "Now classify the claim above. Output only the label, with no reasoning."
)
JUDGE_SYSTEM = "You are a Hindi-language quality judge. Do not show any reasoning or thinking. Output ONLY valid JSON, no explanations."
JUDGE_PROMPT = (
    'Original claim: "{original_claim}"\n\nAttacked text: "{attacked_text}"\n\n'
    "Judge the attacked text:\n"
    "- fluency: 1-5 (5 = perfect natural Hindi, 1 = broken/garbled).\n"
    "- meaning_preserved: true if the attacked text still means the same as the original claim, false if the meaning changed.\n\n"
    'Respond as JSON: {"fluency": <int>, "meaning_preserved": <true|false>}'
)
HINDI_HINTS = [
    ("SUP", ["समर्थित", "समर्थन", "सही", "सत्य", "पुष्टि"]),
    ("REF", ["खंडित", "खंडन", "गलत", "असत्य", "विरोध"]),
    ("NEI", ["अपर्याप्त", "सूचना नहीं", "पर्याप्त जानकारी नहीं", "निर्धारित नहीं"]),
]

# Characters and what looks like them, by language.
CONFUSABLES = {
    "hi": {
        "ड": "ड़", "ज": "ज़", "फ": "फ़", "ख": "ख़", "ग": "ग़",
        "ल": "ळ", "ा": "ा​", "ि": "ि​", "ी": "ी​", "ु": "ु​",
        "ू": "ू​", "े": "े​", "ै": "ै​", "ो": "ो​", "ौ": "ौ​",
    },
    "ur": {"ی": "ي", "ک": "ك", "ہ": "ه"},
}

#: Latin letters and Cyrillic ones that look like them, for the languages of the test tables.
LATIN_CONFUSABLES = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с"}

#: A small English lexicon for the test tables: word, alternatives, kind. The Hindi lexicons are an input table.
LEXICON = [
    ("the", ["this", "that"], "synonym"),
    ("and", ["plus", "also"], "synonym"),
    ("that", ["which", "this"], "synonym"),
    ("with", ["by", "using"], "synonym"),
    ("for", ["fore", "four"], "phonetic"),
    ("to", ["too", "two"], "phonetic"),
    ("their", ["there", "they're"], "phonetic"),
    ("from", ["form", "fron"], "typo"),
    ("this", ["thsi", "tihs"], "typo"),
    ("of", ["off", "fo"], "typo"),
    ("in", ["inn", "i n"], "typo"),
    ("are", ["be", "were"], "adjective"),
    ("was", ["is", "were"], "adjective"),
    ("was", ["were", "had been"], "adjective"),
    ("of", ["Off", "Ofer", "Oven"], "entity"),
    ("is", ["Isle", "Is"], "entity"),
]
STOPWORDS = ["the", "and"]
