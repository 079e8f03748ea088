"""Queries over whole texts, all rows and whole vectors against their SQL on larger tables, where cuts would show."""

import pytest

from kasauti.plans import ORACLES, QUERIES

from .compare import same

DATA = "/root/testdata/sf0.01"

NAMES = ["char_ngram_fscore", "omission_spans", "homoglyph_or_zero_width", "alias_label_normalise", "sub_question_counts", "sage_mean_aggregate", "embedding_mean_pool", "augmented_state", "bootstrap_ci", "attacked_records", "audit_rates"]


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, name):
    assert "substr(text, 1," not in ORACLES[name] and "row_id %" not in ORACLES[name]
    same(QUERIES[name](spark, DATA), ORACLES[name], DATA)
