"""Every query of the engine against its SQL, and the entry point."""

import pytest

import __spark_entry__
from kasauti.plans import ORACLES, QUERIES

from .compare import SMALL, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 22


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bandit_plays_every_claim(spark):
    out = QUERIES["ucb_bandit"](spark, SMALL).collect()
    assert len(out) == 3 and all(r["calls"] == 5 * r["claims"] and 0 < r["flipped"] <= r["claims"] for r in out)
