"""Operators on small tables whose results are known."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kasauti.functions import stats
from kasauti.operators import asr, evaluation, graph, perturb, policies, sampling
from kasauti.plans.verification import verified
from kasauti.sources import files, tables
from kasauti.sources.fixed import CONFUSABLES
from kasauti.streaming import rates

from .compare import SMALL


def test_empty_group_has_null_rates(spark):
    rows = spark.createDataFrame([(1, 0, None, "SUP", True, 3, True)], "row_id long, attack_idx int, verdict string, gold_label string, baseline_failed boolean, fluency int, meaning_preserved boolean")
    out = asr.success_rates(asr.verify(rows, tables.attacks(spark)), "attack_id").first()
    assert (out["eligible"], out["raw_asr"], out["gated_asr"]) == (0, None, None)


def test_identities_of_rates(spark):
    for r in asr.success_rates(verified(spark, SMALL), "attack_id").collect():
        assert r["excluded"] == r["eligible"] - r["gated_eligible"] == r["flips_raw"] - r["flips_gated"]


def test_character_edits(spark):
    row = spark.createDataFrame([(1, "ab क्षत्रिय"), (2, "a"), (3, "")], "row_id long, claim string")
    c, i = F.col("claim"), F.col("row_id")
    got = {r["row_id"]: r for r in row.select(i, perturb.swap(c, i).alias("s"), perturb.repeat(c, i).alias("r"), perturb.delete(c, i).alias("d"), perturb.jumble(c, i).alias("j")).collect()}
    assert all(got[n][k] is None for n in (2, 3) for k in "srdj")
    assert sorted(got[1]["s"]) == sorted("ab क्षत्रिय") and got[1]["s"] != "ab क्षत्रिय"
    assert len(got[1]["r"]) > len("ab क्षत्रिय") > len(got[1]["d"])


def test_homoglyph_invisible_omission(spark):
    row = spark.createDataFrame([(1, "जल"), (2, "xyz"), (3, "born (in May) 1998, died")], "row_id long, claim string")
    c, i = F.col("claim"), F.col("row_id")
    got = {r["row_id"]: r for r in row.select(i, perturb.replace_char(c, i, CONFUSABLES["hi"]).alias("h"), perturb.insert_invisible(c, i).alias("v"), perturb.omit(c, i).alias("o")).collect()}
    assert got[1]["h"] in ("ज़ल", "जळ") and got[2]["h"] is None
    assert len(got[2]["v"]) == 6 and got[2]["v"].replace("​", "").replace("‌", "") == "xyz"
    assert got[3]["o"] in ("born 1998, died", "born (in May) , died") and got[2]["o"] is None


def test_omission_deletes_the_drawn_place(spark):
    """Every construct of every kind can go, each at its own place."""
    texts = [
        "वे 1998 से 2004 तक, 2004 तक और 2004 में थे",
        "2 अक्टूबर 1869 को और 12 मार्च को",
        "12 वर्ष तक, 12 वर्षों से, 40 प्रतिशत, 40 प्रतिशत और १२ बार",
        "5 लाख (लगभग) 7 के बाद 1999-2001 (लगभग)",
        "from 1984 to 1984 and 1984 (twice) or 10-12 and 3%, 3%",
        "1999", "(x)", "nothing here",
    ]
    patterns = [p.replace(r"\p{Nd}", r"\d") for p in perturb.DELETABLE]
    rows = [(k * 100 + n, t) for n, t in enumerate(texts) for k in range(60)]
    got = spark.createDataFrame(rows, "row_id long, t string").select("row_id", "t", perturb.omit(F.col("t"), F.col("row_id")).alias("o")).collect()
    for t in texts:
        spots = [m.span() for p in patterns for m in re.finditer(p, t)]
        expected = {re.sub(r"\s{2,}", " ", (t[:a] + t[b:]).strip()).strip(" ,-") or None for a, b in spots} or {None}
        assert {r["o"] for r in got if r["t"] == t} == expected


def test_later_entries_and_entities(spark):
    claims = spark.createDataFrame([(1, "(Agra) is far")], "row_id long, claim string")
    lexicon = spark.createDataFrame([("Agra", ["Agra Road"], "entity", 0), ("far", ["remote"], "synonym", 1), ("far", ["distant"], "synonym", 2)], "word string, alternatives array<string>, kind string, place int")
    out = perturb.substitute_each(claims, lexicon, {"s": (["synonym"], ()), "e": (["entity"], ()), "n": (["none"], ())})
    assert {r["attack"]: r["changed"] for r in out.collect()} == {"s": "(Agra) is distant", "e": "(Agra Road) is far", "n": None}


def test_substitute_keeps_punctuation_and_last_kind(spark):
    claims = spark.createDataFrame([(1, 'say "hot"!'), (2, "none")], "row_id long, claim string")
    lexicon = spark.createDataFrame([("hot", ["warm"], "synonym"), ("hot", ["hot", "torrid"], "adjective")], "word string, alternatives array<string>, kind string")
    got = {r["row_id"]: r["changed"] for r in perturb.substitute(claims, lexicon, ["synonym", "adjective"], "x").collect()}
    assert got == {1: 'say "torrid"!', 2: None}


def test_split_sizes_of_832(spark):
    sizes = {r["split"]: r["n"] for r in sampling.split_60_20_20(spark.range(832).withColumnRenamed("id", "row_id")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 499, "val": 166, "test": 167}


def test_fold_sizes(spark):
    sizes = [r["n"] for r in sampling.folds(spark.range(832).withColumnRenamed("id", "row_id")).groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]
    assert sizes == [167, 167, 166, 166, 166]


def test_stratified_fills_from_surplus(spark):
    rows = spark.createDataFrame([(i, "d", "SUP" if i < 20 else "REF" if i < 22 else "NEI") for i in range(30)], "row_id long, domain string, label string")
    got = {r["label"]: r["n"] for r in sampling.stratified(rows, "domain", "label", 13, ["SUP", "REF", "NEI"]).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"SUP": 7, "REF": 2, "NEI": 4}


def test_greedy_covers_no_less_than_any_fixed_choice(spark):
    flips = verified(spark, SMALL).filter("gated_flip").select("row_id", "attack_idx")
    chosen = policies.greedy_coverage(flips, 3)
    cover = lambda arms: flips.filter(F.col("attack_idx").isin(arms)).select("row_id").distinct().count()
    best = flips.groupBy("attack_idx").count().orderBy(F.desc("count"), "attack_idx").first()["attack_idx"]
    assert chosen[0] == best and cover(chosen) >= cover(policies.STATIC_TOP5[:3])


def test_rewards(spark):
    r = spark.range(1).select(policies.reward(F.lit(True), F.lit(19)).alias("a"), policies.reward(F.lit(True), F.lit(0)).alias("b"), policies.reward(F.lit(False), F.lit(19), F.lit(True)).alias("c")).first()
    assert (round(r["a"], 2), round(r["b"], 2), r["c"]) == (1.45, 0.95, -0.5)


def test_advantages_are_standardised(spark):
    steps = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 2.0)], "row_id long, step int, reward double")
    out = policies.discounted_returns(steps, ["row_id"]).orderBy("step").collect()
    assert math.isclose(out[0]["back"], 1 + 0.99**2 * 2) and abs(sum(r["advantage"] for r in out)) < 1e-6


def test_published_graph_size(spark):
    a = tables.attacks(spark)
    assert graph.similar_pairs(a, 12).count() == 84 and graph.similar_pairs(a, 11).count() == 88
    assert 2 * 1120 * 22 + graph.similar_pairs(a, 12).count() == 49_364


def test_nearest_against_all_cosines(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (700, 4)).astype(float)
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "id long, features array<float>")
    length = np.sqrt((v * v).sum(axis=1))
    unit = v / np.where(length > 0, length, 1)[:, None]
    near = np.round(unit @ unit.T, 9)
    found = {}
    for r in graph.nearest(df.filter("id % 50 = 0"), df.repartition(5), 4).collect():
        found.setdefault(r.id, []).append((-r.similarity, r.other))
    assert set(found) == set(range(0, 700, 50))
    for i, rows in found.items():
        expected = sorted((-near[i, j], j) for j in range(700) if j != i)[:4]
        assert sorted(rows) == [(pytest.approx(s), j) for s, j in expected]
    assert graph.nearest(df.filter("id = 900"), df, 4).count() == graph.nearest(df.limit(0), df, 4).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "id long, features array<double>")
    one = sorted(map(tuple, graph.nearest(v.filter("id < 9"), v, 3).collect()))
    monkeypatch.setattr(graph, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, graph.nearest(v.filter("id < 9"), v, 3).collect())) == one and len(one) == 27


def test_sage_layer(spark):
    nodes = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.0])], "id long, features array<double>")
    edges = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    h = {r["id"]: r["h"] for r in graph.sage(nodes, edges, [[1.0, 0.0]], [[1.0, 1.0]], [0.5]).collect()}
    assert h[3] == [0 + 2.0 + 0.5 + 0.5] and h[1] == [1.5]


def test_ranking_of_one_class(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False), ("b", 2, True)], "k string, s int, hit boolean")
    got = {r["k"]: (r["auroc"], r["auprc"]) for r in evaluation.ranking(rows, "s", "hit", "k").collect()}
    assert got == {"a": (0.5, 1.0), "b": (1.0, 1.0)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=2, max_size=20))
def test_auroc_against_pairs(spark, cases):
    hits, misses = [s for s, h in cases if h], [s for s, h in cases if not h]
    got = evaluation.ranking(spark.createDataFrame([("x", *c) for c in cases], "k string, s int, hit boolean"), "s", "hit", "k").first()["auroc"]
    expected = sum((p > q) + (p == q) / 2 for p in hits for q in misses) / (len(hits) * len(misses)) if hits and misses else 0.5
    assert math.isclose(got, expected)


def test_published_leaderboard(spark):
    from kasauti.plans.statistics import leaderboard, rule_predictions

    got = {r["model"]: r["correct"] for r in leaderboard(tables.model_votes(spark), tables.attacks(spark)).collect()}
    assert (got["deepseek"], got["sarvam"], got["gpt4o"], got["claude"], got["kimi"]) == (16, 9, 6, 6, 6)
    assert rule_predictions(tables.attacks(spark)).filter("correct").count() == 19


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A_1.csv").write_bytes('﻿row_id,claim_text,technique_params,validity_flags\n1,"x, y","{""a"": ""b""}",bad\n'.encode())
    (tmp_path / "in" / "attacked_rows_all.csv").write_text("row_id,claim_text,technique_params,validity_flags\n9,z,,\n")
    got = files.parse_json_columns(files.read_per_attack(spark, str(tmp_path / "in"))).collect()
    assert [(r["row_id"], r["claim_text"], r["technique_params"], r["attack_file"]) for r in got] == [("1", "x, y", {"a": "b"}, "A_1")]
    df = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "row_id long, attack_id string, claim string")
    files.write_per_attack(df, str(tmp_path / "per"))
    files.write_all(df, str(tmp_path / "all"))
    files.write_summary(df, str(tmp_path / "sum"))
    files.append_audit(df, str(tmp_path / "log"))
    files.append_audit(df, str(tmp_path / "log"))
    assert sorted(p.name for p in (tmp_path / "per").iterdir() if p.is_dir()) == ["attack_id=A", "attack_id=B"]
    assert files.read_csv(spark, str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "log")).count() == 4
    assert df.select(files.pick(df, "claim").alias("c"), files.pick(df, "domain").alias("d")).first() == ("x", "")


def test_workbook(spark, tmp_path):
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>claim</t></si><si><r><t>दिल्ली </t></r><r><t>x</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>label</t></is></c></row>'
                   '<row><c r="A2" t="s"><v>1</v></c></row><row><c r="B3"><v>7</v></c></row></sheetData></worksheet>')  # fmt: skip
    got = files.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["claim", "label"] and [tuple(r) for r in got.collect()] == [("दिल्ली x", None), (None, "7")]


def test_policy_learns_the_arm_that_always_flips():
    import numpy as np

    from kasauti.operators import reinforce

    states = np.eye(3)[np.arange(600) % 3]
    weights = reinforce.train(states, [{7}] * 600, 1, 2)
    for state in np.eye(3):
        steps, rewards, first = reinforce.episode(weights, state, {7}, 2, lambda p: int(p.argmax()))
        assert first == 1 and steps[0][2] == 7 and math.isclose(rewards[0], 0.95)
    assert np.allclose(reinforce.returns([1.0, 0.0, 2.0]), [1 + 0.99**2 * 2, 0.99 * 2, 2])


def test_learned_policies_cover_their_test_claims(spark):
    from kasauti.plans import QUERIES

    for name in ("reinforce_policy", "hybrid_auditor"):
        for r in QUERIES[name](spark, SMALL).collect():
            assert 0 < r["flipped"] <= r["claims"] and 0 <= r["rescued"] <= r["flipped"]


def test_link_prediction_scores_held_out_arms(spark):
    from kasauti.plans import QUERIES

    rows = QUERIES["link_prediction"](spark, SMALL).collect()
    macro = QUERIES["link_prediction_macro"](spark, SMALL).first()
    assert {r["attack_idx"] for r in rows} == set(range(22)) and all(0 <= r["auroc"] <= 1 for r in rows)
    assert macro["folds"] == 22 and abs(macro["auroc"] - sum(r["auroc"] for r in rows) / 22) < 1e-6


def test_generated_records(spark):
    from kasauti.operators import records

    claims = spark.createDataFrame([(1, "c", "e", "NEI"), (2, "c", "", "SUP")], "row_id long, claim string, evidence string, label string")
    made = spark.createDataFrame([(1, a[0], '```\n"new text"\n```') for a in records.GENERATORS] + [(2, "CA_07_AdvTrigger", "__ERROR__")], "row_id long, attack_id string, text string")
    got = {(r["row_id"], r["attack_id"][:5]): r for r in records.apply_generated(claims, made).collect()}
    assert got[1, "CA_07"]["adversarial_claim"] == "new text c" and got[1, "CA_07"]["target_label"] == "NEI"
    assert got[1, "EA_CL"]["skip_reason"] == "nei_claim_not_targeted" and got[1, "EA_CT"]["adversarial_evidence"] == "new text"
    told = {k[1]: r["skip_reason"] for k, r in got.items() if k[0] == 2}
    assert told == {"CA_06": "missing_evidence_pair", "CA_07": "llm_generation_failed", "CA_16": "llm_generation_failed", "EA_AD": "llm_generation_failed", "EA_CL": "missing_claim_or_evidence", "EA_CT": "missing_claim_or_evidence", "EA_FA": "executor_failed"}
    assert got[1, "CA_06"]["skip_reason"] == "missing_evidence_pair"


def test_facts_are_mixed_of_two_evidences(spark):
    from kasauti.operators import records

    rows = [(1, "c", "a b c", "SUP", "x"), (2, "c", "a b d", "SUP", "x"), (3, "c", "z", "REF", "x"), (4, "c", "a b d", "SUP", "y"), (5, "", "e", "SUP", "x"), (6, "c", None, "SUP", "x")]
    claims = records.with_neighbours(spark.createDataFrame(rows, "row_id long, claim string, evidence string, label string, domain string"))
    assert {r["row_id"]: r["neighbor_evidence"] for r in claims.collect()} == {1: "a b d", 2: "a b c", 3: "a b c", 4: "a b d", 5: "a b c", 6: "a b c"}
    made = spark.createDataFrame([(i, "CA_06_FactMixing", f"mix {i}") for i in range(1, 7)], "row_id long, attack_id string, text string")
    got = {r["row_id"]: (r["adversarial_claim"], r["skip_reason"]) for r in records.apply_generated(claims, made).filter("attack_id = 'CA_06_FactMixing'").collect()}
    assert got == {i: (f"mix {i}", None) if i < 5 else (None, "missing_evidence_pair") for i in range(1, 7)}


def test_generated_texts_meet_claims_without_evidence(spark):
    """the query moves no evidence; flags say what texts say, a repeated text gives a row each."""
    from kasauti.operators import records
    from kasauti.plans import QUERIES

    plan = QUERIES["generated_attacks"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("attack_id" in line for line in joins if "SortMergeJoin" in line or "HashJoin" in line) and plan.count("neighbor_evidence") == plan.count("has_neighbor_evidence")
    rows = [(1, "c", "a b c", "SUP", "x"), (2, "c", "a b d", None, "x"), (3, "c", "z", "NEI", "y"), (4, "c", "", "SUP", "y"), (5, None, "e", "SUP", "y"), (6, "c", None, "REF", "z"), (7, "c", " ", "REF", "z"), (8, "c", "", "REF", "")]
    claims = spark.createDataFrame(rows, "row_id long, claim string, evidence string, label string, domain string")
    made = spark.createDataFrame([(i, a[0], f"text {i}") for i in range(1, 9) for a in records.GENERATORS if i != 2] + [(1, records.GENERATORS[0][0], None), (77, records.GENERATORS[0][0], "x")], "row_id long, attack_id string, text string")
    whole = records.apply_generated(records.with_neighbours(claims), made)
    flags = claims.withColumn("has_evidence", F.coalesce("evidence", F.lit("")) != "").drop("evidence")
    told = records.apply_generated(records.with_neighbours(flags, claims.select("row_id", "domain", "evidence"), whole=False), made)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(told) == key(whole) and whole.count() == 8 * len(records.GENERATORS) + 1


def test_sub_questions(spark):
    from kasauti.operators import records

    df = spark.createDataFrame([('{"sub_questions": ["a", "b"]}',), ("1. what is it\n- ab\n* where was it",), ("",)], "t string")
    none = spark.createDataFrame([('{"a": 1}',), ('["what is it"]',), ('{"sub_questions": broken',)], "t string")
    assert [r[0] for r in none.select(records.sub_questions(F.col("t"))).collect()] == [[], ['["what is it"]'], ['{"sub_questions": broken']]
    assert [r[0] for r in df.select(records.sub_questions(F.col("t"))).collect()] == [["a", "b"], ["what is it", "where was it"], []]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").repartition(3)
    events.write.parquet(str(tmp_path / "events"))
    rates.run_to_table(rates.windowed_rates(rates.read_events(spark, str(tmp_path / "events")), "1 day"), "rates_out", str(tmp_path / "checkpoint"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("rates_out")) == key(rates.windowed_rates(events, "1 day"))


def test_text_that_is_no_json_stays(spark):
    df = spark.createDataFrame([('{"a": "b"}', "{broken"), ("no", None)], "technique_params string, validity_flags string")
    got = [(r["technique_params"], r["technique_params_text"], r["validity_flags_text"]) for r in files.parse_json_columns(df).collect()]
    assert got == [({"a": "b"}, None, "{broken"), (None, "no", None)]
    assert files.first_rows(df, 1).count() == 1 and files.first_rows(df).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_pair_neighbours_against_all_pairs(spark, seed, monkeypatch):
    """Few words and small tiles, so that ties, equal sets, several tiles of a size and tiles that are skipped all occur."""
    monkeypatch.setattr(graph, "NEIGHBOUR_TILE", 6)
    monkeypatch.setattr(graph, "TILE_COLUMNS", 4)
    rng = random.Random(seed)
    claims = [(i, rng.choice("xyz") if i else "w", rng.sample("abcdefghijkl", rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(60)] + [(99, None, ["a"]), (100, "", ["b", "c"]), (101, None, [])]
    lonely = lambda domain: not domain or sum(d == domain for _, d, _ in claims) == 1
    found = {r["row_id"]: (r["neighbour"], round(r["overlap"], 6)) for r in graph.pair_neighbours(spark.createDataFrame(claims, "row_id long, domain string, tokens array<string>")).collect()}
    for i, domain, words in claims:
        others = [(-round(len(set(words) & set(w)) / max(len(words), len(w), 1), 9), j) for j, d, w in claims if j != i and (lonely(domain) or d == domain)]
        no, j = min(others, default=(0.0, None))
        assert found[i] == (j, round(-no, 6)), i
    assert len(found) == len(claims)


def test_tiles_meet_without_a_shuffle(spark, monkeypatch):
    """frequent and rare words, many tiles; tiles are compared where they are read, not shuffled once for each tile they meet."""
    for name, value in (("NEIGHBOUR_TILE", 16), ("PLAN_SHARE", 1), ("SIZE_STEP", 1.5)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(7)
    claims = [(i, rng.choice("xy"), list({int(rng.paretovariate(0.6)) for _ in range(rng.choice([1, 4, 30, 60]))})) for i in range(300)]
    claims = [(i, d, [f"w{t}" for t in words]) for i, d, words in claims] + [(300, "x", ["w1", "w2"]), (301, "x", ["w1", "w2"])]
    out = graph.pair_neighbours(spark.createDataFrame(claims, "row_id long, domain string, tokens array<string>"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan
    found = {r["row_id"]: (r["neighbour"], round(r["overlap"], 6)) for r in out.collect()}
    for i, domain, words in claims:
        no, j = min((-round(len(set(words) & set(w)) / max(len(words), len(w)), 9), j) for j, d, w in claims if j != i and d == domain)
        assert found[i] == (j, round(-no, 6)), i
    assert len(found) == len(claims)


def test_shared_tokens_against_sets():
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.zipf(1.3, size=rng.integers(1, 80)) % 5000) for _ in range(n)] for n in (40, 55)]
    a, b = map(graph.Sets.of, sides)
    truth = np.array([[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]])
    assert (graph.shared_tokens(a, b) == truth).all()
    kept = rng.random(40) < 0.3
    assert (graph.shared_tokens(a.only(kept), b) == truth[kept]).all() and not graph.shared_tokens(a, graph.Sets.of([])).size


def test_unmeasured_words(spark):
    names = {"Multi-Hop chain": "MID", "hop": "MID", "Gradient step": "POS", "HotFlip": "POS", "embedding noise": "POS", "evidence swap": "POS", "Retrieval": "POS", "corpus": "POS",
             "char noise": "NEG", "keyboard": "NEG", "visual": "NEG", "tense": "MID", "hop over evidence": "MID", "char gradient": "POS"}
    rows = spark.createDataFrame([*names.items(), (None, "MID")], "name string, expected string")
    out = evaluation.unmeasured(rows, "name").collect()
    assert all(r["tier"] == r["expected"] for r in out) and len(out) == 15
    assert {r["name"]: (r["probability"], r["scope"], r["priority"]) for r in out}["evidence swap"] == (0.58, "testable", "High")


def test_ranked_over_spans(spark):
    ids = [0, 5, 65_535, 65_536, 65_537, 10**12]
    rows = spark.createDataFrame([(i, s) for i in ids for s in (0.5, 0.25)], "id long, s double")
    out = sorted(evaluation.ranked(rows, "s", "id").collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["s"], r["id"]) for r in out] == [(n, s, i) for n, (s, i) in enumerate([(s, i) for s in (0.5, 0.25) for i in ids], 1)]


def test_fisher_and_mcnemar_of_large_counts(spark):
    """Against exact sums of all terms."""
    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    cases = [(5200, 10_000, 50_000, 100_000), (4800, 10_000, 50_000, 100_000), (0, 10_000, 50_000, 100_000), (30, 10_000, 40, 100_000), (3, 3, 5, 10)]
    df = spark.createDataFrame(cases, "k long, n long, all_k long, all_n long")
    for r in evaluation.fisher_greater(df, 5).collect():
        k, n, kk, nn = r["k"], r["n"], r["all_k"], r["all_n"]
        exact = sum(math.exp(log_choose(kk, i) + log_choose(nn - kk, n - i) - log_choose(nn, n)) for i in range(max(k, n + kk - nn), min(n, kk) + 1))
        assert abs(r["p"] - min(1.0, exact)) < 1e-6 * max(exact, 1e-3), r
    pairs = spark.createDataFrame([(50_000, 50_700), (50_000, 52_000), (0, 40), (10, 200_000)], "b long, c long")
    for r in pairs.withColumn("p", stats.mcnemar_exact(F.col("b"), F.col("c"))).collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        exact = min(1.0, 2 * sum(math.exp(log_choose(n, i) - n * math.log(2.0)) for i in range(k + 1)))
        assert abs(r["p"] - exact) < 1e-6 * max(exact, 1e-3), r


def test_bootstrap_weights_and_interval(spark):
    """Weights follow the Poisson distribution; means spread as those of resampling with replacement do."""
    assert [round(x / 65536, 3) for x in sampling.poisson_steps()[:4]] == [0.368, 0.736, 0.92, 0.981]
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("double").alias("hit"))
    means = [r["mean"] for r in sampling.bootstrap_means(rows, 203, "hit").collect()]
    assert len(means) == 203 and abs(sum(means) / 203 - 0.25) < 0.003
    spread = math.sqrt(sum((m - 0.25) ** 2 for m in means) / 203)
    assert 0.8 < spread / math.sqrt(0.25 * 0.75 / 2000) < 1.2


def test_stratified_orders_only_ranges_that_reach_in(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("d").alias("domain"), F.when(F.col("id") % 3 == 0, "SUP").otherwise("REF").alias("label"))
    got = sampling.stratified(rows, "domain", "label", 1501, ["SUP", "REF", "NEI"]).collect()
    key = lambda i: hashlib.md5(f"42:{i}:sample".encode()).hexdigest()
    for label, ids in (("SUP", range(0, 5000, 3)), ("REF", [i for i in range(5000) if i % 3])):
        taken = {r["row_id"] for r in got if r["label"] == label}
        assert taken == set(sorted(ids, key=key)[: len(taken)])
    assert len(got) == 1501


def test_logistic_against_spark(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from kasauti.operators.linking import logistic

    rng = np.random.default_rng(3)
    x, n = rng.integers(0, 2, (40, 4)).astype(float), rng.integers(1, 30, 40).astype(float)
    hits = np.array([rng.binomial(int(m), 1 / (1 + np.exp(-(r[0] - r[1] * 2 + 0.3)))) for m, r in zip(n, x)], float)
    rows = [(Vectors.dense(r), float(y), float(c)) for r, h, m in zip(x, hits, n) for y, c in ((1, h), (0, m - h)) if c]
    model = LogisticRegression(regParam=0.01, standardization=False, weightCol="w", tol=1e-12, maxIter=300).fit(spark.createDataFrame(rows, ["features", "label", "w"]))
    assert np.allclose(logistic(x, hits, n), [*model.coefficients, model.intercept], atol=1e-4)


def test_gat_against_loops(spark):
    x = {1: [1.0, 2.0], 2: [0.5, -1.0], 3: [0.0, 0.25], 4: [2.0, 2.0]}
    pairs = [(1, 3), (2, 3), (4, 3), (3, 1)]
    linear, a, b, bias = [[0.5, -0.25], [1.0, 0.75]], [0.2, -0.4], [0.3, 0.1], [0.1, -2.5]
    nodes = spark.createDataFrame(list(x.items()), "id long, features array<double>")
    found = {r["id"]: r["h"] for r in graph.gat(nodes, spark.createDataFrame(pairs, "src long, dst long"), linear, a, b, bias).collect()}
    z = {i: np.array(linear) @ np.array(v) for i, v in x.items()}
    for i in x:
        sources = [s for s, d in pairs if d == i]
        e = np.array([z[s] @ a + z[i] @ b for s in sources])
        w = np.exp(np.where(e > 0, e, 0.2 * e))
        h = (sum(v * z[s] for v, s in zip(w / w.sum(), sources)) if sources else 0) + np.array(bias)
        assert np.allclose(found[i], np.where(h > 0, h, np.expm1(h)))
