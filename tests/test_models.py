"""The link network, exact resamples and pooled tokens against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kasauti.operators import linking, records, sampling
from kasauti.operators.evaluation import ranking
from kasauti.plans import QUERIES

from .compare import SMALL


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    x, y, hidden = rng.normal(size=(40, 5)), (rng.random(40) < 0.4).astype(float), 7
    w = rng.normal(size=5 * hidden + 2 * hidden + 1)
    _, slope = linking.loss_and_slope(w, x, y, hidden)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (linking.loss_and_slope(w + s, x, y, hidden)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def crossed(spark, claims, partitions):
    """Claims are flipped by perturbations of their own sign: no line through the inputs tells, a hidden layer does."""
    rng = np.random.default_rng(2)
    v = np.where(rng.random((claims, 2)) < 0.5, -1.0, 1.0) * (0.5 + rng.random((claims, 2)))
    features = spark.createDataFrame([(a, [1.0 if a % 2 else -1.0, a / 8.0]) for a in range(8)], "attack_idx int, f array<double>")
    seen = [(i, a, bool(v[i, 0] * (1 if a % 2 else -1) > 0)) for i in range(claims) for a in range(8)]
    odd = [(claims + 1, 0, True), (claims + 2, 1, True), (claims + 3, 2, False)]
    vectors = [(i, [float(x) for x in v[i]]) for i in range(claims)] + [(claims + 1, None), (claims + 2, [1.0]), (claims + 3, [1.0, None])]
    return (
        spark.createDataFrame(seen + odd, "row_id long, attack_idx int, hit boolean").repartition(partitions),
        spark.createDataFrame(vectors, "row_id long, vector array<float>"),
        features,
    )


def test_network_scores_held_out_perturbations(spark):
    seen, vectors, features = crossed(spark, 150, 3)
    out = linking.link_mlp(seen, vectors, features, 2, hidden=12, rounds=40)
    rows = out.collect()
    assert len(rows) == 8 * 150 + 3 and {r.row_id for r in rows if r.p is None} == {151, 152, 153}
    assert all(r.auroc > 0.9 for r in ranking(out.filter("p IS NOT NULL"), "p", "hit", "attack_idx").collect())


def test_gradients_of_partitions_add_up(spark):
    """Many partitions, added by tasks first, give the sums of one loop; a model's own perturbation is not in them."""
    seen, vectors, features = crossed(spark, 20, 1)
    table = seen.join(vectors, "row_id").cache()
    models = linking.LinkModels(features, 2, 4)
    few, many = models.sums(table.coalesce(1)), models.sums(table.repartition(linking.DIRECT + 9))
    np.testing.assert_allclose(few, many, rtol=1e-9, atol=1e-9)
    given = [r for r in table.collect() if r.row_id < 20]
    x = np.array([[*r.vector, *models.table[r.attack_idx]] for r in given])
    y, arm = np.array([float(r.hit) for r in given]), np.array([r.attack_idx for r in given])
    for k in (0, 5):
        loss, slope = linking.loss_and_slope(models.weights[k], x[arm != k], y[arm != k], 4)
        assert few[k, 1] == 140
        np.testing.assert_allclose(few[k], [loss, 140, *slope], rtol=1e-9, atol=1e-9)


def test_one_perturbation_has_no_model(spark):
    seen, vectors, features = crossed(spark, 5, 1)
    out = linking.link_mlp(seen.filter("attack_idx = 0"), vectors, features.filter("attack_idx = 0"), 2, 3, 1)
    assert [r.p for r in out.collect()] == [None] * 6
    assert linking.link_mlp(seen.limit(0), vectors, features, 2, 3, 1).count() == 0


def test_link_mlp_query(spark):
    rows = {r.part: r for r in QUERIES["link_mlp"](spark, SMALL).collect()}
    assert set(rows) == {"all", *map(str, range(22))}
    folds = [r for part, r in rows.items() if part != "all"]
    assert rows["all"].auroc == pytest.approx(sum(r.auroc for r in folds) / 22, abs=1e-5) and rows["all"].hits == sum(r.hits for r in folds)


def test_every_draw_takes_exactly_all_rows(spark):
    rng = np.random.default_rng(3)
    given = [(float(a), float(b)) for a, b in zip(rng.integers(0, 2, 3_000), rng.integers(0, 40, 3_000) / 7)]
    df = spark.createDataFrame([*given, (None, 1.0)], "a double, b double")
    out = sampling.exact_bootstrap(df, ["a", "b"], draws=2_000, bits=4).toPandas()
    assert len(out) == 2_000 and (out["n"] == 3_000).all()
    a, b = np.array(given).T
    picks = [rng.integers(0, 3_000, 3_000) for _ in range(2_000)]
    for name, value in (("a", a), ("b", b)):
        plain = np.array([value[p].mean() for p in picks])
        assert out[name].mean() == pytest.approx(value.mean(), abs=5 * plain.std() / np.sqrt(2_000))
        assert out[name].std() == pytest.approx(plain.std(), rel=0.08)
    gap, plain = out["a"] - out["b"], np.array([(a - b)[p].mean() for p in picks])
    assert gap.std() == pytest.approx(plain.std(), rel=0.08)
    again = sampling.exact_bootstrap(df.repartition(7), ["a", "b"], draws=2_000, bits=4).toPandas().sort_values("draw")
    np.testing.assert_allclose(again["b"], out.sort_values("draw")["b"])


def test_leaves_share_each_draw():
    sizes = np.array([5, 0, 70, 1, 0, 0, 24, 900])
    splits = sampling.Splits(sizes, 4_000, 7)
    taken = np.array([splits.drawn(i) for i in range(8) if sizes[i]])
    assert (taken.sum(axis=0) == 1_000).all()
    np.testing.assert_allclose(taken.mean(axis=1), sizes[sizes > 0], rtol=0.1)
    share = sizes[sizes > 0] / 1_000
    np.testing.assert_allclose(taken.var(axis=1), 1_000 * share * (1 - share), rtol=0.15)


def test_published_shares(spark):
    """832 claims, 553 of them flipped by evidence perturbations and 53 by character ones (66.47 % and 6.37 %): the interval of an exact resample is the binomial one."""
    df = spark.range(832).selectExpr("CAST(id < 553 AS DOUBLE) AS evidence", "CAST(id >= 779 AS DOUBLE) AS letters")
    out = sampling.exact_bootstrap(df, ["evidence", "letters"])
    low, high, mean = out.agg(F.percentile("evidence", F.lit(0.025)), F.percentile("evidence", F.lit(0.975)), F.avg("evidence")).first()
    deviation = np.sqrt(553 / 832 * 279 / 832 / 832)
    assert mean == pytest.approx(553 / 832, abs=6e-4)
    assert low == pytest.approx(553 / 832 - 1.96 * deviation, abs=2.5e-3) and high == pytest.approx(553 / 832 + 1.96 * deviation, abs=2.5e-3)


def test_no_rows_no_draws(spark):
    assert sampling.exact_bootstrap(spark.range(0).selectExpr("id AS a"), ["a"], 10).count() == 0
    one = sampling.exact_bootstrap(spark.range(1).selectExpr("5 AS a"), ["a"], 10).collect()
    assert [(r.n, r.a) for r in one] == [(1, 5.0)] * 10


def test_claim_bootstrap_query(spark):
    r = QUERIES["claim_bootstrap"](spark, SMALL).first()
    assert r.draws == 10_000 and r.ci_low < r.fixed_pct - r.mixed_pct < r.ci_high
    assert r.mean_gap == pytest.approx(r.fixed_pct - r.mixed_pct, abs=0.05 * (r.ci_high - r.ci_low))
    shares = QUERIES["hypergeometric_coverage"](spark, SMALL).collect()
    assert r.mixed_pct == pytest.approx(100 * sum(s.claims * s.expected for s in shares) / r.claims, abs=1e-3)


def test_pooled_tokens(spark):
    rng = np.random.default_rng(4)
    texts = [(i, rng.normal(size=(n, 3)).tolist(), rng.integers(0, 2, n).tolist()) for i, n in enumerate([1, 5, 0, 200, 128, 17])]
    texts += [(90, None, [1]), (91, [[1.0, 2.0, 3.0]], [0]), (92, [[1.0, 2.0, 3.0], [5.0, 5.0, 5.0]], [1]), (93, [[1.0, 2.0, 3.0], None, [1.0, None, 2.0], [1.0], [3.0, 2.0, 1.0]], [1] * 5), (94, [[1.0, 1.0, 1.0]], None), (95, [[1.0, 1.0, 1.0], [3.0, 3.0, 3.0]], [None, 1])]
    df = spark.createDataFrame(texts, "id long, t array<array<double>>, m array<int>").withColumn("pooled", F.lit("clash"))
    found = {r.id: r.pooled for r in records.pool_tokens(df.coalesce(1), "id", "t", "m", 3).collect()}
    assert len(found) == len(texts) and found[90] is None and found[91] == found[94] == found[2] == [0.0] * 3
    assert found[92] == [1.0, 2.0, 3.0] and found[93] == [2.0, 2.0, 2.0] and found[95] == [3.0] * 3
    for i, vectors, mask in texts[:6]:
        counted = [v for v, m in zip(vectors[:128], mask[:128]) if m]
        expected = [sum(v[d] for v in counted) / max(len(counted), 1e-9) for d in range(3)]
        assert found[i] == pytest.approx(expected)
