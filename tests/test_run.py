"""The learned run, and what it is put together from."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coalign.operators import decide, mine, model, ranks, report
from coalign.plans import linkage

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_learned_run_beats_the_hand_score(spark):
    chosen, found = linkage.run(linkage.raw_records(spark, SF_DIR), F.expr(linkage.IN_TEST))
    test = found["test"]
    truth = test.truth.withColumn("y", F.lit(1))
    all_a = test.a.select(F.col("id").alias("a")).join(test.truth.groupBy("a").agg(F.count(F.lit(1)).alias("ntrue")), "a", "left").na.fill(0, ["ntrue"])
    score = lambda d: decide.macro_f05(d.join(truth, ["a", "b"], "left").na.fill(0, ["y"]), all_a).first()[0]
    hand = test.pairs.select("a", "b", F.least(F.col("hand") / 2, F.lit(1.0)).alias("p"))
    assert score(chosen) > max(0.97, score(decide.apply_thresholds(decide.one_to_one(hand), 0.3, 0.6, 0.4)))
    assert chosen.count() == chosen.select("b").distinct().count()
    assert found["recall"][25] > 0.99
    rows = found["scored"].select(F.min("p"), F.max("p")).first()
    assert rows[0] >= 0 and rows[1] <= 1, rows


def test_folds_are_whole_records(spark):
    pairs = spark.range(3000).select((F.col("id") % 200).alias("a"), "id").withColumn("fold", model.fold_of()).collect()
    by = defaultdict(set)
    for r in pairs:
        by[r.a].add(r.fold)
    assert all(len(f) == 1 for f in by.values()) and {f for x in by.values() for f in x} == {0, 1, 2}


def test_out_of_fold_and_fold_mean(spark):
    rnd = np.random.default_rng(1)
    rows = [(int(i % 60), int(i), float(x), float(rnd.random() < x)) for i, x in enumerate(rnd.random(1200))]
    rows = spark.createDataFrame(rows, "a long, b long, x double, y double").cache()
    models = model.train_folds(rows, ["x"], lambda: model.boosted(maxIter=3, maxDepth=2))
    oof = model.predict_oof(models, rows)
    assert oof.count() == 1200 and oof.select("a", "b").distinct().count() == 1200
    for i, m in enumerate(models):
        own = {(r.a, r.b): r.p_raw for r in model.predict(m, rows.where(model.fold_of() == i)).collect()}
        assert own == {(r.a, r.b): r.p_raw for r in oof.where(model.fold_of() == i).collect()}
    each = [{r.b: r.p_raw for r in model.predict(m, rows).collect()} for m in models]
    for r in model.predict_test(models, rows).collect():
        assert r.p_raw == pytest.approx(sum(e[r.b] for e in each) / 3)
    calibrated = model.calibrate(model.calibrator(oof), oof).orderBy("p_raw", "p").select("p").collect()
    p = [r.p for r in calibrated]
    assert all(x <= y + 1e-12 for x, y in zip(p, p[1:])) and 0 <= p[0] and p[-1] <= 1
    both = rows.select("y", F.col("x").alias("p0"), F.lit(0.5).alias("p1"))
    weights, loss = model.blend_weights(both, ["p0", "p1"])
    assert sum(weights) == pytest.approx(1) and weights[0] > 0.5
    q = np.array([(r.y, weights[0] * r.p0 + weights[1] * r.p1) for r in both.collect()])
    assert loss == pytest.approx(-np.mean(q[:, 0] * np.log(q[:, 1]) + (1 - q[:, 0]) * np.log(1 - q[:, 1])))
    best, scores = model.search(rows, ["x"], {"maxDepth": [1, 2]}, "forest")
    assert {p["maxDepth"] for p, _ in scores} == {1, 2} and all(0 < s <= 1 for _, s in scores)


def test_bounded_sample_takes_whole_records(spark):
    rows = spark.range(20_000).select((F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
    kept = linkage.bounded(rows, 4000)
    assert 2500 < kept.count() < 5500 and kept.groupBy("a").count().where("count <> 20").isEmpty()
    assert linkage.bounded(rows, 20_000).count() == 20_000


def test_chains(spark):
    rows = [("x", "a", "b"), ("x", "b", "c"), ("x", "c", "d"), ("y", "a", "z"), ("x", "p", "q"), ("x", "q", "p"), ("x", "r", "p"), ("x", "s", "s")]
    got = mine.resolve_chains(spark.createDataFrame(rows, "country string, component string, canonical string")).collect()
    assert {(r.country, r.component, r.canonical) for r in got} == {("x", "a", "d"), ("x", "b", "d"), ("x", "c", "d"), ("y", "a", "z")}


def test_grid_median(spark):
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 500, 1001):
        values = [(k, float(v)) for k, vs in (("a", rnd.normal(size=n)), (None, rnd.integers(0, 3, n)), ("same", np.full(n, 2.5))) for v in vs]
        rows = spark.createDataFrame([*values, ("a", None)], "g string, v double")
        got = {r.g: r.median for r in ranks.grid_median(rows, F.col("v"), ["g"], steps=8).collect()}
        assert got == {k: pytest.approx(float(np.median([v for x, v in values if x == k]))) for k in ("a", None, "same")}
        whole = ranks.grid_median(rows, F.col("v"), steps=8).first()
        assert whole.median == pytest.approx(float(np.median([v for _, v in values])))


def test_generic_rates_of_a_country_that_training_has_not(spark):
    side = lambda tokens, n, c: spark.createDataFrame([(c, list(tokens))] * n, "country string, core_tok array<string>")
    known, a, b = side("xy", 3, "IN"), side("uv", 60, "FR"), side("uvw", 60, "FR")
    mined = spark.createDataFrame([("x", 0.4), ("w", 0.1)], "t string, rate double")
    got = {(r.country, r.t): r.rate for r in mine.generic_rates(mined, known, a.unionByName(known), b).collect()}
    assert got[("IN", "x")] == 0.4 and got[("FR", "x")] == 0.4 and got[("IN", "w")] == 0.1 and got[("FR", "w")] > 0.5


def test_rank_correlations(spark):
    rnd = np.random.default_rng(4)
    y = rnd.integers(0, 2, 700)
    columns = {"x": rnd.normal(size=700) + y, "ties": rnd.integers(0, 4, 700) * 1.0, "zero": np.where(rnd.random(700) < 0.9, 0.0, 1e6), "same": np.full(700, 3.0)}
    rows = spark.createDataFrame([(*map(float, r),) for r in zip(y, *columns.values())], "y double, x double, ties double, zero double, same double")

    def rank(v):
        order = np.argsort(v, kind="stable")
        out = np.empty(len(v))
        out[order] = np.arange(1, len(v) + 1)
        return np.array([out[v == x].mean() for x in v])

    want = {k: 0.0 if k == "same" else float(np.corrcoef(rank(v), rank(y))[0, 1]) for k, v in columns.items()}
    got = {r.feature: r.spearman for r in report.rank_correlations(rows, list(columns)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
