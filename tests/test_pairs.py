"""Work on many pairs: records spread over tasks, pairs compared in tiles, features only where they are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coalign.functions.vocabulary import KEY_TYPES
from coalign.operators import blocking, features, keys, mine, model, tiles
from coalign.plans import linkage

SMALL = "/root/testdata/sf0.001"


def test_registers_of_small_files_are_normalized_by_many_tasks(spark):
    # five tables of one row group each made five tasks
    assert linkage.raw_records(spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pairs_in_tiles_are_as_in_one(spark, monkeypatch):
    a, b, _ = linkage.registers(spark, SMALL)
    ka, kb = keys.side_keys(a, b)
    found = []
    for tile in (10_000_000, 50):
        monkeypatch.setattr(blocking, "TILE", tile)
        rows = blocking.compared_pairs(ka, kb, a, b, linkage.cut)
        found.append(sorted(rows.collect()))
    assert found[0] == found[1] and len(found[0]) == blocking.key_pairs(ka, kb).count()
    # a few by hand
    idf = {r.t: r.idf for r in blocking.inverse_frequency(a, b, lambda x: F.array_distinct(F.concat("core_tok", "alt_tok"))).collect()}
    of = {r.id: r for r in a.unionByName(b).collect()}
    bag = lambda r: list(dict.fromkeys([*r.core_tok, *r.alt_tok]))[:8]
    for r in found[0][:200]:
        x, y = bag(of[r.a]), bag(of[r.b])
        shared, left, right = (sum(idf[t] for t in s) for s in ([t for t in x if t in y], x, y))
        assert r.n_ov == pytest.approx(shared / min(left, right) if min(left, right) > 0 else 0)
        assert r.n_jac == pytest.approx(shared / (left + right - shared) if left + right > shared else 0)
        assert r.same_number == bool(set(of[r.a].addr_num[:6]) & set(of[r.b].addr_num[:6]))
        assert r.same_compact == (of[r.a].compact == of[r.b].compact) and r.b_addr_empty == of[r.b].addr_empty


def test_best_pairs_in_tiles_are_as_of_all_rows(spark, monkeypatch):
    a, b, _ = linkage.registers(spark, SMALL)
    ka, kb = linkage.sides(spark, SMALL)
    columns = ["country", "a", "b", "cheap", "rank_a", "rank_b"]
    want = sorted(blocking.rank_and_prune(linkage.scored_pairs(spark, SMALL), 3, 1, 5).select(columns).collect())
    for tile in (10_000_000, 50):
        monkeypatch.setattr(blocking, "TILE", tile)
        rows = blocking.prune(blocking.best_of_a(ka, kb, a, b, linkage.cut, 5), 3, 1)
        assert rows.columns == columns and sorted(rows.collect()) == want
    assert 0 < len(want) < linkage.scored_pairs(spark, SMALL).count()


def test_cheap_scores_are_rounded_as_by_spark(spark):
    rnd = np.random.default_rng(4)
    n = 5000
    figures = {c: rnd.random(n) for c in ("n_ov", "n_jac", "a_ov", "a_jac")} | {c: rnd.random(n) < 0.3 for c in ("same_compact", "same_number", "b_addr_empty")}
    # halves of the last digit, a bit more and a bit less
    half = slice(0, 3000)
    for c in ("n_jac", "a_jac", "same_compact", "same_number", "b_addr_empty"):
        figures[c][half] = 0
    figures["n_ov"][half] = (2 * rnd.integers(0, 10**9 // 2, 3000) + 1) / 1e9
    figures["n_ov"][:1000], figures["n_ov"][1000:2000] = np.nextafter(figures["n_ov"][:1000], 0), np.nextafter(figures["n_ov"][1000:2000], 1)
    counts = np.zeros((n, len(KEY_TYPES)), np.int64)
    counts[half.stop :] = rnd.integers(0, 2, (n - half.stop, len(KEY_TYPES)))
    rows = [(i, *(v[i].item() for v in figures.values()), *counts[i].tolist()) for i in range(n)]
    schema = "i int, " + ", ".join(f"{c} {'double' if v.dtype == float else 'boolean'}" for c, v in figures.items()) + "".join(f", k_{k} bigint" for k in KEY_TYPES)
    want = {r.i: r.cheap for r in blocking.cheap_score(spark.createDataFrame(rows, schema)).select("i", F.round("cheap", 9).alias("cheap")).collect()}
    assert (blocking._cheap_units(figures, counts) / blocking.UNITS).tolist() == [want[i] for i in range(n)]


def test_cluster_features_make_no_row_of_each_pair(spark, monkeypatch):
    def scored(*_):
        raise AssertionError("all pairs were made rows")

    for at in [k for k in linkage._prepared if k[2] in ("scored", "candidates")]:
        monkeypatch.delitem(linkage._prepared, at)
    monkeypatch.setattr(linkage, "scored", scored)
    rows = entry.queries()["K02_K05_cluster_features"](spark, SMALL)
    # by b and its records, their totals, by rival and by a
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 12
    assert rows.count() == linkage.candidates(spark, SMALL).count() > 0
    for at in [k for k in linkage._prepared if k[2] == "candidates"]:
        del linkage._prepared[at]


@pytest.mark.parametrize("name", ["F08_F09_set_features", "F10_F11_unmatched_tokens", "F16_F18_F22_plain_features", "L03_labels"])
def test_no_string_is_compared_unless_asked_for(spark, monkeypatch, name):
    def compared(*_):
        raise AssertionError("string similarities were asked for")

    for at in [k for k in linkage._prepared if k[2] in ("features", "labelled")]:
        monkeypatch.delitem(linkage._prepared, at)
    monkeypatch.setattr("coalign.functions.fuzzy.scores", compared)
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_replaced_components_are_counted_for_each_positive(spark):
    rows = [("IN", ["mg rd", "x", "7 a"], ["main rd", "x"])] * 3 + [("IN", ["x"], ["y"])] + [("US", [], ["z"])]
    # three positives under one pair of ids stay three
    d = spark.createDataFrame([("s", "m", *r) for r in rows], "s1_id string, m_id string, a_country string, a_addr_comp array<string>, b_addr_comp array<string>")
    pairs, totals = mine.replaced_components(d)
    assert sorted(map(tuple, pairs.collect())) == [("IN", "main rd", "mg rd", 3), ("IN", "y", "x", 1)]
    assert sorted(map(tuple, totals.collect())) == [("IN", "main rd", 3), ("IN", "y", 1), ("US", "z", 1)]


def test_only_the_ratios_that_are_shown_are_made(spark, monkeypatch):
    made, real = [], features.pair_features
    monkeypatch.setattr(features, "pair_features", lambda *x, **y: made.append(real(*x, **y)) or made[-1])
    rows = entry.queries()["F14_string_ratios"](spark, SMALL)
    assert set(made[0].columns) - {"country", "cheap"} == set(rows.columns)
    whole = real(linkage.candidates(spark, SMALL).select("a", "b"), *linkage.registers(spark, SMALL)[:2], parts=("strings",))
    assert sorted(rows.collect()) == sorted(whole.select("a", "b", *(F.round(c, 6).alias(c) for c in rows.columns[2:])).collect())


def test_features_in_rounds_are_as_at_once(spark, monkeypatch):
    a, b, _ = linkage.registers(spark, SMALL)
    pairs = linkage.candidates(spark, SMALL).select("a", "b", "cheap")
    want = sorted(features.pair_features(pairs, a, b, parts=("nt", "plain", "numbers")).collect())
    for name, value in (("TILE", 50), ("COPIES", 1000), ("PARTS", ("nt", "plain", "numbers"))):
        monkeypatch.setattr(features, name, value)
    of_round, kept = [], []
    keep = lambda df: kept.append(linkage.cut(df)) or kept[-1]
    for part in features.feature_rounds(pairs, a, b, parts=features.PARTS, keep=keep):
        assert len(kept) == 3  # written before the first round
        of_round.append(part.collect())
    assert len(of_round) > 3 and sorted(r for rows in of_round for r in rows) == want
    # a round has all pairs of its records of a
    assert sum(len({r.a for r in rows}) for rows in of_round) == len({r.a for r in want})


def test_best_pairs_in_rounds_are_as_at_once(spark, monkeypatch):
    a, b, _ = linkage.registers(spark, SMALL)
    ka, kb = linkage.sides(spark, SMALL)
    want = sorted(blocking.best_of_a(ka, kb, a, b, linkage.cut, 5).collect())
    monkeypatch.setattr(blocking, "TILE", 500)
    monkeypatch.setattr(blocking, "ROUND", 100_000)
    of_round = []

    def in_turn(parts):
        of_round.extend(linkage.cut(p) for p in parts)
        return features.all_of(of_round)

    assert sorted(blocking.best_of_a(ka, kb, a, b, linkage.cut, 5, in_turn).collect()) == want
    assert len(of_round) > 1 and sum(r.select("a").distinct().count() for r in of_round) == len({r.a for r in want})


def test_rounds_of_a_grid():
    assert tiles.rounds(6, 100, 1000, 1) == [range(6)]
    assert tiles.rounds(6, 600, 200, 1) == [range(2), range(2, 4), range(4, 6)]
    assert tiles.rounds(5, 500, 1, 1) == [range(i, i + 1) for i in range(5)]
    assert tiles.rounds(5, 500, 1, 8) == [range(2), range(2, 4), range(4, 5)]  # tiles for all tasks


def test_ranker_is_judged_on_all_pairs_without_a_table_of_them(spark, monkeypatch):
    pairs, truth = linkage.scored_pairs(spark, SMALL).drop("country").withColumn("hand", F.col("cheap")), linkage.registers(spark, SMALL)[2]
    wanted = sorted(model.ranker_sample(model.labelled(pairs, truth)).collect())

    def scored(*_):
        raise AssertionError("all pairs were made a table")

    monkeypatch.setattr(linkage, "scored_pairs", scored)
    monkeypatch.setattr("coalign.plans.queries.scored_pairs", scored)
    monkeypatch.setattr(blocking, "TILE", 500)
    monkeypatch.setattr(blocking, "ROUND", 100_000)
    rankers, rounds, real, parts = [], [], model.train_ranker, blocking.scored_in_rounds

    def train(rows, *x, **y):
        assert sorted(rows.select(pairs.columns + ["y", "_check"]).collect()) == sorted(tuple(r[c] for c in [*pairs.columns, "y", "_check"]) for r in wanted)
        rankers.append(real(rows, *x, maxIter=3, **y))
        return rankers[-1]

    monkeypatch.setattr(model, "train_ranker", train)
    monkeypatch.setattr(blocking, "scored_in_rounds", lambda made: (rounds.append(1) or x for x in parts(made)))
    got = sorted(linkage.ranker_recall(spark, SMALL).collect())
    monkeypatch.undo()
    want = blocking.recall_by(model.learned_score(rankers[0], pairs), truth, {"learned": "cheap", "hand": "hand"}, pairs.count())
    assert len(rounds) > 3 and got == sorted(want.collect()) and got[0].learned < 1
