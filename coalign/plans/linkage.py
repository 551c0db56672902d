"""The linkage run over the driver's tables, and the registers it starts from (``fixture``)."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coalign.functions.vocabulary import KEY_TYPES
from coalign.operators import blocking, decide, features, keys, mine, model, records, shift, stack
from coalign.sources.scratch import cut, cut_in_turn, drop

from . import fixture


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, country, business_name, business_address, src, same, entity_id): ``same`` is what the truth goes by."""
    rows = reduce(DataFrame.unionByName, (table(spark, sf_dir, r["table"]).selectExpr(*fixture.expressions(r)) for r in fixture.RECORDS))
    # a table of one row group is read by one task, while normalizing is the longest work on a record
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    return rows.withColumn("entity_id", F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("id")))


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A, B and the truth (a, b) of raw records."""
    a, b = raw.where("src = 1"), raw.where("src > 1")
    truth = a.select(F.col("id").alias("a"), "country", "same").join(b.select(F.col("id").alias("b"), "country", "same"), ["country", "same"])
    return a, b, truth.select("a", "b")


def _in_parallel(work: list) -> list:
    """Jobs that don't wait for one another, submitted at once."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


_prepared: dict[tuple[str, str, str], tuple[DataFrame, ...]] = {}


def forget() -> None:
    """The next query makes its stage tables anew."""
    _prepared.clear()


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> tuple[DataFrame, ...]:
    """Stage tables (S05, S06) are made once for an application and an input."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _prepared:
        _prepared[at] = make()
    return _prepared[at]


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A and B, normalized, and the truth as (a, b)."""

    def make() -> tuple[DataFrame, ...]:
        a, b, truth = split(raw_records(spark, sf_dir))
        return *_in_parallel([lambda x=x: cut(records.normalize(x)) for x in (a, b)]), truth

    return _once(spark, sf_dir, "registers", make)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The keys of A and of B."""

    def make() -> tuple[DataFrame, ...]:
        a, b, _ = registers(spark, sf_dir)
        return tuple(_in_parallel([lambda k=k: cut(k) for k in keys.side_keys(a, b, cut)]))

    return _once(spark, sf_dir, "keys", make)


def scored(a: DataFrame, b: DataFrame, ka: DataFrame, kb: DataFrame) -> DataFrame:
    """All pairs that share a key, with hits and the cheap score (rounded, so that ties are ties everywhere)."""
    rows = blocking.cheap_score(blocking.compared_pairs(ka, kb, a, b, cut))
    return rows.select("country", "a", "b", *(f"k_{k}" for k in KEY_TYPES), F.round("cheap", 9).alias("cheap"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = registers(spark, sf_dir)
    return _once(spark, sf_dir, "scored", lambda: (cut(scored(a, b, *sides(spark, sf_dir))),))[0]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidate pairs (country, a, b, cheap, rank_a, rank_b)."""

    def make() -> tuple[DataFrame, ...]:
        a, b, _ = registers(spark, sf_dir)
        ranked = blocking.best_of_a(*sides(spark, sf_dir), a, b, cut, in_turn=cut_in_turn)
        found = cut(blocking.prune(ranked))
        drop(ranked)
        return (found,)

    return _once(spark, sf_dir, "candidates", make)[0]


def ranker_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, learned, hand): recall by rank of all scored pairs, by a ranker that is fitted on one record in ten and by the hand score.

    Pairs are compared in rounds and never written: first those of the ranker's records,
    of which its sample is kept, then all, of which only counts are. Figures and caps of
    keys are those of all records both times.
    """
    a, b, truth = registers(spark, sf_dir)
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(cut(df))
        return kept[-1]

    truth = keep(truth)
    every = blocking.sources(*sides(spark, sf_dir), a, b, keep)
    every = every._replace(left=keep(every.left), right=keep(every.right))

    def parts(made: blocking.Sources) -> Iterator[tuple[DataFrame, float]]:
        for rows, most in blocking.scored_in_rounds(made):
            yield rows.withColumn("hand", F.col("cheap")), most

    sample = cut_in_turn(model.ranker_sample(model.labelled(rows, truth)) for rows, _ in parts(every.of(model.in_ranker_sample, 0.1)))
    ranker = model.train_ranker(sample, ["hand", *HITS])
    drop(sample)
    scores = {"learned": "cheap", "hand": "hand"}
    found = cut_in_turn(blocking.hits_by_rank(model.learned_score(ranker, rows), truth, list(scores.values()), most) for rows, most in parts(every))
    drop(*kept)
    return blocking.recall_of(found, scores)


def features_of(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """a stage table of all features, made in rounds; what the rounds start from is deleted after them."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(cut(df))
        return kept[-1]

    rows = cut_in_turn(features.feature_rounds(pairs, a, b, keep=keep))
    drop(*kept)
    return rows


# The whole run


@dataclass
class Split:
    """Records of one set (training or test), and what the steps of the run add."""

    a: DataFrame
    b: DataFrame
    truth: DataFrame
    pairs: DataFrame | None = None
    rows: DataFrame | None = None


@dataclass(frozen=True)
class RunRules:
    """``most_rows``: about as many labelled pairs as a learner is fitted on, chosen by hash of the record, or None for all; all pairs are scored."""

    folds: int = 3
    most_rows: int | None = 100_000
    trees: dict = field(default_factory=lambda: {"maxIter": 10, "maxDepth": 4})
    min_count: int = 3
    min_alias: int = 20
    min_occ: int = 50


def normalized(raw: DataFrame, maps: mine.Maps) -> Split:
    a, b, truth = split(raw)
    tables = _in_parallel([lambda x=x: cut(records.normalize(x, maps.transliterations, maps.aliases)) for x in (a, b)])
    return Split(*tables, cut(truth))


def bounded(rows: DataFrame, most: int | None) -> DataFrame:
    """About ``most`` rows at most, whole records at a time; with None the same rows."""
    if most is None:
        return rows
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(53), "a"), F.lit(1_000_000)) < int(1_000_000 * most / n))


HITS = [f"k_{k}" for k in KEY_TYPES]


def add_candidates(train: Split, test: Split, rules: RunRules) -> dict[int, float]:
    """The pairs of both sets in the order of a ranker that is learned on the training set; its recall there by rank."""
    for s in (train, test):
        s.pairs = cut(scored(s.a, s.b, *map(cut, keys.side_keys(s.a, s.b, cut))).withColumn("hand", F.col("cheap")))
    ranker = model.train_ranker(bounded(model.labelled(train.pairs, train.truth), rules.most_rows), ["hand", *HITS], modulus=1, **rules.trees)
    recall = {}
    for s in (train, test):
        order = cut(model.learned_score(ranker, s.pairs))
        if s is train:
            recall = {r.k: r.recall for r in blocking.recall_at(order, train.truth).collect()}
        s.pairs = cut(blocking.context(blocking.rank_and_prune(order)))
    return recall


def add_features(s: Split, generic: DataFrame) -> None:
    """all features of the candidates of a set."""
    s.rows = cut(model.labelled(features.pair_features(s.pairs, s.a, s.b, generic), s.truth))


def _feature_names(rows: DataFrame) -> list[str]:
    return [n for n, kind in rows.dtypes if kind in ("double", "bigint", "int", "boolean", "float") and n not in ("a", "b", "y", "p", "p_raw", "fold")]


def _learned(train: DataFrame, test: DataFrame, rules: RunRules) -> tuple[DataFrame, DataFrame, list]:
    """P of the training pairs out of fold and of the test pairs by the mean of the folds' models, both calibrated."""
    names = _feature_names(train)
    models = model.train_folds(cut(bounded(train, rules.most_rows)), names, lambda: model.boosted(**rules.trees), rules.folds, run=_in_parallel)
    oof = cut(model.predict_oof(models, train))
    calibrator = model.calibrator(oof)
    return cut(model.calibrate(calibrator, oof)), cut(model.calibrate(calibrator, model.predict_test(models, test))), models


def _stacked(rows: DataFrame, s: Split) -> DataFrame:
    """K05 and X06 on the first round's p."""
    base = rows.drop("p_raw").withColumnRenamed("p", "p1")
    rows = features.extended_features(base.join(stack.cluster_features(base.select("a", "b", "p1"), s.b).drop("p1"), ["a", "b"]))
    return rows.na.fill(0.0)  # ratios without a denominator


def run(raw: DataFrame, in_test, rules: RunRules = RunRules()) -> tuple[DataFrame, dict]:
    """From raw records to (a, b) of the test records, those with ``in_test``, and what was found on the way.

    Maps are mined from the training pairs (M08), candidates ranked by a learned order
    (B22), features made for both sets (F26), two rounds of models trained out of fold
    and calibrated, the second one on the first one's view of each record's other
    candidates (K05, X06), the rule tuned on the training pairs (D10), the test odds
    corrected for the shift of the mix of pairs (P04) and decided on (D11).
    """
    raw = cut(raw)
    known, asked = raw.where(~in_test), raw.where(in_test)
    maps = mine.mine_maps(known, split, records.normalize, cut, rules.min_count, rules.min_alias, rules.min_occ)
    train, test = normalized(known, maps), normalized(asked, maps)
    recall = add_candidates(train, test, rules)
    generic = mine.generic_rates(maps.generic, train.a, test.a, test.b)
    _in_parallel([lambda s=s: add_features(s, generic) for s in (train, test)])
    first, first_test, _ = _learned(train.rows, test.rows, rules)
    second, second_test, models = _learned(cut(_stacked(first, train)), cut(_stacked(first_test, test)), rules)
    all_a = train.a.select(F.col("id").alias("a")).join(train.truth.groupBy("a").agg(F.count(F.lit(1)).alias("ntrue")), "a", "left").na.fill(0, ["ntrue"])
    config = decide.tune(second.select("a", "b", "p", "y"), cut(all_a))
    buckets = [pairs.join(s.rows.select("a", "b", shift.bucket().alias("bk")), ["a", "b"]) for pairs, s in ((second, train), (second_test, test))]
    factors = shift.factors(*(shift.rates(p, s.a) for p, s in zip(buckets, (train, test), strict=True)))
    corrected = shift.correct(buckets[1].select("a", "b", "country", "bk", "p"), cut(factors))
    chosen = cut(decide.decide(corrected.select("a", "b", "p"), config).select("a", "b"))
    return chosen, {"config": config, "recall": recall, "models": models, "train": train, "test": test, "scored": corrected}


def blocking_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids), a row for each record of A, without anything learned: half the cheap score stands in for the match probability, the thresholds are fixed."""
    a, b, _ = registers(spark, sf_dir)
    pairs = candidates(spark, sf_dir).select("a", "b", F.least(F.col("cheap") / 2, F.lit(1.0)).alias("p"))
    chosen = decide.apply_thresholds(decide.one_to_one(pairs), 0.3, 0.6, 0.4)
    return decide.id_lists(a.select(F.col("id").alias("a"), "entity_id"), chosen, b.select(F.col("id").alias("b"), F.col("entity_id").alias("b_entity_id")))


#: The records that the run decides on: a country that training hasn't, and every second firm of the others.
IN_TEST = "country = 'FR' OR id % 2 = 1"


def match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids), a row for each test record of A: the whole run, learned on the other records."""
    chosen, found = run(raw_records(spark, sf_dir), F.expr(IN_TEST))
    test = found["test"]
    return decide.id_lists(test.a.select(F.col("id").alias("a"), "entity_id"), chosen, test.b.select(F.col("id").alias("b"), F.col("entity_id").alias("b_entity_id")))
