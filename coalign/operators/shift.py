"""Correction for a test set whose mix of pairs differs from the training set's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_FACTOR = 0.2
REFERENCE = "same|eq"


def bucket() -> Column:
    """How the names agree and how the addresses do; the first that fits."""
    c = F.col
    name = F.when(c("n_tset") >= 0.95, "same").when(c("nt_wov") >= 0.5, "partial").otherwise("diff")
    address = (
        F.when(c("aempty_b") == 1, "empty")
        .when((c("num_na") == 0) | (c("num_nb") == 0), "nonum")
        .when(c("num_first_logdiff") == 0, "eq")
        .when(c("num_first_edit1") == 1, "edit1")
        .when(c("num_first_logdiff") <= math.log1p(20), "shift20")
        .when(c("num_first_logdiff") <= math.log1p(200), "shift200")
        .otherwise("far")
    )
    return F.concat_ws("|", name, address)


def rates(pairs: DataFrame, a: DataFrame) -> DataFrame:
    """(country, bk, n, n_a, rate): pairs of a bucket for each record of A."""
    n = a.groupBy("country").agg(F.count(F.lit(1)).alias("n_a"))
    return pairs.groupBy("country", "bk").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), "country").withColumn("rate", F.col("n") / F.col("n_a"))


def factors(train: DataFrame, test: DataFrame) -> DataFrame:
    """(country, bk, rate_train, rate_test, r, r_ref, f); a country that training hasn't is held against all of it."""
    records = train.select("country", "n_a").distinct().agg(F.sum("n_a").alias("all_a"))
    pooled = train.groupBy("bk").agg(F.sum("n").alias("n")).join(F.broadcast(records), how="cross").select("bk", (F.col("n") / F.col("all_a")).alias("pooled"))
    d = test.select("country", "bk", F.col("rate").alias("rate_test")).join(train.select("country", "bk", F.col("rate").alias("own")), ["country", "bk"], "left").join(pooled, "bk", "left")
    d = d.withColumn("rate_train", F.coalesce("own", "pooled")).withColumn("r", F.col("rate_test") / F.col("rate_train"))
    ref = d.where(F.col("bk") == REFERENCE).select("country", F.col("r").alias("r_ref"))
    f = F.greatest(F.lit(LEAST_FACTOR), F.least(F.lit(1.0), F.col("r_ref") / F.col("r")))
    return d.join(F.broadcast(ref), "country").withColumn("f", f).select("country", "bk", "rate_train", "rate_test", "r", "r_ref", "f")


def odds(p: Column, f: Column) -> Column:
    """P04."""
    return F.least(F.lit(1.0), p * f / (p * f + 1 - p))


def correct(pairs: DataFrame, f: DataFrame) -> DataFrame:
    """P corrected by the factor of its country and bucket, 1 where there is none."""
    d = pairs.join(F.broadcast(f.select("country", "bk", "f")), ["country", "bk"], "left")
    return d.withColumn("p", odds(F.col("p"), F.coalesce("f", F.lit(1.0)))).drop("f")


def probe(pairs: DataFrame, bk: str, factor: float) -> DataFrame:
    """The same pairs with the odds of one bucket scaled, to be decided on again."""
    return pairs.withColumn("p", F.when(F.col("bk") == bk, odds(F.col("p"), F.lit(factor))).otherwise(F.col("p")))
