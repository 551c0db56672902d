"""Reports on predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import average_ranks, grid_median

SEGMENTS = (("country",), ("truth_size",), ("candidate_band",), ("margin_band",), ("address_state",), ("country", "margin_band"), ("country", "candidate_band"))


def topology(pairs: DataFrame) -> DataFrame:
    """(a, n_cand, n_p_ge_10, n_p_ge_50, p_max, p_2, p_margin) of (a, b, p)."""
    ranked = pairs.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("p"), "b")))
    t = ranked.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_cand"),
        F.count_if(F.col("p") >= 0.1).alias("n_p_ge_10"),
        F.count_if(F.col("p") >= 0.5).alias("n_p_ge_50"),
        F.max("p").alias("p_max"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("p"))), F.lit(0.0)).alias("p_2"),
    )
    return t.withColumn("p_margin", F.col("p_max") - F.col("p_2"))


def audited(scores: DataFrame, topo: DataFrame) -> DataFrame:
    """Per-a scores with the bands that the segments go by; ``scores`` has country, addr_empty, ntrue, npred, tp, f05."""
    d = scores.join(topo, "a")
    return d.withColumns(
        {
            "truth_size": F.when(F.col("ntrue") == 0, "singleton").when(F.col("ntrue") == 1, "one_true").when(F.col("ntrue") <= 3, "2_3_true").otherwise("4plus_true"),
            "candidate_band": F.when(F.col("n_cand") <= 5, "<=5").when(F.col("n_cand") <= 15, "6_15").when(F.col("n_cand") <= 30, "16_30").otherwise("31plus"),
            "margin_band": F.when(F.col("p_margin") < 0.05, "<.05").when(F.col("p_margin") < 0.20, ".05_.20").otherwise(">=.20"),
            "address_state": F.when(F.col("addr_empty"), "empty").otherwise("present"),
        }
    )


def segments(d: DataFrame, groups=SEGMENTS) -> DataFrame:
    """All groupings in one pass: (segment, value, n, mean_f05, error_rate, mean_ntrue, mean_npred, mean_tp)."""
    names = sorted({c for g in groups for c in g})
    by = d.groupingSets([[F.col(c) for c in g] for g in groups], *names)
    out = by.agg(
        F.grouping_id(*names).alias("_g"),
        F.count(F.lit(1)).alias("n"),
        *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("f05", "ntrue", "npred", "tp")),
        F.round(F.count_if(F.col("f05") < 1) / F.count(F.lit(1)), 6).alias("error_rate"),
    )
    # a bit of the grouping id is set where the column isn't part of the group
    shown = [F.when(F.shiftright("_g", len(names) - 1 - i).bitwiseAND(F.lit(1)) == 0, F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))) for i, c in enumerate(names)]
    own = F.filter(F.array(*shown), lambda x: x.isNotNull())
    return out.select(
        F.array_join(F.transform(own, lambda x: x["k"]), "_x_").alias("segment"), F.array_join(F.transform(own, lambda x: x["v"]), "|").alias("value"), "n", "mean_f05", "error_rate", "mean_ntrue", "mean_npred", "mean_tp"
    )


def correlations(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """(feature, pearson) of every feature with y in one aggregation; 0 where one is constant."""
    made = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        made.append(F.struct(F.lit(f).alias("feature"), F.round(F.when(spread > 1e-12, F.covar_pop(x, F.col(y)) / F.when(spread > 1e-12, spread)).otherwise(0.0), 6).alias("pearson")))
    return rows.agg(F.array(*made).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def rank_correlations(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """(feature, spearman): Pearson of average ranks; 0 where one is constant.

    Rows are counted by value and y before anything is shuffled; ranks come from the
    counts, and the correlation is a sum over the counted cells. No row is joined.
    """
    number = F.col(y).cast("double")
    cells = rows.select(number.alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).cast("double").alias("v")) for f in features))).alias("x"))
    cells = cells.select("y", "x.*").where("v is not null and y is not null").groupBy("name", "v", "y").agg(F.count(F.lit(1)).alias("n"))
    of_x = average_ranks(cells.groupBy("name", "v").agg(F.sum("n").alias("n"))).select("name", "v", F.col("rank").alias("rx"))
    of_y = average_ranks(cells.groupBy("name", F.col("y").alias("v")).agg(F.sum("n").alias("n"))).select("name", F.col("v").alias("y"), F.col("rank").alias("ry"))
    middle = cells.groupBy("name").agg(((F.sum("n") + 1) / 2).alias("middle"))
    d = cells.join(of_x, ["name", "v"]).join(of_y, ["name", "y"]).join(F.broadcast(middle), "name")
    dx, dy, n = F.col("rx") - F.col("middle"), F.col("ry") - F.col("middle"), F.col("n")
    sums = d.groupBy("name").agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(F.col("name").alias("feature"), F.round(F.when(spread > 0, F.col("xy") / F.when(spread > 0, spread)).otherwise(0.0), 6).alias("spearman"))


def worst(d: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` records with the lowest scores."""
    return d.orderBy("f05", F.desc("ntrue"), F.desc("npred"), "a").limit(n)


def worst_pairs(pairs: DataFrame, worst_a: DataFrame, truth: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of those records, with b's name and address and whether they are true."""
    rows = pairs.join(worst_a.select("a"), "a", "left_semi").join(b.select(F.col("id").alias("b"), F.col("name_norm").alias("b_name"), F.col("addr").alias("b_addr")), "b")
    return rows.join(truth.select("a", "b", F.lit(1).alias("is_true")), ["a", "b"], "left").na.fill(0, ["is_true"])


def error_report(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Distribution of p, of true and of false pairs; false negatives and positives; the uncertain band. Medians are exact."""
    true, p = F.col("y") == 1, F.col("p")
    cuts = {f"p_{lo}_{hi}": F.count_if((p >= lo / 10) & (p < hi / 10)) for lo, hi in ((0, 1), (1, 5), (5, 9))} | {"p_9_10": F.count_if(p >= 0.9)}
    measures = cuts | {
        "n": F.count(F.lit(1)),
        "mean_p": F.round(F.avg("p"), 9),
        "std_p": F.round(F.stddev_samp("p"), 9),
        "mean_true": F.round(F.avg(F.when(true, p)), 9),
        "mean_false": F.round(F.avg(F.when(~true, p)), 9),
        "false_negatives": F.count_if(true & (p < 0.5)),
        "false_positives": F.count_if(~true & (p >= 0.5)),
        "uncertain": F.count_if((p >= 0.3) & (p <= 0.7)),
        "uncertain_true": F.count_if(true & (p >= 0.3) & (p <= 0.7)),
    }
    keys = [by] if by else []
    out = pairs.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))
    for name, which in (("true", true), ("false", ~true)):
        medians = grid_median(pairs.where(which), p, keys).withColumn("median", F.round("median", 9)).withColumnRenamed("median", f"median_{name}")
        on = F.col(f"x.{by}").eqNullSafe(F.col(f"y.{by}")) if by else F.lit(True)
        out = out.alias("x").join(F.broadcast(medians.alias("y")), on, "left").select("x.*", f"y.median_{name}")
    return out


def score_quantiles(scores: DataFrame, by: str) -> DataFrame:
    """By segment: records, mean, lowest tenth and quarter of the score."""
    # a score comes from three small counts, so a segment has few different ones
    counts = scores.groupBy(by, "f05").agg(F.count(F.lit(1)).alias("k"))
    mean = F.sum(F.col("f05") * F.col("k")) / F.sum("k")
    quantile = lambda q: F.round(F.percentile("f05", q, F.col("k")), 6)
    return counts.groupBy(by).agg(F.sum("k").alias("n"), F.round(mean, 6).alias("mean_f05"), quantile(0.1).alias("q10"), quantile(0.25).alias("q25"))


def log_loss(rows: DataFrame, p: str = "p", y: str = "y", least: float = 1e-15) -> DataFrame:
    """One row, ``logloss``, with p kept away from 0 and 1."""
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(p)))
    return rows.agg(F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("logloss"))
