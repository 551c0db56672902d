"""Ranks and medians of whole columns, without a task that holds or sorts all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps of the grid between the least and the greatest value of a group.
STEPS = 4096


def grid_step(v: Column, lo: Column, hi: Column, steps: int) -> Column:
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * steps)).otherwise(F.lit(0)).cast("int")


def grid_median(df: DataFrame, value: Column, by: list[str] | None = None, steps: int = STEPS) -> DataFrame:
    """(by, median) of a column of numbers, exact, by counts: the values of the one step of a grid between least and most that holds the middle are looked at alone.

    The step's values are counted too, so no task holds the values of a group: rows are
    combined before they are shuffled, to a row for each distinct value of that step.
    """
    by = by or []
    d = df.select(*by, value.alias("v")).where("v is not null")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    join = lambda x, y: x.alias("x").join(F.broadcast(y.alias("y")), on or F.lit(True)).select("x.*", *(F.col(f"y.{c}") for c in y.columns if c not in by))
    range_ = d.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    placed = join(d, range_).withColumn("step", grid_step(F.col("v"), F.col("lo"), F.col("hi"), steps))
    running = W.partitionBy(*by).orderBy("step")
    steps_ = placed.groupBy(*by, "step").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).withColumn("before", F.sum("k").over(running) - F.col("k"))
    middle = lambda r: (F.col("before") <= r) & (F.col("before") + F.col("k") > r)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    wanted = steps_.where(middle(low) | middle(high)).select(*by, "step", "before")
    near = placed.alias("x").join(F.broadcast(wanted.alias("y")), [*on, F.col("x.step") == F.col("y.step")]).select("x.*", "y.before")
    values = near.groupBy(*by, "step", "v").agg(F.count(F.lit(1)).alias("k"), F.max("before").alias("first"), F.max("n").alias("n"))
    values = values.withColumn("before", F.col("first") + F.sum("k").over(W.partitionBy(*by, "step").orderBy("v")) - F.col("k"))
    pick = lambda r: F.max(F.when(middle(r), F.col("v")))
    return values.groupBy(*by).agg(((pick(low) + pick(high)) / 2).alias("median"))


def average_ranks(values: DataFrame, steps: int = STEPS) -> DataFrame:
    """(name, v, n) with one row for each value of a column: adds ``rank``, the mean rank of the value's rows.

    A value's rank is the number of rows in the grid steps before its own, and of those
    before it in its step.
    """
    range_ = values.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = values.join(F.broadcast(range_), "name").withColumn("step", grid_step(F.col("v"), F.col("lo"), F.col("hi"), steps))
    ahead = placed.groupBy("name", "step").agg(F.sum("n").alias("k")).withColumn("ahead", F.sum("k").over(W.partitionBy("name").orderBy("step")) - F.col("k"))
    inside = F.sum("n").over(W.partitionBy("name", "step").orderBy("v")) - F.col("n")
    placed = placed.withColumn("inside", inside).join(F.broadcast(ahead.select("name", "step", "ahead")), ["name", "step"])
    return placed.select("name", "v", "n", (F.col("ahead") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))
