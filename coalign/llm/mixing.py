"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within each source documents are ranged by
the key: its leading hexadecimal digits name a range, so ranges of any source,
however large, hold about the same number of documents. Sizes are summed by range,
the range sums are summed up within the source, and a window inside each range adds
the rest: a prefix sum of the sizes of each source in key order without a sort of
the whole source in one task. The source is then cut where the prefix sum meets its
budget; where the budget is over the source's size, whole epochs come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

ROWS_PER_RANGE = 20_000
#: Sources up to this number are broadcast, being a row of a few numbers each.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int) -> DataFrame:
    """src, source_size, target from (src, source_size), a row a source.

    Sources in order of ``src`` weigh ``weights``, repeating. They share ``share``
    times all sizes by weight; a target stops at ``most_epochs`` times its source's
    size, and the excess is shared again by weight until no target is above. With
    sources ordered by cap / weight, those that reach their cap are the first ones,
    and the rest share what these leave.
    """
    ordered = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ordered = ordered.withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("w"), "src")
    filled = ordered.withColumns(
        {
            "nth": F.row_number().over(by),
            "left": F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("open", F.col("left") * F.col("w") < F.col("cap") * F.col("rest"))
    first = F.min(F.when(F.col("open"), F.struct("nth", "left", "rest"))).over(W.partitionBy())
    filled = filled.withColumn("first", first)
    return filled.select(
        "src", "source_size", F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), F.col("cap")).otherwise(F.col("w") * F.col("first.left") / F.col("first.rest")).alias("target")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, seed: str = "mix"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, text_key (xxhash64 of the text).

    ``size`` is the number of words (0 for a null or empty text), ``taken`` how many
    words the mix takes, whole epochs and the part of the last one together. Sources
    go by code point, a null source last, as one source. The budget of a source is
    its target rounded down, met exactly; the document at the cut is taken in part.
    Ties of the key (rows with one id) go by id and size, and rows alike in both are
    interchangeable. A null id takes part like any other. The key depends on the seed
    and the id only, so reruns agree. An empty table gives an empty result.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("z")).alias("src"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        )
    )
    n, digits = rows.count(), 0
    while 16**digits * ROWS_PER_RANGE < n and digits < 8:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = cut(rows.groupBy("src", "range").agg(F.sum("size").alias("range_size")))
    ranges = ranges.withColumn("range_before", F.sum("range_size").over(W.partitionBy("src").orderBy("range")) - F.col("range_size"))
    targets = cut(source_targets(ranges.groupBy("src").agg(F.sum("range_size").alias("source_size")), weights, share, most_epochs))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    inside = W.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.join(ranges.join(targets, "src"), ["src", "range"])
    placed = placed.withColumn("before", F.col("range_before") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - epochs * F.col("source_size") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), "text_key")
