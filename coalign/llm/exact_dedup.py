"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass one drops every text hash into a blocked Bloom filter: one 64-bit word of the
filter and three bits in it. Words and bits that were hit twice make a second
filter, of possibly repeated hashes. Pass two tests every row against the second
filter: rows that miss it are unique and go straight to the result; only rows that
hit it are shuffled and grouped by their digest.

The filter table holds the words that have a repeated bit, so it is no larger than
the number of repeated texts; it is broadcast only when it has at most
``BROADCAST_WORDS`` rows and joined by a shuffle of the narrow rows otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, doc_key, power_of_two

BITS_PER_ROW = 16
BROADCAST_WORDS = 400_000
#: A group is hot if it has over max(HOT_ROWS, rows / MOST_HOT) rows; so at most MOST_HOT groups are.
HOT_ROWS, MOST_HOT = 1_000, 10_000


def text_digest(text: Column) -> Column:
    """Bare lower-case hex SHA-256 of the text without white space; a null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", ""), 256)


def _bit(h: Column, at: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. Of equal texts the
    row with the most code points stays, then the smallest id; a missing id comes
    last, and of rows alike in all of this (repeated rows) any one is marked
    ``kept``. A null text counts as empty, so null, empty and blank texts are one
    group. Other columns are not read. An empty table gives an empty result.
    """
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), F.monotonically_increasing_id().alias("row"))
    )
    n = rows.count()
    words = power_of_two(n * BITS_PER_ROW / 64, 64)
    h = F.xxhash64("text_sha256")
    rows = rows.withColumns({"word": F.xxhash64(F.lit("word"), "text_sha256").bitwiseAND(F.lit(words - 1)), "bits": _bit(h, 0).bitwiseOR(_bit(h, 6)).bitwiseOR(_bit(h, 12))})
    twice = rows.groupBy("word", "bits").count().where("count > 1")
    filter_2 = cut(twice.groupBy("word").agg(F.bit_or("bits").alias("set")))
    if filter_2.count() <= BROADCAST_WORDS:
        filter_2 = F.broadcast(filter_2)
    tested = rows.join(filter_2, "word", "left").withColumn("maybe", F.coalesce(F.col("set").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))

    result = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    through = tested.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = tested.where("maybe").select("doc_id", "text_sha256", "n", "row")
    order = F.struct((-F.col("n")).alias("n"), doc_key("doc_id").alias("key"), F.col("row"))
    groups = cut(some.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(order.alias("order"), F.col("doc_id"))).alias("best")))
    groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.order.row").alias("keep_row"))
    hot = F.col("group_size") > max(HOT_ROWS, n // MOST_HOT)
    named = some.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    done = named.where(F.col("keep_row").isNotNull())
    cold = named.where(F.col("keep_row").isNull()).select("doc_id", "text_sha256", "n", "row").join(groups.where(~hot), "text_sha256")
    copies = done.unionByName(cold).withColumn("kept", F.col("row") == F.col("keep_row"))
    return through.unionByName(copies.select(*result)).select(*result)
