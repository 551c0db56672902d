"""Blocking keys (B01-B11): long tables (id, country, kt, key), made for each side.

Frequencies are counted within a country over both sides; everything else is a window
over one record's tokens, so the only wide steps are the count and one join on
(country, token), which is the same exchange for every token-based key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN_CAP = 5000


def name_bag(df: DataFrame) -> Column:
    return F.array_distinct(F.concat("core_tok", "alt_tok"))


def document_frequency(a: DataFrame, b: DataFrame, bag) -> DataFrame:
    """(country, t, df) over both sides; ``bag`` gives a side's array column."""
    sides = [x.select("country", F.explode(F.array_distinct(bag(x))).alias("t")) for x in (a, b)]
    return sides[0].unionByName(sides[1]).groupBy("country", "t").agg(F.count(F.lit(1)).alias("df"))


def rarest(df: DataFrame, bag: Column, frequency: DataFrame, k: int, cap: int | None = None, where: Column | None = None) -> DataFrame:
    """The ``k`` rarest tokens of each record as (id, country, t, df, nth); ties go by token."""
    tokens = df.select("id", "country", F.explode(F.array_distinct(bag)).alias("t"))
    if where is not None:
        tokens = tokens.where(where)
    tokens = tokens.join(frequency, ["country", "t"])
    if cap is not None:
        tokens = tokens.where(F.col("df") <= cap)
    by = W.partitionBy("id").orderBy("df", "t")
    return tokens.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).select("id", "country", "t", "df", "nth")


def _key(df: DataFrame, kt: str, key: Column) -> DataFrame:
    return df.select("id", "country", F.lit(kt).alias("kt"), key.alias("key"))


def keys_t(rare: DataFrame) -> DataFrame:
    """Of the three rarest name tokens those that aren't frequent; frequent ones come last in the order of rarity."""
    return _key(rare.where(F.col("df") <= TOKEN_CAP), "t", F.col("t"))


def two_rarest(rare: DataFrame) -> DataFrame:
    """(id, country, pair): the two rarest name tokens, the rarest first."""
    found = rare.where("nth <= 2")
    return found.groupBy("id", "country").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "t"))), lambda x: x["t"]).alias("pair"))


def keys_b(two: DataFrame) -> DataFrame:
    """Both of the two rarest name tokens."""
    return _key(two.where(F.size("pair") == 2), "b", F.array_join(F.array_sort("pair"), " "))


def keys_cps(df: DataFrame) -> DataFrame:
    """The compact name, and its first and last six letters."""
    n = F.length("compact")
    whole = _key(df.where(n >= 4), "c", F.col("compact"))
    long = df.where(n >= 8)
    return whole.unionByName(_key(long, "p", F.substring("compact", 1, 6))).unionByName(_key(long, "s", F.substring("compact", -6, 6)))


def first_numbers(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode(F.slice("addr_num", 1, 2)).alias("n"))


def three_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """The three rarest address tokens that aren't numbers."""
    return rarest(df, F.col("addr_tok"), places, 3, where=~F.col("t").rlike("^[0-9]+$"))


def keys_a(df: DataFrame, three: DataFrame) -> DataFrame:
    """One of the first two numbers with one of the rarest address tokens."""
    return _key(three.join(first_numbers(df), "id"), "a", F.concat_ws("|", "n", "t"))


def keys_d(three: DataFrame) -> DataFrame:
    """Pairs of the rarest address tokens."""
    bags = three.groupBy("id", "country").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    pairs = F.array(*(F.concat_ws(" ", F.get("ts", F.lit(i)), F.get("ts", F.lit(j))) for i, j in ((0, 1), (0, 2), (1, 2))))
    wanted = F.when(F.size("ts") == 3, pairs).when(F.size("ts") == 2, F.slice(pairs, 1, 1))
    return _key(bags.withColumn("k", F.explode(wanted)), "d", F.col("k"))


def keys_x(two: DataFrame, three: DataFrame) -> DataFrame:
    """The rarest name token with the rarest address token."""
    first = three.where("nth = 1").select("id", "t")
    return _key(two.join(first, "id"), "x", F.concat_ws("|", F.get("pair", F.lit(0)), "t"))


def keys_y(df: DataFrame, two: DataFrame) -> DataFrame:
    """One of the two rarest name tokens with one of the first two numbers."""
    return _key(two.select("id", "country", F.explode("pair").alias("t")).join(first_numbers(df), "id"), "y", F.concat_ws("|", "t", "n"))


def keys_e(two: DataFrame) -> DataFrame:
    """The two rarest name tokens of five letters or more, and each without one of its first twelve letters."""
    tokens = two.select("id", "country", F.explode("pair").alias("t")).where(F.length("t") >= 5)
    shorter = F.transform(F.sequence(F.lit(0), F.least(F.lit(11), F.length("t") - 1)), lambda k: F.concat(F.col("t").substr(F.lit(1), k), F.col("t").substr(k + 2, F.length("t"))))
    return _key(tokens.withColumn("k", F.explode(F.concat(F.array("t"), shorter))), "e", F.col("k"))


def record_keys(df: DataFrame, names: DataFrame, places: DataFrame, keep=lambda rows: rows) -> DataFrame:
    """All keys of a side, distinct. ``keep`` may write what several types of key start from to a table."""
    rare = keep(rarest(df, name_bag(df), names, 3))
    two, three = keep(two_rarest(rare)), keep(three_places(df, places))
    parts = [keys_t(rare), keys_b(two), keys_cps(df), keys_a(df, three), keys_d(three), keys_x(two, three), keys_y(df, two), keys_e(two)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def side_keys(a: DataFrame, b: DataFrame, keep=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    names, places = keep(document_frequency(a, b, name_bag)), keep(document_frequency(a, b, lambda x: F.col("addr_tok")))
    return record_keys(a, names, places, keep), record_keys(b, names, places, keep)
