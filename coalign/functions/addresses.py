"""Normalization of addresses: addr_comp, addr_tok, addr_num, addr and addr_empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V
from .fold import fold
from .names import among, literal_map, map_tokens, own_map, words


def clean_address(c: Column) -> Column:
    """Folded, lower case, without null markers, number ranges apart."""
    c = F.regexp_replace(F.lower(fold(c)), V.NULL_ADDRESS, " ")
    return F.regexp_replace(c, r"(\d)\s*-\s*(\d)", "$1 $2")


def component(c: Column, streets: Column) -> Column:
    """One comma part as tokens, abbreviated, without leading zeros and stop words, joined."""
    tokens = F.transform(map_tokens(words(c), streets), lambda t: F.regexp_replace(t, "^0+([0-9])", "$1"))
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~among(t, V.ADDRESS_STOP_WORDS)), " ")


def components(c: Column) -> Column:
    streets = literal_map(V.STREET_WORDS)
    return F.filter(F.transform(F.split(c, ","), lambda p: component(p, streets)), lambda p: p != "")


def numbers(c: Column) -> Column:
    """Digit runs without leading zeros, distinct in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+", ""))
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def normalize_addresses(df: DataFrame, address: str = "business_address", aliases: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Adds the address columns. A null address counts as empty.

    ``aliases`` has (country, component, canonical), a canonical one for each component
    of a country once; it is joined to the components by record, whose ``key`` must be
    its own, so no record carries more of it than it needs (A09, A14).
    """
    df = df.withColumn("_clean", clean_address(F.coalesce(F.col(address), F.lit(""))))
    df = df.withColumn("addr_comp", components(F.col("_clean")))
    if aliases is not None:
        token = lambda country, c: F.concat_ws("\u0001", country, c)
        by_country = aliases.select(token(F.coalesce("country", F.lit("")), F.col("component")).alias("token"), F.col("canonical").alias("target"))
        asked = F.transform("addr_comp", lambda c: token(F.coalesce("country", F.lit("")), c))
        df = df.join(own_map(df, key, asked, by_country), key, "left")
        mapped = F.transform("addr_comp", lambda c: F.coalesce(F.element_at("_map", token(F.coalesce("country", F.lit("")), c)), c))
        df = df.withColumn("addr_comp", F.when(F.col("_map").isNull(), F.col("addr_comp")).otherwise(mapped)).drop("_map")
    df = df.withColumn("addr_comp", F.array_distinct("addr_comp"))
    df = df.withColumns(
        {
            "addr_tok": F.array_distinct(F.filter(F.split(F.array_join("addr_comp", " "), " "), lambda t: t != "")),
            "addr_num": numbers(F.col("_clean")),
        }
    )
    return df.withColumns({"addr": F.array_join("addr_tok", " "), "addr_empty": F.size("addr_tok") == 0}).drop("_clean")
