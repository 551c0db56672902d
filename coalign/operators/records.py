"""Registers of records and the truth about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coalign.functions.addresses import normalize_addresses
from coalign.functions.names import normalize_names


def normalize(df: DataFrame, transliterated: DataFrame | None = None, aliases: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Name and address columns of raw records (``key``, business_name, business_address, country)."""
    return normalize_addresses(normalize_names(df, transliterated=transliterated, key=key), aliases=aliases, key=key)


def prepare(sources: dict[int, DataFrame], **maps) -> tuple[DataFrame, DataFrame]:
    """A, the first source, and B, the others, normalized and tagged with ``src``. The entity id is the key, so order never matters."""
    tagged = {s: normalize(df.na.fill(""), **maps, key="entity_id").withColumn("src", F.lit(s)) for s, df in sources.items()}
    b = None
    for s, df in tagged.items():
        if s != 1:
            b = df if b is None else b.unionByName(df)
    return tagged[1], b


def explode_truth(lists: DataFrame) -> DataFrame:
    """(s1_id, m_id) from comma lists, empty ones left out."""
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("m_id")).where("m_id <> ''")


def positive_pairs(truth: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Truth with the columns of both records, as a_ and b_ columns."""
    left = a.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in a.columns if c != "entity_id"))
    right = b.select(F.col("entity_id").alias("m_id"), *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "entity_id"))
    return truth.join(left, "s1_id").join(right, "m_id")
