"""A training corpus from raw documents: quality rules, exact and near deduplication, mixing, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir), and what
it returns is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coalign.llm import dart_minhash, exact_dedup, mixing, packing, quality
from coalign.llm.common import WORD, cut, doc_key
from coalign.llm.queries import tokenizer_path

#: Neither the learned quality references nor similarity classes can be written in SQL.
ORACLE_SQL = None


def _names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of a stage's own that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"__{w}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for w in wanted]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a null or empty text has too few words, and goes. Repeated rows fare alike."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; of repeated rows of it one row.

    Null, empty and blank texts are equal. A document without an id stays only where
    its text is in none that has one; of several without an id one row stays.
    """
    key, text = _names(docs, "key", "text_key")
    kept = exact_dedup.exact_dedup(docs).where("kept").select(doc_key("doc_id").alias(key), F.col("text_sha256").alias(text))
    rows = docs.withColumns({key: doc_key("doc_id"), text: exact_dedup.text_digest(F.col("text"))})
    return rows.join(kept, [key, text], "left_semi").dropDuplicates([key, text]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near each other, directly or through others, the one with the smallest id stays.

    Null, empty and blank texts are near nothing and stay; a document without an id
    comes after all others. Repeated rows of the document that stays all stay.
    """
    key, text = _names(docs, "key", "text_key")
    kept = dart_minhash.near_duplicates(docs).where("kept").select(doc_key("doc_id").alias(key), F.col("text_key").alias(text))
    return docs.withColumns({key: doc_key("doc_id"), text: F.xxhash64(F.coalesce("text", F.lit("")))}).join(kept, [key, text], "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole epoch.

    Of the document at a source's cut a last row has the words that are still taken,
    joined by one blank, and their number of characters. What the mix doesn't take goes,
    and so do texts without words, null ones among them. A null source is a source.
    Repeated rows, and rows without an id that share a text, are each taken as often as
    the one of them that the mix takes most.
    """
    key, text, taken, size, copy = _names(docs, "key", "text_key", "taken", "size", "copy")
    mixed = mixing.mix_sources(docs).where("taken > 0").groupBy(doc_key("doc_id").alias(key), F.col("text_key").alias(text)).agg(F.max("taken").alias(taken), F.max("size").alias(size))
    rows = docs.withColumns({key: doc_key("doc_id"), text: F.xxhash64(F.coalesce("text", F.lit("")))}).join(mixed, [key, text])
    whole, part = F.floor(F.col(taken) / F.col(size)).cast("int"), F.pmod(taken, F.col(size)).cast("int")
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(part, F.lit(1))), " ")
    texts = F.concat(F.array_repeat("text", whole), F.when(part > 0, F.array(cut_text)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(copy, F.explode(texts)).withColumn("n_chars", F.when(F.col(copy) == F.col("text"), F.col("n_chars")).otherwise(F.char_length(copy).cast("long")))
    return rows.withColumn("text", F.col(copy)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; a null or empty text is its end alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix_sources", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
