"""Readers and writers."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header, no quoting, all columns strings, missing ones empty."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("encoding", "UTF-8").csv(path).na.fill("")


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Tab-separated with a header and no quoting; ``files`` bounds how many files there are."""
    rows = df.coalesce(files) if files else df
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def source_path(folder: str, split: str, source: int) -> str:
    """S02."""
    return f"{folder}/{split}_source{source}.tsv"


def load_source(spark: SparkSession, folder: str, split: str, source: int) -> DataFrame:
    """S03."""
    return read_tsv(spark, source_path(folder, split, source), RECORD)


def load_truth(spark: SparkSession, folder: str) -> DataFrame:
    """S04, before the lists are split."""
    return read_tsv(spark, f"{folder}/train_ground_truth.tsv", TRUTH)


def save_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """A stage table, by country where that helps to prune."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table of any number of files; columns and conditions reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def load_with_extra(spark: SparkSession, path: str, extra: str, keys: list[str], where: str | None = None) -> DataFrame:
    """Rows of a table with the further columns of another one, of which only the rows that are wanted are read on; null where it has none."""
    rows = load_table(spark, path, where=where)
    more = load_table(spark, extra).join(rows.select(*keys).distinct(), keys, "left_semi")
    return rows.join(more, keys, "left")


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The schema only."""
    return spark.read.parquet(path).columns


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small map, in any store that Spark reaches."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model, path: str) -> None:
    """S14, S15."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_experiment(spark: SparkSession, path: str, title: str, notes: str, figures: dict) -> None:
    """A row for each run."""
    row = spark.createDataFrame([(title, notes, json.dumps(figures, sort_keys=True))], "title string, notes string, figures string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as one CSV file; reports are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def package(folder: str, out: str, suffixes: tuple[str, ...] = (".py", ".md", ".tsv")) -> list[str]:
    """The files of a folder as a zip; their names."""
    names = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.suffix in suffixes)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(Path(folder) / n, n)
    return names
