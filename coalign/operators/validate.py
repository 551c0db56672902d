"""Checks of result lists (S21): each rule is a table of offenders; nothing is collected but counts and examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"matching": ["source1_entity_id", "matched_entity_ids"], "candidate": ["source1_entity_id", "candidate_entity_ids"]}


def check_file(spark: SparkSession, path: str, header: list[str]) -> list[str]:
    """Errors of the form of a file: no lines, a header with other names or separators, rows without a tab."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return ["empty file"]
    if first[0].split("\t") != header:
        return ["header is separated by commas" if first[0].split(",") == header else f"header is {first[0]!r}"]
    bad = lines.where(~F.col("value").contains("\t")).count()
    return [f"{bad} rows without a tab"] if bad else []


def rules(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Offenders (entity_id) of each rule; ``lists`` has (source1_entity_id, ids), ``required`` and ``known`` have entity_id."""
    rows = lists.select(F.col("source1_entity_id").alias("entity_id"), F.filter(F.split("ids", ","), lambda x: x != "").alias("ids"))
    each = rows.select("entity_id", F.explode("ids").alias("m"))
    out = {
        "duplicate_row": rows.groupBy("entity_id").count().where("count > 1"),
        "duplicate_in_list": rows.where(F.size(F.array_distinct("ids")) != F.size("ids")),
        "self_match": each.where("m = entity_id"),
        "wrong_prefix": each.where(~F.col("m").rlike("^S[23]-")),
        "missing_row": required.join(rows, "entity_id", "left_anti"),
        "extra_row": rows.join(required, "entity_id", "left_anti"),
    }
    if known is not None:
        out["unknown_id"] = each.join(known.select(F.col("entity_id").alias("m")), "m", "left_anti")
    return {k: v.select("entity_id") for k, v in out.items()}


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning only: (entity_id, m) matches that aren't among the candidates."""
    flat = lambda d: d.select(F.col("source1_entity_id").alias("entity_id"), F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("m"))
    return flat(matches).join(flat(candidates), ["entity_id", "m"], "left_anti")


def findings(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, examples: int = 5) -> DataFrame:
    """(rule, offenders, examples) of all rules; a rule without offenders has a row with 0."""
    parts = []
    for name, rows in rules(lists, required, known).items():
        count = rows.agg(F.count(F.lit(1)).alias("offenders"))
        first = rows.distinct().orderBy("entity_id").limit(examples).agg(F.array_sort(F.collect_list("entity_id")).alias("examples"))
        parts.append(count.join(first, how="cross").select(F.lit(name).alias("rule"), "offenders", "examples"))
    return reduce(DataFrame.unionByName, parts)


def validate(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> bool:
    """Whether no rule has offenders."""
    return findings(lists, required, known).where("offenders > 0").isEmpty()
