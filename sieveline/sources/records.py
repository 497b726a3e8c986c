"""JSON-lines records: customer queries, candidates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = """
query_id string, subject_type string, query_name string,
query_attributes struct<year_of_birth: int, city: string, country: string, registration_country: string>,
is_true_match boolean, source_uid long, perturbation_type string, perturbation_note string, expected_outcome string,
raw_name_unchanged boolean, normalization_equivalent boolean, negative_kind string, collides_with_uid long, split string
"""
CANDIDATE = "struct<uid: long, score: double, entry_type: string, matched_name: string, name_kind: string, is_weak: boolean, generators: array<string>, ambiguous: boolean>"
CANDIDATES_SCHEMA = f"query_id string, candidates array<{CANDIDATE}>"


def read_queries(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Blank lines are skipped; absent keys are null."""
    df = spark.read.schema(QUERY_SCHEMA).json(path).where("query_id is not null")
    return df if split is None else df.where(F.col("split") == split)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATES_SCHEMA).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls left out, no escapes beyond JSON's own."""
    df.write.mode("overwrite").json(path)


def report_row(df: DataFrame, name: str) -> DataFrame:
    """A whole (small) report table as one JSON text: (report, body)."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("body")).select(F.lit(name).alias("report"), "body")
