"""Screener CSV export and review-decision files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt

DECISION_SHAPE = "kind string, id string, action string, note string, fields map<string,string>"


def export_columns(rows: DataFrame) -> DataFrame:
    """The eleven text columns of the screener export."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = lambda c, digits: F.when(F.col(c).isNotNull(), fmt.number(c, digits)).otherwise(F.lit(""))
    return rows.select(
        F.col("name").alias("project"), blank("company_name").alias("company"), blank("country").alias("country"), blank("stage").alias("stage"),
        F.coalesce(F.array_join("commodities", "|"), F.lit("")).alias("commodities"), blank("resource_category").alias("category"),
        fmt.tonnes("tonnes").alias("tonnes"), fmt.grade("grade").alias("grade"), blank("study_type").alias("study"),
        shown("irr_pct", 2).alias("irr_pct"), shown("capex_initial", 0).alias("capex"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Doubled quotes inside quoted fields, header on each file."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", "").csv(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions, one JSON object a line; blank lines are no decisions.

    ``seq`` orders them by file name and then as they stand in the file, however Spark deals files and their parts to tasks.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(DECISION_SHAPE).json(path).withColumn("seq", place).filter(F.col("id").isNotNull())


def write_to_read(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
