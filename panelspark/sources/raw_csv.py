"""Typed CSV source of per-area raw cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.config import PANEL_COLS, WORLD
from panelspark.functions.cells import days_since_base
from panelspark.operators.audit import run_guards
from panelspark.operators.warehouse import ContractError

# File names, table codes, level domains.
FILE_NAME = r"([^/]+?)(_family)?_visa_backlog_timecourse\.csv"
TABLES = {"final_action": "FAD", "dates_for_filing": "DFF"}
EMPLOYMENT_LEVEL = r"^EB[1-5]"
FAMILY_LEVELS = ("1", "2A", "2B", "3", "4")
WORLD_SLUG = "row"
STATUSES = ("F", "C", "U", "UNK")

#: Holds a line that does not fit the columns.
CORRUPT = "_corrupt"
SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "level",
            "priority_date",
            "visa_bulletin_date",
            "table_type",
            "raw_value",
            "status",
            "visa_wait_time",
            "raw_category",
            CORRUPT,
        )
    ]
)


def read_raw(spark: SparkSession, folder: str, file_name: str = FILE_NAME) -> DataFrame:
    """Raw cells of every area file under ``folder``; text stays text, only an empty field is NULL.

    Area and block come from the file name (groups 1 and 2 of ``file_name``), so one scan reads all files. ``NA`` is data,
    never NULL. A line with too few or too many fields is in the column ``_corrupt``.
    """
    raw = (
        spark.read.schema(SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
        .csv(folder)
    )
    path = F.input_file_name()
    slug = F.regexp_extract(path, file_name, 1)
    family = F.regexp_extract(path, file_name, 2) != ""
    day = lambda c: F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    table = F.when(F.col("table_type") == "final_action", "FAD").when(F.col("table_type") == "dates_for_filing", "DFF")
    return raw.select(
        F.when(slug == WORLD_SLUG, WORLD).otherwise(slug).alias("country"),
        F.when(family, "family").otherwise("employment").alias("block"),
        "level",
        F.when(family, F.concat(F.lit("F"), F.col("level"))).otherwise(F.col("level")).alias("category"),
        table.alias("table"),
        day(F.col("visa_bulletin_date")).alias("bulletin_date"),
        "status",
        day(F.col("priority_date")).alias("priority_date"),
        "raw_value",
        "raw_category",
        CORRUPT,
    )


def bad_level() -> Column:
    """Whether a row's level is outside its block's domain."""
    bad = F.when(F.col("block") == "family", ~F.col("level").isin(*FAMILY_LEVELS)).otherwise(~F.col("level").rlike(EMPLOYMENT_LEVEL))
    return F.coalesce(bad, F.lit(True))


def with_reason(raw: DataFrame) -> DataFrame:
    """Adds ``reason``: why a row can't enter the panel, the first that applies; NULL for a sound row."""
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "fields")
        .when(F.col("country").isNull() | (F.col("country") == ""), "file name")
        .when(F.col("table").isNull(), "table type")
        .when(F.col("bulletin_date").isNull(), "bulletin month")
        .when(bad_level(), "level")
        .when(F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)), "status")
        .when((F.col("status") == "F") & F.col("priority_date").isNull(), "date missing")
    )
    return raw.withColumn("reason", reason)


def split_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with their reason: no row is lost between the two."""
    judged = with_reason(raw)
    return judged.filter(F.col("reason").isNull()).drop("reason", CORRUPT), judged.filter(F.col("reason").isNotNull())


def level_problems(raw: DataFrame) -> DataFrame:
    """Levels outside their block's domain."""
    return raw.filter(bad_level()).groupBy("country", "block", "level").agg(F.count(F.lit(1)).alias("n"))


def to_panel(raw: DataFrame, check: bool = True) -> DataFrame:
    """Raw cells to panel rows; with ``check`` any guard violation stops the build with its counts."""
    is_f = F.col("status") == "F"
    panel = raw.withColumn("days_since_base", days_since_base(F.col("status"), F.col("priority_date")))
    if check:
        sample = level_problems(raw).limit(5).collect()
        if sample:
            raise ContractError(f"level outside its domain: {[tuple(r) for r in sample]}")
        run_guards(panel)
    return panel.withColumn("priority_date", F.when(is_f, F.col("priority_date"))).select(*PANEL_COLS)
