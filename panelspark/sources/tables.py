"""Driver tables and the panels Spark derives from them.

Both panels have the shape of a published monthly panel. The *area* panel reads orders by
nation, segment and priority and travels through the text classifiers; the *supplier* panel reads
lineitem only and has as many series as there are suppliers, so it grows with the data. Each is one
partially aggregated group-by: a hot customer or supplier collapses to one row per month before the
shuffle, and from there on a series holds at most one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.config import PANEL_COLS, WORLD
from panelspark.functions import cells as C
from panelspark.functions import rules


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _level(month: Column, k: Column) -> Column:
    """Days since the epoch of a derived cell: mostly advancing, sometimes frozen, retreating or jumping."""
    months = (C.month_index(month) - 1975 * 12).cast("bigint")
    return (30 * (months - k % 12) - F.when(k % 97 == 0, 3300).otherwise(0)).cast("int")


def _raw_label(category: Column, k: Column) -> Column:
    """Two published spellings per category."""
    odd = k % 2 == 1
    return (
        F.when(category == "EB1", F.when(odd, "1st*").otherwise(" 1st"))
        .when(category == "EB2", F.when(odd, "2ND").otherwise("2nd"))
        .when(category == "EB4_RW", F.when(odd, "Certain Religiuos  Workers").otherwise("Certain Religious Workers"))
        .when(category == "F1", F.when(odd, "F1*").otherwise("1st"))
        .otherwise(F.when(odd, "2nd-A").otherwise("2A*"))
    )


def order_cells(spark: SparkSession, sf: str, by_priority: bool = False, by_region: bool = False) -> DataFrame:
    """Published cells per (area, segment, table, month): one partial aggregation over orders.

    ``by_priority`` keeps one cell per order priority, so a key has several competing cells;
    ``by_region`` takes the five regions as areas instead of the nations.
    """
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf, "nation")
    area = F.when(F.col("n_nationkey") == 0, WORLD).otherwise(F.lower("n_name"))
    if by_region:
        nation = nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        area = F.regexp_replace(F.lower("r_name"), " ", "_")
    keyed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            area.alias("country"),
            F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), "family")
            .otherwise("employment")
            .alias("block"),
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "EB1")
            .when(F.col("c_mktsegment") == "BUILDING", "EB2")
            .when(F.col("c_mktsegment") == "MACHINERY", "EB4_RW")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "F1")
            .otherwise("F2A")
            .alias("code"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "FAD").otherwise("DFF").alias("table"),
            F.trunc("o_orderdate", "month").alias("bulletin_date"),
            "o_orderpriority",
            "o_orderkey",
            "o_orderstatus",
        )
    )
    key = ["country", "block", "code", "table", "bulletin_date"]
    if by_priority:
        key.append("o_orderpriority")
    return keyed.groupBy(*key).agg(
        F.min("o_orderkey").alias("k"), F.max_by("o_orderstatus", "o_orderkey").alias("st")
    )


def published(cells: DataFrame, *extra: str) -> DataFrame:
    """Text cells as a publisher would print them: raw label and raw value."""
    k = F.col("k")
    date = F.date_add(C.epoch(), _level(F.col("bulletin_date"), k))
    raw = (
        F.when(F.col("st") != "P", F.upper(F.date_format(date, "ddMMMyy")))
        .when(k % 7 == 0, "U*")
        .when(k % 13 == 5, "NA")
        .otherwise("C")
    )
    return cells.select(
        "country",
        "block",
        _raw_label(F.col("code"), k).alias("raw_category"),
        "table",
        "bulletin_date",
        raw.alias("raw_value"),
        *extra,
    )


def annotate(cells: DataFrame, *extra: str) -> DataFrame:
    """Published text cells to panel rows: canonical category, regime, date, target."""
    labelled = cells.withColumn("category", rules.panel_category(F.col("block"), F.col("raw_category"))).filter(
        F.col("category").isNotNull()
    )
    return (
        labelled.withColumn("status", C.classify_status(F.col("raw_value")))
        .withColumn(
            "priority_date",
            F.when(F.col("status") == "F", C.parse_cell_date(F.col("raw_value"), F.col("bulletin_date"))),
        )
        .withColumn("days_since_base", C.days_since_base(F.col("status"), F.col("priority_date")))
        .select(*PANEL_COLS, *extra)
    )


def area_panel(spark: SparkSession, sf: str) -> DataFrame:
    return annotate(published(order_cells(spark, sf)))


def region_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The area panel with the five regions as areas: a dense panel over a fixed area domain."""
    return annotate(published(order_cells(spark, sf, by_region=True)))


REGIONS = ("africa", "america", "asia", "europe", "middle_east")


def rank_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Regional rank cells as text, one per region and month of orders."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    label = (
        F.when(F.col("r_name") == "AMERICA", "NORTH AMERICA (BAHAMAS)")
        .when(F.col("r_name") == "MIDDLE EAST", " Oceania")
        .otherwise(F.col("r_name"))
    )
    k = F.col("k")
    number = F.format_number(1000 + k % 90000, 0)
    raw = (
        F.when(k % 9 == 0, "Current")
        .when(k % 9 == 1, "Unavailable")
        .when(k % 9 == 2, "")
        .when(k % 9 == 3, F.concat(F.lit("AF  "), number, F.lit("  Except: Egypt 30,000")))
        .otherwise(number)
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", F.trunc("o_orderdate", "month").alias("bulletin_date"))
        .agg(F.min("o_orderkey").alias("k"))
        .select(
            label.alias("label"),
            "bulletin_date",
            raw.alias("raw_value"),
            F.when(k % 4 == 0, "Except: Egypt").when(k % 4 == 2, "Except: Nigeria").otherwise("").alias("exceptions"),
        )
    )


def rank_panel(spark: SparkSession, sf: str) -> DataFrame:
    return (
        rank_cells(spark, sf)
        .withColumn("region", rules.region_slug(F.col("label")))
        .withColumn("status", C.rank_status(F.col("raw_value")))
        .withColumn("rank_cutoff", C.rank_cutoff(F.col("raw_value")))
        .select("region", "bulletin_date", "status", "rank_cutoff", "raw_value", "exceptions")
    )


def supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    """One series per supplier, return flag and line status; lineitem is scanned once, without a join."""
    line = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", F.trunc("l_shipdate", "month").alias("bulletin_date"), "l_orderkey"
    )
    k = F.col("k")
    cells = line.groupBy("l_suppkey", "l_returnflag", "l_linestatus", "bulletin_date").agg(
        F.min("l_orderkey").alias("k")
    )
    days = _level(F.col("bulletin_date"), k)
    status = F.when(k % 35 == 0, "U").when(k % 5 == 0, "C").otherwise("F")
    date = F.date_add(C.epoch(), days)
    return (
        cells.withColumn("status", status)
        .select(
            F.when(F.col("l_suppkey") == 0, WORLD)
            .otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
            .alias("country"),
            F.when(F.col("l_returnflag") == "N", "family").otherwise("employment").alias("block"),
            F.when(F.col("l_returnflag") == "N", "F1")
            .when(F.col("l_returnflag") == "A", "EB1")
            .otherwise("EB2")
            .alias("category"),
            F.when(F.col("l_linestatus") == "F", "FAD").otherwise("DFF").alias("table"),
            "bulletin_date",
            "status",
            F.when(F.col("status") == "F", date).alias("priority_date"),
            F.when(F.col("status") == "F", days).alias("days_since_base"),
            F.when(F.col("status") == "F", F.upper(F.date_format(date, "ddMMMyy")))
            .otherwise(F.col("status"))
            .alias("raw_value"),
        )
    )


def observed(panel: DataFrame) -> DataFrame:
    """The only scorable rows: regime F, with the target as a double named ``y``."""
    return panel.filter(F.col("status") == "F").select(
        "country", "block", "category", "table", "bulletin_date", F.col("days_since_base").cast("double").alias("y")
    )
