"""Star schema: dimensions, keyed facts, lossless views, marts, derived timestamps, constraints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.config import PANEL_COLS, PANEL_KEY, WORLD
from panelspark.functions.cells import epoch, fiscal_year
from panelspark.functions.hashing import content_sha
from panelspark.operators.setops import month_domain, union_blocks
from panelspark.session import stage

# Category hierarchy (code, parent, preference level, subcategory, statutory basis).
CATEGORY_META = (
    ("F1", None, 1, False, "INA 203(a)(1)"),
    ("F2A", "F2", 2, True, "INA 203(a)(2)(A)"),
    ("F2B", "F2", 2, True, "INA 203(a)(2)(B)"),
    ("F3", None, 3, False, "INA 203(a)(3)"),
    ("F4", None, 4, False, "INA 203(a)(4)"),
    ("EB1", None, 1, False, "INA 203(b)(1)"),
    ("EB2", None, 2, False, "INA 203(b)(2)"),
    ("EB3", None, 3, False, "INA 203(b)(3)"),
    ("EB3_OW", "EB3", 3, True, "INA 203(b)(3)"),
    ("EB4", None, 4, False, "INA 203(b)(4)"),
    ("EB4_RW", "EB4", 4, True, "INA 203(b)(4)"),
    ("EB4_TRANS", "EB4", 4, True, "INA 203(b)(4)"),
    ("EB5", None, 5, False, "INA 203(b)(5)"),
    ("EB5_TEA", "EB5", 5, True, "INA 203(b)(5)"),
    ("EB5_PILOT", "EB5", 5, True, "INA 203(b)(5)"),
    ("EB5_RC", "EB5", 5, True, "INA 203(b)(5)"),
    ("EB5_NONRC", "EB5", 5, True, "INA 203(b)(5)"),
    ("EB5_UNRESERVED", "EB5", 5, True, "INA 203(b)(5)"),
    ("EB5_RURAL", "EB5", 5, True, "INA 203(b)(5)(B)(ii)"),
    ("EB5_HIGHUNEMP", "EB5", 5, True, "INA 203(b)(5)(B)(ii)"),
    ("EB5_INFRA", "EB5", 5, True, "INA 203(b)(5)(B)(ii)"),
)
# Display names.
AREA_NAMES = {
    "mexico": "México",
    "india": "India",
    "china": "China (mainland born)",
    "philippines": "Philippines",
    "all_chargeability": "All Chargeability Areas Except Those Listed",
}
TABLE_NAMES = {"FAD": "Final Action Dates", "DFF": "Dates for Filing"}
REGION_NAMES = {
    "africa": "Africa",
    "asia": "Asia",
    "europe": "Europe",
    "north_america": "North America (Bahamas)",
    "oceania": "Oceania",
    "south_america_caribbean": "South America and the Caribbean",
}
STATUS_ROWS = (("F", "Final", True), ("C", "Current", False), ("U", "Unavailable", False), ("UNK", "Unknown", False))


class ContractError(RuntimeError):
    """A data contract is violated; nothing is published."""


def _named(col: Column, names: Mapping[str, str]) -> Column:
    case = None
    for key, name in names.items():
        case = F.when(col == key, name) if case is None else case.when(col == key, name)
    return case.otherwise(col)


def small_ids(dim: DataFrame, id_name: str, *order: str) -> DataFrame:
    """Surrogate ids by rank of the natural key, for dimensions bounded by a code list or the calendar."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return dim.withColumn(id_name, F.row_number().over(w))


def ordered_ids(dim: DataFrame, id_name: str, *order: str) -> DataFrame:
    """The same ids for a dimension of any size: range partitions, local ranks, partition offsets.

    The range-partitioned frame is written once, so local ranks and offsets see the same boundaries.
    """
    ranged = dim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, id_name)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_rank", local)
        .join(offsets, "_part")
        .withColumn(id_name, (F.col("_rank") + F.col("_offset")).cast("int"))
        .drop("_part", "_rank", "_offset")
    )


def calendar_columns(months: DataFrame) -> DataFrame:
    d = F.col("bulletin_date")
    return months.select(
        "bulletin_date",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        fiscal_year(d).alias("us_fiscal_year"),
    )


def dim_area(panel: DataFrame) -> DataFrame:
    areas = panel.select(F.col("country").alias("slug")).distinct()
    return ordered_ids(areas, "area_id", "slug").select(
        "area_id",
        "slug",
        _named(F.col("slug"), AREA_NAMES).alias("name"),
        (F.col("slug") == WORLD).alias("is_residual_group"),
    )


def dim_category(panel: DataFrame) -> DataFrame:
    """Category codes with their hierarchy; an unseen code falls back to its first digit."""
    spark = panel.sparkSession
    meta = spark.createDataFrame(
        list(CATEGORY_META), "code string, _parent string, _level int, _sub boolean, _basis string"
    )
    codes = panel.select("block", F.col("category").alias("code")).distinct()
    digit = F.regexp_extract("code", r"\d", 0).try_cast("int")
    return small_ids(codes, "category_id", "block", "code").join(meta, "code", "left").select(
        "category_id",
        "block",
        "code",
        F.col("_parent").alias("parent_code"),
        F.coalesce("_level", digit, F.lit(1)).alias("preference_level"),
        F.coalesce(F.col("_sub"), F.col("code").contains("_")).alias("is_subcategory"),
        F.col("_basis").alias("ina_basis"),
    )


def dim_table(panel: DataFrame) -> DataFrame:
    codes = panel.select(F.col("table").alias("code")).distinct()
    return small_ids(codes, "table_id", "code").select(
        "table_id", "code", _named(F.col("code"), TABLE_NAMES).alias("name")
    )


def dim_date(*facts: DataFrame) -> DataFrame:
    return small_ids(calendar_columns(month_domain(*facts)), "date_id", "bulletin_date")


def dim_region(ranks: DataFrame) -> DataFrame:
    slugs = ranks.select(F.col("region").alias("slug")).distinct()
    return small_ids(slugs, "region_id", "slug").withColumn("name", _named(F.col("slug"), REGION_NAMES))


def dim_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUS_ROWS), "status string, label string, is_predictable boolean")


def dim_category_alias(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Alias bridge keyed to its category; timestamps are the first and last month observed."""
    from panelspark.operators.aggregates import alias_bridge

    keyed = alias_bridge(raw).join(categories.select("category_id", "block", "code"), ["block", "code"])
    return ordered_ids(keyed, "alias_id", "category_id", "raw_label").select(
        "alias_id", "category_id", "raw_label", "valid_from", "valid_to", "n_months",
        F.col("valid_from").alias("created_at"), F.col("valid_to").alias("updated_at"),
    )


def require_unique(dim: DataFrame, *key: str) -> None:
    """The right side of an m:1 join must not repeat its key."""
    twice = dim.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ContractError(f"repeated key {key}: {[tuple(r)[:-1] for r in twice]}")


@dataclass
class Star:
    """The warehouse as DataFrames, by table name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def build_dims(panel: DataFrame, ranks: DataFrame | None = None) -> Star:
    facts = [panel] if ranks is None else [panel, ranks]
    star = Star(
        {
            "dim_area": dim_area(panel),
            "dim_category": dim_category(panel),
            "dim_table": dim_table(panel),
            "dim_date": dim_date(*facts),
            "dim_status": dim_status(panel.sparkSession),
        }
    )
    if ranks is not None:
        star.tables["dim_region"] = dim_region(ranks)
    return star


def key_facts(panel: DataFrame, star: Star, check: bool = True) -> DataFrame:
    """Natural keys to surrogate keys, m:1 on every dimension.

    Category, table and date are bounded by code lists and the calendar and are broadcast; the area
    dimension has no such bound, so the planner decides from its size.
    """
    if check:
        require_unique(star["dim_area"], "slug")
        require_unique(star["dim_category"], "block", "code")
        require_unique(star["dim_date"], "bulletin_date")
    extra = [c for c in panel.columns if c not in PANEL_COLS]
    category = star["dim_category"].select("category_id", "block", F.col("code").alias("category"))
    table = star["dim_table"].select("table_id", F.col("code").alias("table"))
    date = star["dim_date"].select("date_id", "bulletin_date")
    return (
        panel.join(star["dim_area"].select("area_id", F.col("slug").alias("country")), "country")
        .join(F.broadcast(category), ["block", "category"])
        .join(F.broadcast(table), "table")
        .join(F.broadcast(date), "bulletin_date")
        .select(
            "area_id", "category_id", "table_id", "date_id", "status", "priority_date", "days_since_base", "raw_value",
            *extra,
        )
    )


def key_ranks(ranks: DataFrame, star: Star) -> DataFrame:
    return (
        ranks.join(star["dim_region"].select("region_id", F.col("slug").alias("region")), "region")
        .join(star["dim_date"].select("date_id", "bulletin_date"), "bulletin_date")
        .select("region_id", "date_id", "status", "rank_cutoff", "raw_value", "exceptions")
    )


def _joined(fact: DataFrame, star: Star) -> DataFrame:
    category = star["dim_category"].select("category_id", "block", F.col("code").alias("category"), "preference_level")
    return (
        fact.join(star["dim_area"].select("area_id", F.col("slug").alias("country")), "area_id")
        .join(F.broadcast(category), "category_id")
        .join(F.broadcast(star["dim_table"].select("table_id", F.col("code").alias("table"))), "table_id")
        .join(F.broadcast(star["dim_date"]), "date_id")
    )


def panel_view(fact: DataFrame, star: Star) -> DataFrame:
    """The tidy panel, rebuilt without loss."""
    return _joined(fact, star).select(*PANEL_COLS)


def rank_view(fact: DataFrame, star: Star) -> DataFrame:
    return (
        fact.join(star["dim_region"].select("region_id", F.col("slug").alias("region")), "region_id")
        .join(star["dim_date"].select("date_id", "bulletin_date"), "date_id")
        .select("region", "bulletin_date", "status", "rank_cutoff", "raw_value", "exceptions")
    )


def training_mart(fact: DataFrame, star: Star) -> DataFrame:
    """Observed rows only; the regime filter sits on the fact so that it reaches its scan."""
    return _joined(fact.filter(F.col("status") == "F"), star).select(
        *PANEL_KEY, "year", "month", "quarter", "preference_level", "priority_date", "days_since_base"
    )


def rollup_preference(fact: DataFrame, categories: DataFrame) -> DataFrame:
    """Observed rows per block and preference level."""
    per_category = fact.filter(F.col("status") == "F").groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_category.join(categories, "category_id")
        .groupBy("block", "preference_level")
        .agg(F.sum("_n").alias("n_obs"))
    )


def rollup_levels(fact: DataFrame, categories: DataFrame) -> DataFrame:
    """Block, preference level and code subtotals with a grand total; ``depth`` tells them apart."""
    per_category = fact.filter(F.col("status") == "F").groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_category.join(categories, "category_id")
        .rollup("block", "preference_level", "code")
        .agg(F.sum("_n").alias("n_obs"), F.grouping_id().alias("depth"))
    )


def fact_sha(panel: DataFrame) -> DataFrame:
    c = F.col
    return panel.withColumn(
        "content_sha", content_sha(c("status"), c("priority_date"), c("days_since_base"), c("raw_value"))
    )


def carry_forward(new: DataFrame, prev: DataFrame | None, key: list[str], ceiling: Column) -> DataFrame:
    """``created_at`` and ``updated_at`` derived from the data, never from a clock.

    ``prev`` holds key, ``content_sha`` and ``updated_at``. Unchanged content keeps its date, changed
    content takes ``ceiling`` (the newest month of this build), and no row is older than its month.
    """
    created = F.col("bulletin_date")
    if prev is None:
        return new.withColumns({"created_at": created, "updated_at": created})
    old = prev.select(*key, F.col("content_sha").alias("_sha"), F.col("updated_at").alias("_upd"))
    updated = (
        F.when(F.col("_sha").isNull(), created)
        .when(F.col("_sha") == F.col("content_sha"), F.col("_upd"))
        .otherwise(ceiling)
    )
    return (
        new.join(old, key, "left")
        .withColumn("created_at", created)
        .withColumn("updated_at", F.greatest(updated, created))
        .drop("_sha", "_upd")
    )


@dataclass(frozen=True)
class Contract:
    """Declared constraints of one table.

    ``checks`` maps a rule name to the condition every row must satisfy (NULL passes, as in SQL);
    ``keys`` maps a rule name to a unique column list; ``references`` maps a rule name to
    (column, dimension, dimension column).
    """

    checks: Mapping[str, Column] = field(default_factory=dict)
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    references: Mapping[str, tuple[str, DataFrame, str]] = field(default_factory=dict)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Violations per rule: (rule, kind, n). All row checks share a single pass over the table."""
    parts = []
    if contract.checks:
        counted = df.agg(*[F.count_if(~cond).alias(name) for name, cond in contract.checks.items()])
        rows = F.array(
            *[F.struct(F.lit(n).alias("rule"), F.lit("check").alias("kind"), F.col(n).alias("n")) for n in contract.checks]
        )
        parts.append(counted.select(F.inline(rows)))
    for name, cols in contract.keys.items():
        groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")
        parts.append(groups.agg(extra.alias("n")).select(F.lit(name).alias("rule"), F.lit("unique").alias("kind"), "n"))
    for name, (col, dim, dim_col) in contract.references.items():
        used = df.groupBy(F.col(col).alias("_ref")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_ref").isNotNull())
        lost = used.join(dim.select(F.col(dim_col).alias("_ref")), "_ref", "left_anti")
        extra = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
        parts.append(lost.agg(extra.alias("n")).select(F.lit(name).alias("rule"), F.lit("reference").alias("kind"), "n"))
    return union_blocks(*parts)


def enforce(df: DataFrame, contract: Contract, label: str) -> None:
    bad = validate(df, contract).filter("n > 0").collect()
    if bad:
        raise ContractError(f"{label}: " + "; ".join(f"{r['rule']} x{r['n']}" for r in bad))


def priority_checks() -> dict[str, Column]:
    """Row checks of the priority fact, or of a panel with the same columns."""
    is_f = F.col("status") == "F"
    days, date = F.col("days_since_base"), F.col("priority_date")
    return {
        "status_domain": F.col("status").isin("C", "F", "U", "UNK"),
        "days_iff_f": is_f == days.isNotNull(),
        "pdate_iff_f": is_f == date.isNotNull(),
        "days_not_negative": days >= 0,
        "days_is_datediff": days == F.datediff(date, epoch()),
    }


def priority_contract(star: Star) -> Contract:
    return Contract(
        checks=priority_checks(),
        keys={"priority_key": ("area_id", "category_id", "table_id", "date_id")},
        references={
            "area_fk": ("area_id", star["dim_area"], "area_id"),
            "category_fk": ("category_id", star["dim_category"], "category_id"),
            "table_fk": ("table_id", star["dim_table"], "table_id"),
            "date_fk": ("date_id", star["dim_date"], "date_id"),
            "status_fk": ("status", star["dim_status"], "status"),
        },
    )


def rank_contract(star: Star) -> Contract:
    return Contract(
        checks={
            "rank_iff_f": (F.col("status") == "F") == F.col("rank_cutoff").isNotNull(),
            "rank_not_negative": F.col("rank_cutoff") >= 0,
        },
        keys={"rank_key": ("region_id", "date_id")},
        references={
            "region_fk": ("region_id", star["dim_region"], "region_id"),
            "rank_date_fk": ("date_id", star["dim_date"], "date_id"),
        },
    )


def category_contract() -> Contract:
    return Contract(
        checks={
            "block_domain": F.col("block").isin("employment", "family"),
            "preference_range": F.col("preference_level").between(1, 5),
        },
        keys={"category_natural_key": ("block", "code")},
    )


def date_contract() -> Contract:
    return Contract(
        checks={"month_range": F.col("month").between(1, 12), "quarter_range": F.col("quarter").between(1, 4)},
        keys={"bulletin_date_unique": ("bulletin_date",)},
    )


def alias_contract(categories: DataFrame) -> Contract:
    span = F.months_between(F.trunc("valid_to", "month"), F.trunc("valid_from", "month")) + 1
    return Contract(
        checks={
            "valid_order": F.col("valid_from") <= F.col("valid_to"),
            "months_positive": F.col("n_months") > 0,
            "months_within_span": F.col("n_months") <= span,
        },
        keys={"alias_natural_key": ("category_id", "raw_label")},
        references={"alias_category_fk": ("category_id", categories, "category_id")},
    )


def record_contract() -> Contract:
    return Contract(
        checks={
            "pct_range": F.col("pct_trainable").between(0, 1),
            "build_status_domain": F.col("build_status").isin("ok", "degraded"),
            "degraded_iff_reasons": (F.col("build_status") == "degraded") == F.col("degradations").isNotNull(),
        }
    )


def build_record(panel: DataFrame, ranks: DataFrame | None, degradations: list[str]) -> DataFrame:
    """The audit row of a build: counts, trainable share, month range, status with its reasons."""
    p = panel.agg(
        F.count(F.lit(1)).alias("n_fact_priority"),
        F.count_if(F.col("status") == "F").alias("n_trainable_f"),
        F.min("bulletin_date").alias("_lo"),
        F.max("bulletin_date").alias("_hi"),
    ).withColumn("_k", F.lit(1))
    if ranks is None:
        r = panel.sparkSession.range(1).select(
            F.lit(0).cast("bigint").alias("n_fact_dv"),
            F.lit(None).cast("date").alias("_rlo"),
            F.lit(None).cast("date").alias("_rhi"),
            F.lit(1).alias("_k"),
        )
    else:
        r = ranks.agg(
            F.count(F.lit(1)).alias("n_fact_dv"),
            F.min("bulletin_date").alias("_rlo"),
            F.max("bulletin_date").alias("_rhi"),
        ).withColumn("_k", F.lit(1))
    reasons = F.lit(", ".join(degradations) if degradations else None).cast("string")
    return p.join(r, "_k").select(
        F.lit(1).alias("run_id"),
        "n_fact_priority",
        "n_fact_dv",
        "n_trainable_f",
        F.coalesce(F.col("n_trainable_f") / F.nullif(F.col("n_fact_priority"), F.lit(0)), F.lit(0.0)).alias("pct_trainable"),
        F.least("_lo", "_rlo").alias("panel_floor"),
        F.greatest("_hi", "_rhi").alias("panel_ceiling"),
        F.lit("degraded" if degradations else "ok").alias("build_status"),
        reasons.alias("degradations"),
    )


def build_warehouse(
    panel: DataFrame,
    ranks: DataFrame | None = None,
    raw: DataFrame | None = None,
    sources: DataFrame | None = None,
    prev: DataFrame | None = None,
    allow_degraded: bool = False,
) -> Star:
    """Dimensions, keyed and dated facts and the build record, checked against their contracts.

    Missing rank or label input is an error unless ``allow_degraded``; missing sources only degrade.
    Any violation raises before anything is written.
    """
    degradations = []
    if ranks is None:
        degradations.append("dv_missing")
    if raw is None:
        degradations.append("alias_lineage_missing")
    if degradations and not allow_degraded:
        raise ContractError(f"missing inputs: {', '.join(degradations)}")
    if sources is None:
        degradations.append("source_lineage_missing")
    # Inputs and the keyed fact are read by dimensions, views and every contract: written once.
    panel = stage(panel, "panel")
    ranks = None if ranks is None else stage(ranks, "ranks")
    raw = None if raw is None else stage(raw, "raw")
    star = build_dims(panel, ranks)
    star.tables = {name: stage(df, name) for name, df in star.tables.items()}
    ceiling = star["dim_date"].agg(F.max("bulletin_date")).scalar()
    dated = carry_forward(fact_sha(panel), prev, PANEL_KEY, ceiling).drop("content_sha").withColumn("etl_run_id", F.lit(1))
    star.tables["fact_priority"] = stage(key_facts(dated, star), "fact-priority")
    enforce(star["fact_priority"], priority_contract(star), "fact_priority")
    enforce(star["dim_category"], category_contract(), "dim_category")
    enforce(star["dim_date"], date_contract(), "dim_date")
    if ranks is not None:
        star.tables["fact_dv_rank"] = key_ranks(ranks, star)
        enforce(star["fact_dv_rank"], rank_contract(star), "fact_dv_rank")
    if raw is not None:
        star.tables["dim_category_alias"] = dim_category_alias(raw, star["dim_category"])
        enforce(star["dim_category_alias"], alias_contract(star["dim_category"]), "dim_category_alias")
    if sources is not None:
        star.tables["source_artifact"] = sources
    star.tables["etl_run"] = build_record(panel, ranks, degradations)
    return star
