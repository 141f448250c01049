"""Panel audit, reconciliation, guards, ingestion gate and artifact contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.config import BIG_JUMP_YEARS, DAYS_PER_YEAR, PANEL_COLS, PANEL_KEY, REGIMES, REGIME_RANK, SERIES
from panelspark.functions.cells import epoch, strip_footnotes
from panelspark.operators.aggregates import inventory, observed_step
from panelspark.operators.series import max_run
from panelspark.operators.setops import missing_months, union_blocks
from panelspark.operators.warehouse import ContractError

REQUIRED_COMBOS = (("employment", "FAD"), ("employment", "DFF"), ("family", "FAD"), ("family", "DFF"))
MIN_ROWS_NEW_MONTH = 90
MAX_LOST = 50


def regime_order(status: Column) -> Column:
    case = None
    for name, rank in REGIME_RANK.items():
        case = F.when(status == name, rank) if case is None else case.when(status == name, rank)
    return case.otherwise(len(REGIME_RANK))


def dedup_conflicts(cells: DataFrame) -> DataFrame:
    """Keys with two different published dates: a source conflict for a person to resolve."""
    dated = F.when(F.col("status") == "F", F.col("priority_date"))
    return (
        cells.groupBy(*PANEL_KEY)
        .agg(F.min(dated).alias("first_date"), F.max(dated).alias("last_date"))
        .filter(F.col("first_date") < F.col("last_date"))
    )


def dedup_regime(cells: DataFrame, strict: bool = False) -> DataFrame:
    """One cell per key, preferring F over C over U over UNK, as a partial minimum per key.

    ``strict`` raises when a key has two different dates; otherwise the earliest date stands.
    """
    if strict and not dedup_conflicts(cells).isEmpty():
        sample = dedup_conflicts(cells).limit(5).collect()
        raise ContractError(f"keys with two different dates: {[tuple(r) for r in sample]}")
    rest = [c for c in cells.columns if c not in PANEL_KEY]
    order = F.struct(regime_order(F.col("status")), F.col("priority_date"), F.col("raw_value"))
    best = F.min_by(F.struct(*rest), order)
    return cells.groupBy(*PANEL_KEY).agg(best.alias("_row")).select(*PANEL_KEY, "_row.*").select(*cells.columns)


def date_validity(panel: DataFrame) -> DataFrame:
    """Counts of implausible dates and of regime/raw/date disagreements: one pass, one row per check."""
    is_f, date, days = F.col("status") == "F", F.col("priority_date"), F.col("days_since_base")
    ceiling = panel.agg(F.max(F.year("bulletin_date"))).scalar()
    mark = strip_footnotes(F.upper(F.col("raw_value")))
    rules = {
        "negative_days": days < 0,
        "date_out_of_range": is_f & ((F.year(date) < F.year(epoch())) | (F.year(date) > ceiling)),
        "date_after_bulletin": is_f & (date > F.col("bulletin_date")),
        "c_raw_mismatch": (F.col("status") == "C") & (mark != "C"),
        "u_raw_mismatch": (F.col("status") == "U") & (mark != "U"),
        "status_domain": ~F.col("status").isin(*REGIMES),
        "f_without_date": is_f & (date.isNull() | days.isNull()),
        "date_off_regime": ~is_f & (date.isNotNull() | days.isNotNull()),
    }
    counted = panel.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])))


def pair_tables(panel: DataFrame) -> DataFrame:
    """Months where both tables publish a date, and how often DFF is behind FAD."""
    wide = (
        panel.filter(F.col("status") == "F")
        .groupBy("country", "block", "category", "bulletin_date")
        .agg(
            F.max(F.when(F.col("table") == "FAD", F.col("priority_date"))).alias("fad"),
            F.max(F.when(F.col("table") == "DFF", F.col("priority_date"))).alias("dff"),
        )
        .filter(F.col("fad").isNotNull() & F.col("dff").isNotNull())
    )
    return wide.withColumn("violation", F.col("dff") < F.col("fad"))


def reconcile(source: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows per regime in source and panel; more in the panel, or far fewer, is critical."""
    s = source.groupBy("status").agg(F.count(F.lit(1)).alias("n_source"))
    p = panel.groupBy("status").agg(F.count(F.lit(1)).alias("n_panel"))
    diff = F.col("n_source") - F.col("n_panel")
    return (
        s.join(p, "status", "full_outer")
        .na.fill(0, ["n_source", "n_panel"])
        .withColumn("diff", diff)
        .withColumn(
            "severity", F.when((diff < 0) | (diff > MAX_LOST), "CRIT").when(diff > 0, "INFO").otherwise("OK")
        )
    )


def cleaning_ledger(panel: DataFrame, n_source: DataFrame) -> DataFrame:
    """One row per build: sizes, rows per regime, collapsed duplicates, large jumps."""
    tagged = observed_step(panel).withColumn(
        "_first", F.row_number().over(Window.partitionBy(*SERIES).orderBy("bulletin_date")) == 1
    )
    limit = BIG_JUMP_YEARS * DAYS_PER_YEAR
    built = tagged.agg(
        F.date_format(F.max("bulletin_date"), "yyyy-MM").alias("vintage"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_first").alias("n_series"),
        *[F.count_if(F.col("status") == s).alias(f"rows_{s.lower()}") for s in REGIMES],
        F.count_if(F.abs("delta") > limit).alias("big_jumps_gt_8y"),
    ).withColumn("_k", F.lit(1))
    source = n_source.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    return built.join(source, "_k").withColumn("dup_collapsed", F.col("_n") - F.col("n_rows")).drop("_k", "_n")


def guards(cells: DataFrame, parsed_month: str = "bulletin_date") -> DataFrame:
    """Counts of rows that must stop a build: missing months, undated F rows, dates before the epoch, unknown tables."""
    is_f = F.col("status") == "F"
    rules = {
        "month_unparseable": F.col(parsed_month).isNull(),
        "f_date_unparseable": is_f & F.col("priority_date").isNull(),
        "epoch_underflow": is_f & (F.col("days_since_base") < 0),
        "unknown_table": F.col("table").isNull() | ~F.col("table").isin("FAD", "DFF"),
    }
    counted = cells.agg(
        *[F.count_if(c).alias(n) for n, c in rules.items()], F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("empty_source")
    )
    names = [*rules, "empty_source"]
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("guard"), F.col(n).alias("n")) for n in names])))


def newest_month_gaps(panel: DataFrame) -> DataFrame:
    """Areas without a row in the newest month: a live parser regression, unlike old gaps."""
    newest = panel.agg(F.max("bulletin_date")).scalar()
    return panel.groupBy("country").agg(F.max("bulletin_date").alias("last_month")).filter(F.col("last_month") < newest)


def run_guards(cells: DataFrame) -> None:
    bad = guards(cells).filter("n > 0").collect()
    if bad:
        raise ContractError("; ".join(f"{r['guard']} x{r['n']}" for r in bad))


def month_coverage(panel: DataFrame, min_rows: int = MIN_ROWS_NEW_MONTH) -> DataFrame:
    """Defects of the newest month: missing block and table combinations, too few rows. Empty means complete."""
    newest = panel.agg(F.max("bulletin_date")).scalar()
    combos = panel.filter(F.col("bulletin_date") == newest).groupBy("block", "table").agg(F.count(F.lit(1)).alias("_n"))
    required = panel.sparkSession.createDataFrame(list(REQUIRED_COMBOS), "block string, table string")
    missing = required.join(combos, ["block", "table"], "left_anti").select(
        F.lit("missing combination").alias("problem"), F.concat_ws("/", "block", "table").alias("detail")
    )
    total = F.coalesce(F.sum("_n"), F.lit(0))
    few = combos.agg(total.alias("_t")).filter(F.col("_t") < min_rows).select(
        F.lit("too few rows").alias("problem"), F.col("_t").cast("string").alias("detail")
    )
    return missing.unionByName(few)


def freshness(panel: DataFrame, source_months: DataFrame) -> DataFrame:
    """Whether the panel carries the newest source month."""
    p = panel.agg(F.max("bulletin_date").alias("panel_month")).withColumn("_k", F.lit(1))
    s = source_months.agg(F.max("bulletin_date").alias("source_month")).withColumn("_k", F.lit(1))
    return p.join(s, "_k").drop("_k").withColumn("stale", F.col("panel_month") < F.col("source_month"))


def check_contract(df: DataFrame, required: dict[str, str], vintage: str | None = None, expected: str | None = None) -> list[str]:
    """Problems of a frame against its contract: missing columns or nested paths, other types, another vintage.

    ``required`` maps a dotted path to a simple type name, ``*`` for any.
    """
    problems = []
    for path, kind in required.items():
        field: T.DataType | None = df.schema
        for part in path.split("."):
            if isinstance(field, T.ArrayType):
                field = field.elementType
            names = field.fieldNames() if isinstance(field, T.StructType) else []
            field = field[part].dataType if part in names else None
            if field is None:
                problems.append(f"missing path {path}")
                break
        else:
            if kind not in ("*", field.simpleString()):
                problems.append(f"{path} is {field.simpleString()}, not {kind}")
    if vintage and not problems:
        found = df.agg(F.max(vintage)).first()[0]
        if expected is not None and str(found)[:7] != expected[:7]:
            problems.append(f"vintage {found} is not {expected}")
    return problems


def audit(panel: DataFrame, source: DataFrame, dead_months: DataFrame | None = None) -> DataFrame:
    """All audit dimensions as (dimension, severity, message, n); the verdict is whether any CRIT exists."""
    lit = F.lit

    def finding(df: DataFrame, dim: str, severity: Column, message: Column) -> DataFrame:
        return df.select(lit(dim).alias("dimension"), severity.alias("severity"), message.alias("message"), F.col("n").cast("bigint").alias("n"))

    parts = []
    missing = [c for c in PANEL_COLS if c not in panel.columns]
    parts.append(
        panel.sparkSession.range(1).select(
            lit("schema").alias("dimension"),
            lit("CRIT" if missing else "OK").alias("severity"),
            lit("missing columns").alias("message"),
            lit(len(missing)).cast("bigint").alias("n"),
        )
    )
    gaps = missing_months(panel, [], dead_months).agg(F.count(lit(1)).alias("n"))
    parts.append(finding(gaps, "completeness", F.when(F.col("n") > 0, "CRIT").otherwise("OK"), lit("unexplained absent months")))
    inv = inventory(panel)
    parts.append(finding(inv.agg(F.count(lit(1)).alias("n")), "inventory", lit("OK"), lit("series")))
    unk = panel.agg(F.count_if(F.col("status") == "UNK").alias("n"))
    parts.append(finding(unk, "regimes", F.when(F.col("n") > 0, "WARN").otherwise("OK"), lit("unparsed cells")))
    dup = panel.groupBy(*PANEL_KEY).agg((F.count(lit(1)) - 1).alias("_d")).agg(F.coalesce(F.sum("_d"), lit(0)).alias("n"))
    parts.append(finding(dup, "keys", F.when(F.col("n") > 0, "CRIT").otherwise("OK"), lit("repeated keys")))
    rule = F.col("rule")
    level = (
        F.when(F.col("n") == 0, "OK")
        .when(rule == "date_after_bulletin", "WARN")
        .when(rule.isin("c_raw_mismatch", "u_raw_mismatch"), "INFO")
        .otherwise("CRIT")
    )
    parts.append(finding(date_validity(panel), "dates", level, rule))
    pairs = pair_tables(panel).agg(F.count_if("violation").alias("n"))
    parts.append(finding(pairs, "tables", F.when(F.col("n") > 0, "INFO").otherwise("OK"), lit("DFF behind FAD")))
    jumps = observed_step(panel).agg(F.count_if(F.abs(F.col("delta")) > BIG_JUMP_YEARS * DAYS_PER_YEAR).alias("n"))
    parts.append(finding(jumps, "jumps", F.when(F.col("n") > 0, "INFO").otherwise("OK"), lit("steps over 8 years")))
    rec = reconcile(source, panel).withColumn("n", F.col("diff"))
    parts.append(finding(rec, "reconciliation", F.col("severity"), F.col("status")))
    cover = panel.groupBy("country", "category").agg(F.countDistinct("table").alias("_t"))
    parts.append(finding(cover.agg(F.count_if(F.col("_t") < 2).alias("n")), "coverage", lit("OK"), lit("area and category pairs with one table")))
    runs = max_run(panel.filter(F.col("status") == "F"))
    parts.append(finding(runs.agg(F.count_if(F.col("max_run") >= 24).alias("n")), "trainability", lit("OK"), lit("series with 24 consecutive observed months")))
    return union_blocks(*parts)


def verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRIT", "WARN", "INFO")],
        F.when(F.count_if(F.col("severity") == "CRIT") > 0, "needs attention").otherwise("fit").alias("verdict"),
    )
