"""Sources and sinks exercised over the derived panel: rendered pages, CSV files, a published warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY, WORLD
from panelspark.functions.cells import norm_label
from panelspark.functions.rules import panel_category
from panelspark.operators import warehouse as W
from panelspark.operators.audit import check_contract
from panelspark.operators.setops import union_blocks
from panelspark.plans.ctes import sql
from panelspark.plans.registry import query
from panelspark.session import shared_dir, stage
from panelspark.sources import raw_csv as RC
from panelspark.sources import sinks
from panelspark.sources import snapshots as SN
from panelspark.sources.files import write_files
from panelspark.sources.tables import annotate, area_panel, order_cells, published, rank_cells, rank_panel, table

KEY5 = 'country, block, category, "table", bulletin_date'
TITLES = {"employment": "Employment-based", "family": "Family-Sponsored"}


def rendered_pages(spark, sf):
    """HTML page parts per month: a table per table type, one row label, one column per area that has a cell.

    A part holds one cell per area, so its size is set by the area dimension of the derived panel.
    """
    cells = published(order_cells(spark, sf), "code")
    part = ["bulletin_date", "block", "code", "raw_category"]
    rows = cells.groupBy(*part, "table").agg(F.sort_array(F.collect_list(F.struct("country", "raw_value"))).alias("_cells"))
    heads = F.concat_ws("", F.transform("_cells", lambda c: F.concat(F.lit("<th>"), c["country"], F.lit("</th>"))))
    values = F.concat_ws("", F.transform("_cells", lambda c: F.concat(F.lit("<td> "), c["raw_value"], F.lit("\n</td>"))))
    title = F.when(F.col("block") == "family", TITLES["family"]).otherwise(TITLES["employment"])
    heading = F.when(F.col("table") == "FAD", "A. FINAL ACTION DATES").otherwise("B. DATES FOR FILING")
    table = F.concat(
        F.lit("<p>"), heading, F.lit("</p><table><tr><td>title</td></tr><tr><th>"), title, F.lit("</th>"), heads,
        F.lit("</tr><tr><td>"), F.col("raw_category"), F.lit("</td>"), values, F.lit("</tr></table>"),
    )
    parts = rows.select(*part, F.struct("table", table.alias("html")).alias("_t"))
    pages = parts.groupBy(*part).agg(F.sort_array(F.collect_list("_t"), asc=False).alias("_ts"))
    body = F.array_join(F.transform("_ts", lambda t: t["html"]), "")
    return pages.select(
        F.col("bulletin_date").alias("month"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("content"), "block"
    )


@query(
    "page_cells",
    "S2",
    sql(f"SELECT {KEY5}, status, priority_date FROM panel", "panel"),
)
def _pages(spark, sf):
    pages = rendered_pages(spark, sf)
    parts = []
    for block in ("employment", "family"):
        cells = SN.extract_cells(pages.filter(F.col("block") == block), block)
        parts.append(SN.area_cells(cells, block, norm_label(F.col("header"))))
    return annotate(parts[0].unionByName(parts[1])).select(*PANEL_KEY, "status", "priority_date")


def rendered_ranks(spark, sf):
    """Rank pages: a table in most months, the single-cell layout in January."""
    cells = rank_cells(spark, sf).withColumn("_code", F.upper(F.substring(F.trim("label"), 1, 2)))
    code = F.when(F.col("_code") == "NO", "NA").otherwise(F.col("_code"))
    row = F.concat(
        F.lit("<tr><td>"), F.col("label"), F.lit("</td><td>"), code, F.lit("</td><td>"), F.col("raw_value"), F.lit("</td><td>"),
        F.col("exceptions"), F.lit("</td></tr>"),
    )
    digits = F.regexp_extract("raw_value", r"\d[\d,]*", 0)
    word = F.when(F.col("raw_value") == "Current", "CURRENT").when(digits != "", digits).otherwise("U")
    blob = F.concat_ws(" ", F.concat(F.upper(F.trim("label")), F.lit(":")), code, word)
    pages = cells.select("bulletin_date", F.struct("label", row.alias("row"), blob.alias("blob")).alias("_r")).groupBy("bulletin_date").agg(
        F.sort_array(F.collect_list("_r")).alias("_rs")
    )
    table = F.concat(
        F.lit("<table><tr><th>Region</th><th></th><th>All DV Chargeability Areas</th><th>Notes</th></tr>"),
        F.array_join(F.transform("_rs", lambda r: r["row"]), ""), F.lit("</table>"),
    )
    single = F.concat(F.lit("<table><tr><td>"), F.array_join(F.transform("_rs", lambda r: r["blob"]), " "), F.lit("</td></tr></table>"))
    return pages.select(
        F.col("bulletin_date").alias("month"), F.when(F.month("bulletin_date") == 1, single).otherwise(table).alias("content")
    )


@query(
    "page_ranks",
    "S3",
    sql(
        """WITH b AS (SELECT *, CASE WHEN status = 'C' THEN 'CURRENT' WHEN status = 'F' THEN regexp_extract(raw_value, '[0-9][0-9,]*', 0) ELSE 'U' END AS w FROM ranks)
           SELECT region, bulletin_date AS month, status, CAST(rank_cutoff AS DOUBLE) AS rank_cutoff, raw_value, exceptions FROM ranks WHERE month(bulletin_date) <> 1
           UNION ALL SELECT region, bulletin_date, CASE WHEN status = 'UNK' THEN 'U' ELSE status END, CAST(rank_cutoff AS DOUBLE), w, '' FROM b
           WHERE month(bulletin_date) = 1""",
        "ranks",
    ),
)
def _page_ranks(spark, sf):
    return SN.rank_rows(rendered_ranks(spark, sf)).withColumn("rank_cutoff", F.col("rank_cutoff").cast("double"))


def month_files(spark, sf):
    """Whole snapshots as files: name and page of each month."""
    pages = rendered_pages(spark, sf).groupBy("month").agg(F.array_join(F.array_sort(F.collect_list("content")), "").alias("content"))
    name = F.concat(F.lit("visa-bulletin-for-"), F.lower(F.date_format("month", "MMMM")), F.lit("-"), F.date_format("month", "yyyy"), F.lit(".html"))
    return stage(pages.select("month", name.alias("name"), "content"), "month-pages")


@query(
    "snapshot_months",
    "S1",
    sql(
        """SELECT bulletin_date AS m, 1 AS n_files, 1 AS n_pages FROM panel GROUP BY bulletin_date
           UNION ALL SELECT NULL, count(DISTINCT bulletin_date), 1 FROM panel WHERE month(bulletin_date) = 1""",
        "panel",
    ),
)
def _months(spark, sf):
    """A folder of snapshot files, some with names that stand for no month, scanned again."""
    folder, pages = shared_dir(spark, "snapshots"), month_files(spark, sf)
    odd = pages.filter(F.month("month") == 1).select(F.concat(F.lit("announcement-"), "name").alias("name"), F.lit("<html></html>").alias("content"))
    odd = odd.withColumn("name", F.regexp_replace("name", "visa-bulletin-for", "notice"))
    write_files(pages.select("name", "content").unionByName(odd), folder)
    found = SN.read_snapshots(spark, folder)
    return found.groupBy(F.col("month").alias("m")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("sha256").alias("n_pages"))


@query(
    "csv_quarantine",
    "S4",
    sql(
        """WITH r AS (SELECT *, bulletin_date AS m, CASE WHEN month(bulletin_date) = 2 THEN 'fields' WHEN month(bulletin_date) = 3 THEN 'level'
                  WHEN month(bulletin_date) = 4 THEN 'table type' WHEN month(bulletin_date) = 5 THEN 'bulletin month' WHEN month(bulletin_date) = 6 THEN 'status'
                  WHEN month(bulletin_date) = 7 AND status = 'F' THEN 'date missing' END AS reason FROM panel)
           SELECT country, block, coalesce(reason, 'sound') AS reason, count(*) AS n, count(CASE WHEN reason IS NULL THEN days_since_base END) AS n_dates,
             CAST(sum(CASE WHEN reason IS NULL THEN days_since_base END) AS BIGINT) AS days FROM r GROUP BY ALL""",
        "panel",
    ),
)
def _quarantine(spark, sf):
    """Area files with sound lines and lines that are broken in a way that depends on their month; both sides of the split."""
    cells, month = area_panel(spark, sf), F.month("bulletin_date")
    level = F.when(month == 3, "X9").when(F.col("block") == "family", F.lit("1")).otherwise(F.lit("EB1"))
    table = F.when(month == 4, "other").when(F.col("table") == "FAD", "final_action").otherwise("dates_for_filing")
    fields = [
        level, F.when(month != 7, F.col("priority_date").cast("string")), F.when(month == 5, "19xx-05-01").otherwise(F.col("bulletin_date").cast("string")), table, F.col("raw_value"),
        F.when(month == 6, "?").otherwise(F.col("status")), F.lit("1.5"), F.regexp_replace("category", ",", " "),
    ]
    line = F.concat(F.array_join(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), ","), F.when(month == 2, ",one,more").otherwise(""))
    slug = F.when(F.col("country") == WORLD, RC.WORLD_SLUG).otherwise(F.col("country"))
    rows = cells.select(slug.alias("slug"), "block", line.alias("line"))
    files = rows.groupBy("slug", "block").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    head = ",".join(f.name for f in RC.SCHEMA if f.name != RC.CORRUPT)
    name = F.concat("slug", F.when(F.col("block") == "family", "_family").otherwise(""), F.lit("_visa_backlog_timecourse.csv"))
    folder = shared_dir(spark, "area-files")
    write_files(files.select(name.alias("name"), F.concat(F.lit(head + "\n"), "lines", F.lit("\n")).alias("content")), folder)
    sound, bad = RC.split_rows(RC.read_raw(spark, folder))
    good = RC.to_panel(sound).select("country", "block", F.lit("sound").alias("reason"), "days_since_base")
    both = good.unionByName(bad.select("country", "block", "reason", F.lit(None).cast("int").alias("days_since_base")))
    return both.groupBy("country", "block", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("days_since_base").alias("n_dates"), F.sum("days_since_base").cast("bigint").alias("days")
    )


@query(
    "csv_round_trip",
    "S4 S6",
    sql(f"SELECT {KEY5}, status, priority_date, raw_value FROM panel", "panel"),
)
def _csv(spark, sf):
    path = shared_dir(spark, "csv-cells")
    sinks.write_csv_dir(area_panel(spark, sf).drop("days_since_base"), path, "block")
    schema = "country string, category string, `table` string, bulletin_date date, status string, priority_date date, raw_value string, block string"
    back = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return back.select(*PANEL_KEY, "status", "priority_date", "raw_value")


@query(
    "parquet_export",
    "S5",
    sql(f"SELECT {KEY5}, status, priority_date FROM panel", "panel"),
)
def _parquet(spark, sf):
    path = shared_dir(spark, "panel-export")
    sinks.write_panel(area_panel(spark, sf), path)
    return spark.read.parquet(path).select(*PANEL_KEY, "status", "priority_date")


@query(
    "published_warehouse",
    "S7 G4 G5",
    sql(
        """SELECT 'fact_priority' AS name, count(*) AS n_rows FROM panel UNION ALL SELECT 'fact_dv_rank', count(*) FROM ranks
           UNION ALL SELECT 'dim_area', count(DISTINCT country) FROM panel UNION ALL SELECT 'etl_run', 1
           UNION ALL SELECT 'dim_category_alias', count(*) FROM (SELECT DISTINCT block, category, trim(regexp_replace(raw_category, '\\s+', ' ', 'g')) FROM panel)""",
        "panel",
        "ranks",
    ),
)
def _published(spark, sf):
    raw = published(order_cells(spark, sf)).withColumn("category", panel_category(F.col("block"), F.col("raw_category")))
    star = W.build_warehouse(area_panel(spark, sf), rank_panel(spark, sf), raw)
    root = shared_dir(spark, "warehouse")
    sinks.publish(star, root)
    back = sinks.open_warehouse(spark, root, area_panel(spark, sf))
    names = ("fact_priority", "fact_dv_rank", "dim_area", "etl_run", "dim_category_alias")
    return union_blocks(*[back[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names])


CONTRACT = {c: "*" for c in ("country", "block", "category", "table", "raw_value")} | {
    "bulletin_date": "date", "priority_date": "date", "days_since_base": "int", "status": "string",
}


@query(
    "contract_check",
    "G13",
    sql(
        """WITH v AS (SELECT strftime(max(bulletin_date), '%Y-%m') AS vintage FROM panel)
           SELECT a.artifact, v.vintage, a.problem FROM v, (VALUES ('panel', NULL), ('early', 'vintage'), ('renamed', 'missing path raw_value'), ('typed', 'days_since_base is string, not int'),
             ('nested', 'missing path cells.status')) a(artifact, problem)""",
        "panel",
    ),
)
def _contract(spark, sf):
    """The panel as an artifact, sound and broken in four ways, against its contract; a problem is a row."""
    panel = stage(area_panel(spark, sf), "artifact")
    vintage = panel.agg(F.date_format(F.max("bulletin_date"), "yyyy-MM")).first()[0]
    nested = panel.groupBy("country").agg(F.collect_list(F.struct("bulletin_date", F.col("status").alias("regime"))).alias("cells"))
    artifacts = {
        "panel": (panel, CONTRACT),
        "early": (panel.filter(F.date_format("bulletin_date", "yyyy-MM") < vintage), CONTRACT),
        "renamed": (panel.withColumnRenamed("raw_value", "raw"), CONTRACT),
        "typed": (panel.withColumn("days_since_base", F.col("days_since_base").cast("string")), CONTRACT),
        "nested": (nested, {"country": "string", "cells.bulletin_date": "date", "cells.status": "string"}),
    }
    rows = []
    for name, (df, contract) in artifacts.items():
        found = check_contract(df, contract, "bulletin_date" if "bulletin_date" in df.columns else None, vintage)
        rows += [(name, vintage, p.split(" ")[0] if p.startswith("vintage") else p) for p in found] or [(name, vintage, None)]
    return spark.createDataFrame(rows, "artifact string, vintage string, problem string")


@query(
    "release_manifest",
    "G14",
    """SELECT 'month=' || strftime(m, '%Y-%m') || '.csv' AS path, 'text/csv' AS mime, CASE WHEN m = lo THEN 'required' WHEN m = hi THEN 'optional' ELSE 'extra' END AS criticality,
         true AS present, sha256(body) AS merkle, CAST(strlen(body) AS BIGINT) AS size FROM (
         SELECT m, min(m) OVER () AS lo, max(m) OVER () AS hi, string_agg(k, chr(10) ORDER BY k) AS body
         FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY m)
       UNION ALL SELECT 'notes.md', 'text/markdown', 'optional', false, NULL, NULL""",
)
def _manifest(spark, sf):
    """Files of the order keys of each month, digested in ranges; the SQL digests each file as a whole."""
    folder, month = shared_dir(spark, "release"), F.date_format("o_orderdate", "yyyy-MM")
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf, "orders").groupBy(month.alias("m")).agg(F.array_join(F.array_sort(F.collect_list(key)), "\n").alias("content"))
    rows = stage(rows.select(F.concat(F.lit("month="), "m", F.lit(".csv")).alias("name"), "content"), "release-parts")
    write_files(rows, folder)
    first, last = rows.agg(F.min("name"), F.max("name")).first()
    _, out = sinks.manifest(spark, folder, last[6:13], required=(first,), optional=(last, "notes.md"))
    return out
