"""Frozen monthly HTML snapshots: directory scan, table extraction, area and rank cells.

Parsing is per page and therefore embarrassingly parallel: Spark spreads pages, a small standard-library
parser turns one page into its cells, and everything after that (sections to areas, the value column
of a rank table, fallbacks) is DataFrame work on those cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.cells import norm_label, rank_cutoff, rank_status, strip
from panelspark.functions.rules import REGION_CODES, area_slug, panel_category, region_slug

# Snapshot file names, month names, section and table markers.
FILE_MONTH = r"visa-bulletin(?:-for)?-(\w+)-(\d{4})\.html$"
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
TYPE_MARKER = re.compile(r"final action|dates for filing", re.IGNORECASE)
SECTIONS = {
    "employment": re.compile(r"employment[\s-]*based"),
    "family": re.compile(r"family"),
    "rank": re.compile(r"dv chargeability|diversity"),
}
MIN_BLOB_REGIONS = 4


def month_of_name(path: Column) -> Column:
    """First day of the month a snapshot's file name stands for, NULL when it names none."""
    name = F.lower(F.regexp_extract(path, FILE_MONTH, 1))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    year = F.regexp_extract(path, FILE_MONTH, 2).try_cast("int")
    return F.when(number > 0, F.make_date(year, number.cast("int"), F.lit(1)))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with their month, hash and bytes; ``month`` is NULL for names that map to none."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.html")
        .load(folder)
        .select("path", month_of_name(F.col("path")).alias("month"), F.sha2("content", 256).alias("sha256"), "content")
    )


def unmapped_snapshots(snapshots: DataFrame) -> DataFrame:
    """Skipped files, to be reported rather than dropped in silence."""
    return snapshots.filter(F.col("month").isNull()).select("path", "sha256")


def source_artifacts(snapshots: DataFrame) -> DataFrame:
    """Provenance rows: file name, hash and month; timestamps derive from the month."""
    name = F.element_at(F.split("path", "/"), -1)
    return snapshots.filter(F.col("month").isNotNull()).select(
        name.alias("filename"), "sha256", F.col("month").alias("vintage"), F.col("month").alias("created_at"), F.col("month").alias("updated_at")
    )


class _Tables(HTMLParser):
    """Tables of a page as rows of stripped cell texts, each with the last type marker before it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.marker: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._flush()
            table = {"marker": self.marker, "rows": [], "words": []}
            self.tables.append(table)
            self.open.append(table)
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.open[-1]["rows"][-1].append([])
        elif tag != "br":
            self._flush()

    def handle_endtag(self, tag):
        self._flush()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)
        for table in self.open:
            if data.strip():
                table["words"].append(data.strip())
            if table["rows"] and table["rows"][-1]:
                table["rows"][-1][-1].append(data)

    def _flush(self):
        text = "".join(self.text)
        self.text = []
        if TYPE_MARKER.search(text):
            self.marker = text

    def result(self) -> list[dict]:
        self.close()
        for table in self.tables:
            table["rows"] = [["".join(c).strip() for c in row] for row in table["rows"]]
        return self.tables


def page_tables(html: str) -> list[dict]:
    parser = _Tables()
    parser.feed(html)
    return parser.result()


def _header(text: str) -> str:
    return text.replace("\n", "").replace("- ", "-").lower()


def section_cells(html: str, section: str) -> list[tuple]:
    """(table number, type, row, column, header, label, value) of a page's tables of one section.

    The type is the nearest heading before the table, or its ordinal when there is none; rank tables
    always go by ordinal because the headings before them belong to another section.
    """
    out: list[tuple] = []
    matched = 0
    for table in page_tables(html):
        rows = [r for r in table["rows"] if r]
        if not any(SECTIONS[section].search("".join(r).lower()) for r in rows):
            continue
        matched += 1
        marker = None if section == "rank" else table["marker"]
        if marker is not None:
            kind = "dates_for_filing" if "filing" in marker.lower() else "final_action"
        else:
            kind = "final_action" if matched == 1 else "dates_for_filing"
        if len(rows[0]) == 1:  # spanning title
            rows = rows[1:]
        if len(rows) > 1:
            heads = [_header(h) for h in rows[0]]
            for i, row in enumerate(rows[1:]):
                for j, value in enumerate(row):
                    out.append((matched, kind, i, j, heads[j] if j < len(heads) else "", row[0], value))
    return out


CELL_SCHEMA = (
    "month date, table_no int, table_type string, row int, col int, header string, label string, value string"
)


def _text(content) -> str:
    return content if isinstance(content, str) else bytes(content).decode("utf-8", errors="replace")


def extract_cells(snapshots: DataFrame, section: str) -> DataFrame:
    """Long cells of every mapped snapshot (``month``, ``content``) for one section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["month", "table_no", "table_type", "row", "col", "header", "label", "value"]
        for pdf in batches:
            rows = []
            for month, content in zip(pdf["month"], pdf["content"], strict=True):
                rows += [(month, *cell) for cell in section_cells(_text(content), section)]
            yield pd.DataFrame(rows, columns=names)

    return snapshots.filter(F.col("month").isNotNull()).select("month", "content").mapInPandas(run, CELL_SCHEMA)


def area_cells(cells: DataFrame, block: str, area: Column | None = None) -> DataFrame:
    """Published cells per area from extracted cells: header to area, label to category, first row wins.

    Only the first column of an area counts; labels outside the block's categories drop out.
    """
    first_col = Window.partitionBy("month", "table_no", "row", "label", "country").orderBy("col")
    keyed = (
        cells.filter(F.col("col") > 0)
        .withColumn("country", area if area is not None else area_slug(F.col("header")))
        .withColumn("block", F.lit(block))
        .withColumn("raw_category", strip(F.regexp_replace("label", r"[ \t]+\n", "\n")))
        .withColumn("category", panel_category(F.col("block"), F.col("raw_category")))
        .filter(F.col("country").isNotNull() & F.col("category").isNotNull())
        .withColumn("_c", F.row_number().over(first_col))
        .filter(F.col("_c") == 1)
    )
    key = ["country", "block", "category", "table_type", "month"]
    first = F.min_by(F.struct("raw_category", "value"), F.struct("table_no", "row"))
    return (
        keyed.groupBy(*key)
        .agg(first.alias("_first"))
        .select(
            "country",
            "block",
            "category",
            F.when(F.col("table_type") == "final_action", "FAD").otherwise("DFF").alias("table"),
            F.col("month").alias("bulletin_date"),
            F.col("_first.raw_category").alias("raw_category"),
            F.col("_first.value").alias("raw_value"),
        )
    )


def extract_ranks(cells: DataFrame) -> DataFrame:
    """Region ranks from rank-section cells; the value column is the one whose cells parse most often.

    Ties prefer a header naming chargeability, then the leftmost column. Another column mentioning
    exceptions supplies that text. Only the current-month table (the first) counts.
    """
    first = cells.filter(F.col("table_type") == "final_action")
    table = ["month", "table_no"]
    body = first.filter(F.col("col") > 0)
    scored = body.groupBy(*table, "col").agg(
        F.count_if(rank_status(F.col("value")).isin("F", "C", "U")).alias("_score"),
        F.max(norm_label(F.col("header")).contains("chargeability").cast("int")).alias("_named"),
        F.max(F.coalesce(F.col("value").contains("xcept"), F.lit(False)).cast("int")).alias("_except"),
    )
    choice = scored.groupBy(*table).agg(F.max_by("col", F.struct("_score", "_named", -F.col("col"))).alias("_value_col"))
    notes = (
        scored.join(choice, table)
        .filter((F.col("_except") == 1) & (F.col("col") != F.col("_value_col")))
        .groupBy(*table)
        .agg(F.min("col").alias("_note_col"))
    )
    note = F.max(F.when(F.col("col") == F.col("_note_col"), F.col("value")))
    rows = (
        body.join(choice, table)
        .join(notes, table, "left")
        .groupBy(*table, "row", "label")
        .agg(F.max(F.when(F.col("col") == F.col("_value_col"), F.col("value"))).alias("_value"), note.alias("_note"))
        .withColumn("region", region_slug(F.col("label")))
        .filter(F.col("region").isNotNull())
    )
    pick = F.min_by(F.struct("_value", "_note"), F.struct("table_no", "row"))
    kept = rows.groupBy("region", "month").agg(pick.alias("_p")).select("region", "month", "_p.*")
    return kept.select(
        "region",
        "month",
        rank_status(F.col("_value")).alias("status"),
        rank_cutoff(F.col("_value")).alias("rank_cutoff"),
        strip(F.col("_value")).alias("raw_value"),
        F.coalesce(strip(F.regexp_replace("_note", r"\s+", " ")), F.lit("")).alias("exceptions"),
    )


def rank_blobs(snapshots: DataFrame) -> DataFrame:
    """The single-cell layout: text of the first table holding region names and codes, per month."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for month, content in zip(pdf["month"], pdf["content"], strict=True):
                for table in page_tables(_text(content)):
                    text = " ".join(table["words"])
                    low = text.lower()
                    if "africa" in low and "asia" in low and re.search(r"\bAF\b", text) and re.search(r"\bOC\b", text):
                        rows.append((month, text))
                        break
            yield pd.DataFrame(rows, columns=["month", "blob"])

    return snapshots.filter(F.col("month").isNotNull()).select("month", "content").mapInPandas(run, "month date, blob string")


def blob_ranks(blobs: DataFrame) -> DataFrame:
    """Ranks after each region code; months with fewer than four regions are not rank blobs."""
    found = [
        F.struct(F.lit(slug).alias("region"), F.regexp_extract("blob", rf"\b{code}\s+([\d,]+|CURRENT|U)\b", 1).alias("raw_value"))
        for slug, code in REGION_CODES.items()
    ]
    hits = F.filter(F.array(*found), lambda r: r["raw_value"] != "")
    rows = blobs.withColumn("_hits", hits).filter(F.size("_hits") >= MIN_BLOB_REGIONS).select("month", F.inline("_hits"))
    return rows.select(
        "region",
        "month",
        rank_status(F.col("raw_value")).alias("status"),
        rank_cutoff(F.col("raw_value")).alias("rank_cutoff"),
        "raw_value",
        F.lit("").alias("exceptions"),
    )


def rank_rows(snapshots: DataFrame) -> DataFrame:
    """Structured tables first; the blob layout fills months that have none."""
    structured = extract_ranks(extract_cells(snapshots, "rank"))
    rest = blob_ranks(rank_blobs(snapshots)).join(structured.select("month").distinct(), "month", "left_anti")
    return structured.unionByName(rest)
