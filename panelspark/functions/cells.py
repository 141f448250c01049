"""Column expressions over published cells: regimes, dates, ranks, calendar, transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.config import DAYS_PER_YEAR, EPOCH

# Footnote marks, the day-month-year token, the first number group.
FOOTNOTE = "*† "
DATE_TOKEN = r"\d{1,2}[A-Z]{3}\d{2}(?!\d)"
RANK_TOKEN = r"\d[\d,]*"

BLANK = r"[\s ]+"


def epoch() -> Column:
    return F.lit(EPOCH).cast("date")


def strip(col: Column) -> Column:
    """Trim every kind of blank, the non-breaking one included."""
    return F.regexp_replace(col, rf"^{BLANK}|{BLANK}$", "")


def strip_footnotes(col: Column) -> Column:
    return F.regexp_replace(col, rf"[{FOOTNOTE}]+$", "")


def token_date(text: Column) -> Column:
    """First ``ddMMMyy`` token as a date, NULL when absent or not a calendar day.

    The century is written out (pivot 69) because the ``yy`` pattern letter always lands in
    2000-2099. One linear chain, so pushing a filter on it through a projection stays cheap.
    """
    token = F.regexp_extract(text, DATE_TOKEN, 0)
    token = F.regexp_replace(token, r"([A-Z])(69|[7-9]\d)$", "$119$2")
    token = F.regexp_replace(token, r"([A-Z])([0-6]\d)$", "$120$2")
    return F.try_to_timestamp(token, F.lit("dMMMyyyy")).cast("date")


def _mark(cell: Column) -> Column:
    return strip_footnotes(F.upper(strip(cell)))


def classify_status(cell: Column) -> Column:
    """Regime of a published cell: F (a date), C, U or UNK."""
    return (
        F.when(_mark(cell) == "C", "C")
        .when(_mark(cell) == "U", "U")
        .when(token_date(F.upper(cell)).isNotNull(), "F")
        .otherwise("UNK")
    )


def parse_cell_date(cell: Column, month: Column) -> Column:
    """Date of a published cell; C stands for the bulletin month itself.

    A date in a later month than its bulletin is a wrong century and moves back 100 years.
    """
    date = token_date(F.upper(cell))
    return (
        F.when(_mark(cell) == "C", month)
        .when(_mark(cell) == "U", F.lit(None).cast("date"))
        .when(F.trunc(date, "month") > F.trunc(month, "month"), F.add_months(date, -1200))
        .otherwise(date)
    )


def rank_status(cell: Column) -> Column:
    text = F.upper(strip(cell))
    return (
        F.when(cell.isNull() | (text == ""), "UNK")
        .when(text.contains("CURRENT") | (text == "C"), "C")
        .when((text == "U") | text.contains("UNAVAIL"), "U")
        .when(text.rlike(r"\d"), "F")
        .otherwise("UNK")
    )


def rank_cutoff(cell: Column) -> Column:
    """First number group of a rank cell (thousands commas dropped), only when it is a cut-off."""
    digits = F.regexp_replace(F.regexp_extract(cell, RANK_TOKEN, 0), ",", "")
    return F.when(rank_status(cell) == "F", digits.try_cast("int"))


def norm_label(col: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(col, F.lit("")), BLANK, " ")))


def wait_years(month: Column, date: Column) -> Column:
    return F.datediff(month, date) / F.lit(DAYS_PER_YEAR)


def days_since_base(status: Column, date: Column) -> Column:
    """The dependent variable: defined on regime F only."""
    return F.when(status == "F", F.datediff(date, epoch()))


def days_to_year(days: Column) -> Column:
    return F.lit(float(EPOCH[:4])) + days / F.lit(DAYS_PER_YEAR)


def month_index(date: Column) -> Column:
    """Months since year 0: integer arithmetic for gaps, spans and islands."""
    return F.year(date) * 12 + F.month(date) - 1


def fiscal_year(date: Column) -> Column:
    return F.year(date) + (F.month(date) >= 10).cast("int")


def calendar_features(date: Column) -> dict[str, Column]:
    """Cyclic month and fiscal-position encodings (the fiscal year starts in October)."""
    turn = 2.0 * math.pi / 12.0
    month = F.month(date)
    fiscal = F.pmod(month - 10, F.lit(12))
    return {
        "month_sin": F.sin(F.lit(turn) * month),
        "month_cos": F.cos(F.lit(turn) * month),
        "fiscal_sin": F.sin(F.lit(turn) * fiscal),
        "fiscal_cos": F.cos(F.lit(turn) * fiscal),
    }


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def encode_regime(status: Column, days: Column, month: Column) -> Column:
    """One continuous level: the cut-off for F, the bulletin month for C, NULL otherwise."""
    return F.when(status == "F", days.cast("double")).when(
        status == "C", F.datediff(month, epoch()).cast("double")
    )


def series_uid(country: Column, block: Column, category: Column) -> Column:
    return F.concat_ws("/", country, block, category)


def split_uid(uid: Column) -> dict[str, Column]:
    parts = F.split(uid, "/")
    return {name: parts.getItem(i) for i, name in enumerate(("country", "block", "category"))}
