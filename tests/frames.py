"""Small synthetic frames."""

from __future__ import annotations

import datetime as dt
import random


def month(i: int, start: int = 2000) -> dt.date:
    return dt.date(start + i // 12, i % 12 + 1, 1)


def obs_frame(spark, series: int = 3, months: int = 90, gaps: bool = True, seed: int = 1):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        y = 7000.0
        for i in range(months):
            y += rng.choice([0, 0, 30, 31, 60, -90, 15])
            if not gaps or i in (0, months - 1) or rng.random() > 0.2:
                rows.append((f"a{s}", "family", "F1", "FAD" if s % 2 else "DFF", month(i), y))
    return spark.createDataFrame(rows, "country string, block string, category string, `table` string, bulletin_date date, y double")


def panel_rows():
    """Two areas, two categories, both tables, thirty observed months."""
    base = dt.date(1975, 1, 1)
    rows = []
    for area in ("mexico", "all_chargeability"):
        for block, category in (("family", "F1"), ("employment", "EB1")):
            for table in ("FAD", "DFF"):
                for i in range(30):
                    d = base + dt.timedelta(days=9000 + 20 * i)
                    rows.append((area, block, category, table, month(i, 2010), "F", d, (d - base).days, d.strftime("%d%b%y").upper()))
    return rows


PANEL_SCHEMA = (
    "country string, block string, category string, `table` string, bulletin_date date, status string, priority_date date, "
    "days_since_base int, raw_value string"
)


def panel_frame(spark):
    return spark.createDataFrame(panel_rows(), PANEL_SCHEMA)
