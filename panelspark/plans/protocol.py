"""What the plan modules share: the protocol of the driver tables and the usual inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import Protocol
from panelspark.sources.tables import area_panel, observed, region_panel, supplier_panel

# The driver tables span 80 to 83 months, so the walk-forward minimum is shorter than the published one.
SHORT = Protocol(min_train={"FAD": 36, "DFF": 24}, min_f=48, val_tune=12, val_confirm=6)


def obs(spark, sf):
    return observed(supplier_panel(spark, sf))


def area_obs(spark, sf):
    return observed(area_panel(spark, sf))


def region_obs(spark, sf):
    return observed(region_panel(spark, sf))


def r6(*names):
    return {n: F.round(F.col(n), 6) for n in names}


def settle(*names):
    """Six decimals with near-ties pushed up, so that both engines land on the same side of a dyadic tie."""
    return {n: F.floor(F.col(n) * 1e6 + 0.5001) / 1e6 for n in names}


def settle_sql(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5001) / 1e6"
