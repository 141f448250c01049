"""Changing the future must not change anything computed for the past."""

import datetime as dt

import pytest
from frames import obs_frame
from pyspark.sql import functions as F

from panelspark.config import SERIES, Protocol
from panelspark.operators import forecast as FC
from panelspark.operators import series as S
from panelspark.operators import smoothing as SM
from panelspark.operators import vintage as V

CUT = dt.date(2005, 7, 1)
SHORT = Protocol(min_train={"FAD": 24, "DFF": 24}, holdout=12, min_f=24)


def rows(df, date, upto):
    cols = sorted(df.columns)
    return sorted(map(repr, df.filter(F.col(date) <= F.lit(upto)).select(*cols).collect()))


CAUSAL = {
    "locf": lambda o: S.fill_locf(o),
    "masks": lambda o: S.mask_features(o).filter(F.col("bulletin_date") <= F.lit(CUT)),
    "features": lambda o: S.feature_frame(o).drop("n_grid"),
    "one_step": lambda o: FC.one_step_long(o, SHORT).drop("hold_start", "region"),
    "smoothing": lambda o: SM.smoothing_forecasts(o, protocol=SHORT).filter("region <> 'future'").drop("hold_start", "region"),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_future_does_not_leak(spark, name):
    obs = obs_frame(spark)
    changed = obs.withColumn("y", F.when(F.col("bulletin_date") > F.lit(CUT), F.col("y") * 3 + 1000).otherwise(F.col("y")))
    fn = CAUSAL[name]
    assert rows(fn(obs), "bulletin_date", CUT) == rows(fn(changed), "bulletin_date", CUT)


def test_interpolation_does_leak(spark):
    """The check itself must be able to fail."""
    obs = obs_frame(spark)
    changed = obs.withColumn("y", F.when(F.col("bulletin_date") > F.lit(CUT), F.col("y") * 3 + 1000).otherwise(F.col("y")))
    ahead = lambda o: o.withColumn("x", F.lead("y").over(S.over_series()))
    assert rows(ahead(obs), "bulletin_date", CUT) != rows(ahead(changed), "bulletin_date", CUT)


def test_vintage_equals_truncated_panel(spark):
    """A vintage at a month equals the live vintage of the panel cut at that month."""
    obs = obs_frame(spark, gaps=False)
    origins = obs.filter(F.col("bulletin_date") == F.lit(CUT)).select("bulletin_date")
    past = V.vintages(obs, origins, protocol=SHORT, coherent=False)
    live = V.vintages(obs.filter(F.col("bulletin_date") <= F.lit(CUT)), protocol=SHORT, coherent=False)
    cols = ["origin", *SERIES, "h", "date", "days", "lo80", "hi80", "lo95", "hi95"]
    assert past.count() > 0
    assert sorted(map(tuple, past.select(*cols).collect())) == sorted(map(tuple, live.select(*cols).collect()))
