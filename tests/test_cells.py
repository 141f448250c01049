"""Classifiers and parsers on the published edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import cells as C
from panelspark.functions import rules

CASES = [
    ("01MAY16", "2018-01-01", "F", dt.date(2016, 5, 1)),
    ("15JUL05*", "2018-01-01", "F", dt.date(2005, 7, 15)),
    ("01MAY16 1", "2018-01-01", "F", dt.date(2016, 5, 1)),
    ("1may16", "2018-01-01", "F", dt.date(2016, 5, 1)),
    ("C", "2018-01-01", "C", dt.date(2018, 1, 1)),
    (" c ", "2018-01-01", "C", dt.date(2018, 1, 1)),
    ("C*", "2018-01-01", "C", dt.date(2018, 1, 1)),
    ("C†", "2018-01-01", "C", dt.date(2018, 1, 1)),
    ("U", "2018-01-01", "U", None),
    ("U*", "2018-01-01", "U", None),
    ("", "2018-01-01", "UNK", None),
    (None, "2018-01-01", "UNK", None),
    ("NA", "2018-01-01", "UNK", None),
    ("31JUN26", "2018-01-01", "UNK", None),
    ("00MAY16", "2018-01-01", "UNK", None),
    ("15XYZ05", "2018-01-01", "UNK", None),
    ("01JAN2015", "2018-01-01", "UNK", None),
    ("29FEB01", "2018-01-01", "UNK", None),
    ("29FEB00", "2018-01-01", "F", dt.date(2000, 2, 29)),
    ("01JAN81", "2018-01-01", "F", dt.date(1981, 1, 1)),
    ("01JAN69", "2018-01-01", "F", dt.date(1969, 1, 1)),
    ("01JAN68", "2018-01-01", "F", dt.date(1968, 1, 1)),  # 2068 is after its bulletin
    ("22JUN22", "2022-06-01", "F", dt.date(2022, 6, 22)),  # later day of the bulletin's own month
    ("01JUL22", "2022-06-01", "F", dt.date(1922, 7, 1)),
]


def test_status_and_date(spark):
    df = spark.createDataFrame([(i, c, m) for i, (c, m, _, _) in enumerate(CASES)], "i int, c string, m string")
    m = F.col("m").cast("date")
    out = df.select("i", C.classify_status(F.col("c")).alias("s"), C.parse_cell_date(F.col("c"), m).alias("d")).orderBy("i").collect()
    got = [(CASES[r["i"]][0], r["s"], r["d"]) for r in out]
    assert got == [(c, s, d) for c, _, s, d in CASES]


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ("1st", "EB1"), ("4th*", "EB4"), ("Other Workers", "EB3_OW"), ("Certain Religiuos Workers", "EB4_RW"),
        ("Iraqi & Afghani Translators", "EB4_TRANS"), ("5th Pilot Progams", "EB5_PILOT"),
        ("5th Non-Regional Center (C5 and T5)", "EB5_NONRC"), ("5th Regional Center (I5 and R5)", "EB5_RC"),
        ("Targeted Employment Areas/ Regional Centers", "EB5_TEA"), ("5th Set Aside:\n Rural (20%)", "EB5_RURAL"),
        ("5th Set-Aside: High Unemployment", "EB5_HIGHUNEMP"), ("5th Set Aside: Infrastructure", "EB5_INFRA"),
        ("5th Set Aside", "EB5_UNRESERVED"), ("5th Unreserved", "EB5_UNRESERVED"), ("5th", "EB5"), ("Schedule A Workers", None), ("", None),
    ],
)
def test_employment_labels(spark, raw, code):
    row = spark.createDataFrame([(raw,)], "r string").select(rules.canonical_category(F.col("r"), rules.EMPLOYMENT_RULES)).first()
    assert row[0] == code


@pytest.mark.parametrize(
    ("raw", "code"),
    [("F1", "1"), ("1st", "1"), ("2A*", "2A"), ("2nd-A", "2A"), ("F2A", "2A"), ("2nd-B", "2B"), ("3rd", "3"), ("4rd", "4"), ("F4 ", "4"), ("family", None)],
)
def test_family_labels(spark, raw, code):
    row = spark.createDataFrame([(raw,)], "r string").select(rules.canonical_category(F.col("r"), rules.FAMILY_RULES)).first()
    assert row[0] == code


@pytest.mark.parametrize(
    ("raw", "status", "rank"),
    [
        ("55,000", "F", 55000), ("CURRENT", "C", None), ("c", "C", None), ("U", "U", None), ("Unavailable", "U", None),
        ("", "UNK", None), (None, "UNK", None), ("AF  20,400  Except: Egypt 30,000", "F", 20400), ("n/a", "UNK", None),
    ],
)
def test_ranks(spark, raw, status, rank):
    df = spark.createDataFrame([(raw,)], "r string")
    assert tuple(df.select(C.rank_status(F.col("r")), C.rank_cutoff(F.col("r"))).first()) == (status, rank)


def test_label_noise(spark):
    df = spark.createDataFrame([("  All Areas \n  Except ",)], "r string")
    assert df.select(C.norm_label(F.col("r"))).first()[0] == "all areas except"


def test_rule_tables_are_checked(spark):
    from panelspark.functions import rules
    from panelspark.operators import labelling as LB
    from panelspark.operators.warehouse import ContractError

    book = {("v1", "family"): rules.FAMILY_RULES, ("v1", "employment"): rules.EMPLOYMENT_RULES}
    rows = LB.rule_rows(spark, book)
    assert LB.read_rules(rows.orderBy(F.desc("priority"))) == book
    for broken in (
        rows.withColumn("kind", F.when(F.col("priority") == 3, "like").otherwise(F.col("kind"))),
        rows.withColumn("priority", F.least("priority", F.lit(2))),
        rows.withColumn("code", F.lit(None).cast("string")),
    ):
        with pytest.raises(ContractError):
            LB.read_rules(broken)
    labels = spark.createDataFrame([("2a", "family"), ("set aside: rural", "employment"), ("2a", "none"), (None, "family")], "label string, s string")
    assert [r[0] for r in labels.select(LB.coded(F.col("label"), F.col("s"), "v1", book)).collect()] == ["2A", "EB5_RURAL", None, None]
    assert [r[0] for r in labels.select(LB.coded(F.col("label"), F.col("s"), "v9", book)).collect()] == [None] * 4
