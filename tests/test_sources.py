"""Snapshot eras, rank layouts, raw CSV files, sinks."""

import datetime as dt
import hashlib
import json

import pytest
from frames import panel_frame
from pyspark.sql import functions as F

from panelspark.config import PANEL_KEY
from panelspark.functions.cells import norm_label
from panelspark.operators.audit import check_contract
from panelspark.operators.warehouse import ContractError
from panelspark.sources import raw_csv, sinks
from panelspark.sources import snapshots as SN
from panelspark.sources.files import digest_files, list_files, write_files
from panelspark.sources.tables import annotate

MODERN = """<html><h2>Family</h2><p><b>A.&nbsp;FINAL ACTION DATES FOR FAMILY</b></p>
<table><tr><td colspan=6>title</td></tr>
<tr><th>Family- Sponsored</th><th>All Chargeability Areas Except Those Listed</th><th>CHINA- mainland born</th><th>MEXICO</th></tr>
<tr><td>F1</td><td>01MAY16</td><td>01MAY16</td><td>15JUL05*</td></tr><tr><td>F2A*</td><td>C</td><td>C</td><td>U</td></tr>
<tr><td>note</td><td>C</td><td>C</td><td>C</td></tr></table>
<p>B. DATES FOR FILING FAMILY</p>
<table><tr><th>Family-Sponsored</th><th>All Charge ability Areas\n Except Those  Listed</th><th>CHINA-mainland born</th><th>MEXICO</th></tr>
<tr><td>F1</td><td>01JUN16</td><td>01JUN16</td><td>01AUG05</td></tr></table>
<p>A. FINAL ACTION DATES FOR EMPLOYMENT</p>
<table><tr><td>Employment-<br>based</td><td>All Chargeability Areas Except Those Listed</td><td>INDIA</td></tr>
<tr><td>1st</td><td>C</td><td>01JAN81</td></tr><tr><td>5th Set Aside:\n Rural</td><td>C</td><td>C</td></tr></table></html>"""
# No headings at all: the order of the tables decides.
OLD = """<table><tr><td>Employment -Based</td><td>All Chargeability Areas Except Those Listed</td><td>INDIA</td></tr>
<tr><td>1st</td><td>C</td><td>01MAY02</td></tr></table>
<table><tr><td>Employment based</td><td>All Chargeability Areas Except Those Listed</td><td>INDIA</td></tr>
<tr><td>1st</td><td>C</td><td>01JUN02</td></tr></table>"""
RANKS = """<p>FINAL ACTION DATES</p><table><tr><td>Region</td><td></td><td>All DV Chargeability Areas Except Those Listed Separately</td><td></td></tr>
<tr><td>AFRICA</td><td>AF</td><td>55,000</td><td>Except: Egypt 30,000</td></tr><tr><td>ASIA</td><td>AS</td><td>CURRENT</td><td></td></tr>
<tr><td>NORTH AMERICA (BAHAMAS)</td><td>NA</td><td>U</td><td></td></tr></table>
<table><tr><td>Region</td><td>All DV Chargeability Areas</td></tr><tr><td>AFRICA</td><td>1</td></tr></table>"""
BLOB = """<table><tr><td>AFRICA: AF 21,400 ASIA: AS 9,500 EUROPE: EU CURRENT NORTH AMERICA: NA 12 OCEANIA: OC 850</td></tr></table>"""


def page(spark, html, day="2018-01-01"):
    return spark.createDataFrame([(dt.date.fromisoformat(day), html)], "month date, content string")


def cells(spark, html, block, day="2018-01-01"):
    out = SN.area_cells(SN.extract_cells(page(spark, html, day), block), block)
    rows = annotate(out).select("country", "category", "table", "status", "priority_date").collect()
    return {(r[0], r[1], r[2]): (r[3], r[4]) for r in rows}


def test_headings_label_tables(spark):
    fam = cells(spark, MODERN, "family")
    assert fam[("mexico", "F1", "FAD")] == ("F", dt.date(2005, 7, 15))
    assert fam[("mexico", "F1", "DFF")] == ("F", dt.date(2005, 8, 1))
    assert fam[("china", "F2A", "FAD")] == ("C", None) and fam[("mexico", "F2A", "FAD")] == ("U", None)
    assert fam[("all_chargeability", "F1", "FAD")] == ("F", dt.date(2016, 5, 1))
    assert len(fam) == 9
    emp = cells(spark, MODERN, "employment")
    assert emp[("india", "EB1", "FAD")] == ("F", dt.date(1981, 1, 1))
    assert ("india", "EB5_RURAL", "FAD") in emp and len(emp) == 4


def test_ordinal_fallback(spark):
    emp = cells(spark, OLD, "employment", "2003-01-01")
    assert emp[("india", "EB1", "FAD")] == ("F", dt.date(2002, 5, 1))
    assert emp[("india", "EB1", "DFF")] == ("F", dt.date(2002, 6, 1))


def test_rank_layouts(spark):
    both = page(spark, RANKS).unionByName(page(spark, BLOB, "2002-01-01")).unionByName(page(spark, "<table><tr><td>AF 1 OC 2 africa asia</td></tr></table>", "2002-02-01"))
    rows = {(r["month"].year, r["region"]): (r["status"], r["rank_cutoff"], r["exceptions"]) for r in SN.rank_rows(both).collect()}
    assert rows == {
        (2018, "africa"): ("F", 55000, "Except: Egypt 30,000"),
        (2018, "asia"): ("C", None, ""),
        (2018, "north_america"): ("U", None, ""),
        (2002, "africa"): ("F", 21400, ""),
        (2002, "asia"): ("F", 9500, ""),
        (2002, "europe"): ("C", None, ""),
        (2002, "north_america"): ("F", 12, ""),
        (2002, "oceania"): ("F", 850, ""),
    }


def test_directory_scan(spark, tmp_path):
    (tmp_path / "visa-bulletin-for-january-2018.html").write_text(MODERN)
    (tmp_path / "visa-bulletin-march-2009.html").write_bytes(OLD.encode() + b"\xff")
    (tmp_path / "visa-bulletin-announcement.html").write_text("x")
    (tmp_path / "notes.txt").write_text("x")
    snaps = SN.read_snapshots(spark, str(tmp_path))
    assert {r[0] for r in snaps.select("month").collect()} == {dt.date(2018, 1, 1), dt.date(2009, 3, 1), None}
    assert [r["path"].split("/")[-1] for r in SN.unmapped_snapshots(snaps).collect()] == ["visa-bulletin-announcement.html"]
    assert SN.source_artifacts(snaps).count() == 2
    assert SN.extract_cells(snaps, "employment").select("month").distinct().count() == 2


HEAD = "{lv},priority_date,visa_bulletin_date,table_type,raw_value,status,visa_wait_time,raw_category\n"


def test_raw_csv(spark, tmp_path):
    (tmp_path / "row_visa_backlog_timecourse.csv").write_text(
        HEAD.format(lv="EB_level") + "EB1,2018-01-01,2018-01-01,final_action,NA,UNK,,1st\nEB2,2016-05-01,2018-01-01,final_action,01MAY16,F,1.6,2nd\n"
    )
    (tmp_path / "india_family_visa_backlog_timecourse.csv").write_text(
        HEAD.format(lv="F_level") + "2A,2016-05-01 00:00:00,2018-01-01 00:00:00,dates_for_filing,01MAY16,F,1.6,\"2nd-A\n x\"\n"
    )
    raw = raw_csv.read_raw(spark, str(tmp_path))
    panel = {(r["country"], r["category"], r["table"]): r for r in raw_csv.to_panel(raw).collect()}
    assert set(panel) == {("all_chargeability", "EB1", "FAD"), ("all_chargeability", "EB2", "FAD"), ("india", "F2A", "DFF")}
    assert panel[("all_chargeability", "EB1", "FAD")]["raw_value"] == "NA"
    assert panel[("all_chargeability", "EB1", "FAD")]["priority_date"] is None
    assert panel[("india", "F2A", "DFF")]["days_since_base"] == 15096


@pytest.mark.parametrize(
    "line",
    [
        "XX,2016-05-01,2018-01-01,final_action,01MAY16,F,1,2nd",
        "EB2,bad,2018-01-01,final_action,01MAY16,F,1,2nd",
        "EB2,2016-05-01,01/2018,final_action,01MAY16,F,1,2nd",
        "EB2,1970-05-01,2018-01-01,final_action,01MAY70,F,1,2nd",
        "EB2,2016-05-01,2018-01-01,advance_notice,01MAY16,F,1,2nd",
    ],
)
def test_raw_csv_guards(spark, tmp_path, line):
    (tmp_path / "row_visa_backlog_timecourse.csv").write_text(HEAD.format(lv="EB_level") + line + "\n")
    with pytest.raises(ContractError):
        raw_csv.to_panel(raw_csv.read_raw(spark, str(tmp_path)))


def test_panel_export_and_json(spark, tmp_path):
    panel = panel_frame(spark)
    assert sinks.write_panel(panel, str(tmp_path / "p")) == panel.count()
    back = spark.read.parquet(str(tmp_path / "p")).select(panel.columns)
    assert back.exceptAll(panel).count() == 0
    sinks.write_json_dir(panel.limit(3).withColumn("priority_date", F.lit(None).cast("date")), str(tmp_path / "j"))
    docs = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(docs) == 3 and all(d["priority_date"] is None and d["country"] for d in docs)


def test_manifest_depends_on_content_only(spark, tmp_path):
    for name, order in (("a", "xy"), ("b", "yx")):
        (tmp_path / name / "art").mkdir(parents=True)
        for f in order:
            (tmp_path / name / "art" / f).write_text(f * 3)
    one, rows = sinks.manifest(spark, str(tmp_path / "a" / "art"), "2018-01", ("x",))
    two, _ = sinks.manifest(spark, str(tmp_path / "b" / "art"), "2018-01")
    assert one == two and one.startswith("2018-01-") and rows.count() == 2
    (tmp_path / "b" / "art" / "x").write_text("changed")
    assert sinks.manifest(spark, str(tmp_path / "b" / "art"), "2018-01")[0] != one
    with pytest.raises(ContractError):
        sinks.manifest(spark, str(tmp_path / "a" / "art"), "2018-01", ("missing",))


def test_contract_paths(spark):
    df = panel_frame(spark).withColumn("meta", F.struct(F.lit(1).alias("n"), F.array(F.struct(F.lit("x").alias("k"))).alias("rows")))
    assert check_contract(df, {"country": "string", "meta.n": "int", "meta.rows.k": "string"}, "bulletin_date", "2012-06") == []
    assert len(check_contract(df, {"nope": "*", "meta.m": "*", "country": "int"})) == 3
    assert check_contract(df, {"country": "*"}, "bulletin_date", "2013-01") != []


def test_generic_area_headers(spark):
    out = SN.area_cells(SN.extract_cells(page(spark, OLD), "employment"), "employment", norm_label(F.col("header")))
    assert {r[0] for r in out.select("country").collect()} == {"india", "all chargeability areas except those listed"}
    assert set(PANEL_KEY) <= set(out.columns)


def test_every_table_of_a_section_is_read():
    table = "<table><tr><td>Family-based</td><td>All areas</td></tr><tr><td>F1</td><td>{}</td></tr></table>"
    page = "".join(table.format(f"0{i}JAN99") for i in range(1, 7))
    cells = SN.section_cells(page, "family")
    assert {c[0] for c in cells} == {1, 2, 3, 4, 5, 6}
    assert [c[6] for c in cells if c[3] == 1] == [f"0{i}JAN99" for i in range(1, 7)]


def test_files_of_any_size_are_digested_in_ranges(spark, tmp_path):
    """Roots do not depend on who reads which range; a file beyond two gigabytes, mostly holes, included."""
    folder = tmp_path / "art"
    folder.mkdir()
    data = bytes(range(256)) * 5000
    (folder / "odd.bin").write_bytes(data)
    (folder / "empty.txt").write_bytes(b"")  # Spark lists no empty file
    with open(folder / "large.bin", "wb") as file:
        file.seek((2 << 30) + (100 << 20))
        file.write(b"end")
    size = 64 << 20
    got = {r["path"].rsplit("/", 1)[1]: r["merkle"] for r in digest_files(list_files(spark, str(folder)), size).collect()}

    def plain(path, size):
        leaves, file = [], open(path, "rb")
        while part := file.read(size):
            leaves.append(hashlib.sha256(part).digest())
        while len(leaves) > 1:
            leaves = [hashlib.sha256(leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return (leaves[0] if leaves else hashlib.sha256(b"").digest()).hex()

    assert got == {name: plain(folder / name, size) for name in ("odd.bin", "large.bin")}
    assert got["odd.bin"] == hashlib.sha256(data).hexdigest()
    small = {r["path"].rsplit("/", 1)[1]: r["merkle"] for r in digest_files(list_files(spark, str(folder)).filter("length < 10000000"), 1000).collect()}
    assert small["odd.bin"] == plain(folder / "odd.bin", 1000) != got["odd.bin"]


def test_manifest_names_what_is_missing(spark, tmp_path):
    write_files(spark.createDataFrame([("a.json", "{}"), ("sub/b.csv", "x")], "name string, content string"), str(tmp_path / "art"))
    _, rows = sinks.manifest(spark, str(tmp_path / "art"), "2018-01", ("a.json",), ("sub/b.csv", "c.html"))
    got = {r["path"]: (r["mime"], r["criticality"], r["present"], r["size"]) for r in rows.collect()}
    assert got == {
        "a.json": ("application/json", "required", True, 2),
        "sub/b.csv": ("text/csv", "optional", True, 1),
        "c.html": ("text/html", "optional", False, None),
    }


def test_bad_lines_go_to_quarantine(spark, tmp_path):
    lines = [
        "EB1,2016-05-01,2018-01-01,final_action,01MAY16,F,1.6,1st",
        "EB1,2016-05-01,2018-01-01,final_action,01MAY16",
        "EB1,2016-05-01,2018-01-01,final_action,01MAY16,F,1.6,1st,more",
        "XX,2016-05-01,2018-01-01,final_action,01MAY16,F,1,2nd",
        "EB2,bad,2018-01-01,final_action,01MAY16,F,1,2nd",
        "EB2,2016-05-01,01/2018,final_action,01MAY16,F,1,2nd",
        "EB2,2016-05-01,2018-01-01,advance_notice,01MAY16,F,1,2nd",
        "EB2,,2018-01-01,final_action,C,?,1,2nd",
    ]
    (tmp_path / "row_visa_backlog_timecourse.csv").write_text(HEAD.format(lv="EB_level") + "\n".join(lines) + "\n")
    sound, bad = raw_csv.split_rows(raw_csv.read_raw(spark, str(tmp_path)))
    assert raw_csv.to_panel(sound).count() == 1
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["bulletin month", "date missing", "fields", "fields", "level", "status", "table type"]
