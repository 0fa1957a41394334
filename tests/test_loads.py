"""Batch loads: atomic, repeatable, numbered without gaps; files as workbooks and with preambles; resumes of older versions."""

import datetime
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark.operators import loads, store
from tallymark.sources import registers, registry, sheets

RECORD = "seq long, company_name string, country string, year int, metric string, value decimal(14,2), published_date date, aliases array<string>, domains array<string>"
DAY = datetime.date(2024, 1, 1)


def batch(spark, k, value=1):
    rows = [(i, f" Acme {i} Inc", "US", 2020, "approvals", Decimal(value), DAY, [f"al {i}", " "], [f"www.X{i}.com"]) for i in range(k * 5, k * 5 + 12)]
    return spark.createDataFrame([*rows, (9000, "acme 3 LTD", "US", 2020, "approvals", Decimal(5), DAY, None, None)], RECORD)


def everything(held):
    return {name: sorted(map(tuple, held.table(name).collect()), key=str) for name in loads.SCHEMAS}


def test_ten_loads(spark, tmp_path):
    held = loads.CompanyStore(spark, str(tmp_path))
    for k in range(10):
        assert held.load(batch(spark, k), "us_petitions") == (12 if k == 0 else 13)
    rows = held.table("companies").collect()
    assert sorted(r.company_id for r in rows) == list(range(1, len(rows) + 1)) and len({(r.normalized_name, r.country) for r in rows}) == len(rows)
    assert {r.canonical_name for r in rows if r.normalized_name == "acme 3"} == {"Acme 3 Inc"}
    assert held.table("facts").agg(F.count("*"), F.count_distinct("company_id")).first() == (len(rows), len(rows))
    before = everything(held)
    held.load(batch(spark, 9), "us_petitions")
    assert everything(held) == before
    held.load(batch(spark, 0).withColumn("country", F.lit("GB")), "uk_register")
    assert {r.source_id for r in held.table("facts").select("source_id").distinct().collect()} == {"us_petitions", "uk_register"}
    assert [r.status for r in held.runs().collect()] == ["success"] * 12


def test_a_load_that_dies_leaves_the_old_state(spark, tmp_path):
    held = loads.CompanyStore(spark, str(tmp_path))
    held.load(batch(spark, 0), "us_petitions")
    before, reader = everything(held), held.table("companies")
    broken = batch(spark, 1).withColumn("value", F.when(F.col("seq") == 10, F.raise_error(F.lit("bad row"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="bad row"):
        held.load(broken, "us_petitions")
    with pytest.raises(KeyError, match="unknown source id"):
        held.load(batch(spark, 1), "nowhere")
    assert everything(held) == before and reader.count() == len(before["companies"])
    failed = held.runs().where("status <> 'success'").collect()
    assert [(r.status, r.rows_ingested) for r in failed] == [("failed", 0)] and "bad row" in failed[0].notes
    # a load that began on the same state and is published second is refused, not merged half
    stale = held.manifest()
    held.manifest = lambda: stale
    held.load(batch(spark, 2), "us_petitions")
    with pytest.raises(RuntimeError, match="another load"):
        held.load(batch(spark, 3), "us_petitions")


def test_curated_aliases(spark, tmp_path):
    held = loads.CompanyStore(spark, str(tmp_path))
    held.load(batch(spark, 0), "us_petitions")
    pairs = spark.createDataFrame([("Acme 2 LLC", "Two Acme", "US"), ("ACME 2", "al 2", "US"), ("Nobody", "No", "US"), ("Acme 2", "x", "GB")], "canonical_name string, alias string, country string")
    n, missing = held.seed_aliases(pairs)
    assert n == 2 and sorted(r.canonical_name for r in missing.collect()) == ["Acme 2", "Nobody"]
    assert {(r.alias, r.source) for r in held.table("aliases").where("normalized_alias in ('two acme', 'al 2')").collect()} == {("Two Acme", "seed"), ("al 2", "etl:us_petitions")}


def test_new_ids_have_no_gaps_and_order_names_a_company(spark):
    held = spark.createDataFrame([(41, "Old Name", "old name", "US")], "company_id long, canonical_name string, normalized_name string, country string")
    rows = [(5, "Old  Name Inc", "US"), (9, " Acme Ltd ", "US"), (7, "Acme Inc ", "US"), (8, "ACME", "GB"), (1, "  ", "US"), (2, None, "US")] + [(100 + i, f"firm no {i}", "CA") for i in range(300)]
    after = store.upsert_companies(held, spark.createDataFrame(rows, "seq long, company_name string, country string"), lots=16).collect()
    assert sorted(r.company_id for r in after) == list(range(41, 41 + 303))
    assert {(r.canonical_name, r.country) for r in after if r.normalized_name == "acme"} == {("Acme Inc", "US"), ("ACME", "GB")}
    assert [r.canonical_name for r in after if r.normalized_name == "old name"] == ["Old Name"]


CELLS = [["Positive assessments, Q1"], [], ["", "Employer Name", "Approved Positions", "Approved LMIAs", "Province"], ["", "Firm, One", "3", "1", "Ontario"], ["", "Firm \"Two\"\nof Ålesund", "1,000", "-", ""], ["", "Firm, One", "4", "2", "Québec"], ["", "Total", "1007", "3"]]


def workbook(path, rows):
    """A workbook of shared, inline and plain cells, empty ones left out."""
    shared, lines = [], []
    for i, row in enumerate(rows):
        cells = []
        for j, value in enumerate(row):
            at = f"{chr(65 + j)}{i + 1}"
            text = value.replace("&", "&amp;").replace("<", "&lt;")
            if value.isdigit():
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
            elif value and (i + j) % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
            elif value:
                cells.append(f'<c r="{at}" t="s"><v>{len(shared)}</v></c>')
                shared.append(f"<si><r><t>{text[:2]}</t></r><r><t xml:space='preserve'>{text[2:]}</t></r></si>" if j % 2 else f"<si><t>{text}</t></si>")
        if row:
            lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="rId7"/><sheet name="B" sheetId="2" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(shared)}</sst>")
        book.writestr("xl/worksheets/first.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")


def test_a_workbook_equals_its_csv(spark, tmp_path):
    import csv

    workbook(tmp_path / "list-2024-03-31.xlsx", CELLS)
    with open(tmp_path / "list-2024-03-31.csv", "w", newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_MINIMAL).writerows([r if r else [""] for r in CELLS])
    text = (tmp_path / "list-2024-03-31.csv").read_text().replace('""Two""', '""Two""')
    assert '"Firm ""Two""\nof' in text
    got = {}
    for kind in ("xlsx", "csv"):
        rows = registry.ingest(spark, "ca_assessments", str(tmp_path / f"*.{kind}"))
        got[kind] = sorted((r.company_name, r.metric, float(r.value), r.year, str(r.published_date), tuple(r.extra.items())) for r in rows.collect())
    assert got["xlsx"] == got["csv"] == [
        ('Firm "Two"\nof Ålesund', "positions", 1000.0, 2024, "2024-03-31", ()),
        ("Firm, One", "assessments", 3.0, 2024, "2024-03-31", (("province", "Ontario"),)),
        ("Firm, One", "positions", 7.0, 2024, "2024-03-31", (("province", "Ontario"),)),
    ]
    assert sheets._column("A1") == 0 and sheets._column("AB7") == 27


def test_ingest_by_source(spark, tmp_path):
    (tmp_path / "hub-2023-01-01.csv").write_text("Fiscal Year,Employer,Initial Approval,Initial Denial,Continuing Approval,Continuing Denial\n2022,Old,1,0,0,0\n")
    (tmp_path / "hub-2024-01-01.csv").write_text("Fiscal Year,Employer,Initial Approval,Initial Denial,Continuing Approval,Continuing Denial\n2023,Acme,1,0,2,0\n")
    rows = registry.ingest(spark, "us_petitions", str(tmp_path / "hub-*.csv")).collect()
    assert {(r.company_name, str(r.published_date)) for r in rows} == {("Acme", "2024-01-01")} and len(rows) == 4
    with pytest.raises(KeyError, match="unknown source id"):
        registry.ingest(spark, "nowhere", "x")
    with pytest.raises(NotImplementedError, match="no reader"):
        registry.ingest(spark, "us_conditions", "x")
    (tmp_path / "undated.csv").write_text("a\n")
    with pytest.raises(ValueError, match="no date"):
        registry.ingest(spark, "uk_register", str(tmp_path / "undated.csv"))
    (tmp_path / "seeds.csv").write_text("canonical_name,alias,country\n# note\n\nAcme LLC, Acme ,us\n,x,us\n")
    assert [tuple(r) for r in registers.read_aliases(spark, str(tmp_path / "seeds.csv")).collect()] == [("Acme LLC", "Acme", "US")]


def test_resumes_of_every_version(spark):
    rows = [(1, None, "plain text"), (2, 0, "older text"), (3, 1, '{"text":"one","updatedAt":1704067200000}'), (4, 2, '{"text":"two","updatedAt":1704067200000,"embedding":[1.0,0.5]}'), (5, 2, "{broken"), (6, 3, '{"text":"later","updatedAt":1}'), (7, 1, None)]
    got = {r.resume_id: (r.text, r.updated_at.year, r.vector) for r in store.migrate_resumes(spark.createDataFrame(rows, "resume_id int, version int, payload string")).collect()}
    assert got == {1: ("plain text", 1970, None), 2: ("older text", 1970, None), 3: ("one", 2024, None), 4: ("two", 2024, [1.0, 0.5])}
