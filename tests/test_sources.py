"""Readers, sinks, the question router, streams, and the SQL oracles on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerweave.plans import catalog, nlquery
from ledgerweave.sources import readers, sinks
from ledgerweave.streaming import monitor

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_canonical_reader_keeps_physical_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿supplier_id,name,country,registration_id,tax_id,postcode\nS1,"A\nB",GB,,,X\nS2,C,GB,,,Y\n', encoding="utf-8")
    rows = {r.supplier_id: r for r in readers.read_canonical(spark, str(tmp_path / "s.csv")).collect()}
    assert (rows["S1"]["_line"], rows["S2"]["_line"], rows["S2"].lei) == (2, 4, "")


def test_delimited_reader(spark, tmp_path):
    (tmp_path / "v.csv").write_bytes("Extract;;\nLIFNR;NAME1;LAND1\nV1;Müller;DE\nV2;Café;FR\n".encode("cp1252"))
    rows = readers.read_delimited(spark, str(tmp_path / "v.csv"))
    assert rows.columns == ["LIFNR", "NAME1", "LAND1"] and {r.NAME1 for r in rows.collect()} == {"Müller", "Café"}


def test_snapshot_pointer(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.write_snapshot({"t": spark.range(3)}, root)
    sinks.write_snapshot({"t": spark.range(5)}, root)
    assert sinks.read_snapshot(spark, root, "t").count() == 5


def test_questions():
    names, codes = {"S1": "Alpha", "S10": "Beta"}, {"GBP"}
    assert nlquery.parse("total spend for S10", names, codes).suppliers == ("S10",)
    assert nlquery.parse("total spend for S1 in GBP", names, codes).currencies == ("GBP",)
    assert nlquery.parse("total spend in ALL", names, codes).currencies == ("ALL",)
    assert nlquery.parse("spend on zebras", names, codes).intent == "needs_review"
    assert nlquery.parse("find duplicate suppliers", names, codes).intent == "supplier_resolution"


def test_stream_equals_batch(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    s = monitor.events_stream(spark, f"{DIR}/events*.parquet", e.schema)
    got = monitor.run_to_table(monitor.monthly_counts(s), "monthly")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monitor.monthly_counts(e).collect()))


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v).replace("+00:00", "")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    told = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in told.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, DIR).agg(F.count(F.lit(1))).first()[0] >= 0


def test_rows_like_a_banner_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\n,,\nid,name,amount\n,Beta,20\n1,Alpha,30\n2,Gamma,40\n3,Delta,50\n".encode())
    got = readers.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.id or "", r.name, r.amount) for r in got) == [("", "Beta", "20"), ("1", "Alpha", "30"), ("2", "Gamma", "40"), ("3", "Delta", "50")]


def test_encoding_is_told_from_every_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"id,name\n1,Alpha\n2,Beta\n")
    (folder / "b.csv").write_bytes("id,name\n3,Café\n".encode("cp1252"))
    assert sorted((r.id, r.name) for r in readers.read_delimited(spark, str(folder)).collect()) == [("1", "Alpha"), ("2", "Beta"), ("3", "Café")]


def test_snapshot_survives_a_torn_pointer(spark, tmp_path):
    root = str(tmp_path / "root")
    assert not sinks.has_snapshot(spark, root)
    sinks.write_snapshot({"t": spark.range(3)}, root)
    (tmp_path / "root" / "_pointers" / "000000000002-torn").mkdir()  # written, but not whole
    assert sinks.read_snapshot(spark, root, "t").count() == 3
    sinks.write_snapshot({"t": spark.range(4)}, root)
    assert sinks.read_snapshot(spark, root, "t").count() == 4
    import shutil

    shutil.rmtree(tmp_path / "root" / "_pointers")
    (tmp_path / "root" / "_pointers" / "000000000001-torn").mkdir(parents=True)
    with pytest.raises(RuntimeError):
        sinks.has_snapshot(spark, root)
