"""List publications and JSON records."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import names_index
from sieveline.sources import records, watchlist

XML = """<?xml version="1.0" encoding="utf-8"?>
<sdnList xmlns="http://tempuri.org/sdnList.xsd">
  <publshInformation><Publish_Date>01/01/2026</Publish_Date></publshInformation>
  <sdnEntry><uid>1</uid><firstName> Vadim Yevgenyevich </firstName><lastName>DENGIN</lastName><sdnType>Individual</sdnType>
    <programList><program>UKRAINE</program><program> </program><program>RUSSIA</program></programList>
    <akaList><aka><uid>9</uid><type>a.k.a.</type><category>strong</category><lastName>DENGIN</lastName><firstName>Vadim</firstName></aka>
      <aka><type>a.k.a.</type><category>Weak</category><lastName>DENGIN</lastName><firstName>V.</firstName></aka><aka><type>a.k.a.</type></aka></akaList>
    <dateOfBirthList><dateOfBirthItem><dateOfBirth>10 Dec 1948</dateOfBirth></dateOfBirthItem><dateOfBirthItem><dateOfBirth>circa 1951</dateOfBirth></dateOfBirthItem></dateOfBirthList>
    <placeOfBirthList><placeOfBirthItem><placeOfBirth>Kazan, Russia</placeOfBirth></placeOfBirthItem></placeOfBirthList>
    <nationalityList><nationality><country>Russia</country></nationality></nationalityList>
    <citizenshipList><citizenship><country>Russia</country></citizenship></citizenshipList>
    <idList><id><idType>Passport No.</idType><idNumber>123</idNumber><idCountry>Russia</idCountry><issueDate>02 Feb 2002</issueDate></id><id><idType>Gender</idType></id></idList>
    <addressList><address><address1>1 Street</address1><address3>Floor 2</address3><city>Moscow</city><country>Russia</country></address><address><uid>5</uid></address></addressList>
  </sdnEntry>
  <sdnEntry><uid>2</uid><lastName>MONONYMOUS</lastName><sdnType>Individual</sdnType></sdnEntry>
  <sdnEntry><uid>3</uid><lastName>CHINA 49 GROUP CO., LIMITED</lastName><sdnType>Entity</sdnType><akaList><aka><lastName>C4G</lastName></aka></akaList></sdnEntry>
  <sdnEntry><uid>5</uid><lastName>MAR AZUL</lastName><sdnType>Vessel</sdnType>
    <vesselInfo><callSign>HABC</callSign><vesselType>Tanker</vesselType><vesselFlag>Panama</vesselFlag><tonnage>100</tonnage></vesselInfo>
    <akaList><aka><lastName>AZUL, MAR</lastName></aka></akaList></sdnEntry>
</sdnList>
"""


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("list")
    (base / "list.xml").write_text(XML)
    counts = watchlist.load(spark, str(base / "list.xml"), str(base / "out"), reset=True)
    return base, counts, watchlist.read_tables(spark, str(base / "out"))


def test_counts_and_entries(loaded):
    _, counts, t = loaded
    assert counts == {"entries": 4, "aliases": 4, "features": 11, "addresses": 1}
    first = t["entries"].where("uid = 1").first()
    assert (first["entry_type"], first["primary_name"], first["first_name"], first["programs"]) == ("individual", "DENGIN, Vadim Yevgenyevich", "Vadim Yevgenyevich", ["UKRAINE", "RUSSIA"])
    assert t["entries"].where("uid = 3").first()["programs"] == []


def test_aliases_and_addresses(loaded):
    t = loaded[2]
    got = {(r["uid"], r["alias_name"], r["is_weak"]) for r in t["aliases"].collect()}
    assert got == {(1, "DENGIN, Vadim", False), (1, "DENGIN, V.", True), (3, "C4G", False), (5, "AZUL, MAR", False)}
    a = t["addresses"].first()
    assert (a["uid"], a["address"], a["city"], a["country"]) == (1, "1 Street, Floor 2", "Moscow", "Russia")


def test_features(loaded):
    got = [(r["uid"], r["feature_type"], r["value_text"], r["value_date"], r["value_country"]) for r in loaded[2]["features"].orderBy("id").collect()]
    assert got == [
        (1, "dob", "10 Dec 1948", datetime.date(1948, 12, 10), None), (1, "dob", "circa 1951", None, None), (1, "place_of_birth", "Kazan, Russia", None, None),
        (1, "nationality", "Russia", None, None), (1, "citizenship", "Russia", None, None), (1, "passport_no", "123", datetime.date(2002, 2, 2), "Russia"), (1, "gender", None, None, None),
        (5, "vessel_call_sign", "HABC", None, None), (5, "vessel_vessel_type" if False else "vessel_type", "Tanker", None, None), (5, "vessel_flag", "Panama", None, None), (5, "vessel_tonnage", "100", None, None),
    ]


def test_appending_limits_and_violations(spark, loaded):
    base, _, t = loaded
    assert {r["n"] for r in watchlist.violations(t).collect()} == {0}
    out = str(base / "again")
    assert watchlist.load(spark, str(base / "list.xml"), out, reset=True, limit=2)["entries"] == 2
    assert watchlist.load(spark, str(base / "list.xml"), out)["entries"] == 6
    wrong = watchlist.read_tables(spark, out) | {"aliases": t["aliases"].withColumn("uid", F.col("uid") + 100)}
    found = {r["rule"]: r["n"] for r in watchlist.violations(wrong).collect()}
    assert found["duplicate_uid"] == 2 and found["aliases_without_entry"] == 4


def test_index_fixture(spark):
    entries = spark.createDataFrame(
        [(1, "individual", "Vadim Yevgenyevich", "DENGIN", "DENGIN, Vadim Yevgenyevich"), (2, "individual", None, "MONONYMOUS", "MONONYMOUS"), (3, "entity", None, "CHINA 49 GROUP CO., LIMITED", "CHINA 49 GROUP CO., LIMITED"),
         (4, "entity", None, None, "FALLBACK PRIMARY LLC"), (5, "vessel", None, "MAR AZUL", "MAR AZUL"), (6, "entity", None, "---", "---")],
        "uid long, entry_type string, first_name string, last_name string, primary_name string",
    )
    aliases = spark.createDataFrame([(1, 1, "DENGIN, Vadim", False), (2, 1, "DENGIN, V.", True), (3, 3, "C4G", False), (4, 5, "AZUL, MAR", False)], "id long, uid long, alias_name string, is_weak boolean")
    names = names_index.build(entries, aliases)
    rows = names.orderBy("name_id").collect()
    assert [r["display"] for r in rows] == ["Vadim Yevgenyevich DENGIN", "MONONYMOUS", "CHINA 49 GROUP CO., LIMITED", "FALLBACK PRIMARY LLC", "MAR AZUL", "Vadim DENGIN", "V. DENGIN", "C4G", "AZUL, MAR"]
    assert [r["name_kind"] for r in rows] == ["primary"] * 5 + ["alias"] * 4
    assert all((r["stem"] is None) == (r["entry_type"] == "individual") for r in rows)
    assert rows[2]["acronyms"] == ["C4G", "C4GC", "C4GCL"] and rows[2]["stem"] == "CHINA 49 GROUP" and rows[0]["acronyms"] == []
    assert names_index.differences(names, names).count() == 0
    changed = names.withColumn("display", F.when(F.col("uid") == 2, "X").otherwise(F.col("display")))
    assert {r["side"] for r in names_index.differences(changed, names).collect()} == {"fresh", "stored"}
    groups = {r["acronym"]: (r["n_rows"], r["n_uids"], r["uids"]) for r in names_index.acronym_groups(names).collect()}
    assert groups["C4G"] == (1, 1, [3])


def test_json_records(spark, tmp_path):
    lines = [{"query_id": "P-1", "query_name": "Ünï", "split": "dev", "query_attributes": {"city": "X"}, "is_true_match": True}, {"query_id": "N-1", "split": "test", "is_true_match": False}]
    (tmp_path / "q.jsonl").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\n")
    all_rows = records.read_queries(spark, str(tmp_path / "q.jsonl"))
    assert all_rows.count() == 2 and records.read_queries(spark, str(tmp_path / "q.jsonl"), "dev").first()["query_attributes"]["city"] == "X"
    records.write_json(all_rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "Ünï" in text and "null" not in text
    back = records.read_queries(spark, str(tmp_path / "out"))
    assert sorted(back.collect(), key=lambda r: r["query_id"]) == sorted(all_rows.collect(), key=lambda r: r["query_id"])
    body = json.loads(records.report_row(all_rows.select("query_id", "split"), "r").first()["body"])
    assert body == [{"query_id": "N-1", "split": "test"}, {"query_id": "P-1", "split": "dev"}]
