"""Name functions: fixed values, properties, agreement of column and plain forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import keys, reference_data, text


@pytest.fixture(scope="module")
def apply(spark):
    def run(fn, values, kind="string"):  # noqa: ANN001, ANN202
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(1)
        return [r["y"] for r in sorted(df.select("i", fn(F.col("x")).alias("y")).collect(), key=lambda r: r["i"])]

    return run


NORMAL = {
    "MUÑOZ": "MUNOZ", "Łukasz": "UKASZ", "Søren": "S REN", "O'Brien": "O BRIEN", "A/S": "A S", "(PVT.) LTD.": "PVT LTD", "M&S": "M AND S", "--.,'": "", "": "",
    "straße": "STRASSE", "  a \t b ": "A B", "ﬁne ½": "FINE 1 2", "日本": "",
}


def test_normalize(apply):
    assert apply(text.normalize, list(NORMAL)) == list(NORMAL.values())
    assert apply(text.normalize, [None]) == [None]


def test_normalize_agrees_with_the_plain_form(apply):
    rng = random.Random(1)
    values = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x1E00, 0x2200)])) for _ in range(12)) for _ in range(500)]
    got = apply(text.normalize, values)
    assert got == [text.py_normalize(v) for v in values]
    assert apply(text.normalize, got) == got  # idempotent


FORMS = {
    "MAROC INTERNATIONAL PVT LTD": "MAROC INTERNATIONAL", "OOO STROYINVEST OOO": "STROYINVEST", "XYZ HOLDINGS LTD": "XYZ HOLDINGS", "ABC LLC LLC LLC": "ABC",
    "LLC LTD": "LLC", "OOO LLC": "OOO", "TRUST": "TRUST", "BASALT": "BASALT", "": "",
}


def test_legal_forms(apply):
    assert apply(text.strip_legal_forms, list(FORMS)) == list(FORMS.values())
    assert [x.strip() for x in apply(text.strip_legal_suffix, ["MAROC INTERNATIONAL PVT LTD", "OOO STROYINVEST", "TRUST"])] == ["MAROC INTERNATIONAL PVT", "OOO STROYINVEST", ""]
    assert apply(text.find_legal_suffix, ["ABC L L C", "ABC SDN BHD", "ABC", "LTD"]) == ["L L C", "SDN BHD", None, "LTD"]


def test_distinctive_tokens(apply):
    assert apply(text.distinctive_tokens, ["THE BASALT TRADING CO", "A B GROUP LTD", ""]) == [["BASALT"], [], []]


def test_orders_and_parts(apply):
    person = lambda c: text.natural_order(c, F.lit(True))
    firm = lambda c: text.natural_order(c, F.lit(False))
    values = ["DENGIN, Vadim Yevgenyevich", "SMITH,John", "KNOWLES, JR., Samuel"]
    assert apply(person, values) == ["Vadim Yevgenyevich DENGIN", "SMITH,John", "JR., Samuel KNOWLES"]
    assert apply(firm, values) == values
    assert apply(text.title_case, ["AL-ZAWAHIRI o'neil", "élan VITAL"]) == ["Al-Zawahiri O'Neil", "Élan Vital"]
    assert apply(text.feature_type, ["SWIFT/BIC", " Tax ID No. ", "D-U-N-S Number"]) == ["swift_bic", "tax_id_no", "d_u_n_s_number"]
    assert [str(d) if d else None for d in apply(text.listed_date, ["10 Dec 1948", "1 JAN 2001", "circa 1951", "1951", None, ""])] == ["1948-12-10", "2001-01-01", None, None, None, None]
    assert apply(text.years, ["circa 1951 to 2003; 1799, 12000", ""]) == [[1951, 2003], []]
    assert apply(text.fold, ["Muñoz ½", None]) == ["Munoz 1⁄2", None]


SOUNDS = {"MOHAMMED": "MHMT", "MOHAMED": "MHMT", "MUHAMMAD": "MHMT", "HASSAN": "HSN", "HASSEN": "HSN", "HASAN": "HSN", "SHAHRESTANI": "XRSTN", "SHAHRASHTANI": "XRXTN"}


def test_metaphone():
    assert {w: keys.metaphone(w) for w in SOUNDS} == SOUNDS
    assert [keys.metaphone(w) for w in ("KNIGHT", "PHONE", "WRIGHT", "SCHOOL", "XAVIER")][1] == "FN"


def test_phonetic_keys(apply):
    assert apply(keys.phonetic_keys, ["AL BIN ABU", "MOHAMMED AL HASSAN", "BITBANK3 C4G", ""]) == [["AB", "BN"], ["HSN", "MHMT"], [], []]


def test_acronyms(apply):
    named = lambda c: keys.acronyms(text.normalize(c))
    values = ["CHINA 49 GROUP CO., LIMITED", "SINA COMPOSITE DELIJAN COMPANY", "MAROC INTERNATIONAL PVT LTD", "ALPHA OMEGA"]
    assert apply(named, values) == [["C4G", "C4GC", "C4GCL"], ["SCD", "SCDC"], ["MIP", "MIPL"], []]
    asked = lambda c: F.struct(*[x.alias(n) for n, x in zip("ab", keys.query_acronyms(text.normalize(c), F.lit("entity")), strict=True)])
    assert [tuple(r) for r in apply(asked, ["SCD", "AB", "ALPHA OMEGA SIGMA", "M&S", "SCD LLC"])] == [(["SCD"], []), ([], []), ([], ["AOS"]), ([], ["MAS"]), ([], [])]
    person = lambda c: F.size(keys.query_acronyms(c, F.lit("individual"))[0])
    assert apply(person, ["SCD"]) == [0]


def test_trigrams(spark):
    rows = [("HASSEN", "HASSAN"), ("YAZBECK AHMAD MOHAMAD", "MOHAMAD AHMAD YAZBECK"), ("A", "B"), ("", "A")]
    df = spark.createDataFrame(rows, "a string, b string").select(keys.trigram_similarity(keys.trigrams(F.col("a")), keys.trigrams(F.col("b"))).alias("s"))
    assert [round(r["s"], 6) for r in df.collect()] == [0.4, 1.0, 0.0, 0.0]


def test_fixed_tables():
    assert set(reference_data.SIBLINGS["MOHAMMED"]) >= {"MUHAMMAD", "MOHAMED"} and "MOHAMMED" not in reference_data.SIBLINGS["MOHAMMED"]
    assert all(a in reference_data.SIBLINGS[b] for a, own in reference_data.SIBLINGS.items() for b in own)
    assert reference_data.JURISDICTION["GMBH"] == "Germany" and reference_data.JURISDICTION["SDN BHD"] == "Malaysia"
