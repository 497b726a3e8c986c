"""Measures against a worked answer key."""

from __future__ import annotations

import pytest

from sieveline.operators import evaluation as ev

QUERIES = [("Q1", "individual", True, 1, "typo"), ("Q2", "individual", True, 2, "typo"), ("Q3", "individual", True, 3, "token_drop"), ("Q4", "entity", True, 4, "acronym"), ("N1", "individual", False, None, None), ("N2", "entity", False, None, None)]
FOUND = {"Q1": [(1, 0.95)], "Q2": [(9, 0.9), (8, 0.8), (2, 0.7)], "Q3": [(7, 0.6)], "Q4": [(u, 0.9) for u in [*range(20, 30), 4]], "N1": [(5, 0.85)]}


@pytest.fixture(scope="module")
def tables(spark):
    q = spark.createDataFrame([(*r, f"name {r[0]}") for r in QUERIES], "query_id string, subject_type string, is_true_match boolean, source_uid long, perturbation_type string, query_name string")
    c = [(k, i + 1, u, s, k == "Q4", "Someone Else" if u == 7 else f"n{u}") for k, own in FOUND.items() for i, (u, s) in enumerate(own)]
    return q, spark.createDataFrame(c, "query_id string, position int, uid long, score double, ambiguous boolean, matched_name string")


def test_recall(tables):
    got = {r["subject"]: tuple(r)[1:] for r in ev.recall(ev.ranks(*tables)).collect()}
    assert got == {"all": (0.25, 0.5, 0.5, 0.5, 0.75, 4), "individual": (0.3333, 0.6667, 0.6667, 0.6667, 0.6667, 3), "entity": (0.0, 0.0, 0.0, 0.0, 1.0, 1)}
    kinds = {r["perturbation"]: (r["recall"], r["n"]) for r in ev.recall_by_perturbation(ev.ranks(*tables)).collect()}
    assert kinds == {"entity:acronym": (1.0, 1), "individual:token_drop": (0.0, 1), "individual:typo": (1.0, 2)}


def test_operating_points(tables):
    got = {(r["k"], r["floor"]): (r["recall"], r["pairs"], r["queries_with_candidates"]) for r in ev.operating_points(*tables).collect()}
    assert len(got) == 15
    assert got[3, 0.0] == (0.75, 17, 5) and got[3, 0.8] == (0.5, 15, 4) and got[10, 0.5] == (0.75, 17, 5) and got[5, 0.6] == (0.75, 17, 5) and got[10, 0.7] == (0.75, 16, 4)
    none = ev.operating_points(tables[0], tables[1].limit(0)).collect()
    assert len(none) == 15 and {tuple(r)[2:] for r in none} == {(0.0, 0, 0)}


def test_threshold_baseline(tables):
    got = {(r["subject_type"], r["threshold"]): (r["alerts"], r["true_hits_alerted"], r["recall"], r["false_positives"], r["fp_per_true_hit"]) for r in ev.threshold_baseline(*tables).collect()}
    assert len(got) == 8
    assert got["individual", 0.8] == (4, 1, 0.3333, 3, 3.0) and got["individual", 0.95] == (1, 1, 0.3333, 0, 0.0)
    assert got["entity", 0.9] == (11, 1, 1.0, 10, 10.0) and got["entity", 0.95] == (0, 0, 0.0, 0, None)


def test_misses_and_unanswered(spark, tables):
    rows = ev.misses(ev.ranks(*tables), tables[1], spark.createDataFrame([(3, "Three")], "uid long, primary_name string")).collect()
    assert [(r["query_id"], r["source_name"], r["top_candidate"]) for r in rows] == [("Q3", "Three", "Someone Else")]
    assert ev.misses(ev.ranks(*tables), tables[1]).first()["source_name"] is None
    assert [r["query_id"] for r in ev.unanswered(tables[0], tables[1]).collect()] == ["N2"]


def test_no_queries(tables):
    q, c = tables
    assert [tuple(r) for r in ev.recall(ev.ranks(q.limit(0), c)).collect()] in ([], [("all", 0.0, 0.0, 0.0, 0.0, 0.0, 0)])
