import json

import numpy as np
import pytest

from vitaeloom.llm.pii import Finder, estimate, find_spans, first_names, proposals, redact

TEXT = """MARA T. LINDQVIST
Velmouth · E-mail: mara.l [at] webmail [dot] example · Tel. +44 (0)7700 900123
12b Copper Street, Flat 9, Velmouth 45763

EXPERIENCE
Data Engineer at Lindqvist Shipping Group
2019-05 - 2020-09
- Moved 110 555 000 rows in 5 hours
- Closed ticket INC-6383867 and 43 others; build 10.4.3.209
- Reference: Joris Kestenmark, Product Analyst (JORIS@MAIL.EXAMPLE / 284/555-0189)
Emergency contact Ada Derantin, (030) 23125 340
Right to work documents on file - SSN 666-43-4557, valid until 2027
c/o Joris Kestenmark, Ospreyplatz 57
See @retry helpers; mail lost maraweb.example"""

WANT = {
    ("name", "mara t lindqvist"), ("name", "joris kestenmark"), ("name", "ada derantin"), ("email", "mara.l@webmail.example"), ("email", "joris@mail.example"), ("phone", "4407700900123"),
    ("phone", "2845550189"), ("phone", "03023125340"), ("address", "12b copper street"), ("address", "ospreyplatz 57"), ("identity", "666434557"),
}


@pytest.fixture(scope="module")
def names(spark):
    return first_names(spark.createDataFrame([("Mara Lindqvist",), ("Mara X",), ("Joris K",), ("Joris L",), ("Ada D",), ("Ada E",), (None,), ("",)], "full_name string"), "full_name")


def rows(spark, extra=()):
    base = [("r.raw_text", f"r{i}", TEXT, False) for i in range(4)] + [("r.email", "e1", "Ada Derantin <ada+cv@box.invalid>", False), ("r.email", "e2", "n/a", False), ("r.phone", "p1", "Tel: 01.99.00.67.43 (evenings)", False), ("r.phone", "p2", "12345", False)]
    base += [("r.raw_text", "null", None, False), ("r.raw_text", "empty", "", False), (None, "x", "y", False), ("j", "j1", json.dumps({"b": {"name": "Ada Derantin", "company": "Ada Derantin Foods", "n": 3}}), True), ("j", "j2", "{no json", True)]
    return spark.createDataFrame(base + list(extra), "field string, rec_id string, text string, is_json boolean")


def test_found(spark, names):
    got: dict = {}
    for r in find_spans(rows(spark), names).collect():
        got.setdefault(r["rec_id"], set()).add((r["pii_kind"], r["pii_value"]))
    assert got["r0"] == WANT
    assert got["e1"] == {("name", "ada derantin"), ("email", "ada+cv@box.invalid")}
    assert got["p1"] == {("phone", "0199006743")} and got["j1"] == {("name", "ada derantin")}
    assert not {"e2", "p2", "null", "empty", "j2"} & set(got)


def test_redaction(spark, names):
    df = rows(spark)
    out = {r["rec_id"]: r["text"] for r in redact(df, find_spans(df, names)).collect()}
    assert out["r0"].splitlines()[0] == "[NAME]" and "Moved 110 555 000 rows" in out["r0"] and "[ADDRESS], Flat 9" in out["r0"]
    assert not any(v in out["r0"].lower() for v in ("lindqvist\n", "900123", "joris", "copper"))
    assert json.loads(out["j1"]) == {"b": {"name": "[NAME]", "company": "Ada Derantin Foods", "n": 3}}
    assert out["null"] is None and out["empty"] == "" and out["j2"] == "{no json"


def test_empty(spark, names):
    assert find_spans(rows(spark).limit(0), names).count() == 0


def test_held_out_labels_of_the_estimate():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where(rng.random(4000) < a, 1, -1) * np.where(truth, 1, -1)) for a in (0.9, 0.8, 0.75, 0.6)], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, right, share = estimate(patterns, counts)
    assert abs(share - 0.6) < 0.05 
    best = votes @ np.log(np.array([9, 4, 3, 1.5])) + np.log(1.5) > 0
    assert ((p[back.ravel()] > 0.5) == truth).mean() > (best == truth).mean() - 0.01
    assert abs(right[0] - 0.9) < 0.05 and right[0] > right[1] > right[3]


def test_look_alikes_are_no_cases():
    find = Finder(frozenset(["mara"]))
    for text in ("Order volume grew from 74 400 to 303 200", "2018-07 – 2022-10", "Paper no. 708-27, pages 114-167", "128 000 calls per day", "the @cached helpers"):
        assert [s for s in find(text, "raw_text") if sum(s[4]) > 0] == []


def test_rare_first_names_stay_known_in_a_large_table(spark):
    rare = spark.createDataFrame([("Zelda A",), ("Zelda B",), ("Once C",)], "full_name string")
    many = rare.unionByName(spark.range(30_000).selectExpr("'Mara X' as full_name"))
    assert {r["first"] for r in first_names(many, "full_name").collect()} == {"Mara", "Zelda"}


def test_names_by_join_equal_names_by_broadcast(spark, names):
    found = [sorted(map(str, proposals(rows(spark), names, most).collect())) for most in (0, 100)]
    assert found[0] == found[1] and any("pii_kind='name'" in r for r in found[0])
