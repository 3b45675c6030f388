import random

import pytest
from pyspark.sql import functions as F

from vitaeloom.functions import text as tx
from vitaeloom.functions.dates import first_range
from vitaeloom.operators import checks, resume
from vitaeloom.operators.sections import LABEL_WORDS, LABELS, find_sections

CLEAN = """MARA LINDQVIST
Austin, TX | mara@site.example | (512) 555-0143

SUMMARY
Builds things.

EXPERIENCE
Senior ML Engineer — Orbital Works, Austin, TX
Mar 2021 – Present
• Built a ranking service
• Cut latency
and costs
Data Scientist at Plain Labs | Jun 2018 – Feb 2021
• Tested models

EDUCATION
M.S. Statistics, University of Somewhere, 2016 – 2018
B.S. Mathematics, Other College, 2016

SKILLS
Languages: Python, SQL, Go
Tools: CI/CD; Spark | python

PROJECTS
Paper Trail 2020
A reader for forms
and letters
• Parsed 10k forms
Second Thing
• Did more"""

CREATIVE = """Someone Else
MY JOURNEY
Analyst, Acme Corp
2019 – 2021
- Did analysis
TOOLBOX
Sql and more"""


@pytest.fixture(scope="module")
def lines(spark):
    df = spark.createDataFrame([("a", CLEAN), ("b", CREATIVE), ("c", None), ("d", "")], "resume_id string, text string")
    return find_sections(tx.explode_lines(df, "text", "resume_id")).cache()


def test_kinds(lines):
    heads = lambda i: [(r["line"], r["kind"]) for r in lines.where(f"resume_id = '{i}' and is_header").orderBy("line_no").collect()]
    assert heads("a") == [("SUMMARY", "summary"), ("EXPERIENCE", "experience"), ("EDUCATION", "education"), ("SKILLS", "skills"), ("PROJECTS", "projects")]
    assert heads("b") == [("MY JOURNEY", "unknown"), ("TOOLBOX", "unknown")]
    assert lines.where("resume_id = 'd'").count() == 1


def test_entities(lines):
    b = resume.basics(lines).where("resume_id = 'a'").first()
    assert (b["name"], b["email"], b["phone"], b["location"]) == ("MARA LINDQVIST", "mara@site.example", "(512) 555-0143", "Austin, TX")
    work = resume.work_entries(lines).orderBy("resume_id", "entry_idx").collect()
    assert [(w["company"], w["position"], w["start_date"], w["end_date"], len(w["bullets"])) for w in work] == [
        ("Orbital Works", "Senior ML Engineer", "2021-03", "present", 2),
        ("Plain Labs", "Data Scientist", "2018-06", "2021-02", 1),
        ("Acme Corp", "Analyst", "2019", "2021", 1),
    ]
    assert work[0]["bullets"][1] == "Cut latency and costs"
    education = resume.education(lines).orderBy("entry_idx").collect()
    assert [(e["degree"], e["institution"], e["dates"]) for e in education] == [("M.S. Statistics", "University of Somewhere", "2016 – 2018"), ("B.S. Mathematics", "Other College", "2016")]
    skills = [r["raw_text"] for r in resume.skills(lines).orderBy("skill_idx").collect()]
    assert skills == ["Python", "SQL", "Go", "CI", "CD", "Spark"]
    projects = resume.projects(lines).orderBy("project_idx").collect()
    assert [(p["name"], p["description"], p["bullets"]) for p in projects] == [("Paper Trail", "A reader for forms and letters", ["Parsed 10k forms"]), ("Second Thing", None, ["Did more"])]


def test_checks(spark, lines):
    seen = {(r["resume_id"], r["check_name"]): (r["status"], r["location"]) for r in checks.check_dates(lines).unionByName(checks.check_headers(lines)).collect()}
    assert seen["a", "inconsistent_dates"][0] == "pass" and seen["a", "non_standard_section_headers"][0] == "pass"
    assert seen["b", "non_standard_section_headers"] == ("fail", "Unrecognised section headers: MY JOURNEY, TOOLBOX")


def brute(lines: list[str]) -> list[str]:
    """Section kinds by a plain state machine."""
    import re

    def label(line):
        return re.sub(r"\s+", " ", re.sub(r"^[\s\-=_—–·•|#*:]+|[\s\-=_—–·•|#*:]+$", "", line)).strip().lower()

    def plain(line):
        if not line or re.match(r"\s*[•-]\s+", line) or "@" in line or first_range(line) or ":" in line.rstrip(":") or "," in line:
            return False
        return 0 < len(label(line)) <= 48 and len(label(line).split()) <= 6

    def known(line):
        if not plain(line):
            return None
        for kind, names in LABELS.items():
            if label(line) in [n.strip() for n in names.split(";")]:
                return kind
        return next((k for k, w in LABEL_WORDS if re.search(rf"\b(?:{w})\b", label(line))), None)

    out, current, seen = [], "header", False
    for i, line in enumerate(lines):
        kind = known(line)
        letters = [c for c in line if c.isalpha()]
        caps = plain(line) and kind is None and len(letters) >= 3 and all(c.isupper() for c in letters)
        if kind:
            current = kind
        elif caps and seen and (current not in ("experience", "projects") or not any(first_range(x) for x in lines[i + 1 : i + 3])):
            current = "unknown"
        out.append(current)
        seen = seen or bool(line)
    return out


def test_two_passes_equal_the_state_machine(spark):
    rng = random.Random(5)
    pool = ["ACME CORP", "EXPERIENCE", "Projects", "", "2019 – 2021", "- did it", "some words", "MY JOURNEY", "Skills", "Summary:", "ODD, ONE", "TOOLS"]
    docs = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(400)]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "resume_id int, text string")
    got: dict[int, list[str]] = {}
    for r in find_sections(tx.explode_lines(df, "text", "resume_id")).orderBy("resume_id", "line_no").select("resume_id", "kind").collect():
        got.setdefault(r["resume_id"], []).append(r["kind"])
    assert all(got[i] == brute(d) for i, d in enumerate(docs))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "resume_id string, line_no int, line string")
    found = find_sections(empty)
    for f in (resume.basics, resume.work_entries, resume.education, resume.skills, resume.projects):
        assert f(found).count() == 0


def test_layout_checks(spark):
    words = [("two", 1, 10.0 if i % 2 else 320.0, 250.0 if i % 2 else 560.0, float(i // 2 * 12), 600.0) for i in range(60)]
    words += [("one", 1, 10.0, 560.0, float(i * 12), 600.0) for i in range(40)]
    got = {r["doc_id"]: r["status"] for r in checks.check_columns(spark.createDataFrame(words, "doc_id string, page int, x0 double, x1 double, top double, page_width double")).collect()}
    assert got == {"two": "fail", "one": "pass"}
    pages = spark.createDataFrame([("t", 1, 0, 1, 500), ("i", 1, 1, 0, 3), ("ok", 1, 0, 0, 900)], "doc_id string, page int, n_images int, n_tables int, n_chars int")
    got = {(r["doc_id"], r["check_name"]): r["status"] for r in checks.check_pages(pages).collect()}
    assert got["t", "table_detected"] == got["i", "image_based_pdf"] == "fail" and got["ok", "table_detected"] == "pass"
    fonts = spark.createDataFrame([("s", "Wingdings", 3), ("c", "Arial", 97), ("c", "(cid)", 3), ("ok", "Arial", 5), ("z", "ZapfDingbats", 1), ("u", "unnamed", 1), ("n", "Silicon Sans", 1)], "doc_id string, font string, n int")
    assert {r["doc_id"]: r["status"] for r in checks.check_fonts(fonts).collect()} == {"s": "fail", "c": "fail", "ok": "pass", "z": "fail", "u": "fail", "n": "pass"}
    margins = spark.createDataFrame([("r", 1, "me@x.example", 770.0, 790.0, 800.0), ("r", 2, "me@x.example", 770.0, 790.0, 800.0), ("o", 1, "me@x.example", 770.0, 790.0, 800.0)], "doc_id string, page int, text string, top double, bottom double, page_height double")
    assert {r["doc_id"]: r["status"] for r in checks.check_margins(margins).collect()} == {"r": "fail", "o": "pass"}


def test_parseability_goldens(spark):
    ids = spark.createDataFrame([("m",), ("t",)], "resume_id string")
    seen = spark.createDataFrame([("m", "inconsistent_dates", "fail", ""), ("t", "table_detected", "fail", "")], "resume_id string, check_name string, status string, location string")
    dim = checks.severity_dimension(spark)
    report = checks.full_report(ids, seen)
    assert report.count() == 16
    score = lambda p: {r["resume_id"]: r["parseability"] for r in checks.parseability_scores(report, checks.resolved_severity(dim, p)).collect()}
    assert score(None) == {"m": 85, "t": 75}
    assert score("workday")["t"] == 75 and score("lever")["t"] == 95
    assert checks.check_view(report, dim).where(F.col("status") == "fail").count() == 2
