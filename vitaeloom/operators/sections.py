"""Sections of a resume, from line structure alone, with two window passes and no state machine.

A known label (any case) always opens a section. A line in capitals that is no known label opens an
unknown section, except as the first line; inside experience and projects it does so only if neither
of the next two lines holds a date range, unless an unknown section has already begun there. That last
rule is why two passes are enough: the first finds the lines that open one by themselves, the second
spreads that within the stretch up to the next known label.

Defined results: a resume without headers is one `header` section 0; blank lines belong to the section
around them; null lines count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeloom.functions.dates import dates_of
from vitaeloom.functions.text import is_bullet, word_count

# Labels of sections, in lower case.
LABELS = {
    "summary": "summary; professional summary; profile; professional profile; about; about me; objective; career objective; career summary; overview; executive summary; summary of qualifications",
    "experience": "experience; work experience; professional experience; employment; employment history; work history; career history; relevant experience; industry experience; professional background; experience and employment",
    "education": "education; academic background; academics; education and training; qualifications; academic qualifications; education & training",
    "skills": "skills; technical skills; core competencies; competencies; technologies; tech stack; technical stack; tools; tools and technologies; tools & technologies; skills and tools; skills & tools; expertise; technical expertise; areas of expertise; key skills; core skills; technical proficiencies; proficiencies; skills summary; skills & expertise; technical summary; technologies and tools",
    "projects": "projects; personal projects; selected projects; side projects; open source; open-source; open source contributions; key projects; academic projects; research projects; notable projects",
    "certifications": "certifications; certificates; certifications and licenses; licenses and certifications; licenses & certifications; courses; courses and certifications; training; professional development; certifications & training",
    "other": "publications; awards; honors; honours; awards and honors; languages; interests; hobbies; volunteering; volunteer experience; leadership; activities; extracurricular activities; references; patents; talks; presentations; research; teaching; additional information; additional; conferences; memberships",
}
# Words that tell the section where no label does; the first that occurs decides.
LABEL_WORDS = (
    ("other", "volunteer(?:ing)?|publications?|awards?|hono(?:u)?rs|languages?|interests?"),
    ("skills", "skills?|competenc(?:y|ies)|technolog(?:y|ies)|proficienc(?:y|ies)|tools?"),
    ("experience", "experience|employment|work history|career"),
    ("education", "education|academics?"),
    ("projects", "projects?"),
    ("certifications", "certif(?:icate|ication)s?|licen[cs]es?|courses?"),
    ("summary", "summary|profile|objective|about"),
)
DECORATION = r"[\s\-=_—–·•|#*:]+"


def label_of(line: Column) -> Column:
    """A line as a label: without decoration, in lower case, with single blanks."""
    bare = F.regexp_replace(line, rf"(?U)^{DECORATION}|{DECORATION}$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def known_label(label: Column) -> Column:
    """Kind of section that a label names; null if none."""
    exact = [F.when(label.isin(*[x.strip() for x in names.split(";")]), F.lit(kind)) for kind, names in LABELS.items()]
    loose = [F.when(label.rlike(rf"(?U)\b(?:{words})\b"), F.lit(kind)) for kind, words in LABEL_WORDS]
    return F.coalesce(*exact, *loose)


def find_sections(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, line_no, line) → adds has_range, is_header, section_id, kind; columns that come along are kept."""
    seen = lines.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("_dates", dates_of(F.col("line")))
    line, label = F.col("line"), F.col("_label")
    shaped = seen.withColumn("has_range", F.col("_dates.family").isNotNull()).withColumn("_label", label_of(line))
    plain = (line != "") & ~is_bullet(line) & ~line.contains("@") & ~F.col("has_range")
    plain &= ~F.regexp_replace(line, ":+$", "").contains(":") & ~line.contains(",")
    plain &= F.length(label).between(1, 48) & (word_count(label) <= 6) & ~line.rlike(r"(?U)\s[—–|]\s|\sat\s|@")
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    shaped = shaped.withColumn("_known", F.when(plain, known_label(label)))
    shaped = shaped.withColumn("_caps", plain & F.col("_known").isNull() & letters.rlike(r"^\p{Lu}{3,}$"))
    order = Window.partitionBy(key).orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    dated = F.coalesce(F.lead("has_range", 1).over(order), F.lit(False)) | F.coalesce(F.lead("has_range", 2).over(order), F.lit(False))
    base = F.coalesce(F.last("_known", True).over(before), F.lit("header"))
    past = F.coalesce(F.max(F.col("line") != "").over(before), F.lit(False))
    shaped = shaped.withColumn("_span", F.count("_known").over(upto)).withColumn("_open", F.col("_caps") & past & (~base.isin("experience", "projects") | ~dated)).withColumn("_past", past)
    stretch = Window.partitionBy(key, "_span").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max("_open").over(stretch), F.lit(False))
    own = F.coalesce("_known", F.when(F.col("_caps") & F.col("_past") & (F.col("_open") | opened), F.lit("unknown")))
    shaped = shaped.withColumn("_own", own).withColumn("is_header", F.col("_own").isNotNull())
    shaped = shaped.withColumn("section_id", F.count("_own").over(upto)).withColumn("kind", F.coalesce(F.last("_own", True).over(upto), F.lit("header")))
    return shaped.drop("_dates", "_label", "_known", "_caps", "_span", "_open", "_past", "_own")
