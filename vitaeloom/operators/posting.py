"""Typed requirements and signals from the text of postings.

The first line is the title. Short lines with a heading word switch the mode of the lines below and
are no requirements themselves. Statements are kept by mode, the presence of a skill, and requirement
words; repeated ones (but for case) count once, after that choice. Blank postings have no requirement,
unclear signals and null years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeloom.functions.text import clean_text, explode_lines, is_bullet, strip, units, word_count
from vitaeloom.operators.matching import tag_clusters

# Words of headings, by mode; the first mode that fits decides.
HEADINGS = (
    ("preferred", r"preferred|nice[\s-]+to[\s-]+have|bonus|desired|plus(es)?|ideal(ly)?|great[\s-]+to[\s-]+have|extra[\s-]+credit|additional qualifications|good[\s-]+to[\s-]+have"),
    ("required", r"requirements?|qualifications?|minimum|basic|must[\s-]+haves?|what (you|we)('ll| will)? (need|bring|are looking for|look for)|who you are|about you|you have|your (background|experience|profile)|skills?( and experience)?|what it takes|experience"),
    ("responsibilities", r"responsibilities|what you('ll| will)? do|the role|in this role|your (role|mission|impact)|day[\s-]+to[\s-]+day|you will|duties|what you'll be doing|key (tasks|outcomes)"),
    ("boilerplate", r"about (us|the (company|team)|[A-Z]\w+)|benefits|perks|compensation|salary|pay range|why (join|work)|our (mission|values|culture|story)|who we are|the company|equal opportunity|eeo|diversity|how to apply|application process|location|interview process"),
)
# Words of lines that are no requirement, of requirements, and of optional ones.
BOILERPLATE = (
    r"equal[\s-]+opportunity|eeo|discriminat\w*|affirmative action|401\s*\(?k\)?|health(care)?|dental|vision (insurance|coverage)|insurance|pto|paid time off|vacation|parental leave|"
    r"stock options|equity|salary|compensation|bonus structure|wellness|gym|commuter|authori[sz]ed to work|visa|sponsorship|background check|we are (a|an|the) |"
    r"our (mission|office|team|company|customers|culture)|headquartered|founded in|fastest[\s-]+growing|remote[\s-]+first|hybrid|work[\s-]+from[\s-]+home|apply|reasonable accommodation|"
    r"race|religion|gender|sexual orientation|veteran"
)
REQUIREMENT = (
    r"experience|proficien(cy|t)|familiar(ity)?|knowledge|understanding|expertise|background|ability|track record|hands[\s-]+on|fluent|fluency|comfortable|exposure|competen(ce|cy|t)|"
    r"skilled|mastery|degree|ph\.?d|m\.?s\.?c?|b\.?s\.?c?|years?|must|should|strong|solid|deep|working knowledge|contributions?|publications?|demonstrated"
)
OPTIONAL = (
    r"preferred|bonus|(a|big|huge|strong|definite) plus|nice[\s-]+to[\s-]+have|not required|optional|would be (great|nice|a plus|beneficial|welcome)|ideally|is a plus|are a plus|desirable|"
    r"good to have|great to have"
)
# Words of titles and bodies that speak for a track.
TRACKS = {
    "mle": (
        r"machine learning engineer|ml engineer|mle|ai engineer|llm engineer|genai engineer|mlops engineer|ml platform engineer|ml infrastructure",
        r"deploy\w*|production|serving|inference|mlops|latency|scal(e|ing|able)",
    ),
    "applied_scientist": (
        r"applied scientist|applied (ml|machine learning|research) scientist|applied ai",
        r"applied research|prototype\w*|experiment\w* with (new|novel)|state[\s-]+of[\s-]+the[\s-]+art",
    ),
    "data_scientist": (
        r"data scientist|data science|decision scientist|product analyst|analytics engineer",
        r"a/b test\w*|experimentation|statistical|analytics|dashboards?|stakeholders?|insights?|causal inference|hypothesis",
    ),
    "ml_research": (
        r"research scientist|research engineer|ml researcher|member of technical staff|ai researcher|machine learning researcher",
        r"publications?|papers?|neurips|icml|iclr|acl|cvpr|novel (methods?|algorithms?)|phd|research agenda",
    ),
    "data_engineer": (
        r"data engineer|data platform engineer|etl developer|data infrastructure",
        r"data pipelines?|etl|elt|data warehouse\w*|lakehouse|spark|airflow|dbt|kafka|data quality|data modell?ing",
    ),
}
TITLE_WEIGHT = 5
# Words of titles for a level, in the order in which they are tried; years from which a level holds.
LEVELS = (
    ("intern", r"intern(ship)?|co-?op"),
    ("junior", r"junior|jr\.?|entry[\s-]+level|new grad(uate)?|associate|\bI"),
    ("principal", r"principal|distinguished|fellow|\bIV|\bV"),
    ("staff", r"staff|lead|head of|director"),
    ("senior", r"senior|sr\.?|\bIII"),
    ("mid", r"mid[\s-]+level|intermediate|\bII"),
)
# A phrase about years, the words that must stand near it, and how near.
YEARS = r"\b\d{1,2}\s*(?:\+|-|–|to)?\s*(?:\d{1,2})?\s*\+?\s*(?:years?|yrs?)\b"
YEARS_NEAR = ("experience", "background", "track record", "working", "in", "of")
NEAR = 40


def words(pattern: str) -> str:
    return rf"(?iU)\b({pattern})\b"


def heading_mode(line: Column) -> Column:
    """Mode that a heading switches to; null if the line is none."""
    bare = strip(F.regexp_replace(line, ":+$", ""))
    fits = (bare != "") & (F.length(bare) <= 60) & (word_count(bare) <= 8) & ~is_bullet(line) & ~bare.rlike(r"[.,;]$")
    return F.when(fits, F.coalesce(*[F.when(bare.rlike(words(p)), F.lit(m)) for m, p in HEADINGS]))


def posting_lines(postings: DataFrame, key: str = "posting_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, is_title, heading, mode): the lines that aren't blank, with the mode that reaches them."""
    cleaned = postings.select(key, clean_text(F.col(text)).alias("_text"))
    lines = explode_lines(cleaned, "_text", key, keep_blank=False)
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("is_title", F.row_number().over(order) == 1).withColumn("heading", F.when(~F.col("is_title"), heading_mode(F.col("line"))))
    carried = F.last("heading", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("mode", F.coalesce(carried, F.lit("none")))


def requirements(lines: DataFrame, taxonomy: dict[str, list[str]], key: str = "posting_id") -> DataFrame:
    """(key, req_idx, raw_text, requirement_type, clusters) from `posting_lines`."""
    body = lines.where("not is_title and heading is null").select(key, "line_no", "mode", F.posexplode(units(F.col("line"))).alias("unit_no", "raw_text"))
    body = body.withColumn("clusters", tag_clusters(F.col("raw_text"), taxonomy))
    hit, mode, unit = F.size("clusters") > 0, F.col("mode"), F.col("raw_text")
    fits = F.when(mode.isin("required", "preferred"), True).when(mode == "responsibilities", hit).when(mode == "none", hit | unit.rlike(words(REQUIREMENT))).otherwise(False)
    kept = body.where((word_count(unit) >= 3) & ~unit.rlike(words(BOILERPLATE)) & fits)
    first = F.row_number().over(Window.partitionBy(key, F.lower("raw_text")).orderBy("line_no", "unit_no"))
    kept = kept.withColumn("_first", first).where("_first = 1")
    kind = F.when((mode == "preferred") | unit.rlike(words(OPTIONAL)), F.lit("preferred")).otherwise(F.lit("required"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("line_no", "unit_no")) - 1
    return kept.select(key, number.alias("req_idx"), "raw_text", kind.alias("requirement_type"), "clusters")


def track_scores(title: Column, body: Column) -> Column:
    """Array of (score, track) over all tracks."""
    count = lambda c, p: F.coalesce(F.regexp_count(c, F.lit(words(p))), F.lit(0))
    return F.array(*[F.struct((TITLE_WEIGHT * count(title, t) + count(body, t) + count(body, b)).alias("score"), F.lit(k).alias("track")) for k, (t, b) in TRACKS.items()])


def track_vote(title: Column, body: Column) -> Column:
    """Track with the most votes; `unclear` without votes or on a tie."""
    ranked = F.array_sort(track_scores(title, body), lambda a, b: b["score"] - a["score"])
    best, second = ranked[0], ranked[1]
    return F.when((best["score"] == 0) | (best["score"] == second["score"]), F.lit("unclear")).otherwise(best["track"])


def years_asked(text: Column) -> Column:
    """The largest lower bound of the phrases about years that have a context word within NEAR characters; a word cut by that reach counts if what is left of it is one."""
    reach = [(w, NEAR - len(w)) for w in YEARS_NEAR]
    before = "|".join(rf"\b{w}\b[\s\S]{{0,{n}}}|{w}\b[\s\S]{{{n}}}" for w, n in reach)
    after = "|".join(rf"[\s\S]{{0,{n}}}\b{w}\b|[\s\S]{{{n}}}\b{w}" for w, n in reach)
    phrases = F.regexp_extract_all(text, F.lit(rf"(?iU)(?<={before}){YEARS}|{YEARS}(?={after})"), F.lit(0))
    return F.array_max(F.transform(phrases, lambda x: F.regexp_extract(x, r"\d{1,2}", 0).cast("int")))


def seniority(title: Column, years: Column) -> Column:
    named = [F.when(title.rlike(words(p)), F.lit(level)) for level, p in LEVELS]
    by_years = F.when(years < 2, "junior").when(years < 5, "mid").when(years < 8, "senior").when(years >= 8, "staff").otherwise("unclear")
    return F.coalesce(*named, by_years)


def signals(postings: DataFrame, key: str = "posting_id", text: str = "text") -> DataFrame:
    """(key, title, role_track_signal, seniority_signal, years_experience) for every posting."""
    cleaned = postings.select(key, clean_text(F.col(text)).alias("_text"))
    kept = F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x) != "")
    shaped = cleaned.withColumn("_lines", kept).withColumn("title", F.get("_lines", F.lit(0)))
    shaped = shaped.withColumn("_body", F.array_join(F.slice("_lines", 2, 1_000_000), "\n")).withColumn("years_experience", years_asked(F.col("_text")))
    level = F.when(F.col("title").isNull(), "unclear").otherwise(seniority(F.col("title"), F.col("years_experience")))
    return shaped.select(key, "title", track_vote(F.col("title"), F.col("_body")).alias("role_track_signal"), level.alias("seniority_signal"), "years_experience")
