"""Machine-readability checks of resumes, from sections and layout tables.

Each resume gets every check once, in the order of the dimension; what wasn't observed is
`not_assessed`, which is neither a pass nor a failure. Layout tables stand for any file reader:
layout_words(doc_id, page, x0, x1, top, page_width), layout_fonts(doc_id, font, n),
layout_lines(doc_id, page, text, top, bottom, page_height), layout_pages(doc_id, page, n_images,
n_tables, n_chars). Documents without rows of a table have no observation from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeloom.functions.dates import dates_of

# Checks in report order with their severity on workday, greenhouse, lever, ashby.
PLATFORMS = ("workday", "greenhouse", "lever", "ashby")
SEVERITY = (
    ("multi_column_layout", "high medium medium medium"),
    ("table_detected", "high low low low"),
    ("text_box_detected", "high high high high"),
    ("non_standard_font", "high medium medium medium"),
    ("image_based_pdf", "high high high high"),
    ("inconsistent_dates", "medium medium medium medium"),
    ("non_standard_section_headers", "medium medium medium medium"),
    ("header_footer_content", "high medium medium medium"),
)
RANK = {"n/a": 0, "low": 1, "medium": 2, "high": 3}
PENALTY = {"n/a": 0, "low": 5, "medium": 15, "high": 25}
FAMILY_WORDS = {"text": "month name and year", "numeric": "numeric month/year", "year": "year only"}
# Patterns of contact data in margins, of symbol fonts, and of fonts drawn by the page itself.
CONTACT = r"(?U)@|\(?\+?\d[\d\s().-]{7,}\d"
SYMBOL_FONT = r"(?i)zapf|dingbat|wingding|webding|symbol|fontawesome|font-awesome|icomoon|material.?icons|glyphicons"
DRAWN_FONT = r"(?i)type3|\bT3\b|unnamed"


def severity_dimension(spark: SparkSession) -> DataFrame:
    """(check_name, check_idx, platform, severity): 8 checks on 4 platforms."""
    rows = [(name, i, p, s) for i, (name, levels) in enumerate(SEVERITY) for p, s in zip(PLATFORMS, levels.split())]
    return spark.createDataFrame(rows, "check_name string, check_idx int, platform string, severity string")


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()])


def resolved_severity(dimension: DataFrame, platform: str | None = None) -> DataFrame:
    """(check_name, check_idx, severity, penalty): of one platform, or the worst over all of them."""
    rows = dimension.where(F.col("platform") == platform) if platform else dimension
    worst = rows.groupBy("check_name", "check_idx").agg(F.max_by("severity", _lookup(RANK, F.col("severity"))).alias("severity"))
    return worst.withColumn("penalty", _lookup(PENALTY, F.col("severity")))


def full_report(resumes: DataFrame, observed: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, check_idx, check_name, status, location): every check for every resume."""
    names = F.array(*[F.struct(F.lit(i).alias("check_idx"), F.lit(n).alias("check_name")) for i, (n, _) in enumerate(SEVERITY)])
    every = resumes.select(key).distinct().select(key, F.inline(names))
    # Of several observations of a check a failure wins, then the first location by name.
    grade = F.when(F.col("status") == "fail", 0).when(F.col("status") == "pass", 1).otherwise(2)
    first = F.min_by(F.struct("status", "location"), F.struct(grade, F.coalesce("location", F.lit(""))))
    seen = observed.groupBy(key, "check_name").agg(first.alias("_seen")).select(key, "check_name", "_seen.*")
    return every.join(seen, [key, "check_name"], "left").select(key, "check_idx", "check_name", F.coalesce("status", F.lit("not_assessed")).alias("status"), F.coalesce("location", F.lit("")).alias("location"))


def parseability_scores(report: DataFrame, severity: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, parseability, n_failed, n_assessed): 100 less the penalties of failed checks, at least 0."""
    failed = F.col("status") == "fail"
    joined = report.join(severity.select("check_name", "penalty"), "check_name", "left")
    lost = F.coalesce(F.sum(F.when(failed, F.col("penalty"))), F.lit(0))
    return joined.groupBy(key).agg(F.greatest(F.lit(0), 100 - lost).cast("int").alias("parseability"), F.count_if(failed).alias("n_failed"), F.count_if(F.col("status") != "not_assessed").alias("n_assessed"))


def check_dates(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, check_name, status, location): do experience (or else unknown) sections mix families of dates?"""
    has = F.max((F.col("kind") == "experience").cast("int")).over(Window.partitionBy(key))
    picked = lines.withColumn("_has", has).where("kind = if(_has = 1, 'experience', 'unknown') and not is_header and has_range")
    picked = picked.withColumn("_d", dates_of(F.col("line"))).select(key, "line_no", F.col("_d.family").alias("family"), F.col("_d.example").alias("example"))
    families = picked.groupBy(key, "family").agg(F.min("line_no").alias("at"), F.min_by("example", "line_no").alias("example"))
    named = F.concat(F.coalesce(*[F.when(F.col("family") == k, F.lit(v)) for k, v in FAMILY_WORDS.items()]), F.lit(" ("), "example", F.lit(")"))
    mixed = families.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", named.alias("text")))).alias("texts"))
    joined = lines.select(key).distinct().join(mixed, key, "left")
    text = F.concat(F.lit("Experience section mixes "), F.array_join(F.transform("texts", lambda x: x["text"]), "; "))
    bad = F.coalesce(F.col("n"), F.lit(0)) > 1
    return joined.select(key, F.lit("inconsistent_dates").alias("check_name"), F.when(bad, "fail").otherwise("pass").alias("status"), F.when(bad, text).otherwise("").alias("location"))


def check_headers(lines: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, check_name, status, location): are there headers that name no known section?"""
    odd = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.expr("is_header and kind = 'unknown'"), F.struct("line_no", "line")))).alias("odd"))
    bad = F.size("odd") > 0
    text = F.concat(F.lit("Unrecognised section headers: "), F.array_join(F.transform("odd", lambda x: x["line"]), ", "))
    return odd.select(key, F.lit("non_standard_section_headers").alias("check_name"), F.when(bad, "fail").otherwise("pass").alias("status"), F.when(bad, text).otherwise("").alias("location"))


def _status(df: DataFrame, name: str, bad: Column, location: Column) -> DataFrame:
    bad = F.coalesce(bad, F.lit(False))
    return df.select("doc_id", F.lit(name).alias("check_name"), F.when(bad, "fail").otherwise("pass").alias("status"), F.when(bad, location).otherwise("").alias("location"))


def check_columns(words: DataFrame, bins: int = 60, least_words: int = 30, least_rows: int = 6) -> DataFrame:
    """Two columns on a page: a gutter in the middle that no word covers, with enough rows on both sides and enough of them shared."""
    clamp = lambda c: F.least(F.greatest(F.floor(c / F.col("page_width") * bins), F.lit(0)), F.lit(bins - 1))
    good = words.where("page_width > 0 and x0 is not null and x1 is not null")
    pages = good.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    covered = good.select("doc_id", "page", F.explode(F.sequence(clamp(F.col("x0")), clamp(F.col("x1")))).alias("bin")).groupBy("doc_id", "page").agg(F.collect_set("bin").alias("covered"))
    low, high = bins // 4, bins * 3 // 4 - 1
    free = F.array_sort(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda b: ~F.array_contains("covered", b.cast("bigint"))))
    gutters = pages.join(covered, ["doc_id", "page"]).withColumn("free", free).where((F.col("n") >= least_words) & (F.size("free") > 0))
    gutters = gutters.select("doc_id", "page", ((F.element_at("free", (F.size("free") / 2).cast("int") + 1) + 0.5) / bins).alias("share"))
    sided = good.join(gutters, ["doc_id", "page"]).withColumn("gutter", F.col("share") * F.col("page_width")).withColumn("row", F.floor(F.col("top") / 4))
    rows = sided.groupBy("doc_id", "page").agg(F.collect_set(F.expr("if(x1 <= gutter, row, null)")).alias("left_rows"), F.collect_set(F.expr("if(x0 >= gutter, row, null)")).alias("right_rows"))
    two = (F.size("left_rows") >= least_rows) & (F.size("right_rows") >= least_rows) & (F.size(F.array_intersect("left_rows", "right_rows")) >= least_rows)
    found = rows.where(two).groupBy("doc_id").agg(F.min("page").alias("page"))
    return _status(words.select("doc_id").distinct().join(found, "doc_id", "left"), "multi_column_layout", F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string")))


def check_pages(pages: DataFrame, least_chars: int = 40) -> DataFrame:
    """Ruled tables, and pages that are images with hardly any text."""
    docs = pages.groupBy("doc_id").agg(F.min(F.expr("if(n_tables > 0, page, null)")).alias("page"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("images"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    tables = _status(docs, "table_detected", F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string")))
    return tables.unionByName(_status(docs, "image_based_pdf", (F.col("images") > 0) & (F.col("chars") < least_chars), F.lit("no text layer")))


def check_fonts(fonts: DataFrame, cid_share: float = 0.01) -> DataFrame:
    """Symbol fonts, or more than a share of characters without a known code; font '(cid)' counts the latter."""
    docs = fonts.groupBy("doc_id").agg(F.min(F.when(F.col("font").rlike(SYMBOL_FONT) | F.col("font").rlike(DRAWN_FONT), F.col("font"))).alias("symbol"), F.sum(F.when(F.col("font") == "(cid)", F.col("n")).otherwise(0)).alias("cid"), F.sum("n").alias("n"))
    return _status(docs, "non_standard_font", F.col("symbol").isNotNull() | (F.col("cid") > F.col("n") * cid_share), F.coalesce("symbol", F.lit("unmapped characters")))


def check_margins(lines: DataFrame, margin: float = 0.08) -> DataFrame:
    """The same contact line in the top or bottom margin of more than one page."""
    inside = lines.where(F.col("page_height") > 0).withColumn("edge", (F.col("bottom") <= F.col("page_height") * margin) | (F.col("top") >= F.col("page_height") * (1 - margin)))
    repeated = inside.where(F.col("edge") & F.col("text").rlike(CONTACT)).groupBy("doc_id", "text").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first")).where("pages > 1")
    found = repeated.groupBy("doc_id").agg(F.min_by("text", F.struct("first", "text")).alias("text"))
    return _status(lines.select("doc_id").distinct().join(found, "doc_id", "left"), "header_footer_content", F.col("text").isNotNull(), F.col("text"))


def check_docx(parts: DataFrame) -> DataFrame:
    """From sources.files.read_docx: tables, text boxes, columns, symbol fonts, images and header text of DOCX files."""
    found = F.coalesce("margin_text", F.lit("")) != ""
    symbols = F.filter("fonts", lambda f: f.rlike(SYMBOL_FONT))
    chars = F.length(F.regexp_replace(F.concat("body_text", F.array_join("box_texts", "")), r"(?U)\s", ""))
    checks = (
        ("multi_column_layout", F.col("n_columns") >= 2, F.lit("Section formatted with two or more columns")),
        ("table_detected", F.col("n_tables") > 0, F.array_join("table_notes", "; ")),
        ("text_box_detected", F.size("box_texts") > 0, F.concat(F.lit('Text box containing: "'), F.substring(F.array_join("box_texts", " / "), 1, 80), F.lit('"'))),
        ("non_standard_font", F.size(symbols) > 0, F.concat(F.lit("Symbol/icon fonts: "), F.array_join(symbols, ", "))),
        ("image_based_pdf", (F.col("n_images") > 0) & (chars < 40), F.lit("Document is images only, no text")),
        ("header_footer_content", found, F.concat(F.lit("Content in the document "), "margin_zone", F.lit(': "'), F.substring("margin_text", 1, 60), F.lit('"'))),
    )
    out = [_status(parts, *c) for c in checks]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


def check_view(report: DataFrame, dimension: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, check_idx, label, status, location, one severity column per platform)."""
    wide = dimension.groupBy("check_name").pivot("platform", list(PLATFORMS)).agg(F.first("severity"))
    label = F.concat(F.upper(F.substring("check_name", 1, 1)), F.translate(F.expr("substring(check_name, 2)"), "_", " "))
    return report.join(wide, "check_name", "left").select(key, "check_idx", label.alias("label"), "status", "location", *PLATFORMS)
