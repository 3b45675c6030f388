"""Registered queries over the tables of a folder; each reads its whole tables.

Where a table lacks a column that an operator needs, a stand-in is named in the query: vectors of
`embeddings` stand for requirement and line vectors, labels for clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeloom.functions import text as tx
from vitaeloom.operators import checks, embed, jobs, matching, posting, report, resume, retrieval, scoring, sections, terms
from vitaeloom.session import durable, spread, table
from vitaeloom.sources import dimensions
from vitaeloom.streaming import limiter

def _forms(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    return matching.compile_taxonomy(table(spark, folder, "surface_forms"))


def _tagged(spark: SparkSession, folder: str, rows: DataFrame, *keys: str) -> DataFrame:
    return matching.with_clusters(rows, "raw_text", table(spark, folder, "surface_forms"), *keys)


def _asked(spark: SparkSession, folder: str, unpacked: DataFrame) -> DataFrame:
    """Requirements of jobs with the clusters of their texts."""
    return _tagged(spark, folder, jobs.job_requirements(unpacked).drop("clusters"), "id", "req_idx")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of resumes, each once, with their clusters."""
    rows = spread(table(spark, folder, "resume_lines"), "line_id").dropDuplicates(["line_id"])
    return rows.withColumn("clusters", F.coalesce("matched_clusters", F.array().cast("array<string>"))).drop("matched_clusters")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.unpack_inputs(jobs.current_jobs(table(spark, folder, "jobs").select("id", "status", "input_json", "created_at", "updated_at")))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_texts(spark, folder)
    return sections.find_sections(tx.explode_lines(cleaned, "text", "resume_id"))


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return _jobs(spark, folder).select(F.col("id").alias("posting_id"), F.col("inputs.jd.raw_text").alias("text"))


# Text and lines.


def text_lines(spark, folder):
    lines = tx.explode_lines(table(spark, folder, "resumes"), "raw_text", "resume_id", keep_blank=False)
    return lines.select("resume_id", F.col("line_no").cast("bigint").alias("line_no"), tx.is_bullet(F.col("line")).alias("is_bullet"), tx.strip_bullet(F.col("line")).alias("content"))


def clean_texts(spark, folder):
    rows = spread(table(spark, folder, "resumes").select("resume_id", "raw_text"), "resume_id")
    return rows.select("resume_id", tx.clean_text(F.col("raw_text")).alias("text"))


def sentence_units(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(tx.units(F.col("text"))).alias("unit_no", "unit")).select("doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), "unit")


def clipped_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.clip(F.col("text")).alias("clipped"))


def document_terms(spark, folder):
    words = tx.terms(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_terms"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


def reading_ease(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(tx.reading_ease(F.col("text")), 6).alias("ease"))


def number_guard(spark, folder):
    docs = table(spark, folder, "documents").where("title is not null")
    return docs.select("doc_id", tx.adds_numbers(F.col("title"), F.col("text")).alias("adds_numbers"))


# Taxonomy.


def line_clusters(spark, folder):
    return _tagged(spark, folder, _lines(spark, folder).select("line_id", "raw_text"), "line_id").select("line_id", F.explode("clusters").alias("cluster_id"))


def line_cluster_order(spark, folder):
    return _tagged(spark, folder, _lines(spark, folder).select("line_id", "raw_text"), "line_id").select("line_id", F.array_join("clusters", ",").alias("clusters"))


def mention_counts(spark, folder):
    spans = _lines(spark, folder).select(F.explode(matching.mention_spans(F.col("raw_text"), _forms(spark, folder))).alias("m"))
    return spans.groupBy(F.col("m.cluster_id").alias("cluster_id"), F.lower("m.form").alias("form")).agg(F.count("*").alias("mentions"))


def equivalent_phrasings(spark, folder):
    skills = _lines(spark, folder).where("source = 'skill'").select(F.lower(F.trim("raw_text")).alias("text"), F.explode("clusters").alias("cluster_id"))
    return matching.equivalent_phrasings(skills)


def equivalence_chunks(spark, folder):
    return dimensions.equivalence_chunks(table(spark, folder, "clusters"), table(spark, folder, "surface_forms")).select("chunk_id", "text", "category")


def taxonomy_violations(spark, folder):
    return dimensions.taxonomy_violations(table(spark, folder, "clusters"), table(spark, folder, "surface_forms"), least_forms=6)


def ambiguous_forms(spark, folder):
    return table(spark, folder, "surface_forms").groupBy(F.lower("form").alias("form")).agg(F.count_distinct("cluster_id").alias("clusters")).where("clusters > 1")


# Resumes.


def resume_sections(spark, folder):
    return _sections(spark, folder).groupBy("resume_id", "section_id", "kind").agg(F.count("*").alias("lines"), F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"))


def resume_basics(spark, folder):
    return resume.basics(_sections(spark, folder))


def resume_work(spark, folder):
    return resume.work_entries(_sections(spark, folder))


def resume_education(spark, folder):
    return resume.education(_sections(spark, folder))


def resume_skills(spark, folder):
    found = resume.skills(_sections(spark, folder))
    return _tagged(spark, folder, found, "resume_id", "skill_idx").withColumn("clusters", F.array_join("clusters", ","))


def resume_projects(spark, folder):
    return resume.projects(_sections(spark, folder))


def contact_fields(spark, folder):
    text = F.col("raw_text")
    return table(spark, folder, "resumes").select("resume_id", resume.first_match(text, resume.EMAIL).alias("email"), resume.first_match(text, resume.PLACE, 1).alias("place"))


def first_skills(spark, folder):
    from pyspark.sql import Window

    rows = _lines(spark, folder).where("source = 'skill' and raw_text is not null")
    first = F.row_number().over(Window.partitionBy("resume_id", F.lower("raw_text")).orderBy("line_no", "line_id"))
    return rows.withColumn("n", first).where("n = 1").select("resume_id", "line_id", "raw_text")


# Postings.


def posting_modes(spark, folder):
    lines = posting.posting_lines(_postings(spark, folder))
    return lines.where("not is_title").select("posting_id", F.col("line_no").cast("bigint").alias("line_no"), "mode")


def posting_requirements(spark, folder):
    found = posting.requirements(posting.posting_lines(_postings(spark, folder)), _forms(spark, folder))
    return found.withColumn("clusters", F.array_join(F.array_sort("clusters"), ","))


def posting_signals(spark, folder):
    return posting.signals(_postings(spark, folder))


def posting_tracks(spark, folder):
    return posting_signals(spark, folder).where("title is not null").select("posting_id", F.col("role_track_signal").alias("track"))


def track_votes(spark, folder):
    docs = table(spark, folder, "work_entries").where("job_title is not null").select(F.col("job_title").alias("title")).distinct()
    return docs.select("title", posting.track_vote(F.col("title"), F.lit("")).alias("track"))


def title_levels(spark, folder):
    titles = table(spark, folder, "work_entries").where("job_title is not null").select(F.col("job_title").alias("title")).distinct()
    return titles.select("title", posting.seniority(F.col("title"), F.lit(None).cast("int")).alias("level"))


# Checks.


def _job_checks(spark, folder):
    seen = _jobs(spark, folder).select(F.col("id").alias("resume_id"), F.explode("inputs.report.checks").alias("c"))
    name = F.when(F.col("c.check_name") == "section_headers", "non_standard_section_headers").otherwise(F.col("c.check_name"))
    return seen.select("resume_id", name.alias("check_name"), F.col("c.status").alias("status"), F.lit("").alias("location"))


def check_report(spark, folder):
    ids = _jobs(spark, folder).select(F.col("id").alias("resume_id"))
    return checks.full_report(ids, _job_checks(spark, folder)).select("resume_id", "check_idx", "check_name", "status")


def parseability(spark, folder):
    ids = _jobs(spark, folder).select(F.col("id").alias("resume_id"))
    severity = checks.resolved_severity(checks.severity_dimension(spark))
    return checks.parseability_scores(checks.full_report(ids, _job_checks(spark, folder)), severity)


def resume_checks(spark, folder):
    lines = _sections(spark, folder)
    seen = checks.check_dates(lines).unionByName(checks.check_headers(lines))
    return checks.parseability_scores(checks.full_report(lines.select("resume_id"), seen), checks.resolved_severity(checks.severity_dimension(spark)))


# Scores.


def evidence_lines(spark, folder):
    return scoring.evidence_lines(_lines(spark, folder).select("resume_id", "source", "entry_idx", "line_no", "raw_text", "clusters")).select("resume_id", F.col("line_idx").cast("bigint").alias("line_idx"), "raw_text")


def resume_evidence(spark, folder):
    lines = scoring.evidence_lines(_lines(spark, folder).select("resume_id", "source", "entry_idx", "line_no", "raw_text", "clusters"))
    return scoring.resume_clusters(lines)


def _job_skills(spark, folder):
    unpacked = _jobs(spark, folder)
    wanted = scoring.posting_clusters(_asked(spark, folder, unpacked).withColumnRenamed("id", "posting_id"))
    lines = scoring.evidence_lines(jobs.job_lines(unpacked).withColumnRenamed("id", "resume_id"))
    pairs = unpacked.select(F.col("id").alias("resume_id"), F.col("id").alias("posting_id"))
    return pairs, scoring.pair_skills(pairs, scoring.resume_clusters(lines), wanted)


def posting_wants(spark, folder):
    return scoring.posting_clusters(_asked(spark, folder, _jobs(spark, folder)).withColumnRenamed("id", "posting_id"))


def overlap_scores(spark, folder):
    scores = scoring.overlap_scores(*_job_skills(spark, folder))
    return scores.select("resume_id", "taxonomy", *[F.array_join(c, ",").alias(c) for c in ("matched", "missing_required", "missing_preferred")])


def unmatched_skills(spark, folder):
    _, skills = _job_skills(spark, folder)
    return skills.where("state <> 'matched'").select("posting_id", "cluster_id", "state")


def job_blend(spark, folder):
    c = "inputs.result.components"
    return _jobs(spark, folder).where(f"{c} is not null").select("id", scoring.blend(F.col(f"{c}.semantic"), F.col(f"{c}.taxonomy"), F.col(f"{c}.parseability")).alias("overall"))


def job_scores(spark, folder):
    """Whole score of every job's own pair, with the hashed stand-in for a model."""
    unpacked = _jobs(spark, folder)
    pairs, skills = _job_skills(spark, folder)
    asked = jobs.job_requirements(unpacked).select(F.col("id").alias("posting_id"), "req_idx", "requirement_type", embed.vectors(F.col("raw_text"), embed.hashed, embed.QUERY_PREFIX).alias("vector"))
    lines = scoring.evidence_lines(jobs.job_lines(unpacked).withColumnRenamed("id", "resume_id"))
    lines = lines.select("resume_id", "line_idx", embed.vectors(F.col("raw_text"), embed.hashed).alias("vector"))
    semantic = scoring.semantic_scores(pairs, scoring.best_lines(pairs, asked, lines))
    parse = checks.parseability_scores(checks.full_report(pairs.select("resume_id"), _job_checks(spark, folder)), checks.resolved_severity(checks.severity_dimension(spark)))
    return scoring.score_pairs(semantic, scoring.overlap_scores(pairs, skills), parse)


def _vector_sides(spark, folder):
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("label").alias("posting_id"), F.col("vec_id").alias("req_idx"), F.when(F.col("vec_id") % 40 == 0, "required").otherwise("preferred").alias("requirement_type"), F.col("embedding").alias("vector"))
    lines = rows.select((F.col("vec_id") % 16).alias("resume_id"), F.col("vec_id").alias("line_idx"), F.col("embedding").alias("vector"))
    # Every stand-in resume is scored against one posting, numbered by its own number.
    pairs = lines.select("resume_id", (F.col("resume_id") % 10).cast("int").alias("posting_id")).distinct()
    return pairs, asked, lines


def best_lines(spark, folder):
    return scoring.best_lines(*_vector_sides(spark, folder)).select("resume_id", "posting_id", "req_idx", "line_idx", "score")


def semantic_scores(spark, folder):
    pairs, asked, lines = _vector_sides(spark, folder)
    return scoring.semantic_scores(pairs, scoring.best_lines(pairs, asked, lines))


def category_levels(spark, folder):
    weights = table(spark, folder, "surface_forms").groupBy("cluster_id").agg((F.count("*") / 6.0).alias("weight")).withColumn("track", F.lit("mle"))
    return scoring.category_levels(weights, table(spark, folder, "clusters"))


# Retrieval.


def _bm25(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return docs, retrieval.bm25_weights(retrieval.term_counts(docs, "doc_id", "text"), docs, "doc_id")


def bm25_topk(spark, folder):
    _, weights = _bm25(spark, folder)
    found = retrieval.sparse_ranks(table(spark, folder, "eval_items"), weights, "item_id", "doc_id", "question", most=5)
    return found.select("item_id", "doc_id", "rank")


def filtered_search(spark, folder):
    docs, weights = _bm25(spark, folder)
    found = retrieval.sparse_ranks(table(spark, folder, "eval_items"), weights, "item_id", "doc_id", "question", most=5, candidates=docs.where("lang = 'en' and source in ('qa_code', 'helpdesk')"))
    return found.select("item_id", "doc_id", "rank")


def _dense(spark, folder, most, candidates=None):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "q_id")
    held = rows.join(candidates.select("doc_id"), "doc_id", "left_semi") if candidates is not None else rows
    return retrieval.dense_ranks(asked, held, "q_id", "doc_id", most=most)


def dense_topk(spark, folder):
    return _dense(spark, folder, 10).select("q_id", "doc_id", "rank")


def rrf_topk(spark, folder):
    """Documents with a vector of the same number; every document numbered by a multiple of 20 is a query."""
    docs = table(spark, folder, "documents").select("doc_id", "text").join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    weights = retrieval.bm25_weights(retrieval.term_counts(docs, "doc_id", "text"), docs, "doc_id")
    sparse = retrieval.sparse_ranks(docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), "text"), weights, "q_id", "doc_id", "text", most=retrieval.CANDIDATES)
    dense = _dense(spark, folder, retrieval.CANDIDATES, docs)
    return retrieval.fuse(dense, sparse, "q_id", "doc_id").select("q_id", "doc_id", "rank")


def recall_mrr(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = _dense(spark, folder, 10).where("q_id <> doc_id").join(labels, "doc_id")
    cases = labels.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), F.col("label").alias("expected"))
    found = retrieval.evaluate(hits, cases, F.col("label") == F.col("expected"), "q_id")
    return found.select(F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"), "n")


def nearest_label(spark, folder):
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    ranks = _dense(spark, folder, 2).where("q_id <> doc_id").withColumn("rank", F.lit(1))
    first = ranks.groupBy("q_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id")).withColumn("rank", F.lit(1))
    probes = labels.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), "label")
    return retrieval.nearest_label_accuracy(first, probes, labels, "q_id", "doc_id").select(F.round("accuracy", 9).alias("accuracy"), "n")


def auc_labels(spark, folder):
    joined = table(spark, folder, "abuse_labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    found = retrieval.auc(joined.select(F.col("verdict").alias("label"), F.col("n_chars").alias("score")))
    return found.select(F.round("auc", 9).alias("auc"), "positives", "negatives")


# Reports.


def context_numbering(spark, folder):
    lines = _lines(spark, folder).where("source <> 'skill'")
    uses = lines.select("resume_id", F.explode("clusters").alias("chunk_id"), (F.coalesce("entry_idx", F.lit(0)) * 1000 + F.col("line_no")).alias("pos"))
    return report.number_context(uses, "resume_id")


def weak_lines_topn(spark, folder):
    answers = table(spark, folder, "documents").where("post_kind = 'answer' and votes is not null").select("thread_id", F.col("text").alias("line"), F.col("votes").alias("score"), F.col("doc_id").alias("req_idx"))
    return report.weak_lines(answers, "thread_id").select("thread_id", "req_idx", F.col("weak_rank").cast("bigint").alias("weak_rank"))


def grounding_violations(spark, folder):
    lines = _lines(spark, folder)
    context = lines.where("source = 'skill'").select("resume_id", F.explode("clusters").alias("context_id")).distinct().withColumn("text", F.col("context_id"))
    answers = lines.where("source <> 'skill'").select("resume_id", F.col("line_id").alias("answer_id"), F.col("clusters").alias("ids"))
    return report.ground(answers, context, "resume_id")[1]


# Jobs, terms and limits.


def current_jobs(spark, folder):
    return jobs.current_jobs(table(spark, folder, "jobs").select("id", "status", "created_at", "updated_at")).select("id", "status")


def retention_purge(spark, folder):
    rows = jobs.current_jobs(table(spark, folder, "jobs").select("id", "status", "created_at", "updated_at"))
    return jobs.purge(rows, rows.agg(F.max("updated_at").alias("t")).scalar(), dry_run=True)


def term_counts_top(spark, folder):
    log = table(spark, folder, "unmatched_terms").select("submission_id", F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("term")).where("term is not null and term <> ''")
    counts = log.distinct().groupBy("term").agg(F.count("*").alias("count"))
    return terms.top_terms(counts)


def resume_candidate_terms(spark, folder):
    skills = _lines(spark, folder).where("source = 'skill'").select("resume_id", "raw_text", "clusters")
    none = skills.limit(0)
    return terms.candidate_terms(skills, none, "resume_id").select("resume_id", "term")


def submission_terms(spark, folder):
    unpacked = _jobs(spark, folder)
    skills = jobs.job_lines(unpacked).where("source = 'skill'").select("id", "raw_text", "clusters")
    asked = _asked(spark, folder, unpacked).select("id", "raw_text", "clusters")
    return terms.candidate_terms(skills, asked, "id")


def rate_limit_decisions(spark, folder):
    requests = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("request_id"))
    return limiter.decide(requests, limit=3, window=86_400.0)


# Operators whose inputs have no table of their own; every stand-in is named.


def weighted_overlap(spark, folder):
    """Coverage under track weights: those of a category (0.3 and a tenth for each of up to 7 letters of its name), overlaid by 0.95 for clusters whose name is of even length."""
    clusters = table(spark, folder, "clusters")
    tracks = spark.createDataFrame([("mle",), ("data_scientist",)], "track string")
    by_category = clusters.select("category").distinct().crossJoin(tracks).withColumn("weight", F.lit(0.3) + F.lit(0.1) * (F.length("category") % 8))
    own = clusters.where("length(cluster_id) % 2 = 0").select("cluster_id", F.lit("mle").alias("track"), F.lit(0.95).alias("weight"))
    weights = dimensions.track_weights(clusters, by_category, own)
    unpacked = _jobs(spark, folder)
    asked = _asked(spark, folder, unpacked).withColumnRenamed("id", "posting_id")
    lines = scoring.evidence_lines(jobs.job_lines(unpacked).withColumnRenamed("id", "resume_id"))
    track = scoring.resolve_track(F.lit(None).cast("string"), F.col("inputs.jd.role_track_signal"))
    pairs = unpacked.select(F.col("id").alias("resume_id"), F.col("id").alias("posting_id"), track.alias("track"))
    scores = scoring.overlap_scores(pairs, scoring.pair_skills(pairs, scoring.resume_clusters(lines), scoring.posting_clusters(asked), weights))
    return scores.select("resume_id", "taxonomy", *[F.array_join(c, ",").alias(c) for c in ("matched", "missing_required", "missing_preferred")])


def platform_parseability(spark, folder):
    report_ = checks.full_report(_jobs(spark, folder).select(F.col("id").alias("resume_id")), _job_checks(spark, folder))
    dimension = checks.severity_dimension(spark)
    parts = [checks.parseability_scores(report_, checks.resolved_severity(dimension, p)).select("resume_id", F.lit(p).alias("platform"), "parseability") for p in checks.PLATFORMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def check_table(spark, folder):
    report_ = checks.full_report(_jobs(spark, folder).select(F.col("id").alias("resume_id")), _job_checks(spark, folder))
    return checks.check_view(report_, checks.severity_dimension(spark)).drop("location")


def item_labels(spark, folder):
    return report.display_names(table(spark, folder, "clusters"), checks.severity_dimension(spark))


def _answers(spark, folder):
    """Answers stand for rewrites: the first 60 characters for the original, those from the tenth for the rewrite, negative votes for the flag."""
    docs = table(spark, folder, "documents").where("post_kind = 'answer' and text is not null and votes is not null")
    return docs.select("thread_id", F.col("doc_id").alias("rewrite_no"), F.substring("text", 1, 60).alias("original_bullet"), F.substring("text", 10, 60).alias("suggested_rewrite"), (F.col("votes") < 0).alias("readability_flag"))


def rewrite_diffs(spark, folder):
    return report.rewrite_diff(_answers(spark, folder), "thread_id")


def guarded_rewrites(spark, folder):
    return report.guard_rewrites(_answers(spark, folder)).select("thread_id", "rewrite_no")


def readability_flags(spark, folder):
    """Occurrences of the letter t stand for mentions of skills."""
    mentions = lambda c: F.regexp_count(c, F.lit("t"))
    before, after = F.col("original_bullet"), F.col("suggested_rewrite")
    density = lambda c: report.keyword_density(mentions(c), c)
    return _answers(spark, folder).select("rewrite_no", report.readability_flag(before, after, density(before), density(after)).alias("flag"))


def client_keys(spark, folder):
    """A forwarding header made of the user and the event's number; the kind of event stands for the peer."""
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit(" , proxy"))).when(F.col("event_id") % 3 == 1, F.lit(" , proxy"))
    return table(spark, folder, "events").select("event_id", limiter.client_key(header, F.col("event_type")).alias("key"))


def rewrite_requests(spark, folder):
    """Examples for every optional requirement of a job: project bullets as strong bullets, ranked among those of a cluster in common."""
    chunks = durable(_lines(spark, folder).where("source = 'project'").select(F.col("line_id").alias("chunk_id"), F.lit("strong_bullet").alias("kind"), "raw_text", F.col("clusters").alias("cluster_ids"), F.lit(None).cast("string").alias("platform")))
    weights = retrieval.bm25_weights(retrieval.term_counts(chunks, "chunk_id", "raw_text"), chunks, "chunk_id")
    asked = _asked(spark, folder, _jobs(spark, folder)).where("requirement_type = 'preferred'")
    items = asked.select("id", "req_idx", F.col("raw_text").alias("query"), F.array(F.lit("strong_bullet"), F.lit("rewrite_pair")).alias("kinds"), F.col("clusters").alias("cluster_ids"), F.lit(None).cast("string").alias("platform"))
    ranks = retrieval.filtered_ranks(items, chunks, weights, 3, "id", "req_idx")
    found = report.rewrite_context(ranks, "id", "req_idx", "guidance:density")
    return found.select("id", "req_idx", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def layout_fonts(spark, folder):
    """Events stand for the characters of documents, their kinds for fonts: errors for symbols, clicks for unmapped ones."""
    font = F.when(F.col("event_type") == "error", "Wingdings").when(F.col("event_type") == "click", "(cid)").otherwise("Arial")
    fonts = table(spark, folder, "events").select(F.col("user_id").alias("doc_id"), font.alias("font")).groupBy("doc_id", "font").agg(F.count("*").alias("n"))
    return checks.check_fonts(fonts).select("doc_id", "status", "location")


def layout_pages(spark, folder):
    """Posts of a thread stand for its pages, negative votes for tables, accepted answers for images."""
    posts = table(spark, folder, "documents").select(F.coalesce("thread_id", "doc_id").alias("doc_id"), F.coalesce("answer_rank", F.lit(0)).alias("page"), F.coalesce(F.col("is_accepted").cast("int"), F.lit(0)).alias("n_images"), F.coalesce((F.col("votes") < 0).cast("int"), F.lit(0)).alias("n_tables"), F.length("text").alias("n_chars"))
    return checks.check_pages(posts).select("doc_id", "check_name", "status", "location")


def layout_margins(spark, folder):
    """Lines of work entries stand for lines of pages: the entry is the page, the first line of each is in the margin, and text is cut to what names no detail."""
    rows = _lines(spark, folder).where("source = 'work' and entry_idx is not null")
    contact = F.when(F.length("raw_text") % 3 == 0, F.lit("call 555 010 9999")).otherwise(F.substring("raw_text", 1, 12))
    lines = rows.select(F.col("resume_id").alias("doc_id"), F.col("entry_idx").alias("page"), contact.alias("text"), (F.col("line_no") * 100.0).alias("top"), (F.col("line_no") * 100.0 + 12).alias("bottom"), F.lit(800.0).alias("page_height"))
    return checks.check_margins(lines).select("doc_id", "status", "location")


def all_queries():
    skip = {"all_queries", "durable", "table", "spread"}
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in skip}
