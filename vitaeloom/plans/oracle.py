"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Left out are queries that rest on sequential text parsing, compatibility composition or a model; those are
tested against brute force.
"""

from __future__ import annotations

# Fixed values, stated here apart from the package, so that a mistake there can't pass.
BULLETS = "•·▪▫◦○●■□–—*►▶➢➤✓✔◆◇»▸‣⁃"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PLACE = r"\b([A-Z][a-zA-Z.]+(?: [A-Z][a-zA-Z.]+){0,3}, ?[A-Z]{2})\b"
SEVERITY = {
    "multi_column_layout": "high medium medium medium",
    "table_detected": "high low low low",
    "text_box_detected": "high high high high",
    "non_standard_font": "high medium medium medium",
    "image_based_pdf": "high high high high",
    "inconsistent_dates": "medium medium medium medium",
    "non_standard_section_headers": "medium medium medium medium",
    "header_footer_content": "high medium medium medium",
}
PENALTY = {"low": 5, "medium": 15, "high": 25}
LEVELS = (
    ("intern", r"intern(ship)?|co-?op"),
    ("junior", r"junior|jr\.?|entry[\s-]+level|new grad(uate)?|associate|\bI"),
    ("principal", r"principal|distinguished|fellow|\bIV|\bV"),
    ("staff", r"staff|lead|head of|director"),
    ("senior", r"senior|sr\.?|\bIII"),
    ("mid", r"mid[\s-]+level|intermediate|\bII"),
)
TRACKS = {
    "mle": (r"machine learning engineer|ml engineer|mle|ai engineer|llm engineer|genai engineer|mlops engineer|ml platform engineer|ml infrastructure", r"deploy\w*|production|serving|inference|mlops|latency|scal(e|ing|able)"),
    "applied_scientist": (r"applied scientist|applied (ml|machine learning|research) scientist|applied ai", r"applied research|prototype\w*|experiment\w* with (new|novel)|state[\s-]+of[\s-]+the[\s-]+art"),
    "data_scientist": (r"data scientist|data science|decision scientist|product analyst|analytics engineer", r"a/b test\w*|experimentation|statistical|analytics|dashboards?|stakeholders?|insights?|causal inference|hypothesis"),
    "ml_research": (r"research scientist|research engineer|ml researcher|member of technical staff|ai researcher|machine learning researcher", r"publications?|papers?|neurips|icml|iclr|acl|cvpr|novel (methods?|algorithms?)|phd|research agenda"),
    "data_engineer": (r"data engineer|data platform engineer|etl developer|data infrastructure", r"data pipelines?|etl|elt|data warehouse\w*|lakehouse|spark|airflow|dbt|kafka|data quality|data modell?ing"),
}
HEADINGS = (
    ("preferred", r"preferred|nice[\s-]+to[\s-]+have|bonus|desired|plus(es)?|ideal(ly)?|great[\s-]+to[\s-]+have|extra[\s-]+credit|additional qualifications|good[\s-]+to[\s-]+have"),
    ("required", r"requirements?|qualifications?|minimum|basic|must[\s-]+haves?|what (you|we)('ll| will)? (need|bring|are looking for|look for)|who you are|about you|you have|your (background|experience|profile)|skills?( and experience)?|what it takes|experience"),
    ("responsibilities", r"responsibilities|what you('ll| will)? do|the role|in this role|your (role|mission|impact)|day[\s-]+to[\s-]+day|you will|duties|what you'll be doing|key (tasks|outcomes)"),
    ("boilerplate", r"about (us|the (company|team)|[A-Z]\w+)|benefits|perks|compensation|salary|pay range|why (join|work)|our (mission|values|culture|story)|who we are|the company|equal opportunity|eeo|diversity|how to apply|application process|location|interview process"),
)
BOILERPLATE = (
    r"equal[\s-]+opportunity|eeo|discriminat\w*|affirmative action|401\s*\(?k\)?|health(care)?|dental|vision (insurance|coverage)|insurance|pto|paid time off|vacation|parental leave|stock options|equity|salary|compensation|bonus structure|wellness|gym|commuter|authori[sz]ed to work|visa|sponsorship|background check|we are (a|an|the) |our (mission|office|team|company|customers|culture)|headquartered|founded in|fastest[\s-]+growing|remote[\s-]+first|hybrid|work[\s-]+from[\s-]+home|apply|reasonable accommodation|race|religion|gender|sexual orientation|veteran"
)
REQUIREMENT = (
    r"experience|proficien(cy|t)|familiar(ity)?|knowledge|understanding|expertise|background|ability|track record|hands[\s-]+on|fluent|fluency|comfortable|exposure|competen(ce|cy|t)|skilled|mastery|degree|ph\.?d|m\.?s\.?c?|b\.?s\.?c?|years?|must|should|strong|solid|deep|working knowledge|contributions?|publications?|demonstrated"
)
OPTIONAL = (
    r"preferred|bonus|(a|big|huge|strong|definite) plus|nice[\s-]+to[\s-]+have|not required|optional|would be (great|nice|a plus|beneficial|welcome)|ideally|is a plus|are a plus|desirable|good to have|great to have"
)
NO_TERM = ('', 'a', 'an', 'the', 'other', 'others', 'similar', 'related', 'tools', 'technologies', 'frameworks', 'equivalent', 'such as', 'e.g', 'eg', 'ie', 'i.e')


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BULLET = _q(rf"^\s*(?:[{BULLETS.replace('*', chr(92) + '*')}]|-)\s+")
LINES = "lines AS (SELECT DISTINCT line_id, resume_id, source, entry_idx, line_no, raw_text, matched_clusters FROM resume_lines)"
JOBS = "cur AS (SELECT id, arg_max(struct_pack(status := status, input_json := input_json, updated_at := updated_at), struct_pack(u := updated_at, c := created_at, s := status)) AS r FROM jobs WHERE id IS NOT NULL GROUP BY id), job AS (SELECT id, r.status AS status, r.input_json AS input_json, r.updated_at AS updated_at FROM cur)"
FORM = r"'(?i)(?:^|[^A-Za-z0-9])(?:' || regexp_replace(form, '[\s\-_]+', '[\\s\\-_]*', 'g') || ')(?:[^A-Za-z0-9]|$)'"
REQUIREMENTS = f"{JOBS}, req AS (SELECT id, CAST(i AS INTEGER) - 1 AS req_idx, json_extract_string(input_json, '$.jd.requirements[' || (i - 1) || '].raw_text') AS raw_text, json_extract_string(input_json, '$.jd.requirements[' || (i - 1) || '].requirement_type') AS requirement_type FROM job, range(1, 1 + CAST(json_array_length(input_json, '$.jd.requirements') AS BIGINT)) t(i)), wants AS (SELECT DISTINCT id, req_idx, raw_text, requirement_type, cluster_id FROM req, surface_forms WHERE regexp_matches(raw_text, {FORM})), asked AS (SELECT id AS posting_id, cluster_id, CASE WHEN min(CASE WHEN requirement_type = 'required' THEN 0 ELSE 1 END) = 0 THEN 'required' ELSE 'preferred' END AS requirement_type, arg_min(raw_text, struct_pack(k := CASE WHEN requirement_type = 'required' THEN 0 ELSE 1 END, i := req_idx)) AS asked FROM wants GROUP BY 1, 2)"
PLACES = ("$.resume.work[*].bullets[*].matched_clusters[*]", "$.resume.projects[*].bullets[*].matched_clusters[*]", "$.resume.skills[*].matched_clusters[*]")
HAVE = "have AS (" + " UNION ".join(f"SELECT id AS resume_id, unnest(json_extract_string(input_json, '{p}')) AS cluster_id FROM job" for p in PLACES) + ")"
SKILLS = f"{REQUIREMENTS}, {HAVE}, sk AS (SELECT a.posting_id, a.cluster_id, CASE WHEN requirement_type = 'required' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, CASE WHEN h.cluster_id IS NOT NULL THEN 'matched' WHEN requirement_type = 'required' THEN 'missing_required' ELSE 'missing_preferred' END AS state FROM asked a LEFT JOIN have h ON h.resume_id = a.posting_id AND h.cluster_id = a.cluster_id)"
CHECKS = "dim(check_name, check_idx, severity, penalty) AS (VALUES " + ", ".join(f"('{n}', {i}, '{max(s.split(), key=PENALTY.get)}', {max(PENALTY[x] for x in s.split())})" for i, (n, s) in enumerate(SEVERITY.items())) + "), seen AS (SELECT id, CASE WHEN json_extract_string(input_json, '$.report.checks[' || (i - 1) || '].check_name') = 'section_headers' THEN 'non_standard_section_headers' ELSE json_extract_string(input_json, '$.report.checks[' || (i - 1) || '].check_name') END AS check_name, json_extract_string(input_json, '$.report.checks[' || (i - 1) || '].status') AS status FROM job, range(1, 1 + CAST(json_array_length(input_json, '$.report.checks') AS BIGINT)) t(i)), rep AS (SELECT j.id AS resume_id, d.check_idx, d.check_name, coalesce(s.status, 'not_assessed') AS status, d.penalty FROM job j CROSS JOIN dim d LEFT JOIN seen s ON s.id = j.id AND s.check_name = d.check_name)"
COSINE = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9)"


def _dense(most: int, held: str = "") -> str:
    return f"dense AS (SELECT * FROM (SELECT q.vec_id AS q_id, d.vec_id AS doc_id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, d.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings d {held} WHERE q.vec_id % 20 = 0 AND {COSINE} > 0) WHERE rank <= {most})"


def _bm25(docs: str) -> str:
    k, b, share = 1.5, 0.75, 0.25
    return f"""docs AS ({docs}), toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2), dl AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1),
st AS (SELECT (SELECT count(DISTINCT doc_id) FROM docs)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE AS total),
raw AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN {share}::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
w AS (SELECT doc_id, term, idf * tf * ({k + 1}::DOUBLE) / (tf + {k}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / (total / n))) AS weight FROM tf JOIN dl USING (doc_id) JOIN idf USING (term), st)"""


def _sparse(asked: str, query: str, most: int, where: str = "") -> str:
    return f"""ask AS (SELECT {query}, term, count(*) AS times FROM (SELECT {query}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({asked})) GROUP BY 1, 2),
sc AS (SELECT {query}, doc_id, round(sum(times * weight), 9) AS score FROM ask JOIN w USING (term) {where} GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {most})"""


def _title(pattern: str) -> str:
    return _q(rf"(?i)\b(?:{pattern})\b")


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    strip = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
    out["text_lines"] = f"SELECT resume_id, i - 1 AS line_no, regexp_matches(line, {BULLET}) AS is_bullet, {strip.format(f'regexp_replace(line, {BULLET}, {_q("")})')} AS content FROM (SELECT resume_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM resumes) WHERE trim(line) <> ''"
    pieces = r"string_split(regexp_replace(text, '([.!?])\s+([A-Z\x22''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    body = f"CASE WHEN regexp_matches(text, {BULLET}) THEN [regexp_replace(text, {BULLET}, '')] ELSE {pieces} END"
    out["sentence_units"] = f"SELECT doc_id, i - 1 AS unit_no, u AS unit FROM (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (SELECT doc_id, list_filter(list_transform({body}, lambda x: {strip.format('x')}), lambda x: x <> '') AS us FROM documents WHERE text IS NOT NULL))"
    out["clipped_text"] = r"SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE regexp_replace(substring(text, 1, 160), '\s+$', '') || '…' END AS clipped FROM documents"
    words = "regexp_extract_all(lower(text), '[a-z0-9]+')"
    out["document_terms"] = f"SELECT doc_id, len({words}) AS n_terms, len(list_distinct({words})) AS n_distinct FROM documents"
    syll = "greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x) LIKE '%e' AND lower(x) NOT LIKE '%le' AND lower(x) NOT LIKE '%ee' AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
    out["reading_ease"] = f"SELECT doc_id, CASE WHEN n = 0 THEN 100.0::DOUBLE ELSE round(206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / s) - 84.6::DOUBLE * (y::DOUBLE / n), 6) END AS ease FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s, list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: {syll})) AS y FROM documents)"
    number = r"'\d+(?:[.,]\d+)*%?'"
    out["number_guard"] = f"SELECT doc_id, NOT list_has_all(regexp_extract_all(title, {number}), regexp_extract_all(text, {number})) AS adds_numbers FROM documents WHERE title IS NOT NULL"
    out["line_clusters"] = f"WITH {LINES} SELECT DISTINCT line_id, cluster_id FROM lines, surface_forms WHERE regexp_matches(raw_text, {FORM})"
    out["equivalent_phrasings"] = f"WITH {LINES}, t AS (SELECT DISTINCT lower(trim(raw_text)) AS text, unnest(matched_clusters) AS cluster_id FROM lines WHERE source = 'skill') SELECT * FROM (SELECT cluster_id, text AS text_a, lead(text) OVER (PARTITION BY cluster_id ORDER BY text) AS text_b FROM t) WHERE text_b IS NOT NULL"
    out["equivalence_chunks"] = "SELECT 'equiv:' || c.cluster_id AS chunk_id, canonical_name || ' also appears as: ' || coalesce(string_agg(form, ', ' ORDER BY form_idx), '') AS text, category FROM clusters c LEFT JOIN surface_forms f ON f.cluster_id = c.cluster_id AND lower(form) <> lower(canonical_name) GROUP BY c.cluster_id, canonical_name, category"
    out["taxonomy_violations"] = "SELECT 'bad_id' AS kind, cluster_id AS key FROM clusters WHERE NOT regexp_matches(cluster_id, '^[a-z][a-z0-9_]*$') UNION ALL SELECT 'repeated_id', cluster_id FROM clusters GROUP BY cluster_id HAVING count(*) > 1 UNION ALL SELECT 'few_forms', c.cluster_id FROM clusters c LEFT JOIN surface_forms f USING (cluster_id) GROUP BY c.cluster_id HAVING count(DISTINCT form) < 6 UNION ALL SELECT DISTINCT 'unknown_cluster', cluster_id FROM surface_forms WHERE cluster_id NOT IN (SELECT cluster_id FROM clusters)"
    out["ambiguous_forms"] = "SELECT lower(form) AS form, count(DISTINCT cluster_id) AS clusters FROM surface_forms GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1"
    out["contact_fields"] = f"SELECT resume_id, nullif(regexp_extract(raw_text, {_q(EMAIL)}), '') AS email, nullif(regexp_extract(raw_text, {_q(PLACE)}, 1), '') AS place FROM resumes"
    out["first_skills"] = f"WITH {LINES} SELECT resume_id, line_id, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, lower(raw_text) ORDER BY line_no, line_id) AS n FROM lines WHERE source = 'skill' AND raw_text IS NOT NULL) WHERE n = 1"
    by_title = "CASE " + " ".join(f"WHEN regexp_matches(title, {_title(p)}) THEN '{level}'" for level, p in LEVELS) + " ELSE 'unclear' END"
    out["title_levels"] = f"SELECT DISTINCT job_title AS title, {by_title.replace('title,', 'job_title,')} AS level FROM work_entries WHERE job_title IS NOT NULL"
    votes = " UNION ALL ".join(f"SELECT title, '{t}' AS track, {5} * len(regexp_extract_all(title, {_title(p)})) AS score FROM titles" for t, (p, _) in TRACKS.items())
    out["track_votes"] = f"WITH titles AS (SELECT DISTINCT job_title AS title FROM work_entries WHERE job_title IS NOT NULL), v AS ({votes}), r AS (SELECT title, max(score) AS best, arg_max(track, score) AS track FROM v GROUP BY title), n AS (SELECT v.title, count(*) AS ties FROM v JOIN r ON r.title = v.title AND v.score = r.best GROUP BY 1) SELECT title, CASE WHEN best = 0 OR ties > 1 THEN 'unclear' ELSE track END AS track FROM r JOIN n USING (title)"
    out["check_report"] = f"WITH {JOBS}, {CHECKS} SELECT resume_id, check_idx, check_name, status FROM rep"
    out["parseability"] = f"WITH {JOBS}, {CHECKS} SELECT resume_id, CAST(greatest(0, 100 - coalesce(sum(penalty) FILTER (status = 'fail'), 0)) AS INTEGER) AS parseability, count(*) FILTER (status = 'fail') AS n_failed, count(*) FILTER (status <> 'not_assessed') AS n_assessed FROM rep GROUP BY resume_id"
    rank = "CASE source WHEN 'work' THEN 0 WHEN 'project' THEN 1 ELSE 2 END"
    numbered = f"{LINES}, ev AS (SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY {rank}, coalesce(entry_idx, 0), line_no, raw_text) - 1 AS line_idx, raw_text, matched_clusters FROM lines)"
    out["evidence_lines"] = f"WITH {numbered} SELECT resume_id, line_idx, raw_text FROM ev"
    out["resume_evidence"] = f"WITH {numbered} SELECT resume_id, cluster_id, arg_min(raw_text, line_idx) AS evidence FROM (SELECT resume_id, line_idx, raw_text, unnest(matched_clusters) AS cluster_id FROM ev) GROUP BY 1, 2"
    out["posting_wants"] = f"WITH {REQUIREMENTS} SELECT posting_id, cluster_id, requirement_type, asked FROM asked"
    listed = lambda s: f"coalesce(string_agg(cluster_id, ',' ORDER BY weight DESC, cluster_id) FILTER (state = '{s}'), '') AS {s}"
    out["overlap_scores"] = f"WITH {SKILLS} SELECT j.id AS resume_id, CAST(coalesce(round_even(100 * sum(CASE WHEN state = 'matched' THEN weight ELSE 0 END) / sum(weight), 0), 0) AS INTEGER) AS taxonomy, {listed('matched')}, {listed('missing_required')}, {listed('missing_preferred')} FROM job j LEFT JOIN sk ON sk.posting_id = j.id GROUP BY j.id"
    out["unmatched_skills"] = f"WITH {SKILLS} SELECT posting_id, cluster_id, state FROM sk WHERE state <> 'matched'"
    part = lambda c: f"CAST(json_extract_string(input_json, '$.result.components.{c}') AS DOUBLE)"
    blended = " + ".join(f"{w}::DOUBLE * {part(c)}" for c, w in (("semantic", 0.45), ("taxonomy", 0.35), ("parseability", 0.2)))
    out["job_blend"] = f"WITH {JOBS} SELECT id, CAST(least(greatest(round_even({blended}, 0), 0), 100) AS INTEGER) AS overall FROM job WHERE json_extract_string(input_json, '$.result.components.semantic') IS NOT NULL"
    sides = "line AS (SELECT vec_id % 16 AS resume_id, vec_id, embedding FROM embeddings), pair AS (SELECT DISTINCT resume_id, CAST(resume_id % 10 AS INTEGER) AS posting_id FROM line), rq AS (SELECT label AS posting_id, vec_id AS req_idx, CASE WHEN vec_id % 40 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, embedding FROM embeddings WHERE vec_id % 20 = 0), sim AS (SELECT p.resume_id, p.posting_id, q.req_idx, q.weight, d.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS c FROM pair p JOIN rq q USING (posting_id) JOIN line d USING (resume_id)), best AS (SELECT resume_id, posting_id, req_idx, weight, arg_max(vec_id, struct_pack(c := c, i := -vec_id)) AS line_idx, max(c) AS c FROM sim GROUP BY 1, 2, 3, 4)"
    stretched = f"least(greatest((c - 0.47::DOUBLE) / (0.82::DOUBLE - 0.47::DOUBLE), 0), 1)"
    out["best_lines"] = f"WITH {sides} SELECT resume_id, posting_id, req_idx, line_idx, CAST(round_even(100 * {stretched}, 0) AS INTEGER) AS score FROM best"
    out["semantic_scores"] = f"WITH {sides} SELECT p.resume_id, p.posting_id, coalesce(CAST(round_even(100 * sum(weight * {stretched}) / sum(weight), 0) AS INTEGER), 0) AS semantic FROM pair p LEFT JOIN best b USING (resume_id, posting_id) GROUP BY 1, 2"
    out["category_levels"] = "WITH w AS (SELECT cluster_id, count(*) / 6.0::DOUBLE AS weight FROM surface_forms GROUP BY 1), m AS (SELECT category, median(weight) AS median_weight FROM w JOIN clusters USING (cluster_id) GROUP BY 1) SELECT category, 'mle' AS track, median_weight, CASE WHEN median_weight >= 0.9 THEN 'high' WHEN median_weight >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM m"
    items = "SELECT item_id, question AS text FROM eval_items"
    whole = _bm25("SELECT doc_id, text, lang, source FROM documents")
    out["bm25_topk"] = f"WITH {whole}, {_sparse(items, 'item_id', 5)} SELECT item_id, doc_id, rank FROM sparse"
    only = "JOIN docs USING (doc_id) WHERE lang = 'en' AND source IN ('qa_code', 'helpdesk')"
    out["filtered_search"] = f"WITH {whole}, {_sparse(items, 'item_id', 5, only)} SELECT item_id, doc_id, rank FROM sparse"
    out["dense_topk"] = f"WITH {_dense(10)} SELECT q_id, doc_id, rank FROM dense"
    paired = _bm25("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
    out["rrf_topk"] = f"""WITH {paired}, {_sparse('SELECT doc_id AS q_id, text FROM docs WHERE doc_id % 20 = 0', 'q_id', 50)}, {_dense(50, held='JOIN docs x ON x.doc_id = d.vec_id')},
f AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM dense a FULL JOIN sparse b ON a.q_id = b.q_id AND a.doc_id = b.doc_id)
SELECT * FROM (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5"""
    labelled = f"WITH {_dense(10)}, hit AS (SELECT q_id, min(d.rank) AS first FROM dense d JOIN embeddings a ON a.vec_id = d.q_id JOIN embeddings b ON b.vec_id = d.doc_id WHERE q_id <> doc_id AND a.label = b.label GROUP BY 1), cases AS (SELECT vec_id AS q_id FROM embeddings WHERE vec_id % 20 = 0)"
    out["recall_mrr"] = f"{labelled} SELECT round(sum(CASE WHEN first <= 5 THEN 1 ELSE 0 END)::DOUBLE / greatest(1, count(*)), 9) AS recall_at_k, round(sum(coalesce(1.0::DOUBLE / first, 0)) / greatest(1, count(*)), 9) AS mrr, greatest(1, count(*)) AS n FROM cases LEFT JOIN hit USING (q_id)"
    out["nearest_label"] = f"WITH {_dense(2)}, best AS (SELECT q_id, arg_max(doc_id, struct_pack(s := score, i := -doc_id)) AS doc_id FROM dense WHERE q_id <> doc_id GROUP BY 1) SELECT round(avg(CASE WHEN b.label = a.label THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) AS n FROM embeddings a LEFT JOIN best ON q_id = a.vec_id LEFT JOIN embeddings b ON b.vec_id = best.doc_id WHERE a.vec_id % 20 = 0"
    out["auc_labels"] = "WITH s AS (SELECT verdict, n_chars FROM abuse_labels JOIN documents USING (doc_id) WHERE verdict IS NOT NULL AND n_chars IS NOT NULL) SELECT round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0::DOUBLE ELSE 0 END), 9) AS auc, (SELECT count(*) FROM s WHERE verdict = 1) AS positives, (SELECT count(*) FROM s WHERE verdict <> 1) AS negatives FROM (SELECT * FROM s WHERE verdict = 1) p, (SELECT * FROM s WHERE verdict <> 1) n"
    out["context_numbering"] = f"WITH {LINES}, u AS (SELECT resume_id, unnest(matched_clusters) AS chunk_id, coalesce(entry_idx, 0) * 1000 + line_no AS pos FROM lines WHERE source <> 'skill'), f AS (SELECT resume_id, chunk_id, min(pos) AS pos FROM u GROUP BY 1, 2) SELECT resume_id, chunk_id, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY pos, chunk_id) AS INTEGER) AS context_id FROM f"
    n_words = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
    out["weak_lines_topn"] = f"WITH a AS (SELECT thread_id, text, votes, doc_id FROM documents WHERE post_kind = 'answer' AND votes < 70 AND text IS NOT NULL AND {n_words} >= 6), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, text ORDER BY votes, doc_id) AS n FROM a) WHERE n = 1) SELECT * FROM (SELECT thread_id, doc_id AS req_idx, row_number() OVER (PARTITION BY thread_id ORDER BY votes, doc_id) AS weak_rank FROM o) WHERE weak_rank <= 6"
    out["grounding_violations"] = f"WITH {LINES}, ctx AS (SELECT DISTINCT resume_id, unnest(matched_clusters) AS id FROM lines WHERE source = 'skill'), ans AS (SELECT resume_id, line_id AS answer_id, coalesce(matched_clusters, []) AS ids FROM lines WHERE source <> 'skill') SELECT resume_id, answer_id, 'no_context' AS reason FROM ans WHERE len(ids) = 0 UNION ALL SELECT DISTINCT resume_id, answer_id, 'unknown_id' FROM (SELECT resume_id, answer_id, unnest(ids) AS id FROM ans) u WHERE NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.resume_id = u.resume_id AND ctx.id = u.id)"
    out["current_jobs"] = f"WITH {JOBS} SELECT id, status FROM job"
    out["retention_purge"] = f"WITH {JOBS}, t AS (SELECT max(updated_at) AS now FROM job) SELECT status, count(*) AS rows FROM job, t WHERE (status IN ('done', 'failed') AND updated_at < now - INTERVAL 30 DAY) OR (status = 'awaiting_payment' AND updated_at < now - INTERVAL 7 DAY) GROUP BY 1"
    out["term_counts_top"] = r"WITH t AS (SELECT DISTINCT submission_id, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) AS term FROM unmatched_terms) SELECT term, count(*) AS count FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    edge = r"[.:;\-–—''\x22]+"
    cleaned = rf"lower(trim(regexp_replace(trim(raw_text), '^{edge}|{edge}$', '', 'g')))"
    none = ", ".join(_q(x) for x in NO_TERM)
    out["resume_candidate_terms"] = rf"WITH {LINES}, c AS (SELECT resume_id, {cleaned} AS term FROM lines WHERE source = 'skill' AND len(coalesce(matched_clusters, [])) = 0) SELECT DISTINCT resume_id, term FROM c WHERE term NOT IN ({none}) AND NOT regexp_matches(term, '[@\d]') AND length(term) BETWEEN 2 AND 40 AND len(list_filter(regexp_split_to_array(term, '\s+'), lambda x: x <> '')) <= 5"
    cleaned = r"trim(regexp_replace(regexp_replace(json_extract_string(input_json, '$.jd.raw_text'), '\r\n?', chr(10), 'g'), '[ \t\x{00A0}]+', ' ', 'g'), ' ' || chr(10))"
    posted = f"{JOBS}, raw AS (SELECT id AS posting_id, string_split({cleaned}, chr(10)) AS ls FROM job), pl AS (SELECT posting_id, i - 1 AS line_no, trim(ls[i]) AS line FROM raw, range(1, 1 + len(ls)) t(i) WHERE trim(ls[i]) <> ''), pt AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY line_no) AS n, trim(regexp_replace(line, ':+$', '')) AS bare FROM pl)"
    modes = "CASE " + " ".join(f"WHEN regexp_matches(bare, {_title(p)}) THEN '{m}'" for m, p in HEADINGS) + " END"
    short = rf"length(bare) BETWEEN 1 AND 60 AND len(list_filter(regexp_split_to_array(bare, '\s+'), lambda x: x <> '')) <= 8 AND NOT regexp_matches(line, {BULLET}) AND NOT regexp_matches(bare, '[.,;]$')"
    out["posting_modes"] = f"WITH {posted}, h AS (SELECT *, CASE WHEN n > 1 AND {short} THEN {modes} END AS heading FROM pt), m AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS mode FROM h) SELECT posting_id, line_no, mode FROM m WHERE n > 1"
    split = body.replace("text", "line")
    hit = "EXISTS (SELECT 1 FROM tags WHERE tags.u = unit)"
    fits = f"CASE WHEN mode IN ('required', 'preferred') THEN true WHEN mode = 'responsibilities' THEN {hit} WHEN mode = 'none' THEN {hit} OR regexp_matches(unit, {_title(REQUIREMENT)}) ELSE false END"
    out["posting_requirements"] = rf"""WITH {posted}, h AS (SELECT *, CASE WHEN n > 1 AND {short} THEN {modes} END AS heading FROM pt), m AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS mode FROM h),
us AS (SELECT posting_id, line_no, mode, list_filter(list_transform({split}, lambda x: {strip.format('x')}), lambda x: x <> '') AS us FROM m WHERE n > 1 AND heading IS NULL), un AS (SELECT posting_id, line_no, mode, i AS unit_no, us[i] AS unit FROM us, range(1, 1 + len(us)) t(i)),
tags AS (SELECT unit AS u, string_agg(DISTINCT cluster_id, ',' ORDER BY cluster_id) AS clusters FROM (SELECT DISTINCT unit FROM un), surface_forms WHERE regexp_matches(unit, {FORM}) GROUP BY 1),
ok AS (SELECT * FROM un WHERE len(list_filter(regexp_split_to_array(unit, '\s+'), lambda x: x <> '')) >= 3 AND NOT regexp_matches(unit, {_title(BOILERPLATE)}) AND {fits}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id, lower(unit) ORDER BY line_no, unit_no) AS k FROM ok) WHERE k = 1)
SELECT posting_id, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY line_no, unit_no) - 1 AS INTEGER) AS req_idx, unit AS raw_text, CASE WHEN mode = 'preferred' OR regexp_matches(unit, {_title(OPTIONAL)}) THEN 'preferred' ELSE 'required' END AS requirement_type, coalesce(clusters, '') AS clusters FROM f LEFT JOIN tags ON tags.u = f.unit"""
    votes_ = " UNION ALL ".join(f"SELECT posting_id, '{t}' AS track, 5 * len(regexp_extract_all(title, {_title(a)})) + len(regexp_extract_all(body, {_title(a)})) + len(regexp_extract_all(body, {_title(b)})) AS score FROM tb" for t, (a, b) in TRACKS.items())
    out["posting_tracks"] = f"WITH {posted}, tb AS (SELECT posting_id, max(line) FILTER (n = 1) AS title, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n > 1), '') AS body FROM pt GROUP BY 1), v AS ({votes_}), b AS (SELECT posting_id, max(score) AS best FROM v GROUP BY 1) SELECT v.posting_id, CASE WHEN any_value(best) = 0 OR count(*) > 1 THEN 'unclear' ELSE max(track) END AS track FROM v JOIN b ON b.posting_id = v.posting_id AND score = best GROUP BY 1"
    # The first place of a form in a text, from the text before it; borders are one character on either side.
    border = r"'(?i)^(.*?)(?:^|[^A-Za-z0-9])(?:' || regexp_replace(form, '[\\s\\-_]+', '[\\\\s\\\\-_]*', 'g') || ')(?:[^A-Za-z0-9]|$)'"
    place = f"length(regexp_extract(' ' || replace(raw_text, chr(10), ' '), {border}, 1))"
    out["line_cluster_order"] = f"WITH {LINES}, hit AS (SELECT line_id, cluster_id, min({place}) AS began FROM lines, surface_forms WHERE regexp_matches(raw_text, {FORM}) GROUP BY 1, 2), o AS (SELECT line_id, string_agg(cluster_id, ',' ORDER BY began, cluster_id) AS clusters FROM hit GROUP BY 1) SELECT line_id, coalesce(clusters, '') AS clusters FROM lines LEFT JOIN o USING (line_id)"
    out["rate_limit_decisions"] = """WITH RECURSIVE n AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
fold AS (SELECT key, request_id, ts, i, [us] AS kept, true AS allowed, 0 AS retry_after FROM n WHERE i = 1
UNION ALL SELECT n.key, n.request_id, n.ts, n.i, CASE WHEN len(live) < 3 THEN list_append(live, n.us) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 86400000000 - n.us) / 1000000.0) AS INTEGER)) END
FROM (SELECT f.key AS k, f.i AS j, m.us AS now, list_filter(f.kept, lambda t: t > m.us - 86400000000) AS live FROM fold f JOIN n m ON m.key = f.key AND m.i = f.i + 1) s JOIN n ON n.key = s.k AND n.i = s.j + 1)
SELECT key, request_id, ts, allowed, retry_after FROM fold"""
    overlay = "w AS (SELECT c.cluster_id, t.track, CASE WHEN t.track = 'mle' AND length(c.cluster_id) % 2 = 0 THEN 0.95::DOUBLE ELSE 0.3::DOUBLE + 0.1::DOUBLE * (length(category) % 8) END AS tw FROM clusters c, (VALUES ('mle'), ('data_scientist')) t(track))"
    track = "tr AS (SELECT id, nullif(json_extract_string(input_json, '$.jd.role_track_signal'), 'unclear') AS track FROM job)"
    weighted = f"{SKILLS}, {overlay}, {track}, ws AS (SELECT sk.posting_id, sk.cluster_id, sk.state, coalesce(w.tw, 1.0::DOUBLE) * sk.weight AS weight FROM sk JOIN tr ON tr.id = sk.posting_id LEFT JOIN w ON w.cluster_id = sk.cluster_id AND w.track = tr.track)"
    out["weighted_overlap"] = f"WITH {weighted} SELECT j.id AS resume_id, CAST(coalesce(round_even(100 * sum(CASE WHEN state = 'matched' THEN weight ELSE 0 END) / sum(weight), 0), 0) AS INTEGER) AS taxonomy, {listed('matched')}, {listed('missing_required')}, {listed('missing_preferred')} FROM job j LEFT JOIN ws ON ws.posting_id = j.id GROUP BY j.id"
    platforms = ("workday", "greenhouse", "lever", "ashby")
    levels = "lev(check_name, platform, severity, penalty) AS (VALUES " + ", ".join(f"('{n}', '{p}', '{x}', {PENALTY[x]})" for n, line in SEVERITY.items() for p, x in zip(platforms, line.split())) + ")"
    seen = CHECKS.replace(", d.penalty FROM", " FROM")
    out["platform_parseability"] = f"WITH {JOBS}, {seen}, {levels} SELECT resume_id, platform, CAST(greatest(0, 100 - coalesce(sum(lev.penalty) FILTER (status = 'fail'), 0)) AS INTEGER) AS parseability FROM rep JOIN lev USING (check_name) GROUP BY 1, 2"
    label = "upper(check_name[1]) || replace(check_name[2:], '_', ' ')"
    wide = ", ".join(f"max(severity) FILTER (platform = '{p}') AS {p}" for p in platforms)
    out["check_table"] = f"WITH {JOBS}, {seen}, {levels}, wide AS (SELECT check_name, {wide} FROM lev GROUP BY 1) SELECT resume_id, check_idx, {label} AS label, status, {', '.join(platforms)} FROM rep JOIN wide USING (check_name)"
    out["item_labels"] = f"WITH {levels} SELECT cluster_id AS item_id, canonical_name AS label FROM clusters UNION ALL SELECT DISTINCT 'check:' || check_name, {label} FROM lev"
    ans = "a AS (SELECT thread_id, doc_id AS rewrite_no, substring(text, 1, 60) AS b, substring(text, 10, 60) AS r, votes < 0 AS f FROM documents WHERE post_kind = 'answer' AND text IS NOT NULL AND votes IS NOT NULL)"
    out["rewrite_diffs"] = f"WITH {ans}, n AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY rewrite_no) AS i FROM a) SELECT thread_id, '--- resume (original)' || chr(10) || '+++ resume (suggested)' || chr(10) || string_agg('@@ bullet ' || i || ' @@' || chr(10) || '-' || b || chr(10) || '+' || r || CASE WHEN f THEN chr(10) || '# readability flag: raises keyword density at the cost of readability' ELSE '' END, chr(10) ORDER BY i) || chr(10) AS diff FROM n GROUP BY 1"
    out["guarded_rewrites"] = f"WITH {ans} SELECT thread_id, rewrite_no FROM a WHERE list_has_all(regexp_extract_all(b, {number}), regexp_extract_all(r, {number}))"
    ease = lambda t: f"(CASE WHEN len(regexp_extract_all({t}, '[A-Za-z]+')) = 0 THEN 100.0::DOUBLE ELSE 206.835::DOUBLE - 1.015::DOUBLE * (len(regexp_extract_all({t}, '[A-Za-z]+'))::DOUBLE / greatest(1, len(regexp_extract_all({t}, '[.!?]+')))) - 84.6::DOUBLE * (list_sum(list_transform(regexp_extract_all({t}, '[A-Za-z]+'), lambda x: {syll}))::DOUBLE / len(regexp_extract_all({t}, '[A-Za-z]+'))) END)"
    dense = lambda t: f"coalesce(len(regexp_extract_all({t}, 't'))::DOUBLE / nullif(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')), 0), 0)"
    out["readability_flags"] = f"WITH {ans} SELECT rewrite_no, {dense('r')} > {dense('b')} + 0.02::DOUBLE AND ({ease('r')} < {ease('b')} - 10 OR {dense('r')} > 0.20::DOUBLE) AS flag FROM a"
    out["client_keys"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE coalesce(event_type, 'unknown') END AS key FROM events"
    bullets = _bm25("SELECT line_id AS doc_id, raw_text AS text, coalesce(matched_clusters, []) AS held FROM lines WHERE source = 'project'")
    out["rewrite_requests"] = f"""WITH {LINES}, {REQUIREMENTS}, {bullets}, it AS (SELECT r.id, r.req_idx, r.raw_text, coalesce((SELECT list(DISTINCT cluster_id) FROM wants w WHERE w.id = r.id AND w.req_idx = r.req_idx), []) AS need FROM req r WHERE requirement_type = 'preferred'),
ask AS (SELECT id, req_idx, need, term, count(*) AS times FROM (SELECT id, req_idx, need, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM it) GROUP BY ALL),
sc AS (SELECT id, req_idx, doc_id, round(sum(times * weight), 9) AS score FROM ask JOIN w USING (term) JOIN docs USING (doc_id) WHERE len(need) = 0 OR list_has_any(need, held) GROUP BY 1, 2, 3),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, req_idx ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 3),
us AS (SELECT id, doc_id, 1 + row_number() OVER (PARTITION BY id ORDER BY min(req_idx * 10 + rank), doc_id) AS number FROM rk GROUP BY 1, 2)
SELECT id, req_idx, string_agg(number, ',' ORDER BY rank) || ',1' AS ids FROM rk JOIN us USING (id, doc_id) GROUP BY 1, 2"""
    out["layout_fonts"] = "WITH f AS (SELECT user_id AS doc_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS s, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1) SELECT doc_id, CASE WHEN s > 0 OR c > n * 0.01::DOUBLE THEN 'fail' ELSE 'pass' END AS status, CASE WHEN s > 0 THEN 'Wingdings' WHEN c > n * 0.01::DOUBLE THEN 'unmapped characters' ELSE '' END AS location FROM f"
    out["layout_pages"] = "WITH p AS (SELECT coalesce(thread_id, doc_id) AS doc_id, coalesce(answer_rank, 0) AS page, coalesce(is_accepted, false) AS image, coalesce(votes < 0, false) AS tab, length(text) AS n FROM documents), d AS (SELECT doc_id, min(page) FILTER (tab) AS page, bool_or(image) AS image, coalesce(sum(n), 0) AS n FROM p GROUP BY 1) SELECT doc_id, 'table_detected' AS check_name, CASE WHEN page IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce('page ' || page, '') AS location FROM d UNION ALL SELECT doc_id, 'image_based_pdf', CASE WHEN image AND n < 40 THEN 'fail' ELSE 'pass' END, CASE WHEN image AND n < 40 THEN 'no text layer' ELSE '' END FROM d"
    out["layout_margins"] = rf"WITH {LINES}, m AS (SELECT resume_id, entry_idx, line_no, CASE WHEN length(raw_text) % 3 = 0 THEN 'call 555 010 9999' ELSE substring(raw_text, 1, 12) END AS t FROM lines WHERE source = 'work' AND entry_idx IS NOT NULL), h AS (SELECT resume_id, t, min(entry_idx) AS first FROM m WHERE (line_no * 100 + 12 <= 64 OR line_no * 100 >= 736) AND regexp_matches(t, '@|\(?\+?\d[\d\s().-]{{7,}}\d') GROUP BY 1, 2 HAVING count(DISTINCT entry_idx) > 1), b AS (SELECT resume_id, arg_min(t, struct_pack(f := first, t := t)) AS t FROM h GROUP BY 1) SELECT DISTINCT m.resume_id AS doc_id, CASE WHEN b.t IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(b.t, '') AS location FROM m LEFT JOIN b USING (resume_id)"
    return out
