"""SQL counterparts of the queries of this subpackage, where SQL can express them."""

P6_FOUND = r"""
WITH once AS (SELECT DISTINCT row_id, submission_id, term_count, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) AS term FROM unmatched_terms),
per_term AS (SELECT term, coalesce(sum(term_count), 0) AS occurrences, count(DISTINCT submission_id) AS records FROM once WHERE term IS NOT NULL AND term <> '' GROUP BY term),
total AS (SELECT count(DISTINCT submission_id) AS n FROM unmatched_terms)
SELECT term, 'rare' AS mark FROM per_term WHERE occurrences <= 2
UNION ALL
SELECT term, 'common' AS mark FROM per_term, total WHERE records * 10 > n
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND}
