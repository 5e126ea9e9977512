"""DuckDB statements for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

from kgweft.llm import survivor

# Brute force over all pairs of usable vectors.
_P3 = """
WITH v AS (
    SELECT entity_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
    FROM entities WHERE len(embedding) = 96
), s AS (
    SELECT a.entity_id AS a, b.entity_id AS b, list_dot_product(a.x, b.x) / (a.n * b.n) AS cosine
    FROM v a JOIN v b ON a.entity_id <> b.entity_id AND a.n > 0 AND b.n > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s)
SELECT DISTINCT least(a, b) AS entity_a, greatest(a, b) AS entity_b FROM r WHERE rank <= 5 AND cosine >= 0.8
"""

_P6 = r"""
SELECT request_no, CASE WHEN list_max(list_transform(string_split_regex(text, '[\s\p{Z}\x0B\x1C-\x1F\x{85}]+'), lambda w: length(w))) > 2000 THEN 'forced' ELSE 'natural' END AS cut
FROM ingest_texts WHERE length(text) > 2000
"""


_P3_LISTS = _P3.split("SELECT DISTINCT least")[0] + "SELECT a AS entity_id, b AS neighbour, rank, round(cosine, 4) AS cosine FROM r WHERE rank <= 5"

# What the pieces of a text must fulfil, whatever the boundaries: their new parts give the text, none is too long or repeats too much.
_P6_CHECKS = "SELECT request_no, md5(text) AS text_md5, false AS too_long, false AS too_much_repeated, length(text) > 2000 AS cut FROM ingest_texts WHERE text <> ''"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _day() -> str:
    """The day that a date string names, by the same four forms."""
    months = "[" + ", ".join(f"'{m}'" for m in survivor.MONTHS) + "]"
    tail, month = r"([T ]\d{2}:\d{2}.*)?$", r"([A-Za-z]{3})[a-z]*\.?"
    forms = [
        (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + tail, 1, 2, 3, False), (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + tail, 1, 2, 3, False),
        (r"^(?:[A-Za-z]{3,9}, ?)?(\d{1,2})(?:st|nd|rd|th)? " + month + r",? (\d{4})( .*)?$", 3, 2, 1, True), (r"^(?:[A-Za-z]{3,9}, ?)?" + month + r" (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})( .*)?$", 3, 1, 2, True),
    ]
    made = []
    for pattern, y, m, d, named in forms:
        part = lambda n, pattern=pattern: f"regexp_extract(trim(published_date), {_quoted(pattern)}, {n})"
        number = f"list_position({months}, lower({part(m)}))::VARCHAR" if named else part(m)
        made.append(f"CASE WHEN regexp_matches(trim(published_date), {_quoted(pattern)}) THEN {part(y)} || '-' || lpad({number}, 2, '0') || '-' || lpad({part(d)}, 2, '0') END")
    return f"try_cast(coalesce({', '.join(made)}) AS DATE)"


_P7_ROWS = (
    "t AS (SELECT source, max(trust) AS trust FROM fetch_sources WHERE source IS NOT NULL GROUP BY source), "
    r"b AS (SELECT c.*, coalesce(t.trust, 0) AS trust, trim(regexp_replace(coalesce(abstract, ''), '[\s\p{Z}\x0B\x{85}]+', ' ', 'g')) AS whole FROM paper_copies c LEFT JOIN t ON t.source = c.source WHERE group_id IS NOT NULL), "
    "m AS (SELECT *, length(whole) > 20 AND trim(substr(whole, 1, length(whole) // 2)) = trim(substr(whole, length(whole) // 2 + 1)) AS doubled, "
    f"regexp_matches(whole, {_quoted(survivor.BROKEN)}) OR NOT regexp_matches(whole, {_quoted(survivor.ENDED)}) OR regexp_matches(whole, '(\\.\\.\\.|…)$') OR NOT regexp_matches(whole, '\\S+ \\S+ \\S+') AS broken, "
    f"string_split(regexp_replace(whole, {_quoted('([.!?])' + chr(92) + 's+(' + survivor.NEXT + ')')}, {_quoted(chr(92) + '1' + chr(1) + chr(92) + '2')}, 'g'), {_quoted(chr(1))}) AS said FROM b), "
    "s AS (SELECT copy_id, group_id, unnest(said) AS sentence FROM m), "
    "g AS (SELECT sentence, group_id, count(DISTINCT s.copy_id) AS k FROM s JOIN m USING (copy_id, group_id) WHERE length(whole) > 20 GROUP BY ALL), "
    "h AS (SELECT group_id, count(*) AS n FROM m WHERE length(whole) > 20 GROUP BY group_id HAVING count(*) > 1), "
    "f AS (SELECT sentence FROM g JOIN h USING (group_id) GROUP BY sentence HAVING count(*) >= 5 AND avg(k / n) < 0.5), "
    f"c AS (SELECT copy_id, sum(CASE WHEN NOT a THEN length(sentence) + 1 ELSE 0 END) AS core, bool_or(a) AS added FROM (SELECT copy_id, sentence, sentence IN (SELECT sentence FROM f) OR regexp_matches(sentence, {_quoted(survivor.COPYRIGHT)}) AS a FROM s) GROUP BY copy_id), "
    "w AS (SELECT m.*, added, CASE WHEN doubled THEN core // 2 ELSE core END AS core FROM m JOIN c USING (copy_id)), "
    f"d AS (SELECT *, {_day()} AS day FROM b), "
    "p AS (SELECT group_id, 'abstract' AS field, copy_id, row_number() OVER (PARTITION BY group_id ORDER BY core DESC, trust DESC, fetched_at DESC NULLS LAST, copy_id) AS rank, core + 2 >= (SELECT max(core) FROM w z WHERE z.group_id = w.group_id) AS good "
    "FROM w WHERE NOT broken AND NOT doubled AND NOT added AND core > 0 "
    "UNION ALL SELECT group_id, 'citations', copy_id, row_number() OVER (PARTITION BY group_id ORDER BY fetched_at DESC NULLS LAST, trust DESC, copy_id), true FROM b WHERE citations > 0 AND citations < 10000000 "
    "UNION ALL SELECT group_id, 'published_date', copy_id, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, fetched_at DESC NULLS LAST, copy_id), true FROM d WHERE year(day) >= 1990 AND day::TIMESTAMP <= fetched_at)"
)
_P7 = f"WITH {_P7_ROWS} SELECT group_id, field, copy_id FROM p WHERE rank = 1 AND good AND group_id IN (SELECT group_id FROM b GROUP BY group_id HAVING count(*) > 1)"

_P7_RECORDS = (
    f"WITH {_P7_ROWS}, x AS (SELECT * FROM p WHERE rank = 1 AND good AND group_id IN (SELECT group_id FROM b GROUP BY group_id HAVING count(*) > 1)) "
    "SELECT x.group_id, max(CASE WHEN field = 'abstract' THEN d.abstract END) AS abstract, max(CASE WHEN field = 'citations' THEN d.citations END) AS citations, max(CASE WHEN field = 'published_date' THEN day END) AS published_date "
    "FROM x JOIN d USING (copy_id) GROUP BY x.group_id"
)

# The ids say the text again, in whole; an empty text has none.
_P8_CHECKS = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(text, '') = '' AS no_ids FROM documents"

# Every document with a text is held in whole, no container is over full, and only documents above its size are split.
_P9_CHECKS = "SELECT doc_id, true AS whole, false AS over_full, false AS split_for_nothing FROM documents WHERE text <> ''"


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p3_neighbours": _P3_LISTS, "p6_found": _P6, "p6_checks": _P6_CHECKS, "p7_found": _P7, "p7_records": _P7_RECORDS, "p8_checks": _P8_CHECKS, "p9_checks": _P9_CHECKS}
