r"""The registered queries as SQL for DuckDB.

White space is spelled out because ``\s`` covers ASCII only there, and a
sentence boundary is marked with a control character because there is no
look-behind.
"""

from __future__ import annotations

import re

from citeharbor.functions.patterns import ARCHIVE, PatternSet
from citeharbor.plans.catalog import INDEXED_PATTERNS, NATURAL, SEARCH_TEXT, SOURCE_TERMS
from citeharbor.plans.fixtures import ARTICLES_SQL, MAP_SQL, REFERENCE_CELLS_SQL, STUDY_PAGES_SQL, URLS_SQL

WS = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CATEGORY = ("CASE WHEN NOT (coalesce(has_icpsr, false) OR coalesce(ref_has_icpsr, false)) "
            "THEN 'not_icpsr_related' "
            r"WHEN coalesce(regexp_matches(lower(regexp_replace(trim(doi), '^https?://(dx\.)?doi\.org/', '', 'i')), '^10\.3886/(icpsr|e)\d+'), false) "
            "OR coalesce(contains(lower(host_venue), 'icpsr'), false) THEN 'icpsr_data_doc' "
            "ELSE 'research_article_using_icpsr' END")
ARTICLES = f"articles AS ({ARTICLES_SQL})"
WORK_MAP = f"work_map AS ({MAP_SQL})"
URLS = f"urls AS ({URLS_SQL})"


def strip(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def split(value: str) -> str:
    marked = rf"regexp_replace({strip(value)}, '([.!?])[{WS}]+', '\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def re2(pattern: str, fold: bool = True) -> str:
    """A pattern without look-behind and possessive repeats, which only save time here."""
    plain = re.sub(r"\(\?<![^)]*\)", "", pattern).replace("++", "+")
    body = plain.replace(r"\s", f"[{WS}]").replace("'", "''")
    return f"'{'(?i)' if fold else ''}{body}'"


def sentence_cte(source: str, key: str, column: str) -> str:
    return (f"parts AS (SELECT {key} AS k, {split(column)} AS arr FROM {source}), "
            "sent AS (SELECT k, generate_subscripts(arr, 1) - 1 AS sno, unnest(arr) AS s FROM parts)")


def signals_cte(patterns: PatternSet) -> str:
    """Sentences ``sent(k, sno, s)`` to signals ``sig(k, sno, signal_no, ...)``."""
    steps = []
    if patterns.negatives:
        bad = " OR ".join(f"regexp_matches(s, {re2(p)})" for p in patterns.negatives)
        steps.append(f"used AS (SELECT * FROM sent WHERE NOT ({bad}))")
    else:
        steps.append("used AS (SELECT * FROM sent)")
    parts, number = [], 0
    for rule in patterns.rules:
        for pattern in rule.patterns:
            doi = "m" if rule.fills == "doi" else "CAST(NULL AS VARCHAR)"
            study = "m" if rule.fills == "study_number" else "CAST(NULL AS VARCHAR)"
            if rule.every_match:
                source = (f"(SELECT k, sno, s, generate_subscripts(a, 1) AS mno, unnest(a) AS m "
                          f"FROM (SELECT k, sno, s, regexp_extract_all(s, {re2(pattern)}, "
                          f"{rule.group}) AS a FROM used))")
            else:
                source = ("(SELECT k, sno, s, 1 AS mno, '' AS m FROM used "
                          f"WHERE regexp_matches(s, {re2(pattern)}))")
            parts.append(
                f"SELECT k, sno, {number} AS pno, mno, '{rule.signal_type}' AS signal_type, "
                f"{doi} AS doi, {study} AS study_number, {rule.weight} AS score, s FROM {source}")
            number += 1
    steps.append("strong AS (" + " UNION ALL ".join(parts) + ")")
    found = "SELECT * FROM strong"
    if patterns.keyword is not None:
        found += (
            f" UNION ALL SELECT k, sno, {number}, 1, '{patterns.keyword_type}', NULL, NULL, "
            f"{patterns.keyword_weight}, s FROM used WHERE contains(lower(s), '{patterns.keyword}') "
            "AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.k = used.k AND x.sno = used.sno)")
    steps.append(f"found AS ({found})")
    steps.append(
        "sig AS (SELECT k, sno, row_number() OVER (PARTITION BY k ORDER BY sno, pno, mno) - 1 "
        f"AS signal_no, signal_type, doi, study_number, score, {strip('s')} AS snippet FROM found)")
    return ", ".join(steps)


def result_cte(patterns: PatternSet, source: str, key: str) -> str:
    """Signals to ``det(k, has_icpsr, ...)``, one row per row of the source."""
    return (
        "top AS (SELECT k, max(score) AS best FROM sig GROUP BY k), "
        "folded AS (SELECT sig.k, CAST(sum(score) AS INT) AS total, max(best) AS best, "
        "arg_min(doi, signal_no) FILTER (doi IS NOT NULL) AS doi, "
        "arg_min(study_number, signal_no) FILTER (study_number IS NOT NULL) AS study, "
        "arg_min(signal_type, signal_no) FILTER (score = best) AS signal_type, "
        "arg_min(snippet, signal_no) FILTER (score = best) AS snippet "
        "FROM sig JOIN top ON top.k = sig.k GROUP BY sig.k "
        f"HAVING sum(score) >= {patterns.threshold}), "
        f"det AS (SELECT a.{key} AS k, folded.k IS NOT NULL AS has_icpsr, folded.doi AS icpsr_doi, "
        "folded.study AS icpsr_study_number, folded.total AS detection_score, "
        "folded.best AS max_signal_score, folded.signal_type, folded.snippet "
        f"FROM {source} a LEFT JOIN folded ON folded.k = a.{key})")


SIGNALS = ", ".join([ARTICLES, sentence_cte("articles", "seq", "fulltext"), signals_cte(ARCHIVE)])
DETECTED = f"{SIGNALS}, {result_cte(ARCHIVE, 'articles', 'seq')}"

REFS = (
    "refs AS (SELECT seq, CASE WHEN json_valid(referenced_works) THEN "
    "CASE WHEN json_type(referenced_works) = 'ARRAY' THEN list_transform("
    "CAST(referenced_works AS JSON[]), lambda x: CASE WHEN json_type(x) = 'NULL' OR x IS NULL THEN 'None' "
    "ELSE x ->> '$' END) ELSE [] END "
    "WHEN contains(referenced_works, ';') THEN list_filter(list_transform("
    "string_split(referenced_works, ';'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS refs "
    "FROM articles)")
MATCHED = (
    "works AS (SELECT openalex_work_id AS id, arg_max(icpsr_doi, seq) FILTER (icpsr_doi IS NOT NULL) "
    "AS doi, arg_max(icpsr_study_number, seq) FILTER (icpsr_study_number IS NOT NULL) AS study "
    "FROM work_map WHERE openalex_work_id IS NOT NULL GROUP BY 1), "
    "edges AS (SELECT seq, generate_subscripts(refs, 1) AS pos, unnest(refs) AS id FROM refs), "
    "hits AS (SELECT seq, string_agg(e.id, ';' ORDER BY pos) AS ids, "
    "string_agg(DISTINCT nullif(doi, ''), ';' ORDER BY nullif(doi, '')) AS dois, "
    "string_agg(DISTINCT CAST(nullif(study, 0) AS VARCHAR), ';' "
    "ORDER BY CAST(nullif(study, 0) AS VARCHAR)) AS studies "
    "FROM edges e JOIN works w ON w.id = e.id GROUP BY seq)")
REFERENCED = f"{WORK_MAP}, {REFS}, {MATCHED}"
FULL = (
    f"{DETECTED}, {REFERENCED}, "
    "joined AS (SELECT a.seq, a.id, a.title, a.doi, a.publication_year, a.host_venue, "
    "det.has_icpsr, det.icpsr_doi, det.icpsr_study_number, det.detection_score, "
    "det.max_signal_score, det.signal_type, det.snippet, hits.seq IS NOT NULL AS ref_has_icpsr, "
    "coalesce(ids, '') AS ref_icpsr_work_ids, coalesce(dois, '') AS ref_icpsr_dois, "
    "coalesce(studies, '') AS ref_icpsr_study_numbers "
    "FROM articles a JOIN det ON det.k = a.seq LEFT JOIN hits ON hits.seq = a.seq), "
    f"full_table AS (SELECT *, {CATEGORY} AS icpsr_work_category FROM joined)")
VIEW = (
    f"{FULL}, vw AS (SELECT *, publication_year AS year, host_venue AS journal, "
    "icpsr_study_number IS NOT NULL AS has_dataset_link, "
    "try_cast(icpsr_study_number AS BIGINT) AS study_norm FROM full_table WHERE has_icpsr), "
    "linked AS (SELECT * FROM vw WHERE has_dataset_link "
    "AND icpsr_work_category = 'research_article_using_icpsr')")


def summary_select(key: str, source: str = "det JOIN articles ON articles.seq = det.k") -> str:
    return (
        f"SELECT {key}, count(*) AS n_articles, max(detection_score) AS max_detection_score, "
        "CAST(avg(detection_score) AS DOUBLE) AS mean_detection_score, "
        "arg_min(struct_pack(title := title, doi := doi, snippet := snippet), "
        "struct_pack(a := -detection_score, b := seq)) AS best "
        f"FROM {source} WHERE has_icpsr AND icpsr_study_number IS NOT NULL GROUP BY ALL")


SUMMARY_KEYS = "icpsr_study_number, try_cast(icpsr_study_number AS BIGINT) AS study_norm"
SUMMARY = (
    f"grouped AS ({summary_select(SUMMARY_KEYS, 'full_table')}), "
    "datasets AS (SELECT * EXCLUDE (best), best.title AS title, best.doi AS doi, "
    "best.snippet AS snippet FROM grouped)")
STUDY = "https://www.icpsr.umich.edu/web/ICPSR/studies/"
SHORT = "CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n}) || '…' ELSE coalesce({t}, '') END"
CLEAN = r"regexp_replace({0}, '^https?://(dx\.)?doi\.org/', '', 'i')"

HTML_TEXT = (
    r"regexp_replace(regexp_replace(regexp_replace(html, "
    r"'<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>', "
    r"chr(10), 'gis'), '</?[a-zA-Z][^>]*>', chr(10), 'g'), '<[!?][^>]*>', chr(10), 'g')")


def decoded(value: str) -> str:
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"),
                       ("&gt;", ">"), ("&nbsp;", "\xa0")):
        value = f"replace({value}, '{name}', '{char}')"
    return rf"regexp_replace({value}, '&amp(;|\b)', '&', 'g')"


PAGE_TEXT = (
    f"page_text AS (SELECT page_id, url, nullif(array_to_string(list_filter(list_transform("
    f"string_split_regex({decoded(HTML_TEXT)}, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
    f"lambda x: {strip('x')}), lambda x: x <> ''), chr(10)), '') AS page_text FROM pages)")

SOURCE_TEST = " OR ".join(
    f"contains(lower(coalesce({c}, '')), '{t}')"
    for c in ("title", "abstract_text") for t in SOURCE_TERMS)
SEARCH_TEST = " OR ".join(
    f"regexp_matches(lower(coalesce({c}, '')), '{SEARCH_TEXT}')" for c in ("title", "doi", "journal"))
NESTED = (
    f"{ARTICLES}, {URLS}, nested AS (SELECT *, "
    "CASE WHEN seq % 31 <> 0 THEN record_url END AS landing, "
    "CASE WHEN seq % 31 <> 0 THEN CASE WHEN seq % 7 = 0 THEN '' ELSE fulltext_url END END AS pdf, "
    "CASE WHEN seq % 31 <> 0 THEN host_venue END AS venue, "
    "CASE WHEN seq % 3 = 2 THEN concat('http://oa.example/', seq) END AS oa, "
    "CASE WHEN seq % 5 <> 0 THEN id END AS openalex, "
    "CASE WHEN seq % 9 IN (0, 1, 6, 7, 8) THEN referenced_works END AS refs FROM urls)")
FULLTEXT_URL = "coalesce(nullif(pdf, ''), nullif(landing, ''), oa)"
RECORD_URL = "coalesce(nullif(doi, ''), nullif(landing, ''), nullif(openalex, ''), id)"
TWO_REQUESTS = (
    f"{ARTICLES}, both_requests AS (SELECT 0 AS query_ord, * FROM articles WHERE NOT is_oa "
    "UNION ALL SELECT 1, * FROM articles)")
RANKED = (
    f"{VIEW}, {SUMMARY}, usage AS (SELECT study_norm, count(*) AS n_use FROM linked "
    "WHERE study_norm IS NOT NULL GROUP BY 1), "
    "merged AS (SELECT study_norm, min(icpsr_study_number) AS icpsr_study_number, "
    "arg_min(title, icpsr_study_number) AS title, CAST(sum(n_articles) AS BIGINT) AS n_articles, "
    "max(max_detection_score) AS max_detection_score, "
    "sum(mean_detection_score * n_articles) / sum(n_articles) AS mean_detection_score "
    "FROM datasets WHERE study_norm IS NOT NULL GROUP BY 1), "
    "reused AS (SELECT d.*, n_use FROM merged d JOIN usage u ON u.study_norm = d.study_norm)")
ROW_TABLE = (
    f"{VIEW}, chosen AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS row_id, * FROM vw "
    "WHERE icpsr_work_category = 'research_article_using_icpsr' "
    f"AND ({SEARCH_TEST}) AND year BETWEEN 1999 AND 2022)")
COUNT_FLAGS = {
    "articles": "true", "hits": "has_icpsr", "linked": "has_dataset_link",
    "research": "icpsr_work_category = 'research_article_using_icpsr'",
    "data_docs": "icpsr_work_category = 'icpsr_data_doc'",
}
CHOSEN = ("has_icpsr AND has_dataset_link AND year BETWEEN 2000 AND 2020 AND "
          f"icpsr_work_category = 'research_article_using_icpsr' AND ({SEARCH_TEST})")
SIMILAR = (
    f"{FULL}, {SUMMARY}, named AS (SELECT icpsr_study_number, concat_ws(' ', title, snippet) AS text "
    "FROM datasets), leaders AS (SELECT text, min(icpsr_study_number) AS group_study, "
    "count(*) AS n_datasets FROM named GROUP BY text)")
TERMS = (
    f"{SIMILAR}, words AS (SELECT group_study, unnest(string_split_regex(lower(text), "
    r"'[^\p{L}\p{N}]+')) AS term FROM leaders), "
    "tf AS (SELECT group_study, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "raw AS (SELECT group_study, tf.term, tf * (ln(((SELECT count(*) FROM leaders) + 1)::DOUBLE "
    "/ (df + 1)) + 1) AS w FROM tf JOIN df ON df.term = tf.term), "
    "unit AS (SELECT group_study, term, w / sqrt(sum(w * w) OVER (PARTITION BY group_study)) AS w "
    "FROM raw)")

ORACLE: dict[str, str] = {
    "q_source_filter":
        f"WITH {ARTICLES} SELECT seq, title, publication_year FROM articles WHERE is_oa AND "
        f"publication_year BETWEEN 2000 AND 2024 AND ({SOURCE_TEST})",
    "q_works_normalize":
        f"WITH {NESTED} SELECT seq, id, title, doi, publication_year, is_oa, venue AS host_venue, "
        "CASE WHEN trim(abstract_text) <> '' THEN array_to_string(list_filter(string_split("
        "abstract_text, ' '), lambda x: x <> ''), ' ') END AS abstract_text, "
        f"{FULLTEXT_URL} AS fulltext_url, {RECORD_URL} AS record_url, "
        "coalesce(refs, '[]') AS referenced_works FROM nested",
    "q_url_priority":
        f"WITH {NESTED} SELECT seq, {FULLTEXT_URL} AS fulltext_url, {RECORD_URL} AS record_url "
        "FROM nested",
    "q_inverted_index":
        "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') "
        "AS decoded FROM documents",
    "q_norm_text":
        f"SELECT doc_id, {strip(f'''regexp_replace(text, '[{WS}]+', ' ', 'g')''')} AS normed "
        "FROM documents",
    "q_clean_doi":
        f"WITH {ARTICLES} SELECT seq, {CLEAN.format('doi')} AS clean_doi, "
        f"{CLEAN.format('doi')} AS clean_padded FROM articles",
    "q_json_path":
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
        "coalesce(json_extract_string(props, '$.k.deep'), 'none') AS deep FROM events",
    "q_study_key":
        "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 4) THEN NULL ELSE o_orderkey END "
        "AS study_norm, CASE WHEN o_orderkey % 6 IN (3, 4) THEN '' "
        f"ELSE concat('{STUDY}', o_orderkey) END AS icpsr_link FROM orders",
    "q_parse_refs":
        f"WITH {ARTICLES}, cells AS ({REFERENCE_CELLS_SQL}), {REFS.replace('FROM articles', 'FROM cells')} "
        "SELECT seq, len(refs) AS n_refs, "
        "coalesce(array_to_string(refs, '|'), '') AS refs FROM refs",
    "q_sentences":
        f"WITH {sentence_cte('documents', 'doc_id', 'text')} "
        "SELECT k AS doc_id, CAST(sno AS INT) AS sentence_no, s AS sentence FROM sent",
    "q_negative_context":
        f"WITH {ARTICLES}, {sentence_cte('articles', 'seq', 'fulltext')} "
        "SELECT k AS seq, CAST(sno AS INT) AS sentence_no, s AS sentence FROM sent WHERE "
        + " OR ".join(f"regexp_matches(s, {re2(p)})" for p in ARCHIVE.negatives),
    "q_html_text": f"WITH {PAGE_TEXT} SELECT page_id, page_text FROM page_text",
    "q_page_metadata":
        f"WITH study_pages AS ({STUDY_PAGES_SQL}) "
        f"SELECT CAST(page_id AS VARCHAR) AS icpsr_id, concat('{STUDY}', page_id) AS icpsr_url, "
        "concat('Study', page_id, '& more') AS title, "
        "CASE WHEN page_id % 12 = 2 THEN 'Co-Investigator B; ' ELSE '' END || CASE WHEN page_id % 6 = 2 "
        "THEN concat('Principal Investigator: Dr ', page_id) END AS creators, "
        "nullif(concat_ws('; ', CASE WHEN page_id % 4 = 1 THEN concat('Item ', page_id % 5) END, "
        "CASE WHEN page_id % 3 = 0 THEN concat('Topic ', page_id % 7, '; Topicb') END), '') AS subjects, "
        "CASE page_id % 5 WHEN 0 THEN concat('About ', page_id, ' end') WHEN 1 THEN concat('First ', page_id) "
        "WHEN 2 THEN concat('Text <', page_id, '>') END AS description, "
        r"nullif(regexp_extract(html, '10\.\d{4,9}/[-._;()/:A-Z0-9]+', 0, 'i'), '') AS doi "
        "FROM study_pages",
    "q_detection_csv":
        f"WITH {FULL} SELECT seq, id, nullif(title, '') AS title, nullif(doi, '') AS doi, publication_year, has_icpsr, "
        "icpsr_study_number, detection_score, "
        "CASE WHEN seq % 2 = 0 THEN concat('type ', seq % 5) END AS work_type FROM full_table",
    "q_works_json":
        f"WITH {NESTED}, filed AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS place, * FROM nested) "
        "SELECT place AS seq, id, doi, publication_year, is_oa, venue AS host_venue FROM filed "
        "WHERE seq % 10 <> 3 AND seq % 50 <> 7",
    "q_works_rejected":
        f"WITH {ARTICLES}, filed AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS place, seq FROM articles) "
        "SELECT place AS seq, seq % 10 <> 3 AS is_null FROM filed WHERE seq % 10 = 3 OR seq % 50 = 7",
    "q_works_first":
        f"WITH {ARTICLES}, filed AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS place, * FROM articles) "
        "SELECT place AS seq, id, doi FROM filed WHERE seq % 10 <> 3 AND seq % 50 <> 7 QUALIFY doi IS NULL "
        "OR row_number() OVER (PARTITION BY doi ORDER BY seq) = 1",
    "q_csv_arrival":
        f"WITH {ARTICLES} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, id, nullif(title, '') AS title, "
        "publication_year FROM articles",
    "q_map_file":
        f"WITH {ARTICLES}, {REFERENCED} SELECT a.seq, h.seq IS NOT NULL AS ref_has_icpsr, "
        "coalesce(ids, '') AS ref_icpsr_work_ids, coalesce(dois, '') AS ref_icpsr_dois, "
        "coalesce(studies, '') AS ref_icpsr_study_numbers "
        "FROM articles a LEFT JOIN hits h ON h.seq = a.seq",
    "q_union_references":
        f"WITH {ARTICLES}, {REFERENCED} SELECT query_ord, a.seq AS source_seq, h.seq IS NOT NULL AS ref_has_icpsr, "
        "coalesce(ids, '') AS ref_icpsr_work_ids FROM (SELECT 0 AS query_ord, * FROM articles WHERE NOT is_oa "
        "UNION ALL SELECT 1, * FROM articles) a LEFT JOIN hits h ON h.seq = a.seq",
    "q_indexed_search":
        f"WITH {VIEW} " + " UNION ALL ".join(
            f"SELECT {i} AS pattern, seq FROM vw WHERE " + " OR ".join(
                f"regexp_matches(lower(coalesce({c}, '')), '{pattern}')" for c in ("title", "doi", "journal"))
            for i, pattern in enumerate(INDEXED_PATTERNS)),
    "q_article_lookup":
        f"WITH {ROW_TABLE}, best AS (SELECT * FROM chosen ORDER BY detection_score DESC, seq LIMIT 1) "
        f"SELECT row_id, concat('[', row_id, '] ', {SHORT.format(t='title', n=90)}) AS label, "
        "coalesce(title, '') AS title, "
        "CASE WHEN doi IS NULL OR trim(doi) = '' THEN '' WHEN starts_with(trim(doi), 'http') "
        "THEN trim(doi) ELSE concat('https://doi.org/', trim(doi)) END AS doi_url, journal, "
        "icpsr_study_number, detection_score, signal_type, snippet FROM best",
    "q_dataset_lookup":
        f"WITH {RANKED}, best AS (SELECT study_norm FROM reused ORDER BY n_use DESC, study_norm LIMIT 1) "
        "SELECT datasets.*, "
        f"concat('{STUDY}', study_norm) AS icpsr_link FROM datasets WHERE study_norm IN (FROM best) "
        "ORDER BY icpsr_study_number LIMIT 1",
    "q_journal_rows":
        f"WITH {VIEW} SELECT study_norm, seq, title, year, journal, doi, detection_score, signal_type "
        "FROM linked WHERE study_norm IS NOT NULL AND journal = (SELECT min(journal) FROM linked "
        "WHERE study_norm IS NOT NULL)",
    "q_cluster_datasets":
        f"WITH RECURSIVE {TERMS}, pairs AS (SELECT a.group_study AS x, b.group_study AS y FROM unit a "
        "JOIN unit b ON a.term = b.term AND a.group_study <> b.group_study GROUP BY ALL "
        "HAVING round(sum(a.w * b.w), 6) >= 0.5), reach AS (SELECT group_study AS node, group_study AS seen "
        "FROM leaders UNION SELECT r.node, p.y FROM reach r JOIN pairs p ON p.x = r.seen), "
        "roots AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node) "
        "SELECT icpsr_study_number, cluster FROM named JOIN leaders ON leaders.text = named.text "
        "JOIN roots ON roots.node = leaders.group_study",
    "q_dedup_doi":
        f"WITH {TWO_REQUESTS} SELECT query_ord, seq, id, doi FROM both_requests "
        "QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY query_ord, seq) = 1",
    "q_dedup_doi_collapse":
        f"WITH {TWO_REQUESTS} SELECT query_ord, seq, id, doi FROM both_requests "
        "QUALIFY row_number() OVER (PARTITION BY doi ORDER BY query_ord, seq) = 1",
    "q_fulltext_fallback":
        f"WITH {ARTICLES}, {URLS}, {PAGE_TEXT} SELECT u.seq, coalesce(f.page_text, r.page_text, "
        f"CASE WHEN {strip('abstract_text')} <> '' THEN abstract_text END, '') AS fulltext "
        "FROM urls u LEFT JOIN page_text f ON f.url = u.fulltext_url "
        "LEFT JOIN page_text r ON r.url = u.record_url",
    "q_csv_roundtrip": f"WITH {ARTICLES} SELECT * FROM articles",
    "q_signals":
        f"WITH {SIGNALS} SELECT k AS seq, CAST(sno AS INT) AS sentence_no, "
        "CAST(signal_no AS INT) AS signal_no, signal_type, doi, study_number, score, snippet "
        "FROM sig",
    "q_detect_documents":
        f"WITH {DETECTED} SELECT k AS seq, * EXCLUDE (k) FROM det",
    "q_detection_refresh":
        f"WITH {DETECTED} SELECT k AS seq, has_icpsr, icpsr_study_number, detection_score FROM det WHERE k % 5 <> 2",
    "q_detect_natural":
        f"WITH {sentence_cte('documents', 'doc_id', 'text')}, {signals_cte(NATURAL)}, "
        f"{result_cte(NATURAL, 'documents', 'doc_id')} SELECT k AS doc_id, * EXCLUDE (k) FROM det",
    "q_ref_detect":
        f"WITH {ARTICLES}, {REFERENCED} SELECT a.seq, h.seq IS NOT NULL AS ref_has_icpsr, "
        "coalesce(ids, '') AS ref_icpsr_work_ids, coalesce(dois, '') AS ref_icpsr_dois, "
        "coalesce(studies, '') AS ref_icpsr_study_numbers "
        "FROM articles a LEFT JOIN hits h ON h.seq = a.seq",
    "q_ref_detect_prefiltered":
        f"WITH {ARTICLES}, {REFERENCED} SELECT a.seq, h.seq IS NOT NULL AS ref_has_icpsr, "
        "coalesce(ids, '') AS ref_icpsr_work_ids, coalesce(dois, '') AS ref_icpsr_dois, "
        "coalesce(studies, '') AS ref_icpsr_study_numbers "
        "FROM articles a LEFT JOIN hits h ON h.seq = a.seq",
    "q_ref_detect_graph":
        "SELECT l_orderkey AS work, p_partkey AS work_id, concat('10.5555/', p_brand) AS doi, "
        "CAST(p_partkey AS VARCHAR) AS study, count(*) AS n_refs FROM lineitem "
        "JOIN part ON p_partkey = l_partkey WHERE p_size <= 10 "
        "AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL",
    "q_detection_table":
        f"WITH {FULL} SELECT seq, has_icpsr, icpsr_doi, icpsr_study_number, detection_score, "
        "max_signal_score, signal_type, snippet, ref_has_icpsr, ref_icpsr_work_ids, "
        "ref_icpsr_dois, ref_icpsr_study_numbers, icpsr_work_category FROM full_table",
    "q_classify":
        f"WITH {FULL} SELECT seq, has_icpsr, ref_has_icpsr, icpsr_work_category FROM full_table",
    "q_detected_subset":
        f"WITH {FULL} SELECT seq, id, title, icpsr_study_number, detection_score, "
        "icpsr_work_category FROM full_table WHERE has_icpsr",
    "q_category_counts":
        f"WITH {FULL} SELECT icpsr_work_category, count(*) AS n_works, "
        "count(*) FILTER (has_icpsr) AS n_text_hits, "
        "count(*) FILTER (ref_has_icpsr) AS n_reference_hits FROM full_table GROUP BY 1",
    "q_run_summary":
        f"WITH {FULL} SELECT count(*) FILTER (has_icpsr) AS n_text_hits, "
        "count(*) FILTER (ref_has_icpsr) AS n_reference_hits FROM full_table",
    "q_funnel_stats":
        f"WITH {FULL} " + " UNION ALL ".join(
            f"SELECT '{stage}' AS stage, '{metric}' AS metric, {value} AS value FROM {source}"
            for stage, metric, value, source in (
                ("collected", "total_articles", "count(*)", "documents"),
                ("detection", "rows", "count(*)", "full_table"),
                ("detection", "with_signal", "count(*) FILTER (has_icpsr)", "full_table"),
                ("related", "total", "count(*) FILTER (has_icpsr)", "full_table"),
                ("related", "research", "count(*) FILTER (has_icpsr AND icpsr_work_category = "
                 "'research_article_using_icpsr')", "full_table"),
                ("related", "data_docs", "count(*) FILTER (has_icpsr AND icpsr_work_category = "
                 "'icpsr_data_doc')", "full_table"),
                ("related", "other", "count(*) FILTER (has_icpsr AND icpsr_work_category NOT IN "
                 "('research_article_using_icpsr', 'icpsr_data_doc'))", "full_table"),
                ("related", "with_study_number", "count(icpsr_study_number)", "full_table"),
                ("related", "research_linked", "count(icpsr_study_number) FILTER (has_icpsr AND "
                 "icpsr_work_category = 'research_article_using_icpsr')", "full_table"),
                ("datasets", "distinct", "count(DISTINCT icpsr_study_number) FILTER (has_icpsr)",
                 "full_table"))),
    "q_dataset_summary":
        f"WITH {DETECTED}, grouped AS ({summary_select(SUMMARY_KEYS)}) SELECT * EXCLUDE (best), "
        "best.title AS title, best.doi AS doi, best.snippet AS snippet FROM grouped",
    "q_dataset_summary_merged":
        f"WITH {DETECTED}, grouped AS ("
        + summary_select("try_cast(icpsr_study_number AS BIGINT) AS study_norm")
        + ") SELECT CAST(study_norm AS VARCHAR) AS icpsr_study_number, * EXCLUDE (best), "
        "best.title AS title, best.doi AS doi, best.snippet AS snippet FROM grouped",
    "q_build_map":
        f"WITH {DETECTED}, grouped AS ({summary_select(SUMMARY_KEYS)}), "
        f"wanted AS (SELECT icpsr_study_number, {CLEAN.format('best.doi')} AS icpsr_doi, "
        "best.title AS title FROM grouped WHERE best.doi IS NOT NULL), "
        f"catalogue AS (SELECT lower({CLEAN.format('doi')}) AS key, arg_min(id, seq) AS id "
        "FROM articles GROUP BY 1) "
        "SELECT icpsr_study_number, icpsr_doi, title, id AS openalex_work_id FROM wanted "
        "LEFT JOIN catalogue ON key = lower(icpsr_doi)",
    "q_dataset_similarity":
        f"WITH {TERMS}, pairs AS (SELECT a.group_study AS study_a, b.group_study AS study_b, "
        "round(sum(a.w * b.w), 6) AS similarity FROM unit a JOIN unit b ON a.term = b.term "
        "AND a.group_study < b.group_study GROUP BY ALL) "
        "SELECT * FROM pairs WHERE similarity >= 0.5",
    "q_similarity_matrix":
        f"WITH {TERMS} SELECT a.group_study AS study_a, b.group_study AS study_b, "
        "round(sum(a.w * b.w), 6) AS similarity FROM unit a JOIN unit b ON a.term = b.term GROUP BY ALL "
        "HAVING a.group_study = b.group_study OR round(sum(a.w * b.w), 6) >= 0.5",
    "q_dataset_text_groups":
        f"WITH {SIMILAR} SELECT icpsr_study_number, group_study, n_datasets FROM named "
        "JOIN leaders ON leaders.text = named.text",
    "q_overview":
        f"WITH {VIEW}, counts AS (SELECT (SELECT count(*) FROM vw WHERE has_dataset_link) "
        "AS n_identified, (SELECT count(*) FROM linked) AS n_research_identified, "
        "(SELECT count(*) FROM vw WHERE has_dataset_link AND icpsr_work_category = "
        "'icpsr_data_doc') AS n_docs_identified, (SELECT count(*) FROM linked) AS n_research_linked, "
        "(SELECT count(DISTINCT journal) FROM linked) AS n_journals_linked, "
        "(SELECT count(DISTINCT study_norm) FROM linked) AS n_datasets_linked, "
        "(SELECT min(year) FROM linked) AS year_min, (SELECT max(year) FROM linked) AS year_max) "
        "SELECT *, CASE WHEN year_min IS NULL THEN 'n/a' ELSE concat(year_min, '–', year_max) END "
        "AS year_range FROM counts",
    "q_filter_counts":
        f"WITH {VIEW} SELECT "
        + ", ".join([f"count(*) FILTER ({f}) AS total_{n}" for n, f in COUNT_FLAGS.items()]
                    + [f"count(*) FILTER ({f} AND {CHOSEN}) AS filtered_{n}"
                       for n, f in COUNT_FLAGS.items()]) + " FROM vw",
    "q_article_search":
        f"WITH {ROW_TABLE} SELECT row_id, seq, title, journal, year, has_dataset_link FROM chosen",
    "q_article_detail":
        f"WITH {ROW_TABLE} SELECT row_id, concat('[', row_id, '] ', "
        f"{SHORT.format(t='title', n=90)}) AS label, coalesce(title, '') AS title, "
        "CASE WHEN doi IS NULL OR trim(doi) = '' THEN '' WHEN starts_with(trim(doi), 'http') "
        "THEN trim(doi) ELSE concat('https://doi.org/', trim(doi)) END AS doi_url, journal, "
        "icpsr_study_number, detection_score, signal_type, snippet FROM chosen",
    "q_dataset_ranking":
        f"WITH {RANKED} SELECT icpsr_study_number, title, n_use AS n_articles_using_dataset, "
        "n_articles, max_detection_score, mean_detection_score, "
        f"concat('{STUDY}', study_norm) AS icpsr_link, concat(icpsr_study_number, ' · ', "
        f"{SHORT.format(t='title', n=80)}, ' (n=', n_use, ')') AS label FROM reused "
        "ORDER BY n_use DESC, study_norm, icpsr_study_number LIMIT 20",
    "q_dataset_totals":
        f"WITH {RANKED} SELECT count(DISTINCT study_norm) AS n_distinct_datasets, "
        "count(*) FILTER (n_use > 0) AS n_reused_datasets FROM reused",
    "q_dataset_articles":
        f"WITH {VIEW} SELECT study_norm, seq, title, year, journal, doi, detection_score, "
        "signal_type FROM linked WHERE study_norm IS NOT NULL",
    "q_journal_ranking":
        f"WITH {VIEW} SELECT journal, count(*) AS n_articles, count(DISTINCT study_norm) "
        "AS n_datasets, min(year) AS year_min, max(year) AS year_max, "
        "CASE WHEN min(year) IS NULL THEN 'n/a' ELSE concat(min(year), '–', max(year)) END "
        "AS year_range FROM linked WHERE journal IS NOT NULL GROUP BY journal "
        "ORDER BY n_articles DESC, journal LIMIT 20",
    "q_journal_datasets":
        f"WITH {VIEW}, {SUMMARY}, counts AS (SELECT journal, study_norm, count(*) AS n_articles "
        "FROM linked WHERE journal IS NOT NULL AND study_norm IS NOT NULL GROUP BY ALL), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY n_articles DESC, "
        "study_norm) AS rank FROM counts), meta AS (SELECT study_norm, min(icpsr_study_number) "
        "AS number, arg_min(title, icpsr_study_number) AS title FROM datasets GROUP BY 1) "
        "SELECT journal, CAST(rank AS INT) AS rank, number AS icpsr_study_number, title, n_articles, "
        f"concat('{STUDY}', ranked.study_norm) AS icpsr_link, concat(number, ' · ', "
        f"{SHORT.format(t='title', n=80)}, ' (n=', n_articles, ')') AS label "
        "FROM ranked LEFT JOIN meta ON meta.study_norm = ranked.study_norm WHERE rank <= 15",
    "q_journal_profile":
        f"WITH {VIEW} SELECT journal, count(*) AS n_articles, min(year) AS year_min, "
        "max(year) AS year_max FROM linked WHERE journal IS NOT NULL AND study_norm IS NOT NULL "
        "GROUP BY journal",
    "q_journals":
        f"WITH {VIEW} SELECT DISTINCT journal FROM linked "
        "WHERE journal IS NOT NULL AND study_norm IS NOT NULL",
}
# The same views, answered from counts.
ROLLED = {"q_rollup_overview": "q_overview", "q_rollup_journals": "q_journal_ranking", "q_rollup_profile": "q_journal_profile"}
ORACLE |= {name: ORACLE[view] for name, view in ROLLED.items()}
CHOSEN_COUNTS = ("has_icpsr AND year BETWEEN 2000 AND 2020 AND icpsr_work_category = 'research_article_using_icpsr'")
ORACLE["q_rollup_counts"] = f"WITH {VIEW} SELECT " + ", ".join(
    [f"count(*) FILTER ({f}) AS total_{n}" for n, f in COUNT_FLAGS.items()]
    + [f"count(*) FILTER ({f} AND {CHOSEN_COUNTS}) AS filtered_{n}" for n, f in COUNT_FLAGS.items()]) + " FROM vw"
