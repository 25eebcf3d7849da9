r"""Queries of this subpackage as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from citeharbor.llm import quality

WORDS = (r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')")


def _quartiles(name: str, keys: str) -> str:
    part = f"PARTITION BY {keys + ', ' if keys else ''}measure"
    return (
        f"{name} AS (SELECT {keys + ', ' if keys else ''}measure, max(total) AS total, "
        "min(cell) FILTER (4 * upto >= total) AS q1, min(cell) FILTER (4 * upto >= 3 * total) AS q3 "
        f"FROM (SELECT *, sum(n) OVER ({part} ORDER BY cell) AS upto, sum(n) OVER ({part}) AS total "
        f"FROM (SELECT {keys + ', ' if keys else ''}measure, cell, sum(n) AS n FROM cells GROUP BY ALL)) "
        f"GROUP BY {keys + ', ' if keys else ''}measure)")


def _measure(name: str, part: str) -> str:
    return f"SELECT lang, source, '{name}' AS measure, (1000 * {part}) // greatest(n_words, 1) AS v FROM passed"


PARTS = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "20 * n_dup_lines"}
SLACK = " ".join(f"WHEN '{m}' THEN {'q3 // 2' if m in quality.TWO_SIDED else s}" for m, s in quality.MEASURES.items())
INSIDE = " AND ".join(
    f"(1000 * {p}) // greatest(n_words, 1) <= high_{m}"
    + (f" AND (1000 * {p}) // greatest(n_words, 1) >= low_{m}" if m in quality.TWO_SIDED else "")
    for m, p in PARTS.items())
SIDES = ", ".join(f"max(high) FILTER (measure = '{m}') AS high_{m}, max(low) FILTER (measure = '{m}') AS low_{m}"
                  for m in PARTS)

ORACLE = {
    "op8_quality":
        f"WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents), "
        "windows AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS s FROM texts, "
        "unnest(range(0, greatest(len(words) - 7, 0))) AS t(i)), "
        "again AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1), "
        "covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 8)) AS p "
        "FROM windows w JOIN again a ON a.doc_id = w.doc_id AND a.s = w.s) GROUP BY doc_id), "
        "lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), "
        r"lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts), "
        "counts AS (SELECT t.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, "
        "CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, "
        "CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, "
        "CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, "
        "coalesce(c.n, 0) AS n_repeat_words FROM texts t JOIN lines USING (doc_id) LEFT JOIN covered c "
        "ON c.doc_id = t.doc_id), "
        f"base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > "
        f"{quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts), "
        "passed AS (SELECT * FROM base WHERE NOT base_failed), "
        "measured AS (" + " UNION ALL ".join(_measure(m, p) for m, p in PARTS.items()) + "), "
        "cells AS (SELECT lang, source, measure, v - v % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(v)) - "
        f"{quality.BITS}, 0) AS BIGINT)) AS cell, count(*) AS n FROM measured GROUP BY ALL), "
        + ", ".join((_quartiles("by_source", "lang, source"), _quartiles("by_lang", "lang"), _quartiles("by_all", "")))
        + ", chosen AS (SELECT s.lang, s.source, s.measure, "
        + ", ".join(f"CASE WHEN s.total >= {quality.MIN_ROWS} THEN s.{q} WHEN l.total >= {quality.MIN_ROWS} "
                    f"THEN l.{q} ELSE a.{q} END AS {q}" for q in ("q1", "q3"))
        + " FROM by_source s JOIN by_lang l ON l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure "
        "JOIN by_all a ON a.measure = s.measure), "
        "fences AS (SELECT lang, source, measure, q1 - least(greatest(spread, q1 // 4), q1 // 2) AS low, "
        f"q3 + greatest(spread, CASE measure {SLACK} END) AS high FROM (SELECT *, "
        f"{quality.SPREADS} * (q3 - q1) AS spread FROM chosen)), "
        f"limits AS (SELECT lang, source, {SIDES} FROM fences GROUP BY lang, source) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        f"NOT base_failed AND coalesce({INSIDE}, true) AS kept FROM base LEFT JOIN limits "
        "ON limits.lang IS NOT DISTINCT FROM base.lang AND limits.source IS NOT DISTINCT FROM base.source",
    "op9_substring_dedup":
        f"WITH texts AS (SELECT doc_id, {WORDS} AS words FROM documents), "
        "windows AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 50], ' ') AS s FROM texts, "
        "unnest(range(0, greatest(len(words) - 49, 0))) AS t(i)), "
        "first AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)), "
        "gone AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 50)) AS p "
        "FROM windows w JOIN first f ON f.s = w.s WHERE f.low < w.doc_id)), "
        "each AS (SELECT doc_id, generate_subscripts(words, 1) - 1 AS p, unnest(words) AS word FROM texts), "
        "kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each e "
        "LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.doc_id IS NULL GROUP BY e.doc_id) "
        "SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, "
        "sha256(coalesce(k.text, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id",
}
