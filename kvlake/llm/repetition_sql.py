"""SQL of the quality rules: repeated passages by ranks of windows of 1, 2, 4, ... words, and the longest by refining bit by bit."""

from __future__ import annotations

from .repetition import WINDOW, Limits

#: Windows of up to 2 ** (LEVELS - 1) words: longest repeats below 2 ** LEVELS words are found.
LEVELS = 15


def longest_repeat_sql() -> str:
    """CTEs from ``x`` (doc_id, word, i) to ``c0`` (doc_id, cur): each text's longest passage that stands twice in it."""
    parts = ["r0 AS (SELECT doc_id, i, min(i) OVER p AS g FROM x WINDOW p AS (PARTITION BY doc_id, word) QUALIFY count(*) OVER p > 1)"]
    for t in range(1, LEVELS):
        half = 1 << (t - 1)
        parts.append(
            f"r{t} AS (SELECT a.doc_id, a.i, min(a.i) OVER p AS g FROM r{t - 1} a JOIN r{t - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {half} WINDOW p AS (PARTITION BY a.doc_id, a.g, b.g) QUALIFY count(*) OVER p > 1)"
        )
    parts.append("ranks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {t} AS t, * FROM r{t}" for t in range(LEVELS)) + ")")
    parts.append(f"c{LEVELS - 1} AS (SELECT doc_id, max(t) AS t, 1 << max(t) AS cur FROM ranks GROUP BY doc_id)")
    for s in range(LEVELS - 2, -1, -1):
        parts.append(
            f"e{s} AS (SELECT DISTINCT doc_id FROM (SELECT a.doc_id FROM c{s + 1} c JOIN ranks a ON a.doc_id = c.doc_id AND a.t = c.t JOIN ranks b ON b.doc_id = c.doc_id AND b.t = c.t AND b.i = a.i + c.cur + {1 << s} - (1 << c.t) WHERE c.t > {s} GROUP BY a.doc_id, a.g, b.g HAVING count(*) > 1))"
        )
        parts.append(f"c{s} AS (SELECT c.doc_id, c.t, c.cur + CASE WHEN e.doc_id IS NULL THEN 0 ELSE {1 << s} END AS cur FROM c{s + 1} c LEFT JOIN e{s} e USING (doc_id))")
    return ",\n        ".join(p if "MATERIALIZED" in p else p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


def _windows(n: int) -> str:
    """doc_id, i and n of windows of ``n`` words that stand twice in their text: two windows of a power of two words cover one."""
    t = n.bit_length() - 1
    return f"SELECT a.doc_id, a.i, {n} AS n FROM r{t} a JOIN r{t} b ON b.doc_id = a.doc_id AND b.i = a.i + {n - (1 << t)} QUALIFY count(*) OVER (PARTITION BY a.doc_id, a.g, b.g) > 1"


def judge_sql(limits: Limits = Limits()) -> str:
    failed = f"(n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_window_percent} * n_words)"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1))::INT AS i FROM t),
        {longest_repeat_sql()},
        covered AS (SELECT doc_id, n, count(DISTINCT j) AS words FROM (SELECT doc_id, n, unnest(range(i, i + n)) AS j FROM ({_windows(WINDOW)} UNION ALL {_windows(limits.min_repeat)})) GROUP BY doc_id, n),
        ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
        m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
              coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(f.words, 0)::BIGINT AS n_repeat_words, coalesce(c.words, 0)::BIGINT AS covered_words, coalesce(c0.cur, 0)::BIGINT AS longest_repeat
              FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN c0 USING (doc_id) LEFT JOIN covered f ON f.doc_id = t.doc_id AND f.n = {WINDOW} LEFT JOIN covered c ON c.doc_id = t.doc_id AND c.n = {limits.min_repeat})
        SELECT *, {failed} AS base_failed, NOT {failed} AND covered_words <= {limits.max_covered} * n_words AND longest_repeat <= {limits.max_longest} AS kept FROM m"""
