"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_text, line_dedup, minhash, mixing, repetition, sentence_pieces, toxicity, url_filter
from ._spark import table
from .repetition_sql import judge_sql


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_pieces.code(table(spark, sf_dir, "documents").select("doc_id", "text"), sentence_pieces.read_model())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair_turns(table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    s = toxicity.Settings()
    model = toxicity.train(docs, labels.where(~held_out), s)
    scored = toxicity.score(docs, model, s)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash": op7_minhash,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, list_filter(regexp_split_to_array(unnest(ls), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
        k AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS k FROM l WHERE len(w) > 0),
        f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, line_no) = 1),
        n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS ord FROM f WHERE len(w) >= 5),
        v AS (SELECT ord, 0 AS gap, k AS v FROM n UNION ALL SELECT ord, g AS gap, array_to_string(list_concat(w[1:g - 1], w[g + 1:]), ' ') AS v FROM (SELECT ord, w, unnest(range(1, len(w) + 1)) AS g FROM n)),
        m AS (SELECT v, gap, min(ord) AS ord FROM v GROUP BY ALL),
        s AS (SELECT v, min(ord) FILTER (gap = 0) AS whole, min(ord) FILTER (gap > 0) AS short FROM m GROUP BY v),
        e AS (SELECT v.ord, m.ord AS earlier FROM v JOIN m ON v.v = m.v AND v.gap = m.gap AND v.gap > 0 AND m.ord < v.ord
              UNION ALL SELECT v.ord, CASE WHEN v.gap = 0 THEN s.short ELSE s.whole END FROM v JOIN s ON v.v = s.v WHERE CASE WHEN v.gap = 0 THEN s.short ELSE s.whole END < v.ord),
        near AS (SELECT a.doc_id, a.line_no, b.doc_id AS near_doc, b.line_no AS near_line FROM (SELECT ord, min(earlier) AS earlier FROM e GROUP BY ord) x JOIN n a ON a.ord = x.ord JOIN n b ON b.ord = x.earlier),
        told AS (SELECT k.doc_id, k.line_no, coalesce(near_doc, f.doc_id) AS keep_doc, coalesce(near_line, f.line_no) AS keep_line FROM k JOIN f ON f.k = k.k LEFT JOIN near ON near.doc_id = f.doc_id AND near.line_no = f.line_no),
        gone AS (SELECT doc_id, list(line_no ORDER BY line_no) AS dropped, list(keep_doc ORDER BY line_no) AS kept_from FROM told WHERE keep_doc <> doc_id OR keep_line <> line_no GROUP BY doc_id)
        SELECT t.doc_id, len(ls)::BIGINT AS n_lines, len(ls) - coalesce(len(dropped), 0) AS n_kept, coalesce(dropped, []) AS dropped, coalesce(kept_from, []) AS kept_from FROM t LEFT JOIN gone USING (doc_id)""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
    "op4_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
        e AS (SELECT *, CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'books'
                             WHEN source IN ('src7', 'src8', 'src9', 'src10', 'src11', 'src12') THEN 'forum' ELSE 'other' END AS domain FROM d),
        leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS cap, CASE source WHEN 'src1' THEN 3 ELSE 1 END AS weight FROM e GROUP BY ALL),
        total AS (SELECT sum(tokens)::HUGEINT * 60 // 100 AS budget FROM leaf),
        d1 AS (SELECT domain, sum(cap)::HUGEINT AS cap, CASE domain WHEN 'crawl' THEN 3 WHEN 'books' THEN 4 WHEN 'forum' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY domain),
        d2 AS (SELECT *, cap * (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT
                         <= (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT) * weight AS f FROM d1, total),
        d3 AS (SELECT domain, CASE WHEN f THEN cap ELSE (budget - coalesce(sum(cap) FILTER (f) OVER (), 0)::HUGEINT) * weight // (sum(weight) FILTER (NOT f) OVER ())::HUGEINT END AS budget FROM d2),
        l1 AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS weight FROM leaf GROUP BY domain, lang),
        l2 AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT
                         <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT) * weight AS f FROM l1 JOIN d3 USING (domain)),
        l3 AS (SELECT domain, lang, CASE WHEN f THEN cap ELSE (budget - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY domain), 0)::HUGEINT) * weight // (sum(weight) FILTER (NOT f) OVER (PARTITION BY domain))::HUGEINT END AS budget FROM l2),
        s2 AS (SELECT *, cap * (sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT
                         <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT) * weight AS f FROM leaf JOIN l3 USING (domain, lang)),
        s3 AS (SELECT domain, lang, source, tokens, CASE WHEN f THEN cap ELSE (budget - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY domain, lang), 0)::HUGEINT) * weight // (sum(weight) FILTER (NOT f) OVER (PARTITION BY domain, lang))::HUGEINT END AS budget FROM s2),
        b AS (SELECT *, (budget // tokens)::BIGINT AS whole, budget % tokens AS rest FROM s3 WHERE budget > 0 AND tokens > 0),
        r AS (SELECT e.*, b.whole, b.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM e JOIN b USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM r
        UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch FROM r WHERE rest > 0 AND run <= rest""",
    "op6_quality_rules": judge_sql(),
    "op7_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
        x AS (SELECT doc_id, unnest(g) AS g FROM s),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        f AS (SELECT g, count(*) AS df FROM x GROUP BY g),
        r AS (SELECT x.doc_id, x.g, n.n, row_number() OVER (PARTITION BY x.doc_id ORDER BY f.df, x.g) AS k FROM x JOIN f USING (g) JOIN n USING (doc_id)),
        p AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n) + 1),
        c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        j AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN x u ON u.doc_id = c.a JOIN x v ON v.doc_id = c.b AND v.g = u.g GROUP BY ALL),
        l AS (SELECT a, b FROM j JOIN n na ON na.doc_id = j.a JOIN n nb ON nb.doc_id = j.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        t(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b)
        SELECT n.doc_id, n.n AS n_shingles, min(t.b) AS component_id, n.doc_id = min(t.b) AS kept FROM n JOIN t ON t.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op8_url_filter": r"""
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
               ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        parts AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '(?s)^[^/]*(.*)$', 1), '') AS path FROM parts),
        urls AS (SELECT DISTINCT host, path FROM p),
        labels AS (SELECT DISTINCT host, unnest(string_split(host, '.')) AS label FROM p),
        words AS (SELECT host, string_split(part, ':')[1] AS word FROM (SELECT host, unnest(string_split(label, '-')) AS part FROM labels)),
        topical AS (SELECT DISTINCT host FROM words WHERE word IN (TOPICS)),
        hit AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
                FROM urls u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path) GROUP BY ALL)
        SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, CASE WHEN EXISTS (SELECT 1 FROM topical t WHERE t.host = p.host) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN hit h ON p.host = h.host AND p.path = h.path""".replace("TOPICS", ", ".join(f"'{w}'" for words in url_filter.TOPICS.values() for w in words.split())),
}
