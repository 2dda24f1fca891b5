"""Registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.ann import nearest
from weblode.llm.chat import chat_digests
from weblode.llm.common import table
from weblode.llm.fim import fim_digests
from weblode.llm.langid import identify
from weblode.llm.mixing import mixed_sizes
from weblode.llm.neardup import near_duplicates
from weblode.llm.packing import pack
from weblode.llm.pii import span_digests
from weblode.llm.quality import MEASURES, judged
from weblode.llm.resample import resampled
from weblode.llm.suffix import repeated_passages
from weblode.llm.template import extract
from weblode.llm.urlfilter import judged as judged_urls
from weblode.llm.urlfilter import rule_table


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of ``documents`` packed into sequences of 2048 tokens."""
    return pack(table(spark, folder, "documents"))


def op2_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation, and of one whose texts imitate control strings."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return chat_digests(given.unionByName(odd))


def op4_cross_parsing_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    return identify(table(spark, folder, "documents"))


def op5_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document, with its source as its host."""
    return judged(table(spark, folder, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op6_stable_projection_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_sparse_suffix_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that another document holds too."""
    return repeated_passages(table(spark, folder, "documents"))


def op8_disclosure_sanitisation(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, and the terms that reveal it."""
    return span_digests(table(spark, folder, "documents"))


def op9_weighted_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mixture takes."""
    return mixed_sizes(table(spark, folder, "documents"))


def op10_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, folder, "documents"))


#: Fixed values of the query's contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_redirect_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address, by rules and by the other addresses it stands for."""
    return judged_urls(table(spark, folder, "pages"), rule_table(spark, URL_RULES))


def op12_piece_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut at lines and rearranged, with digests of the result and of the text restored from it."""
    return fim_digests(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The tenth of all documents drawn towards the benchmark's words."""
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_template_extraction,
        op3_chat_formatting,
        op4_cross_parsing_language,
        op5_host_quality,
        op6_stable_projection_search,
        op7_sparse_suffix_passages,
        op8_disclosure_sanitisation,
        op9_weighted_mixture,
        op10_minhash_forest,
        op11_redirect_equivalence,
        op12_piece_table,
        op13_importance_resampling,
    )
}

CHECKS = {
    "op3_chat_formatting": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
          SELECT *, length(replace(role, '␛', '␛0')) + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]'))
            + length(replace(text, '␛', '␛0')) + 2 * len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]'))
            + 8 + 8 + 7 AS n FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op5_host_quality": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, source, text AS given, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
          SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)
        ), hit AS (
          SELECT DISTINCT r, i + k AS place
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS found FROM windows), range(5) AS t(k) WHERE found > 1
        ), repeats AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
        doubled AS (
          SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), measured AS (
          SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(doubled.n, 0) AS n_dup_lines,
            coalesce(repeats.n, 0) AS n_repeat_words,
            CASE WHEN given IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines
          FROM d LEFT JOIN doubled USING (r) LEFT JOIN repeats USING (r)
        ), failed AS (
          SELECT *, n_symbols > 0.1 * n_words AS f1, n_dup_lines > 0.3 * n_lines AS f2,
            NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 20) AS f3 FROM measured
        ), hosts AS (
          SELECT source, count(*) AS n, count(*) FILTER (f1) AS c1, count(*) FILTER (f2) AS c2, count(*) FILTER (f3) AS c3
          FROM failed GROUP BY source
        ), prior AS (
          SELECT avg(c1 / n) AS m1, var_pop(c1 / n) AS v1, avg(c2 / n) AS m2, var_pop(c2 / n) AS v2, avg(c3 / n) AS m3, var_pop(c3 / n) AS v3
          FROM hosts
        ), strength AS (
          SELECT *, CASE WHEN v1 > 0 THEN greatest(1, m1 * (1 - m1) / v1 - 1) ELSE 1 END AS s1,
            CASE WHEN v2 > 0 THEN greatest(1, m2 * (1 - m2) / v2 - 1) ELSE 1 END AS s2,
            CASE WHEN v3 > 0 THEN greatest(1, m3 * (1 - m3) / v3 - 1) ELSE 1 END AS s3 FROM prior
        ), bad AS (
          SELECT source, (c1 + m1 * s1) / (n + s1) > 0.5 AS b1, (c2 + m2 * s2) / (n + s2) > 0.5 AS b2, (c3 + m3 * s3) / (n + s3) > 0.5 AS b3
          FROM hosts, strength
        ), judged AS (
          SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (f1 AND b1) OR (f2 AND b2) OR (f3 AND b3) AS hit
          FROM failed f JOIN bad ON bad.source IS NOT DISTINCT FROM f.source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT hit AS kept FROM judged""",
    "op10_minhash_forest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
          SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
        ), reached AS (
          SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
        ), classes AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
        SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM classes c LEFT JOIN sizes s ON s.doc_id = c.doc_id""",
    # Absolute links only: the given pages hold no relative ones; tests cover those.
    "op11_redirect_equivalence": r"""
        WITH RECURSIVE rules(verdict, rule) AS (
          VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')
        ), p AS (
          SELECT row_number() OVER () AS r, page_id, url, html, regexp_replace(trim(url), '#.*', '', 's') AS node FROM pages
        ), tags AS (
          SELECT node, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<(script|style|title|textarea).*?</(script|style|title|textarea)\s*>', '', 'gis'),
            '(?is)<(?:link|meta)[\s/][^>]*>')) AS tag FROM p
        ), targets AS (
          SELECT node, CASE
            WHEN regexp_matches(tag, '(?is)^<link[^>]*\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^\s"''>]+)', 1)
            WHEN regexp_matches(tag, '(?is)^<meta[^>]*\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*([^\s"''>]+)', 1)
            ELSE '' END AS target FROM tags
        ), edges AS (
          SELECT DISTINCT node AS a, regexp_replace(target, '#.*', '', 's') AS b FROM targets WHERE target LIKE '%://%'
        ), sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        urls AS (SELECT node AS url FROM p UNION SELECT a FROM sides),
        parts AS (
          SELECT url, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM urls
        ), ruled AS (
          SELECT url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
          FROM parts LEFT JOIN rules ON ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/')))
          GROUP BY url, host, path
        ), reached AS (
          SELECT a AS x, a AS y FROM sides UNION SELECT x, b FROM reached JOIN sides ON y = a
        ), classes AS (
          SELECT x, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS blocked
          FROM reached JOIN ruled ON ruled.url = y GROUP BY x
        )
        SELECT page_id, p.url, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
        FROM p JOIN ruled ON p.node IS NOT DISTINCT FROM ruled.url LEFT JOIN classes ON x = p.node""",
    "op12_piece_table": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), drawn AS (
          SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3,
            ('0x' || h[25:32])::UBIGINT AS h4 FROM d
        ), cut AS (
          SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
          FROM drawn
        ), parts AS (
          SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
            AS output_sha256,
          sha256(text) AS restored_sha256
        FROM parts""",
    "op13_importance_resampling": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
          SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
        ), dw AS (SELECT r, unnest(w) AS word FROM d),
        steps AS (
          SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS s FROM range(256) AS t(i)
        ), distinct_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)),
        coded AS (
          SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT),
            lambda c, x: xor(c >> 8, s[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM distinct_words, steps
        ), raw AS (SELECT bucket, count(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
        wanted AS (SELECT bucket, count(*) AS t FROM b JOIN coded USING (word) GROUP BY bucket),
        gains AS (
          SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE)
            / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS g FROM raw LEFT JOIN wanted USING (bucket)
        ), weighed AS (
          SELECT r, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
          SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM d LEFT JOIN weighed USING (r)
        ), placed AS (
          SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)""",
}
