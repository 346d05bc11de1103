"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .curve_packing import pack_along_curve
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .fill_middle import fill_in_middle_digests
from .kneser_ney import judged
from .merkle import audit
from .packing import pack_documents
from .secrets import secret_digests
from .simhash import near_components
from .toxicity import toxicity_scores
from .url_rules import url_verdicts
from .vector_codes import ROUNDS, vector_codes
from .wrapper import extract_main_text


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_points")


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits `pages` against a replica that lost and damaged records, chosen by a digest of the id."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2)
    replica = pages.where(mark != "0a").withColumn("html", F.when(mark == "1b", F.concat(F.lit("~"), F.col("html"))).otherwise(F.col("html")))
    return audit(pages, replica).drop("url")


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS z FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY z) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(z) AS text_sha256
FROM n WINDOW w AS (PARTITION BY z ORDER BY length(t) DESC, doc_id)
"""

OP3_SQL = r"""
WITH n AS (SELECT greatest(0, ceil(log2(greatest(1, count(*) / 1024.0)) / 4))::BIGINT AS digits FROM pages),
r AS (SELECT page_id, url, 'WARC/1.1' || chr(10) || 'WARC-Type: response' || chr(10) || page_id::VARCHAR || chr(10) || url || chr(10) || chr(10) AS head,
             html, chr(10) || chr(10) AS tail, left(sha256(page_id::VARCHAR), 2) AS mark,
             left(sha256(page_id::VARCHAR || chr(10) || url), (SELECT digits FROM n)) AS file
      FROM pages),
p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(strlen(head || html || tail)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id, url))
SELECT CASE mark WHEN '0a' THEN 'missing' ELSE 'changed' END AS status, file, place, start, page_id AS record_id,
       sha256(head || html || tail) AS digest,
       CASE mark WHEN '1b' THEN sha256(head || '~' || html || tail) END AS other_digest
FROM p WHERE mark IN ('0a', '1b')
"""

# Every combination of a url's tokens is counted, which FP-growth does without listing them.
OP8_SQL = r"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                  regexp_replace(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '=[^&]*', '', 'g') AS keys FROM pages),
g AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM u),
w AS (SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
             list_sort(list_distinct(list_concat(
               list_transform(list_filter(string_split(host, '.'), lambda x: length(x) > 1 AND regexp_matches(x, '[^0-9]')), lambda x: 'h:' || x),
               list_transform(list_filter(string_split_regex(regexp_replace(path, '[0-9]+', '', 'g'), '[/._-]+'), lambda x: length(x) > 1 AND regexp_matches(x, '[^0-9]')), lambda x: 'p:' || x),
               list_transform(list_filter(string_split(keys, '&'), lambda x: length(x) > 1 AND regexp_matches(x, '[^0-9]')), lambda x: 'q:' || x)))) AS tokens FROM g),
l AS (SELECT tokens, given, count(*) AS n FROM w WHERE given IS NOT NULL GROUP BY 1, 2),
total AS (SELECT sum(n) AS n FROM l),
everywhere AS (SELECT coalesce(list(token), []) AS names FROM (SELECT token FROM (SELECT unnest(tokens) AS token, n FROM l) GROUP BY 1 HAVING sum(n) >= 0.99 * (SELECT n FROM total))),
told AS (SELECT given, n, list_filter(tokens, lambda x: NOT list_contains(names, x)) AS tokens FROM l, everywhere),
part AS (SELECT given, n, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS combo FROM (SELECT given, n, tokens, unnest(range(1, (1 << len(tokens))::BIGINT)) AS m FROM told)),
seen AS (SELECT combo, sum(n) AS n, sum(n) FILTER (given = 'block') AS block, sum(n) FILTER (given = 'allow') AS allow FROM part GROUP BY 1),
rules AS (SELECT combo, 'block' AS verdict, block / n AS confidence FROM seen WHERE block >= 0.005 * (SELECT n FROM total) AND block / n >= 0.9
          UNION ALL SELECT combo, 'allow', allow / n FROM seen WHERE allow >= 0.005 * (SELECT n FROM total) AND allow / n >= 0.9),
asked AS (SELECT DISTINCT tokens FROM w WHERE given IS NULL),
best AS (SELECT tokens, max(confidence) FILTER (verdict = 'block') AS block, max(confidence) FILTER (verdict = 'allow') AS allow FROM asked JOIN rules ON list_has_all(tokens, combo) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN block IS NOT NULL AND (allow IS NULL OR allow < block) THEN 'block' ELSE 'allow' END) AS verdict FROM w LEFT JOIN best USING (tokens)
"""

# A round: the nearest entry of every part, then each entry's floored mean.
NEAREST = "a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, sum((v - c) * (v - c))::BIGINT AS d FROM x JOIN c{i} USING (p, k) GROUP BY r, p, e) GROUP BY r, p)"
MOVED = "c{j} AS MATERIALIZED (SELECT p, e, k, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c) AS c FROM c{i} LEFT JOIN (SELECT p, e, k, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r, p) GROUP BY p, e, k) USING (p, e, k))"
OP12_SQL = (
    """WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS ints FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS r, len(ints) // 8 AS w FROM f),
x AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS k, ints[i] AS v FROM (SELECT r, w, ints, unnest(range(1, len(ints) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, v AS c FROM x WHERE r <= 16), """
    + ", ".join(NEAREST.format(i=i) + ", " + MOVED.format(i=i, j=i + 1) for i in range(ROUNDS))
    + ", "
    + NEAREST.format(i=ROUNDS)
    + f""", books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) AS h FROM c{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (r), books"""
)

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
s AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_weak_toxicity": op2_weak_toxicity,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_wrapper_text": op4_wrapper_text,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_golay_simhash": op6_golay_simhash,
    "op7_kneser_ney_quality": op7_kneser_ney_quality,
    "op8_url_rules": op8_url_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
    "op11_curve_packing": op11_curve_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op3_merkle_audit": OP3_SQL,
    "op8_url_rules": OP8_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
