"""The queries op1 to op10: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm import bayes, decontam, packing, rules, secrets, shard, simhash, suffix, tokens, warc
from trailweave.llm.work import fresh_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_sharding": lambda s, d: shard.shard_documents(_t(s, d, "documents"), 40),
        "op2_secret_scan": lambda s, d: secrets.secret_report(_t(s, d, "documents")),
        "op3_quality_classifier": lambda s, d: bayes.quality_posteriors(_t(s, d, "documents"), _t(s, d, "labels")),
        "op4_simhash_near_dedup": lambda s, d: simhash.simhash_report(_t(s, d, "documents")),
        "op5_best_fit_packing": lambda s, d: packing.pack_documents(_t(s, d, "documents"), tokenizer_path(), 2048),
        "op6_suffix_dedup": lambda s, d: suffix.repeated_bytes(_t(s, d, "documents")),
        "op7_quality_rules": lambda s, d: rules.quality_report(_t(s, d, "documents"), _t(s, d, "labels")),
        "op8_decontamination": lambda s, d: decontam.contaminated(_t(s, d, "documents"), _t(s, d, "benchmark")),
        "op9_warc": lambda s, d: warc.warc_round_trip(_t(s, d, "pages"), fresh_path(s, "warc")),
        "op10_token_counts": lambda s, d: tokens.token_counts(_t(s, d, "documents"), tokenizer_path()),
    }


#: Pages with their records' columns; base 32 of the SHA-1 by groups of 20 bits.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, first_id, list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INT) AS g FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(g, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


def _spans_sql(pattern: str, kind: int, keep: str = "true", group: int = 0) -> str:
    """Matches with their places, from their lengths and those of what lies between them."""
    q = pattern.replace("'", "''")
    return f"""
SELECT r, {kind} AS o, s, s + length(m) AS e, m FROM (
  SELECT r, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s FROM (
    SELECT r, unnest(regexp_extract_all(t, '{q}')) AS m, unnest(regexp_extract_all(t, '{q}', {group})) AS g, unnest(string_split_regex(t, '{q}')[:len(regexp_extract_all(t, '{q}'))]) AS gap, unnest(range(len(regexp_extract_all(t, '{q}')))) AS i FROM t)) WHERE {keep}"""


def _secrets_sql(scope: int = 256) -> str:
    s = secrets
    kinds = ", ".join(f"'{k}'" for k in s.KINDS)
    cells = "SELECT r, unnest([s // {w}, s // {w} - 1]) AS c FROM {t}".replace("{w}", str(scope))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans_sql(s.ASSIGN, 0, "length(g) >= 6", 2)} UNION ALL {_spans_sql(s.ACCESS, 1, "length(m) >= 20")} UNION ALL {_spans_sql(s.HEX, 2)}),
ident AS ({_spans_sql(s.IDENT, 3)}), endp AS ({_spans_sql(s.ENDPOINT, 4)}),
weak AS (SELECT * FROM ({_spans_sql(s.WEAK, 5, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}) w WHERE r IN (SELECT r FROM endp)
  AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM ident UNION ALL SELECT * FROM endp) b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
ids AS (SELECT * FROM ident UNION ALL SELECT * FROM base WHERE o = 1),
linked AS (({cells.replace("{t}", "ids")}) INTERSECT ({cells.replace("{t}", "endp")}) INTERSECT ({cells.replace("{t}", "weak")})),
more AS (SELECT x.* FROM (SELECT * FROM ident UNION ALL SELECT * FROM endp UNION ALL SELECT * FROM weak) x WHERE EXISTS (SELECT 1 FROM linked l WHERE l.r = x.r AND l.c IN (x.s // {scope}, x.s // {scope} - 1))),
said AS (SELECT r, true AS b, s, o, [{kinds}][o + 1] || ':' || s || ':' || e AS x FROM base UNION ALL SELECT r, false, s, o, [{kinds}][o + 1] || ':' || s || ':' || e FROM more),
per AS (SELECT r, count(*) FILTER (WHERE b AND o = 0) AS n0, count(*) FILTER (WHERE b AND o = 1) AS n1, count(*) FILTER (WHERE b AND o = 2) AS n2, string_agg(x, ',' ORDER BY s, o) FILTER (WHERE b) AS bs, string_agg(x, ',' ORDER BY s, o) AS xs, count(*) FILTER (WHERE NOT b) AS nl FROM said GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(xs, '') AS spans, coalesce(nl, 0) AS n_linked FROM t LEFT JOIN per USING (r)"""


def _rules_sql(alpha: float = 0.04, delta: float = 0.05) -> str:
    a = alpha / len(rules.RULES)
    grid = ", ".join(f"('{r}', {i}, {c})" for i, (r, cs) in enumerate(rules.RULES.items()) for c in cs)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS x FROM w WHERE len(w) >= 5)),
cov AS (SELECT r, sum(least(5, i - coalesce(p, i - 5)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM g WHERE n > 1) GROUP BY r),
f AS (SELECT w.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_caps FROM w LEFT JOIN cov ON cov.r = w.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), n_caps / greatest(word_chars, 1)] AS sc FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT stratum, sc FROM b JOIN good USING (doc_id) WHERE NOT base_failed),
c AS (SELECT * FROM (VALUES {grid}) AS v(rule, i, c)),
k AS (SELECT stratum, rule, i, c, count(*) AS n, count(*) FILTER (WHERE sc[i + 1] > c) AS k FROM h CROSS JOIN c GROUP BY ALL),
ok AS (SELECT *, k < n * {a} AND list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a})))) <= {delta} / ((SELECT count(DISTINCT stratum) FROM h) * {len(rules.RULES)}) AS ok FROM k),
cut AS (SELECT stratum, rule, i, min(c) AS c FROM ok WHERE ok GROUP BY ALL),
rej AS (SELECT b.r, list(rule ORDER BY i) AS rejected_by FROM b JOIN cut ON cut.stratum = b.stratum WHERE sc[i + 1] > c GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(array_to_string(rejected_by, ','), '') AS rejected_by FROM b LEFT JOIN rej ON rej.r = b.r"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op2_secret_scan": _secrets_sql(), "op7_quality_rules": _rules_sql(), "op9_warc": WARC_SQL}
