"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, format_turns

    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_turns(rows.unionByName(more)))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_digest

    return token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .probminhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import archived

    return archived(_table(spark, sf_dir, "pages"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import digest, infill

    return digest(infill(_table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at: each source's size and target."""
    from .mixing import targets, word_count

    sizes = _table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"), F.count("*").alias("n_docs"))
    return targets(sizes).select("source", "source_size", "n_docs", F.round("target", 3).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and listed rule of every page, with the rule's verdict."""
    from .urls import host_and_path, listed_rule

    host, path = host_and_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    return _table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("listed"))


def personal_data_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind a document holds, and the digest of all of them."""
    from .pii import KINDS, base_digest, base_spans, counted

    spans = _table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return spans.select("doc_id", *[counted("base", k) for k in KINDS], base_digest("base"))


def queries() -> dict:
    """Name -> function of (spark, sf_dir), for __spark_entry__."""
    names = ("op1_chat", "op2_neighbours", "op3_quality", "op4_urls", "op5_toxicity", "op6_decontaminate", "op7_mixing", "op8_personal_data", "op9_tokens", "op10_near_duplicates", "op11_archives", "op12_infill", "op13_divergence", "pipeline", "mix_targets", "url_rules", "personal_data_spans")
    return {name: globals()[name] for name in names}


_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  -- a control string or backslash inside a text takes one character more
  CAST(sum(17 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\[INST\]|\[/INST\]|<s>|</s>|\\'))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS rewritten_turns
FROM turns GROUP BY conv_id"""

_TARGETS = r"""
WITH sizes AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size, count(*) AS n_docs FROM documents GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM sizes),
-- the level at which capped shares add up to all words: that of the first source whose cap is not reached
levels AS (SELECT a.cap / a.w AS bar, ((SELECT sum(source_size) FROM sizes) - coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.cap / b.w < a.cap / a.w), 0)) / (SELECT sum(b.w) FROM ranked b WHERE b.cap / b.w >= a.cap / a.w) AS level FROM ranked a),
final AS (SELECT min_by(level, bar) AS level FROM levels WHERE level < bar)
SELECT source, source_size, n_docs, round(least(cap, level * w), 3) AS target FROM ranked, final"""

_URLS = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM rest),
rules(rule, of, start, listed) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(listed, length(rule)) AS listed FROM parts JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, listed FROM parts LEFT JOIN fits USING (page_id)"""

_KIND_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(x.said, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 256) > 255)) = 0",
    "card": "length(regexp_replace(x.said, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(x.said, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0",
    "phone": "length(regexp_replace(x.said, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
}


def _personal_sql() -> str:
    """Base spans: matches lie between the pieces that splitting at the pattern leaves."""
    lists = ", ".join(f"regexp_extract_all(text, '{p}') AS m_{k}, string_split_regex(text, '{p}') AS p_{k}" for k, p in _KIND_PATTERNS.items())
    place = "list_transform(m_{k}, lambda said, i: {{'said': said, 'at': list_sum(list_transform(p_{k}[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda v: length(v))), 0)}})"
    found = ", ".join(f"list_filter({place.format(k=k)}, lambda x: {_CHECKS[k]}) AS {k}" for k in _KIND_PATTERNS)
    said = ", ".join(f"list_transform({k}, lambda x: '{k}:' || CAST(x.at AS BIGINT) || ':' || CAST(x.at + length(x.said) AS BIGINT))" for k in _KIND_PATTERNS)
    return f"WITH t AS (SELECT doc_id, {lists} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), found AS (SELECT doc_id, {found} FROM t) SELECT doc_id, {', '.join(f'len({k}) AS n_{k}' for k in _KIND_PATTERNS)}, sha256(array_to_string(list_concat({said}), ',')) AS base_sha256 FROM found"


_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS id, min(doc_id) AS least, text FROM d GROUP BY text),
w AS (SELECT id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
sh AS (SELECT id, s, 1 + ln(count(*)) AS v FROM s GROUP BY id, s),
total AS (SELECT id, sum(v) AS v FROM sh GROUP BY id),
-- common shingles weigh at least the threshold's share of either text
near AS (SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id JOIN total x ON x.id = a.id JOIN total y ON y.id = b.id GROUP BY a.id, b.id, x.v, y.v HAVING sum(a.v) >= 0.799 * x.v AND sum(b.v) >= 0.799 * y.v),
paired AS (SELECT a, b, coalesce(x.v, 0) AS x, coalesce(y.v, 0) AS y FROM (SELECT a, b, s, v FROM near JOIN sh ON sh.id = a) x FULL JOIN (SELECT a, b, s, v FROM near JOIN sh ON sh.id = b) y USING (a, b, s)),
alike AS (SELECT k.a, k.b, sum(p) AS j FROM (SELECT c.a, c.b, 1 / sum(greatest(o.x / c.x, o.y / c.y)) AS p FROM (SELECT *, row_number() OVER () AS r FROM paired WHERE x > 0 AND y > 0) c JOIN paired o ON o.a = c.a AND o.b = c.b GROUP BY c.r, c.a, c.b) k GROUP BY k.a, k.b),
links AS (SELECT a, b FROM alike WHERE j >= 0.8 - 1e-9 UNION SELECT b, a FROM alike WHERE j >= 0.8 - 1e-9),
reach(id, other) AS (SELECT id, id FROM t UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
class AS (SELECT reach.id, min(t.least) AS class_id FROM reach JOIN t ON t.id = reach.other GROUP BY reach.id)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM d JOIN t USING (text) JOIN class USING (id)"""


_ARCHIVES = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER w AS r, first_value(page_id) OVER w AS largest FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND r > 1 THEN largest END AS refers_to FROM r"""

_INFILL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha FROM documents),
h AS (SELECT *, len(w) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(sha, CAST(1 + 8 * k AS BIGINT), 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""

_DIVERGENCE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS c FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS total FROM t GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS m FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(sum(c) AS BIGINT) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v) AS p, 1 + (1000000000 * (total + 1)) // (m + v) AS q
  FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
summed AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested by brute force."""
    return {"op1_chat": _CHAT, "op10_near_duplicates": _NEAR, "mix_targets": _TARGETS, "url_rules": _URLS, "personal_data_spans": _personal_sql(), "op11_archives": _ARCHIVES, "op12_infill": _INFILL, "op13_divergence": _DIVERGENCE}
