"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm import bpe_codec, chat_format, decontaminate, filter_audit, jaccard_join, language_id, line_dedup, quality_rules, ranked_search, substring_dedup, token_counts, token_store, warc
from fundflow.llm.common import only
from fundflow.shipping import ship

#: op1: a line key of this many documents loses all its lines.
MIN_DOCS = 10
#: op4: the policy that decides.
POLICY = "v2"
#: op6: documents of more tokens are over the limit.
TOKEN_LIMIT = 4096
#: op5: closes each document.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(_table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = line_dedup.dedup_lines(docs, MIN_DOCS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = only(_table(spark, sf_dir, "conversations"), *extra.columns).unionByName(extra)
    return chat_format.digests(chat_format.format_log(chat_format.streamed_log(conversations), dealt=True), in_order=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.kept_ledger(only(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.fails(quality_rules.POLICIES[POLICY])).alias("kept"),
        "failure_bits",
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, from the stored ledger."""
    return quality_rules.ablations(quality_rules.kept_ledger(only(_table(spark, sf_dir, "documents"), "doc_id", "text")), POLICY)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False, digests=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.archived(_table(spark, sf_dir, "pages")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_chat_format": op3_chat_format,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_store": op5_token_store,
        "op6_token_counts": op6_token_counts,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_language_id": op8_language_id,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_filter_audit": op11_filter_audit,
        "op12_warc": op12_warc,
        "op13_ranked_search": op13_ranked_search,
        "quality_rule_ablations": quality_rule_ablations,
    }


#: DuckDB: words of a text t.
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_TRIMMED = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, l.line, l.pos, translate({_TRIMMED.replace("line", "l.line")}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(ls, range(1, len(ls) + 1))) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) x,
  LATERAL (SELECT z[1] AS line, z[2] AS pos) l),
gone AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone g USING (key) GROUP BY doc_id
"""

_LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
pair AS (SELECT doc_id, count(*) FILTER (WHERE a = b) AS n FROM (SELECT doc_id, unnest(ws[2:]) AS a, unnest(ws[:len(ws) - 1]) AS b FROM w WHERE len(ws) > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(list_aggregate(list_append(ws, ''), 'string_agg', '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(pair.n, 0) AS n_stutter, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN pair USING (doc_id)),
b AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality_rules.RULES.values()))} AS bits FROM m)
"""

OP4_SQL = f"""{_LEDGER}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (bits & {quality_rules.mask(*quality_rules.BASE)}) <> 0 AS base_failed,
  (bits & {quality_rules.mask(*quality_rules.POLICIES[POLICY])}) = 0 AS kept, bits::BIGINT AS failure_bits
FROM b
"""

_MASK = quality_rules.mask(*quality_rules.POLICIES[POLICY])
ABLATIONS_SQL = f"""{_LEDGER}, r(rule, bit) AS (VALUES {", ".join(f"('{r}', {quality_rules.mask(r)})" for r in quality_rules.POLICIES[POLICY])})
SELECT rule, count(*) FILTER ((bits & bit) <> 0) AS n_failed, count(*) FILTER ((bits & {_MASK}) = bit) AS n_only,
  count(*) FILTER ((bits & {_MASK} & ~bit) <> 0) AS n_rejected_without
FROM b, r GROUP BY rule
"""


OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(list_aggregate(ws[i:i + 4], 'string_agg', ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '#', chr(92) || '#'), '</', '<' || chr(92) || '/')"

OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(replace({_ESCAPED.format("role")}, ':', chr(92) || ':')) + 2 + length({_ESCAPED.format("text")}) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

#: One row per part, order and step, from the distinct sets of failures of each part.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_WORDS} AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN y ON w.doc_id = y.doc_id),
g AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits),
l(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, c, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o) x JOIN l ON l.c = substr(filter_order, step::INT, 1)),
r AS (SELECT part, filter_order, step, c, sum(n) FILTER ((bits & (before | bit)) = 0) AS kept, sum(n) FILTER ((bits & before) = 0 AND (bits & bit) <> 0) AS removed,
  sum(n) FILTER ((bits & before) <> 0 AND (bits & bit) <> 0) AS redundant, sum(n) FILTER (bits = bit) AS unique_fails,
  sum(good) FILTER ((bits & before) = 0 AND (bits & bit) <> 0) AS good_lost, sum(toxic) FILTER ((bits & before) = 0 AND (bits & bit) <> 0) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, c, before, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, c), 0)::BIGINT AS shapley
FROM r
"""

_DIGIT = "(('0x' || substr(h, 5 * g + 1, 5))::INT >> {shift}) & 31"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({_DIGIT.format(shift=s)}), 1)" for s in (15, 10, 5, 0))
OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(0, 8), lambda g: {_BASE32}), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
  CASE WHEN page_id > first THEN NULL ELSE true END AS intact
FROM p
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS MATERIALIZED (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op2_jaccard_join": OP2_SQL,
        "op3_chat_format": OP3_SQL,
        "op4_quality_rules": OP4_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
        "quality_rule_ablations": ABLATIONS_SQL,
    }
