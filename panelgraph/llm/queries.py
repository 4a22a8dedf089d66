"""The registered corpus queries, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelgraph.llm.common import table

SHARDS = 8
#: The key of the pseudonyms; a deployment passes its own secret to the operator.
PII_KEY = "example"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.rule_ensemble import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.language_id import languages

    return languages(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelgraph.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_rule_ensemble, op4_language_id, op5_suffix_dedup, op6_decontamination, op7_mixing, op8_pii, op9_ngram_jaccard, op10_quality_rules)}
_WORDS = "regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, UNNEST(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, MIN(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, LEAST(d.doc_id, COALESCE(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""


def _op10_sql() -> str:
    from panelgraph.llm import quality_rules as q

    text = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda c: f"(length(line) - length(replace(line, {text(c)}, ''))) / {len(c)}"
    rules = [f"GREATEST({', '.join(map(count, q.CELLS))}) >= 3", f"regexp_matches(line, {text(q.SYMBOL_WORDS)})", f"regexp_matches(line, {text(q.SHOUT)})"]
    rules += ["(" + " OR ".join(f"contains(lower(line), {text(p)})" for p in q.STOCK) + ")"]
    rules += [f"(length(line) >= {q.LONG_LINE} AND NOT (" + " OR ".join(f"contains(line, {text(c)})" for c in q.STOPS) + "))"]
    spaces = text(q.SPACE_RUN)
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, UNNEST(generate_series(1, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
v AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM h, generate_series(0, 4) s(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS dup, SUM(CASE WHEN {' OR '.join(rules)} THEN length(regexp_replace(line, {spaces}, '', 'g')) ELSE 0 END) AS lost FROM l GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(COALESCE(dup, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(v.n, 0) AS BIGINT) AS n_repeat_words, CAST(COALESCE(lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN v ON v.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id)
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words) AND lost_chars <= {q.MAX_LOSS} * word_chars AS kept FROM b"""


ORACLES: dict[str, str] = {"op9_ngram_jaccard": OP9_SQL, "op10_quality_rules": _op10_sql()}
