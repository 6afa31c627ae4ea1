"""The registered queries of this subpackage: thin digests over the operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, html, importance, language, lines, minhash, mixing, packing, pii, planes, quality, runs, vectors
from quirefold.llm.common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stored = planes.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(table(spark, sf_dir, "documents"), modify=True)
    return found.select("doc_id", *runs.LONGS, "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_html": op1_html,
    "op2_lines": op2_lines,
    "op3_vectors": op3_vectors,
    "op4_language": op4_language,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_planes": op9_planes,
    "op10_minhash": op10_minhash,
    "op11_mixing": op11_mixing,
    "op12_runs": op12_runs,
    "op13_importance": op13_importance,
}

ORACLE_SQL = {
    "op2_lines": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents
), lines AS (
  SELECT rid, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM docs
), totals AS (
  SELECT source, count(*) AS n_pages FROM docs WHERE source IS NOT NULL GROUP BY source
), bad AS (
  SELECT source, line FROM lines JOIN totals USING (source) WHERE regexp_matches(line, '\S')
  GROUP BY source, line, n_pages HAVING count(DISTINCT rid) >= 3 AND count(DISTINCT rid) > n_pages * 0.05
), kept AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS clean, count(*) AS n
  FROM lines ANTI JOIN bad ON lines.source = bad.source AND lines.line = bad.line GROUP BY rid
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(clean, '') END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_dropped
FROM docs LEFT JOIN kept USING (rid)
""",
    "op6_quality": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), wins AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM words, unnest(range(1, len(w) - 6)) AS u(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM wins) WHERE n > 1
), cover AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), rules AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN cover USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM rules
), hosts AS (
  SELECT source AS host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS spread, avg(1.0 / n) AS noise FROM hosts
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(spread - m * (1 - m) * noise, 1e-6) - 1, 1.0), 1e4) AS strength FROM moments
), bad AS (
  SELECT host FROM hosts, prior WHERE (failed + m * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       host IS NOT NULL AS host_rejected, NOT base_failed AND host IS NULL AS kept
FROM judged LEFT JOIN bad ON source = host
""",
    "op11_mixing": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         coalesce(CAST(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT), 0) AS size,
         CAST('0x' || substr(sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources
), totals AS (
  SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM weighed
), filled AS (
  SELECT (budget - coalesce(sum(2 * source_size) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed, totals WINDOW w AS (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT source, source_size, rank, weight, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM filled) * weight) AS target FROM weighed
), queued AS (
  SELECT rid, doc_id, size, h, source_size, rank, weight, target,
         sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs JOIN aimed ON docs.source IS NOT DISTINCT FROM aimed.source
), copies AS (
  SELECT *, CAST(pass * source_size + upto AS DOUBLE) / weight AS finish FROM queued, (VALUES (0), (1)) AS p(pass)
), sent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, h, doc_id, size, rid ROWS UNBOUNDED PRECEDING) - size AS position FROM copies
)
SELECT doc_id, size, source_size, target,
       CAST(sum(greatest(0, least(size, CAST(floor((SELECT budget FROM totals)) AS BIGINT) - position))) AS BIGINT) AS taken
FROM sent GROUP BY rid, doc_id, size, source_size, target
""",
}
