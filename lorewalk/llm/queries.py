"""Queries op1 to op10 and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk.llm import ann, bpe, chat, langid, mixing, neardup, passages, quality, scoring, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, VOCABULARY, ids=None, ids_text="ids_text", decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("copies")).alias("taken"))


ORACLES["op4_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM totals),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((rnk - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, rnk, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target, greatest(256, (source_size + 1023) // 1024) AS block FROM levels),
placed AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS off
  FROM sized),
numbered AS (
  SELECT doc_id, size, rnk, source_size, target, CAST(round(target) AS BIGINT) AS quota, off, (off + size // 2) // block AS number
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
held AS (SELECT rnk, number, CAST(sum(size) AS BIGINT) AS weight, min(off) AS start FROM numbered WHERE size > 0 GROUP BY rnk, number),
drawn AS (
  SELECT rnk, number, start, CAST(sum(weight) OVER (PARTITION BY rnk ORDER BY epoch, md5('mix:' || rnk || ':' || epoch || ':' || number) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - weight AS before
  FROM held, (SELECT unnest([0, 1, 2]) AS epoch)),
befores AS (SELECT rnk, number, start, list(before) AS before FROM drawn GROUP BY rnk, number, start)
SELECT doc_id, size, source_size, target, CAST(coalesce(list_sum(list_transform(before, lambda b: greatest(0, least(size, quota - b - (off - start))))), 0) AS BIGINT) AS taken
FROM numbered LEFT JOIN befores USING (rnk, number)
"""


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op5_chat"] = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
grouped AS (
  SELECT conv_id, list(md5(role || '|' || text) ORDER BY turn NULLS LAST, role, text) AS said,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS rendered
  FROM turns GROUP BY conv_id),
begun AS (SELECT DISTINCT said[1:n] AS said FROM (SELECT said, unnest(range(1, len(said))) AS n FROM grouped)),
whole AS (SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM grouped GROUP BY said)
SELECT w.conv_id, CAST(len(w.said) AS BIGINT) AS n_turns, w.copies, g.rendered
FROM whole w JOIN grouped g ON g.conv_id = w.conv_id
WHERE w.said NOT IN (SELECT said FROM begun)
"""


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


@query
def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80)


ORACLES["op7_neardup"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(v, label) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT b.v, r.label FROM reach r JOIN edges b ON b.u = r.v WHERE r.label < b.v),
lowest AS (SELECT v, min(label) AS label FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, label AS component_id, d.doc_id = label AS kept
FROM documents d JOIN lowest ON v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "log_perplexity")


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


@query
def op9_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"), scoring.is_held_out(F.col("doc_id")))


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", scoring.is_held_out(F.col("doc_id"), 4))
    network = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), network)
