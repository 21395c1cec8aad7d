"""From raw documents to token ids: five stages, each by an operator of lorewalk.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.

1. quality rules: documents that fail the plain rules, or whose perplexity is
   outside their language's band, go.
2. near-dedup: of documents linked at 0.8 on five-word shingles the one with the
   smallest id stays.
3. secrets: spans of secrets are replaced by [SECRET]; other texts stay as they are.
4. mixing: whole documents are drawn so that sources reach their target weights, at
   most three times each, and shuffled in shards.
5. BPE: ids and n_tokens are added.

Rows without doc_id, text, lang or source go through as the operators define: a null
text has no words and fails the plain rules, a null id is no near duplicate, a null
language and a null source stand for themselves, repeated rows leave one, and an empty
table gives an empty result.  Extra columns stay, whatever their names; only `ids`
and `n_tokens` (in any case) give way to the last stage's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk.llm import bpe, mixing, neardup, quality, secrets
from lorewalk.llm.shared import cut, fresh

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (found,) = fresh(docs.columns, "secrets")
    text = secrets.redact(F.col("text"), F.col(found))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(found) > 0, F.length(text)).otherwise(F.col("n_chars")).cast("bigint")
    return secrets.scan(docs, secrets=found).withColumns(changed).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL expresses neither the perplexity model nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
