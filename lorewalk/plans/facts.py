"""Fact tables over the sample tables: each reads only the columns that it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file, language, ext, size, content."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return d.select(name.alias("file"), F.col("lang").alias("language"), F.col("lang").alias("ext"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as two levels of symbols: brands are classes, parts their methods."""
    p = table(spark, sf_dir, "part")
    inner = p.select(F.col("p_partkey").alias("sym_id"), F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), F.lit("method").alias("kind"), F.col("p_partkey").alias("ord"), F.lit(1).alias("depth"), F.col("p_size").alias("line"))
    return inner


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as three levels: modules, namespaces and classes."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = r.select((F.col("r_regionkey").cast("bigint") + 1).alias("sym_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"), F.lit("module").alias("kind"), F.lit(0).alias("depth"), F.col("r_regionkey").cast("bigint").alias("ord"))
    middle = n.select((F.col("n_nationkey").cast("bigint") + 1000).alias("sym_id"), (F.col("n_regionkey").cast("bigint") + 1).alias("parent_id"), F.col("n_name").alias("name"), F.lit("namespace").alias("kind"), F.lit(1).alias("depth"), F.col("n_nationkey").cast("bigint").alias("ord"))
    bottom = c.select((F.col("c_custkey") + 1_000_000).alias("sym_id"), (F.col("c_nationkey").cast("bigint") + 1000).alias("parent_id"), F.col("c_name").alias("name"), F.lit("class").alias("kind"), F.lit(2).alias("depth"), F.col("c_custkey").alias("ord"))
    return top.unionByName(middle).unionByName(bottom)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as references to parts: target_id, file, line, column."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").alias("target_id"), F.concat(F.lit("/src/"), F.col("l_orderkey").cast("string"), F.lit(".rs")).alias("file"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_suppkey").cast("int").alias("column"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as calls of parts by suppliers, each once; ids are told apart by their first letter."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("caller"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee")).distinct()


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as diagnostics of users' files."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("file"), severity.alias("severity"), F.col("event_type").alias("message"), F.get_json_object("props", "$.k").alias("source"), F.col("event_id").alias("seq"), F.col("ts"))
