"""Batches: many commands as rows, each answered in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S

COMMAND = "command string, file string, location string, new_name string"
# What a batch may ask, with the fields that a command needs and the feature that answers it.
COMMANDS = {
    "find_symbol": (("file",), "find_symbol"),
    "find_refs": (("location",), "find_references"),
    "find_def": (("location",), "goto_definition"),
    "find_typedef": (("location",), "goto_type_definition"),
    "find_impl": (("location",), "find_implementations"),
    "hover": (("location",), "hover"),
    "diagnostics": (("file",), "diagnostics"),
    "rename": (("location", "new_name"), "rename"),
    "calls_incoming": (("location",), "incoming_calls"),
    "calls_outgoing": (("location",), "outgoing_calls"),
}


def parsed(lines: DataFrame) -> DataFrame:
    """index, command, file, line, column, new_name and error of every line that is a command; others go. lines: index, value.

    A line that lacks a field of its command is none; a location that can't be read is an error.
    """
    c = F.from_json("value", COMMAND, {"mode": "PERMISSIVE"})
    whole = F.lit(False)
    for name, (needed, _) in COMMANDS.items():
        one = F.col("c.command") == name
        for f in needed:
            one &= F.col(f"c.{f}").isNotNull()
        whole |= one
    rows = lines.withColumn("c", c).where(whole).withColumn("at", S.location(F.col("c.location")))
    placed = F.col("c.command").isin([n for n, (needed, _) in COMMANDS.items() if "location" in needed])
    return rows.select(
        "index",
        "c.command",
        F.when(placed, F.col("at.file")).otherwise(F.col("c.file")).alias("file"),
        F.when(placed, F.col("at.line")).alias("line"),
        F.when(placed, F.col("at.column")).alias("column"),
        "c.new_name",
        F.when(placed, F.col("at.error")).alias("error"),
    )


def gated(commands: DataFrame, languages: DataFrame) -> DataFrame:
    """commands with an error where the file's language (languages: file, language) lacks the feature."""
    spark = commands.sparkSession
    asks = spark.createDataFrame([(c, f) for c, (_, f) in COMMANDS.items()], "command string, feature string")
    none = dims.unsupported(spark).select("language", "feature", F.col("message").alias("lacks"))
    named = commands.join(languages.select("file", "language"), "file", "left").join(F.broadcast(asks), "command").join(F.broadcast(none), ["language", "feature"], "left")
    return named.withColumn("error", F.coalesce("error", "lacks")).select(*commands.columns)


def answered(commands: DataFrame, answers: dict[str, DataFrame | None]) -> DataFrame:
    """index, command, success, result and error of every command: the answers' rows (index, result) as JSON arrays.

    answers: by the commands that they answer (None: no rows).  A command without rows succeeds
    with an empty result; one with an error, or that nothing answers, fails.
    """
    both = commands.sparkSession.createDataFrame([], commands.select("index", F.lit("").alias("result")).schema)
    for a in answers.values():
        both = both if a is None else both.unionByName(a)
    held = both.groupBy("index").agg(F.sort_array(F.collect_list("result")).alias("rows"))
    unknown = F.when(~F.col("command").isin(*answers), F.concat(F.lit("nothing answers "), "command"))
    out = commands.select("index", "command", F.coalesce("error", unknown).alias("error")).join(held, "index", "left")
    out = out.withColumn("success", F.col("error").isNull())
    return out.select("index", "command", "success", F.when(F.col("success"), F.coalesce("rows", F.array().cast("array<string>"))).alias("result"), "error")


def until_failure(results: DataFrame) -> DataFrame:
    """Results up to the first failure, it included."""
    first = results.where(~F.col("success")).agg(F.min("index").alias("first"))
    return results.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("index") <= F.col("first"))).drop("first")


def summary(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))
