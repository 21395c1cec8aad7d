"""Edits as string expressions: nothing is written in place, a new content column is returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewalk.functions import text as X


def line_start(content: Column, line: Column) -> Column:
    """The place (from 0, in code points) where a line (from 1) begins; line ends stay as they are."""
    return F.when(line <= 1, F.lit(0)).otherwise(F.length(F.call_function("substring_index", content, F.lit("\n"), (line - 1).cast("int"))) + 1)


def apply(content: Column, edits: Column) -> Column:
    """The content after edits, array<struct<start, end, new_text>> with places from 0: the last places first, so that earlier ones stay right."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, content, lambda text, e: F.concat(F.substring(text, F.lit(1), e["start"]), e["new_text"], F.substring(text, e["end"] + 1, F.length(text))))


def replaced(content: Column, line: Column, column: Column, end_line: Column, end_column: Column, text: Column) -> Column:
    """The content with a range (from 1, in code points) replaced; without an end, up to the end of the line."""
    start = line_start(content, line)
    begin = start + column - 1
    to_end = start + F.length(F.regexp_replace(F.element_at(F.split(content, "\n"), line), "\r$", ""))
    end = F.when(end_line.isNull(), to_end).otherwise(line_start(content, F.coalesce(end_line, line)) + F.coalesce(end_column, F.lit(1)) - 1)
    return F.concat(F.substring(content, F.lit(1), begin), text, F.substring(content, end + 1, F.length(content)))


def inserted(content: Column, line: Column, text: Column, *, after: bool) -> Column:
    """The content with a line put before or after a line (from 1)."""
    lines = F.split(content, "\n")
    at = line if after else line - 1
    return F.array_join(F.concat(F.slice(lines, 1, at), F.array(text), F.slice(lines, at + 1, F.size(lines))), "\n")


def per_file(edits: DataFrame) -> DataFrame:
    return edits.groupBy("file").agg(F.count(F.lit(1)).alias("edit_count"))


def in_code_points(content: Column, line: Column, character: Column) -> Column:
    """The place (from 0, in code points) of a wire position: a line from 0 and UTF-16 units from 0."""
    text = F.element_at(F.split(content, "\n"), line + 1)
    return (line_start(content, line + 1) + X.code_points(text, character)).cast("int")


def applied(edits: DataFrame, files: DataFrame) -> DataFrame:
    """file and content after edits with wire positions (file, start_line, start_char, end_line, end_char, new_text)."""
    place = lambda which: in_code_points(F.col("content"), F.col(f"{which}_line"), F.col(f"{which}_char"))
    held = edits.join(files.select("file", "content"), "file").select("file", "content", F.struct(place("start").alias("start"), place("end").alias("end"), "new_text").alias("e"))
    each = held.groupBy("file").agg(F.first("content").alias("content"), F.collect_list("e").alias("e"))
    return each.select("file", apply(F.col("content"), F.col("e")).alias("content"))


def in_symbol(content: Column, line: Column, end_line: Column, text: Column) -> Column:
    """The content with a symbol's lines replaced."""
    lines = F.split(content, "\n")
    return F.array_join(F.concat(F.slice(lines, 1, line - 1), F.array(text), F.slice(lines, F.coalesce(end_line, line) + 1, F.size(lines))), "\n")


def exploded(actions: DataFrame, changes: str = "changes") -> DataFrame:
    """A row per edit of a map from file to edits; empty lists give none."""
    each = actions.select("action_id", F.explode(changes).alias("file", "list")).select("action_id", "file", F.explode("list").alias("e"))
    return each.select("action_id", "file", "e.*")


def rename_plan(refs: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that rename a symbol at its references; none if the name stays."""
    out = refs.select("file", "line", "column", (F.col("column") + len(old)).alias("end_column"), F.lit(new).alias("new_text"))
    return out.where(F.lit(old != new))
