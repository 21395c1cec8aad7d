"""Text search over files.

A search is one scan: files are split into lines, lines filtered by a pattern,
and only then are columns computed.  Positions are bytes from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorewalk import dims


def pattern(text: str, *, ignore_case: bool = False, word: bool = False) -> str:
    """The regular expression to match, checked: blank patterns, look-around and back references are refused."""
    if not text.strip():
        raise ValueError("the pattern is empty")
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!])|\\[1-9])", text):
        raise ValueError("look-around and back references are not supported")
    body = rf"(?<![\p{{L}}\p{{N}}_])(?:{text})(?![\p{{L}}\p{{N}}_])" if word else text
    return f"(?iu){body}" if ignore_case else body


def file_type(alias: str) -> str:
    found = dims.FILE_TYPES.get(alias.lower())
    if found is None:
        raise ValueError(f"unknown file type {alias!r}; known: {', '.join(sorted(dims.FILE_TYPES))}")
    return found


def split_lines(content: Column) -> Column:
    """The lines without their ends; a last line end begins no further line."""
    parts = F.split(content, "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return whole


def lines(files: DataFrame) -> DataFrame:
    """file, language, line (from 1) and text of every line."""
    each = files.select("file", "language", F.posexplode(split_lines(F.col("content"))).alias("nth", "text"))
    return each.select("file", "language", (F.col("nth") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def byte_column(text: Column, expression: str) -> Column:
    return (F.octet_length(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(expression)) - 1)) + 1).cast("int")


def search_text(files: DataFrame, text: str, *, ignore_case: bool = False, word: bool = False, language: str | None = None, under: str | None = None, limit: int = 0) -> DataFrame:
    """A row per line that matches: file, line, column of the first match in bytes, text without trailing blanks, match."""
    p = pattern(text, ignore_case=ignore_case, word=word)
    if language is not None:
        files = files.where(F.col("language") == language)
    if under is not None:
        files = files.where(F.startswith("file", F.lit(under.rstrip("/") + "/")))
    t = F.col("text")
    hit = lines(files).where(t.rlike(p))
    out = hit.select("file", "line", byte_column(t, p).alias("column"), F.rtrim(t).alias("text"), F.regexp_substr(t, F.lit(p)).alias("match"))
    return first(out, limit, "file", "line")


def search_with_context(files: DataFrame, text: str, context: int, **options) -> DataFrame:
    """file, line, text and the lines around: context_before and context_after. Only these lines leave a file's array."""
    p = pattern(text, **options)
    held = files.select("file", split_lines(F.col("content")).alias("all"))
    line = lambda i: F.element_at(F.col("all"), i)
    places = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: line(i).rlike(p))

    def around(i: Column) -> Column:
        low = F.greatest(i - context, F.lit(1))
        return F.struct(i.alias("line"), line(i).alias("text"), F.slice("all", low, i - low).alias("context_before"), F.slice("all", i + 1, F.lit(context)).alias("context_after"))

    return held.where(F.size("all") > 0).select("file", F.explode(F.transform(places, around)).alias("x")).select("file", "x.*")


#: Phrases that are sent to every task at most; more are joined.
MOST_PHRASES = 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def search_many(files: DataFrame, phrases: DataFrame, *, most: int = MOST_PHRASES) -> DataFrame:
    """file and item_id for every phrase (item_id, text) whose words stand in a row in a file; phrases without words are found nowhere.

    Up to `most` phrases go to the files, looked up by first words in one pass.  More
    are joined with the files' runs of as many words as the phrases begin with (five at
    most), so no file meets every phrase.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    asked = phrases.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    held = asked.limit(most + 1).collect()
    if len(held) > most:
        return _joined_phrases(files.select("file", words("content").alias("w")), asked)
    index: dict[str, dict[int, dict[str, list]]] = {}
    for r in held:
        index.setdefault(r["w"][0], {}).setdefault(len(r["w"]), {}).setdefault(" ".join(r["w"]), []).append(r["item_id"])
    sent = files.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[tuple] = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = _WORD.findall(content or "")
                found = set()
                for k in [k for k, x in enumerate(w) if x in known]:
                    for n, runs in known[w[k]].items():
                        found.update(runs.get(" ".join(w[k : k + n]), ()))
                out += [(file, i) for i in found]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], batch.column(0).type), pa.array([i for _, i in out], kind)], names=["file", "item_id"])

    schema = T.StructType([files.schema["file"], phrases.schema["item_id"]])
    kind = to_arrow_type(phrases.schema["item_id"].dataType)
    return files.select("file", "content").mapInArrow(run, schema)


def _joined_phrases(held: DataFrame, asked: DataFrame) -> DataFrame:
    head = lambda w, i, n: F.concat_ws(" ", F.slice(w, i, n))
    asked = asked.select("item_id", F.concat_ws(" ", "w").alias("phrase"), F.least(F.size("w"), F.lit(5)).alias("n"), head(F.col("w"), F.lit(1), F.lit(5)).alias("run"))
    sizes = [r["n"] for r in asked.select("n").distinct().collect()]  # five at most
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: head(F.col("w"), i, F.lit(n)))
    runs = F.array_distinct(F.concat(*[F.when(F.size("w") >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))
    near = held.select("file", F.explode(runs).alias("run")).join(asked, "run").select("file", "item_id", "phrase").distinct()
    texts = held.select("file", F.concat(F.lit(" "), F.concat_ws(" ", "w"), F.lit(" ")).alias("all"))
    return near.join(texts, "file").where(F.contains("all", F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("file", "item_id").distinct()


def first(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in an order; 0 is no limit."""
    return rows.orderBy(*order).limit(limit) if limit else rows
