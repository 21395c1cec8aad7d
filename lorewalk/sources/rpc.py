"""JSON-RPC traffic as rows: lines of requests and responses, and captures with Content-Length headers.

Each reader and writer works on tables and on streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewalk.functions import symbols as S
from lorewalk.functions import text as X
from lorewalk.sources import wire


def lines(spark: SparkSession, folder: str, *, stream: bool = False) -> DataFrame:
    """value, a row for each line of the files of a folder."""
    return (spark.readStream if stream else spark.read).text(folder)


def requests(messages: DataFrame) -> DataFrame:
    """id (a JSON text), method, params and error (the kind of it: parse_error, invalid_request, or null) of messages (value); blank ones go.

    A message that isn't an object can't be parsed; one without a method is no request.
    """
    parsed = F.try_parse_json(F.col("value"))
    get = lambda p: F.to_json(F.try_variant_get(parsed, p, "variant"))
    method = F.try_variant_get(parsed, "$.method", "string")
    whole = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    error = F.when(~whole, "parse_error").when(method.isNull(), "invalid_request")
    return messages.where(F.trim("value") != "").select(get("$.id").alias("id"), method.alias("method"), get("$.params").alias("params"), error.alias("error"))


def responses(answers: DataFrame) -> DataFrame:
    """value: a line for each answer (id, result, error: a kind, detail); errors win over results."""
    e = X.rpc_error(F.col("error"), F.col("detail"))
    return answers.select(X.envelope(F.col("id"), F.col("result"), e["code"], e["message"]).alias("value"))


def write_lines(messages: DataFrame, folder: str, checkpoint: str | None = None):
    """Appends messages (value) to the files of a folder; a stream until its input has been read, and its query is returned."""
    if not messages.isStreaming:
        return messages.select("value").write.mode("append").text(folder)
    out = messages.select("value").writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def document_sync(versions: DataFrame) -> DataFrame:
    """file, version and value: the message that tells a server of each version of a document (file, seq, version, content): didOpen for the first, didChange for the rest, none where the content stays."""
    first = versions.groupBy("file", "version").agg(F.min_by("content", "seq").alias("content"))
    uri = S.path_to_uri(F.col("file"))
    opened = F.struct(F.struct(uri.alias("uri"), "version", F.col("content").alias("text")).alias("textDocument"))
    changed = F.struct(F.struct(uri.alias("uri"), "version").alias("textDocument"), F.array(F.struct(F.col("content").alias("text"))).alias("contentChanges"))
    message = lambda method, params: F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit(f"textDocument/{method}").alias("method"), params.alias("params")))
    return first.select("file", "version", F.when(F.col("version") == 1, message("didOpen", opened)).otherwise(message("didChange", changed)).alias("value"))


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """file, nth and value of the framed messages in a folder's captures; bytes that aren't UTF-8 are replaced, an unfinished last message goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                bodies = wire.frames(bytes(content))
                yield pd.DataFrame({"file": [path] * len(bodies), "nth": range(len(bodies)), "value": bodies}).astype({"file": "object", "value": "object", "nth": "int64"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "content").mapInPandas(run, "file string, nth long, value string")


def kinds(messages: DataFrame) -> DataFrame:
    """messages (value) with their kind: request, response, notification or invalid."""
    return messages.withColumn("kind", X.message_kind(F.col("value")))


def results(responses: DataFrame) -> DataFrame:
    """id, result and error (JSON texts) of response messages (value): an error wins, a missing result is null."""
    parsed = F.try_parse_json(F.col("value"))
    get = lambda p: F.to_json(F.try_variant_get(parsed, p, "variant"))
    error = F.nullif(get("$.error"), F.lit("null"))
    return responses.select(get("$.id").alias("id"), F.when(error.isNull(), F.coalesce(get("$.result"), F.lit("null"))).alias("result"), error.alias("error"))
