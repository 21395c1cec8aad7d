"""Streams folded into state, once for batches and once for Structured Streaming.

The batch forms are windows and aggregations over an ordered table; the streaming
forms keep the same state per key and give the same rows for a finished stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.functions import text as X

#: Failures in a row after which a server is started anew; minutes after which a project is idle.
FAILURES, IDLE = 3, "30 minutes"


# Latest diagnostics


def latest_stream(publications: DataFrame) -> DataFrame:
    """file, seq and diagnostics of each file's last publication (file, seq, diagnostics: an array), for update or complete mode."""
    return publications.groupBy("file").agg(F.max("seq").alias("seq"), F.max_by("diagnostics", "seq").alias("diagnostics"))


def published(latest: DataFrame) -> DataFrame:
    """A row for each diagnostic of publications (file, seq, diagnostics); empty ones give none."""
    return latest.select("file", "seq", F.explode("diagnostics").alias("d")).select("file", "seq", "d.*")


# Document versions


def versions(documents: DataFrame) -> DataFrame:
    """file, seq and version: 1 at first, one more whenever the content's hash changes. documents: file, seq, content."""
    w = W.partitionBy("file").orderBy("seq")
    hashed = documents.select("file", "seq", F.xxhash64("content").alias("h"))
    changed = F.when(F.lag("h").over(w).eqNullSafe(F.col("h")), 0).otherwise(1)
    return hashed.withColumn("c", changed).select("file", "seq", F.sum("c").over(w).alias("version"))


def versions_stream(documents: DataFrame) -> DataFrame:
    """The same for a stream whose rows come in the order of seq."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, last = state.get if state.exists else (0, None)
        for rows in batches:
            out = []
            for seq, h in rows.sort_values("seq")[["seq", "h"]].itertuples(index=False):
                if h != last:
                    version, last = version + 1, h
                out.append((key[0], seq, version))
            yield pd.DataFrame(out, columns=["file", "seq", "version"])
        state.update((version, last))

    hashed = documents.select("file", "seq", F.xxhash64("content").alias("h"))
    return hashed.groupBy("file").applyInPandasWithState(fold, f"file {documents.schema['file'].dataType.simpleString()}, seq long, version long", "version long, last long", "append", "NoTimeout")


# Requests and responses


def paired(turns: DataFrame) -> DataFrame:
    """conv_id, asked and answered: a user's turn and the assistant's next one, null if another turn or none follows."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", "turn", "role", F.lead("role").over(w).alias("r"), F.lead("turn").over(w).alias("t"))
    return t.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.when(F.col("r") == "assistant", F.col("t")).alias("answered"))


def correlated(requests: DataFrame, responses: DataFrame, within: str = "120 seconds") -> DataFrame:
    """Requests (id, ts) with their responses (id, ts, result) inside the timeout; without one, cancelled. For batches and streams.

    An id that is a number and the same one as a string are equal.
    """
    q = requests.select(F.col("id").cast("string").alias("id"), F.col("ts").alias("asked_at")).withWatermark("asked_at", within)
    a = responses.select(F.col("id").cast("string").alias("rid"), F.col("ts").alias("answered_at"), "result").withWatermark("answered_at", within)
    on = (F.col("id") == F.col("rid")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    return q.join(a, on, "left").select("id", "asked_at", "answered_at", "result", F.col("rid").isNull().alias("cancelled"))


def terminated(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """id and error (code and message) of requests (server, id, ts) that were open when their server ended (server, ts, expected), each at the first end after it.

    requests that were answered before have answered_at.  An unexpected end is told from a cancellation.
    """
    e = ends.select("server", F.col("ts").alias("ended_at"), "expected")
    open_ = (F.col("ts") <= F.col("ended_at")) & (F.col("answered_at").isNull() | (F.col("answered_at") > F.col("ended_at")))
    met = requests.join(e, "server").where(open_).groupBy("id", "server").agg(F.min(F.struct("ended_at", "expected")).alias("e"))
    code = F.when(F.col("e.expected"), -32800).otherwise(-32099)
    message = F.when(F.col("e.expected"), "request cancelled").otherwise(F.concat("server", F.lit(" ended unexpectedly")))
    return met.select("id", code.alias("code"), message.alias("message"))


# Health


def _islands(checks: DataFrame) -> DataFrame:
    """Checks with the number of healthy ones up to them, which failures in a row share."""
    return checks.withColumn("island", F.sum(F.col("healthy").cast("long")).over(W.partitionBy("server").orderBy("seq")))


def failures(checks: DataFrame) -> DataFrame:
    """server, longest (failures in a row) and restarted. checks: server, seq, healthy."""
    run = _islands(checks).groupBy("server", "island").agg(F.count_if(~F.col("healthy")).alias("n"))
    return run.groupBy("server").agg(F.max("n").alias("longest"), (F.max("n") >= FAILURES).alias("restarted"))


def restarts(checks: DataFrame) -> DataFrame:
    """server and seq of each check that makes the failures in a row reach FAILURES, after which they count anew."""
    bad = _islands(checks).where(~F.col("healthy"))
    nth = F.row_number().over(W.partitionBy("server", "island").orderBy("seq"))
    return bad.withColumn("nth", nth).where(F.col("nth") % FAILURES == 0).select("server", "seq")


def unhealthy(checks: DataFrame) -> DataFrame:
    """server and since of the servers whose last check failed: the first of the failures in a row that go on."""
    last = checks.groupBy("server").agg(F.max_by("healthy", "seq").alias("healthy"), F.max(F.when(F.col("healthy"), F.col("seq"))).alias("good"))
    bad = last.where(~F.col("healthy")).select("server", "good").join(checks.where(~F.col("healthy")), "server")
    return bad.where(F.col("good").isNull() | (F.col("seq") > F.col("good"))).groupBy("server").agg(F.min("seq").alias("since"))


def failures_stream(checks: DataFrame) -> DataFrame:
    """restarts for a stream whose rows come in the order of seq."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        for rows in batches:
            out = []
            for seq, healthy in rows.sort_values("seq")[["seq", "healthy"]].itertuples(index=False):
                run = 0 if healthy else run + 1
                if run == FAILURES:
                    out.append((key[0], seq))
                    run = 0
            yield pd.DataFrame(out, columns=["server", "seq"])
        state.update((run,))

    return checks.groupBy("server").applyInPandasWithState(fold, f"server {checks.schema['server'].dataType.simpleString()}, seq long", "run long", "append", "NoTimeout")


# Idle projects


def sessions(requests: DataFrame) -> DataFrame:
    """project, begun, ended and requests of each stretch without IDLE between two requests; a stream needs a watermark on ts."""
    return requests.groupBy("project", F.session_window("ts", IDLE).alias("s")).agg(F.count(F.lit(1)).alias("requests")).select("project", F.col("s.start").alias("begun"), F.col("s.end").alias("ended"), "requests")


# Caches


def cache_hits(reads: DataFrame) -> DataFrame:
    """key, hits, misses and hit_rate: a read (key, seq, hash) hits if the key's content is that of the read before it."""
    same = F.col("hash").eqNullSafe(F.lag("hash").over(W.partitionBy("key").orderBy("seq"))) & F.lag("seq").over(W.partitionBy("key").orderBy("seq")).isNotNull()
    c = reads.withColumn("hit", same).groupBy("key").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return c.withColumn("hit_rate", X.hit_rate(F.col("hits"), F.col("misses")))


def victim(entries: DataFrame, *by: str) -> DataFrame:
    """The entry (key, last_accessed) that a full cache gives up: the one longest unread, of several the smallest key."""
    return entries.groupBy(*by).agg(F.min_by("key", F.struct("last_accessed", "key")).alias("key"))


# Indexing


def indexing_state(events: DataFrame) -> DataFrame:
    """key, seq and state after each event (open, ready, timeout, edit): a machine that is the last of its letters.

    not_started until opened; edits make a ready or timed-out index stale, and are passed over before.
    """
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    settled = F.last(F.when(F.col("event").isin("ready", "timeout"), F.col("event")), True).over(w)
    at = F.last(F.when(F.col("event").isin("ready", "timeout", "open"), F.col("seq")), True).over(w)
    edited = F.last(F.when(F.col("event") == "edit", F.col("seq")), True).over(w)
    opened = F.last(F.when(F.col("event") == "open", F.col("seq")), True).over(w)
    closed = F.last(F.when(F.col("event").isin("ready", "timeout"), F.col("seq")), True).over(w)
    state = (
        F.when(at.isNull(), "not_started")
        .when(closed.isNull() | (opened > closed), "in_progress")
        .when(edited > closed, "stale")
        .when(settled == "ready", "ready")
        .otherwise("timed_out")
    )
    return events.select("key", "seq", state.alias("state"))
