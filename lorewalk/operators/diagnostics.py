"""Diagnostics and code actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.functions import text as X


def filtered(diagnostics: DataFrame, severities: str | None = None, source: str | None = None) -> DataFrame:
    """Diagnostics of some severities (unknown names are passed over; only unknown ones match nothing) and of one source."""
    out = diagnostics
    if severities is not None:
        known = [X.SEVERITIES[s] for s in (x.strip().lower() for x in severities.split(",")) if s in X.SEVERITIES]
        out = out.where(F.coalesce(F.col("severity"), F.lit(1)).isin(known) if known else F.lit(False))
    if source is not None:
        out = out.where(F.col("source") == source)
    return out


def latest(published: DataFrame) -> DataFrame:
    """Per file all diagnostics of its last publication, which replaces those before it.

    published: file, seq, message and more, a row for each diagnostic; an empty publication is a row without a message, and clears its file.
    """
    last = published.groupBy("file").agg(F.max("seq").alias("seq"))
    return published.join(last, ["file", "seq"]).where("message is not null")


def numbered_actions(actions: DataFrame, kind: str | None = None) -> DataFrame:
    """Actions of a kind (any that holds it, whatever the case) with their place after that, from 0."""
    out = actions
    if kind is not None:
        out = out.where(F.contains(F.lower("kind"), F.lit(kind.lower())))
    return out.withColumn("index", F.row_number().over(W.partitionBy("file").orderBy("ord")) - 1)


def selected_action(actions: DataFrame, *, preferred: bool = False, index: int = 0) -> DataFrame:
    """Per file the first preferred action, else the first; or that of an index."""
    if not preferred:
        return actions.where(F.col("index") == index)
    w = W.partitionBy("file").orderBy(F.desc("is_preferred"), "ord")
    return actions.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")
