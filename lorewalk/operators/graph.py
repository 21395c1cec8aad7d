"""References, definitions, implementations, calls, types and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.functions import symbols as S
from lorewalk.operators.search import first
from lorewalk.plans.tables import cut


def find_references(refs: DataFrame, target: Column, *, root: str | None = None, limit: int = 0) -> DataFrame:
    """file, line and column of a target's references, its declaration included."""
    out = refs.where(target)
    if root is not None:
        out = out.where(S.own(F.col("file"), root))
    return first(out.select("file", "line", "column"), limit, "file", "line", "column")


def best_definition(defs: DataFrame, *, key: str = "target_id") -> DataFrame:
    """Of each target's definitions the best: not of a dependency and no declaration file, else not of a dependency, else no declaration file, else the first."""
    file = F.col("file")
    far, thin = F.contains(file, F.lit("node_modules")), file.endswith(".d.ts")
    rank = F.when(~far & ~thin, 1).when(~far, 2).when(~thin, 3).otherwise(4)
    w = W.partitionBy(key).orderBy(rank, "ord")
    return defs.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def first_of(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of each key's rows the first in ord, by one partial aggregation."""
    best = rows.groupBy(key).agg(F.min(F.struct("ord", *columns)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in columns])


def calls(edges: DataFrame, symbol: Column, direction: str) -> DataFrame:
    """Callers of a symbol (incoming) or what it calls (outgoing); symbol is a condition on the other end."""
    return edges.where(symbol).select("caller" if direction == "incoming" else "callee").distinct()


def impact(refs: DataFrame, target: Column) -> DataFrame:
    """Per file how many references a target has, and where."""
    places = F.sort_array(F.collect_list(F.struct("line", "column")))
    return refs.where(target).groupBy("file").agg(F.count(F.lit(1)).alias("count"), places.alias("locations"))


def impact_totals(refs: DataFrame, target: Column) -> DataFrame:
    """How many references a target has, and in how many files."""
    return refs.where(target).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("file").alias("files"))


def find_implementations(edges: DataFrame, target: Column, *columns: str, limit: int = 0) -> DataFrame:
    """A target's implementations, each once; those outside the project too."""
    return first(edges.where(target).select(*columns).distinct(), limit, *columns)


def types(edges: DataFrame, of: Column, direction: str) -> DataFrame:
    """Supertypes or subtypes, one step away, over edges(sub, super); of: a condition on the other end."""
    return edges.where(of).select("sub", "super").distinct() if direction == "super" else edges.where(of).select("sub").distinct()


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node and the least number of steps (1 to depth) from start(node) over edges(caller, callee) backwards; depth bounds cycles.

    Each step's nodes are written before the next step, so plans don't grow with depth; it ends early when nothing new is met.
    """
    back = edges.select(F.col("callee").alias("from"), F.col("caller").alias("to"))
    edge = start.select("node").distinct()
    seen = edge.withColumn("steps", F.lit(0))
    for k in range(1, depth + 1):
        met = edge.join(back, edge["node"] == back["from"]).select(F.col("to").alias("node")).distinct()
        edge = met.join(seen.select("node"), "node", "left_anti")
        if k < depth:
            edge = cut(edge)
            if edge.isEmpty():
                break
        seen = seen.unionByName(edge.select("node", F.lit(k).alias("steps")))
    return seen.where("steps > 0")
