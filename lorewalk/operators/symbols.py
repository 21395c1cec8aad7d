"""Symbols as flat rows: sym_id, parent_id, name, kind, depth, ord (document order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk import dims
from lorewalk.functions import symbols as S
from lorewalk.plans.tables import cut

#: Levels that a path without a depth is looked for in.
DEEPEST = 10
#: Levels that are joined in one plan; deeper trees are written level by level, so that plans stay short.
LEVELS = 3


def overload_index(group: list[str], order: str = "ord") -> Column:
    """Places, from 0, among siblings of one name; null for a name alone."""
    w = W.partitionBy(*group)
    return F.when(F.count(F.lit(1)).over(w) > 1, F.row_number().over(w.orderBy(order)) - 1)


def suffixed(base: Column, index: Column) -> Column:
    return F.when(index.isNotNull(), F.concat(base, F.lit("["), index.cast("string"), F.lit("]"))).otherwise(base)


def with_paths(symbols: DataFrame, deepest: int | None = None) -> DataFrame:
    """symbols with overload_idx, base_path and name_path, at every level.

    A child's path continues its parent's base path, which carries no index.
    Level after level joins its parents on their id.  deepest: the deepest level, if it is known.
    """
    if deepest is None:
        deepest = symbols.agg(F.max("depth").alias("d")).first()["d"] or 0
    numbered = symbols.withColumn("overload_idx", overload_index(["parent_id", "name"]).cast("int"))
    if deepest > LEVELS:
        numbered = cut(numbered)
    level = numbered.where("depth = 0").withColumn("base_path", F.col("name"))
    out = level
    for depth in range(1, deepest + 1):
        above = level.select(F.col("sym_id").alias("parent_id"), F.col("base_path").alias("above"))
        level = numbered.where(F.col("depth") == depth).join(above, "parent_id").withColumn("base_path", F.concat_ws("/", "above", "name")).select(*out.columns)
        if deepest > LEVELS:
            level = cut(level)
        out = out.unionByName(level)
    return out.withColumn("name_path", suffixed(F.col("base_path"), F.col("overload_idx")))


def parse_kinds(text: str) -> list[str]:
    """Kinds of a comma list; unknown names are refused."""
    out = []
    for name in filter(None, (x.strip().lower() for x in text.split(","))):
        kind = dims.KIND_ALIASES.get(name, name)
        if kind not in dims.NAMED_KINDS:
            raise ValueError(f"unknown symbol kind {name!r}; known: {', '.join(dims.NAMED_KINDS)}")
        out.append(kind)
    return out


def find_symbols(symbols: DataFrame, path: str | None = None, *, substring: str | None = None, include: str = "", exclude: str = "", structural: bool = False, depth: int | None = None, limit: int = 0) -> DataFrame:
    """Symbols by path pattern or part of a name, by kind and by depth; excluding a kind keeps what is below it."""
    out = symbols
    if depth is not None:
        out = out.where(F.col("depth") <= depth)
    if path is not None:
        out = out.where(S.matches(F.col("name_path"), path))
    if substring is not None:
        out = out.where(S.substring(F.col("name"), substring))
    if include:
        out = out.where(F.col("kind").isin(parse_kinds(include)))
    if exclude:
        out = out.where(~F.col("kind").isin(parse_kinds(exclude)))
    if structural:
        out = out.where(~F.col("kind").isin(*dims.LOW_LEVEL_KINDS))
    return out.orderBy("ord").limit(limit) if limit else out


def distinct_first(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Of rows alike in the key the first."""
    w = W.partitionBy(*key).orderBy(order)
    return rows.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def find_by_path(symbols: DataFrame, path: str) -> DataFrame:
    """The first symbol whose whole path is this."""
    return symbols.where(F.col("name_path") == path).orderBy("ord").limit(1)


def with_file_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name and kind of all symbols, and a symbol of kind file for files without one."""
    bare = files.select("file").join(symbols.select("file").distinct(), "file", "left_anti")
    return symbols.select("file", "name", "kind").unionByName(bare.select("file", F.element_at(F.split("file", "/"), -1).alias("name"), F.lit("file").alias("kind")))


def body(content: Column, line: Column, end_line: Column) -> Column:
    """The lines from line to end_line, null if the first is past the end."""
    parts = F.split(content, "\r?\n")
    n = F.least(end_line, F.size(parts)) - line + 1
    return F.when(line <= F.size(parts), F.array_join(F.slice(parts, line, F.greatest(n, F.lit(0))), "\n"))


def _held(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """key, at and best of every distinct point (key, at): the least best of the spans (key, first, last, best) that hold it; a null last has no end.

    A span is a few blocks of places, whose sizes are powers of two, and a point lies in one
    block of each size: both meet by an equi-join on blocks that keep their least best alone,
    so neither crowded keys nor long spans make pairs.
    """
    p = points.select(*key, F.col("at").cast("bigint").alias("at")).where("at is not null").distinct()
    reach = p.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    clipped = spans.where("first is not null").crossJoin(F.broadcast(reach)).select(
        *key, (F.greatest(F.col("first").cast("bigint"), "lo") - F.col("lo")).alias("a"), (F.least(F.col("last").cast("bigint"), "hi") - F.col("lo") + 1).alias("b"), "best"
    )
    clipped = clipped.where("a < b")
    sizes = clipped.agg(F.max(F.expr("length(bin(b - a)) - 1")).alias("top"))
    low, high = "shiftright(a + shiftleft(1L, k) - 1, k)", "shiftright(b, k)"
    ends = f"array(if({low} < {high} and {low} % 2 = 1, {low}, null), if({low} < {high} and {high} % 2 = 1, {high} - 1, null))"
    blocks = F.expr(f"inline(flatten(transform(sequence(0, length(bin(b - a)) - 1), k -> transform(filter({ends}, n -> n is not null), n -> struct(k as size, n as block)))))")
    nodes = clipped.groupBy(*key, "a", "b").agg(F.min("best").alias("best")).select(*key, "best", blocks).groupBy(*key, "size", "block").agg(F.min("best").alias("best"))
    lie = F.expr("inline(transform(sequence(0, top), k -> struct(k as size, shiftright(at - lo, k) as block)))")
    lying = p.crossJoin(F.broadcast(reach)).crossJoin(F.broadcast(sizes)).where("top is not null").select(*key, "at", lie)
    return lying.join(nodes, [*key, "size", "block"]).groupBy(*key, "at").agg(F.min("best").alias("best"))


def enclosing(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each position (pos_id, file, line) with the first symbol whose lines hold it.

    symbols has file, line, end_line (null: to the end), ord and name.
    """
    best = F.struct(F.col("ord").isNull(), "ord", "name").alias("best")
    held = _held(positions.select("file", F.col("line").alias("at")), symbols.select("file", F.col("line").alias("first"), F.col("end_line").alias("last"), best), ["file"])
    met = positions.select("pos_id", "file", F.col("line").alias("at")).join(held, ["file", "at"])
    return met.groupBy("pos_id").agg(F.min("best").alias("best")).select("pos_id", F.col("best.name").alias("name"))


def innermost(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each position with the symbol reached by taking, level by level, the first sibling that holds it, to any depth.

    A level looks only below the symbols that the level above has reached, and is written, so that plans stay short.
    """
    spans = symbols.select("file", "parent_id", "depth", F.col("line").alias("first"), F.col("end_line").alias("last"), F.struct("ord", "sym_id", "name").alias("best"))
    deepest = spans.agg(F.max("depth").alias("d")).first()["d"]
    at = positions.select("file", F.col("line").alias("at"))
    reached = None
    for depth in range((-1 if deepest is None else deepest) + 1):
        of = spans.where(F.col("depth") == depth)
        if reached is None:
            level = _held(at, of, ["file"])
        else:
            above = at.select("file", F.col("best.sym_id").alias("parent_id"), "at")
            level = _held(above, of.join(above.select("file", "parent_id").distinct(), ["file", "parent_id"], "left_semi"), ["file", "parent_id"])
        at = cut(level.select("file", "at", "best"))
        if at.isEmpty():
            break
        level = at.select("file", "at", F.struct(F.lit(depth).alias("depth"), F.col("best.name").alias("name")).alias("best"))
        reached = level if reached is None else reached.unionByName(level)
    if reached is None:
        return positions.where(F.lit(False)).select("pos_id", F.lit(None).cast("string").alias("name"))
    last = reached.groupBy("file", "at").agg(F.max("best").alias("best"))
    met = positions.select("pos_id", "file", F.col("line").alias("at")).join(last, ["file", "at"])
    return met.groupBy("pos_id").agg(F.max("best").alias("best")).select("pos_id", F.col("best.name").alias("name")).where("name is not null")


def at_positions(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """pos_id and target_id: the symbol whose name stands at a position (pos_id, file, line, column), else the innermost whose lines hold it."""
    best = F.struct((-F.col("depth")).alias("up"), "ord", "sym_id").alias("best")
    named = symbols.select("file", "line", F.col("column").alias("first"), (F.col("column") + F.length("name")).alias("last"), best).where("last is not null")
    exact = _held(positions.select("file", "line", F.col("column").alias("at")), named, ["file", "line"]).select("file", "line", F.col("at").alias("column"), F.col("best").alias("exact"))
    places = positions.select("file", "line", F.col("column").cast("bigint").alias("column")).distinct().join(exact, ["file", "line", "column"], "left")
    lines = symbols.select("file", F.col("line").alias("first"), F.col("end_line").alias("last"), best)
    inside = _held(places.where("exact is null").select("file", F.col("line").alias("at")), lines, ["file"]).select("file", F.col("at").alias("line"), F.col("best").alias("inside"))
    met = positions.select("pos_id", "file", "line", F.col("column").cast("bigint").alias("column")).join(exact, ["file", "line", "column"], "left").join(inside, ["file", "line"], "left")
    best = met.where("exact is not null or inside is not null").groupBy("pos_id").agg(F.min(F.struct(F.col("exact").isNull(), F.coalesce("exact", "inside").alias("best"))).alias("b"))
    return best.select("pos_id", F.col("b.best.sym_id").alias("target_id"))


def nested(symbols: DataFrame, deepest: int) -> DataFrame:
    """Top symbols with their children as arrays of structs, built from the deepest level up; siblings in document order."""
    kids: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        level = symbols.where(F.col("depth") == depth).select("sym_id", "parent_id", "ord", "name", "kind")
        if kids is not None:
            level = level.join(kids.withColumnRenamed("parent_id", "sym_id"), "sym_id", "left")
        if depth == 0:
            return level
        fields = ["ord", "name", "kind", *(["children"] if kids is not None else [])]
        kids = level.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    raise AssertionError
