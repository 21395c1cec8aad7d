"""Mixing sources to target weights, in DataFrame and SQL functions alone.

1. Sizes are counted once and each source's share follows from its weight, no
   source above `most` times its size.
2. A source's documents, in a random order that its ids fix, form one stream of
   words.  The stream is cut into blocks of whole documents (a document is in the
   block that holds its middle word).
3. In each pass over the stream the blocks have an order of their own, by a hash.  A
   source's quota is its drawn blocks: those that begin before the quota's words are
   reached; the last of them is cut.
4. A multivariate-hypergeometric splitting tree deals every source's exact
   number of drawn blocks out to the shards: a node's quotas are split between its two
   halves by drawing without replacement, source after source, from the root
   down.  Each draw is an exact inverse of the distribution function at a
   uniform number that the node fixes, so reruns agree.
5. A shard takes as many of a source's permuted blocks as the tree gave it, the next
   ones; so shards draw disjoint blocks, and a copy of a document exists exactly
   where a shard drew its block.  Rows are shuffled in their shard alone.

The order inside a source needs running sums over all its documents.  They are
taken in slices of a source by the order's leading digits, more of them the more
documents there are, then over the slices' sums, so that a source with a third of
all rows is no single task.  Shards follow the words that are drawn, up to MOST_SHARDS;
a shard is written in parts of about PART_WORDS.

Tables of one row per source or block are small beside the documents and are joined as
Spark's statistics say; no size is assumed.  A tree's node holds a number for each
source.

Defined results: null text has size 0; null source is a source of its own, the
last; null ids order as the empty string; repeated rows are documents of their
own, ordered by size and a hash of the text; an empty table gives an empty result;
documents of size 0 are never taken.  mix returns docs' own columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.llm.shared import cut

#: What sources weigh in the order of their names.
WEIGHTS = (5, 2, 1)
#: Words: runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of a source's stream, and the least words of a block.
MOST_BLOCKS, LEAST_BLOCK = 1 << 10, 1 << 8
#: Documents of a slice, about.
SLICE = 1 << 14
#: Words of a part of a shard, about; shards and parts at most.
PART_WORDS, MOST_SHARDS, MOST_PARTS = 1 << 21, 1 << 10, 1 << 17


def _targets(totals: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """totals has source and source_size; adds rank, weight and target.

    With sources in the order of cap / weight, the level that shares the rest
    among those not yet capped rises while sources are capped and falls after;
    its greatest value is the level at which none is above its cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(W.partitionBy()), F.sum("weight").over(W.partitionBy())
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    levels = ranked.withColumn("weight", w).withColumn("cap", cap)
    levels = levels.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max("level").over(W.partitionBy())
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("cap", "level")


def _ln_factorial(n: str) -> str:
    """SQL of ln(n!): products up to 20, then Stirling's series."""
    small = ", ".join(f"ln({f}D)" for f in _factorials(20))
    return f"if({n} <= 20, element_at(array({small}), cast({n} as int) + 1), {n} * ln({n}) - {n} + 0.5D * ln(6.283185307179586D * {n}) + 1 / (12D * {n}) - 1 / (360D * {n} * {n} * {n}) + 1 / (1260D * {n} * {n} * {n} * {n} * {n}))"


def _factorials(n: int) -> list[int]:
    out = [1]
    for k in range(1, n + 1):
        out.append(out[-1] * k)
    return out


def _draw(good: str, total: str, draws: str, uniform: str) -> str:
    """SQL: how many of `draws` without replacement from `total` are of the `good`; the distribution function's inverse at `uniform`.

    Numbers more than 12 deviations from the mean, with odds below 1e-30, are passed over.
    """
    choose = lambda n, k: f"({_ln_factorial(f'greatest({n}, 0D)')} - {_ln_factorial(f'greatest({k}, 0D)')} - {_ln_factorial(f'greatest({n} - {k}, 0D)')})"
    return f"""
    aggregate(
      array(named_struct('g', cast({good} as double), 't', cast({total} as double), 'd', cast({draws} as double), 'u', {uniform})),
      0L,
      (ignored, x) -> if(x.g <= 0 or x.d <= 0, 0L, if(x.d >= x.t, cast(x.g as bigint),
        aggregate(
          transform(
            array(named_struct('m', x.d * x.g / x.t, 's', 12D * sqrt(x.d * x.g / x.t * (1D - x.g / x.t) * (x.t - x.d) / greatest(x.t - 1D, 1D)) + 2D)),
            y -> named_struct('lo', greatest(0D, x.d - (x.t - x.g), floor(y.m - y.s)), 'hi', least(x.g, x.d, ceil(y.m + y.s)))),
          0L,
          (unused, r) -> aggregate(
            sequence(cast(r.lo as bigint), cast(r.hi as bigint)),
            named_struct('p', exp({choose('x.g', 'r.lo')} + {choose('(x.t - x.g)', '(x.d - r.lo)')} - {choose('x.t', 'x.d')}), 'sum', 0D, 'at', cast(r.lo as bigint), 'done', false),
            (a, k) -> if(a.done, a, named_struct(
              'p', a.p * (x.g - k) * (x.d - k) / ((k + 1D) * greatest(x.t - x.g - x.d + k + 1D, 1D)),
              'sum', a.sum + a.p,
              'at', k,
              'done', a.sum + a.p >= x.u)),
            a -> a.at)))))"""


def _deal(sources: DataFrame, shards: int, seed: str) -> DataFrame:
    """sources has rank and blocks; returns shard, rank and how many of the source's blocks the shard draws.

    The tree's nodes are rows; a level makes two of each, in place, without a shuffle but for one after five levels.
    """
    node = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "blocks"))).alias("all")).where(F.size("all") > 0)
    node = node.select(F.lit(0).cast("bigint").alias("shard"), F.transform("all", lambda x: x["rank"]).alias("ranks"), F.transform("all", lambda x: x["blocks"]).alias("quotas"))
    levels = (shards - 1).bit_length()
    uniform = f"((xxhash64('{seed}', @level, shard, i) & 4503599627370495L) + 0.5D) / 4503599627370496D"
    for level in range(levels):
        if level == 5:
            node = node.repartition("shard")
        # What the left half draws: half of all blocks, dealt over the sources in turn.
        draw = _draw("quotas[i]", "a.total", "a.draws", uniform.replace("@level", str(level)))
        left = F.expr(f"""
          aggregate(
            sequence(0, size(quotas) - 1),
            named_struct('left', cast(array() as array<bigint>), 'total', aggregate(quotas, 0L, (s, q) -> s + q), 'draws', aggregate(quotas, 0L, (s, q) -> s + q) div 2, 'x', 0L),
            (a, i) -> transform(array(named_struct('x', {draw})), z -> named_struct('left', concat(a.left, array(z.x)), 'total', a.total - quotas[i], 'draws', a.draws - z.x, 'x', z.x))[0],
            a -> a.left)""")
        node = node.withColumn("left", left)
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        node = node.select("ranks", F.explode(halves).alias("half")).select(F.col("half.shard").alias("shard"), "ranks", F.col("half.quotas").alias("quotas"))
    dealt = node.select("shard", F.explode(F.arrays_zip("ranks", "quotas")).alias("x")).select("shard", F.col("x.ranks").alias("rank"), F.col("x.quotas").alias("blocks"))
    return dealt


def _power(x: float, most: int) -> int:
    """The least power of two that is not below x, most at most."""
    return min(most, 1 << max(0, int(-(-x // 1)) - 1).bit_length())


class Plan:
    """Sources, the blocks that shards draw of them, and where each document lies."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], most: int, shards: int | None, seed: str, doc_id: str, source: str, text: str):
        self.docs, self.seed = docs, seed
        place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
        self.columns = [
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            place.alias("place"),
            F.xxhash64(F.col(text)).alias("tie"),
        ]
        self.sized = cut(docs.select(*self.columns))
        self.digits = max(2, min(8, len(f"{self.sized.count() // SLICE:x}")))
        slices = self.sized.groupBy("source", F.substring("place", 1, self.digits).alias("slice")).agg(F.sum("size").alias("slice_size"))
        slices = slices.withColumn("before", F.sum("slice_size").over(W.partitionBy("source").orderBy("slice")) - F.col("slice_size"))
        sources = _targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
        block = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("source_size") / MOST_BLOCKS)).cast("bigint")
        self.sources = cut(sources.select("source", "rank", "source_size", "target", F.round("target").cast("bigint").alias("quota"), block.alias("block")))
        drawn = self.sources.agg(F.sum("quota").alias("n")).first()["n"] or 0
        self.parts = _power(drawn / PART_WORDS, MOST_PARTS)
        self.shards = _power(shards, 1 << 20) if shards else min(self.parts, MOST_SHARDS)
        self.parts = max(self.parts, self.shards)
        prefix = slices.select("source", "slice", "before").join(self.sources, slices["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        self.prefix = cut(prefix.select(F.col("source").alias("s"), F.col("slice").alias("b"), "before", "rank", "source_size", "target", "quota", "block"))
        self.draws = self._draws(most)

    def placed(self, rows: bool = False) -> DataFrame:
        """Documents with their source's row and the block they are in; with rows, their columns as struct row."""
        sized = self.docs.select(*self.columns, F.struct(*[f"`{c}`" for c in self.docs.columns]).alias("row")) if rows else self.sized
        sized = sized.withColumn("slice", F.substring("place", 1, self.digits))
        upto = W.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
        placed = sized.withColumn("inside", F.sum("size").over(upto) - F.col("size")).join(self.prefix, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b")))
        placed = placed.withColumn("offset", F.col("before") + F.col("inside")).withColumn("number", F.expr("(offset + size div 2) div block"))
        return placed.select("doc_id", "source", "size", "rank", "source_size", "target", "quota", "offset", "number", *(["row", "tie"] if rows else []))

    def _draws(self, most: int) -> DataFrame:
        """rank, number (of a block), start (its first word's offset) and draws, array<struct<epoch, shard, before>>: the passes in which a shard draws it, and the words drawn before."""
        held = self.placed().where("size > 0").groupBy("rank", "number").agg(F.sum("size").alias("weight"), F.min("offset").alias("start"), F.first("quota").alias("quota"), F.first("source_size").alias("source_size"))
        passes = F.sequence(F.lit(0), F.least(F.lit(most), F.ceil(F.col("quota") / F.col("source_size"))).cast("int") - 1)
        every = held.where("quota > 0").withColumn("epoch", F.explode(passes))
        order = W.partitionBy("rank").orderBy("epoch", F.md5(F.concat_ws(":", F.lit(self.seed), "rank", "epoch", "number")))
        every = every.withColumn("nth", F.row_number().over(order) - 1).withColumn("before", F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight"))
        every = cut(every.where("before < quota").select("rank", "number", "start", "epoch", "nth", "before"))
        quotas = self.sources.select("rank").join(every.groupBy("rank").agg(F.count(F.lit(1)).alias("blocks")), "rank", "left").select("rank", F.coalesce("blocks", F.lit(0)).alias("blocks"))
        self.dealt = cut(_deal(quotas, self.shards, self.seed))
        ends = self.dealt.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("dealt"))
        ends = ends.select("rank", F.expr("aggregate(dealt, cast(array() as array<bigint>), (a, d) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + d.blocks)))").alias("ends"))
        taken = every.join(ends, "rank").withColumn("shard", F.expr("size(filter(ends, x -> x <= nth))")).where(F.col("shard") < self.shards)
        return taken.groupBy("rank", "number", "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "before"))).alias("draws"))

    def copies(self, whole: bool, rows: bool) -> DataFrame:
        placed, draws = self.placed(rows), cut(self.draws)
        both = placed.join(draws, ["rank", "number"], "left")
        rest = "(quota - d.before - (offset - start))"
        words = f"if(2 * {rest} >= size, size, 0L)" if whole else f"least(size, {rest})"
        copies = F.expr(f"filter(transform(coalesce(draws, array()), d -> named_struct('epoch', d.epoch, 'shard', d.shard, 'words', if(size = 0, 0L, {words}))), c -> c.words > 0)")
        return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["row", "tie"] if rows else []))


def plan(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = 3, shards: int | None = None, whole: bool = False, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and copies, array<struct<epoch, shard, words>>.

    shards: how many output shards, raised to a power of two; without it they follow
    the words.  words is what the quota leaves of the copy; with whole, a copy that the
    quota cuts counts wholly if its middle lies inside, else not at all.
    """
    return Plan(docs, weights, most, shards, seed, doc_id, source, text).copies(whole, rows=False)


def taken(copies: Column) -> Column:
    return F.aggregate(copies, F.lit(0).cast("bigint"), lambda s, c: s + c["words"])


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = 3, shards: int | None = None, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: rows of docs, each as often as its whole copies are drawn, dealt to shards and shuffled inside them. Rows that aren't drawn go.

    A shard is one partition, or as many as its words need; a partition has rows of one shard alone.
    """
    made = Plan(docs, weights, most, shards, seed, doc_id, source, text)
    drawn = made.copies(whole=True, rows=True).select("row", "doc_id", "tie", F.explode("copies").alias("copy"))
    local = F.md5(F.concat_ws(":", F.lit(seed), F.lit("local"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie").cast("string"), F.col("copy.epoch").cast("string")))
    split = made.parts // made.shards
    part = F.col("copy.shard") * split + F.pmod(F.xxhash64(local), F.lit(split))
    drawn = drawn.select("row", local.alias("at"), part.cast("int").alias("part"))
    return drawn.repartitionById(made.parts, "part").sortWithinPartitions("at").select("row.*")
