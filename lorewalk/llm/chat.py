"""Chat formatting: logs that grow turn by turn collapse to their longest form, then are rendered.

A chat service often logs a conversation anew after every turn, so one log is
the beginning of another.  Each turn's prefix gets a rolling hash (the running
exclusive-or of 64-bit hashes of place, role and text, twice, with different
salts).  A conversation whose whole hash is a proper prefix's hash of another
goes, by an anti-join; of equal conversations the one with the smallest id stays.

The tables of hashes hold no text.  Prefixes and whole conversations are made
distinct before the anti-join, so a first turn that all share is one row there.

Defined results: rows without conv_id belong to no conversation and go;
repeated rows (same id, turn, role and text) count once; turns are ordered by
turn (null last), then role, then text; null role and text count as empty; a
conversation with empty texts is one like any other;
conv_id, turn, role and text alone are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.llm.shared import cut

#: How a turn is rendered.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns: conv_id, late (turn is null), turn, role, text."""
    c = conversations
    return c.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.col("turn").isNull().alias("late"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that stay: neither the beginning of a longer one nor equal to one with a smaller id."""
    turns = _turns(conversations)
    said = ("late", "turn", "role", "text")
    # A row per turn, without its text: its order is that of text by the sort below.
    w = W.partitionBy("conv_id").orderBy(*said)
    fresh = F.coalesce(~F.struct(*said).eqNullSafe(F.lag(F.struct(*said)).over(w)), F.lit(True))
    placed = turns.withColumn("fresh", fresh).where("fresh").withColumn("nth", F.row_number().over(w))
    hashed = placed.select("conv_id", "nth", *[F.xxhash64(F.lit(salt), "nth", "role", "text").alias(n) for n, salt in (("a", 11), ("b", 23))])
    rows = W.partitionBy("conv_id").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "nth", F.bit_xor("a").over(rows).alias("a"), F.bit_xor("b").over(rows).alias("b"), F.lead("nth").over(W.partitionBy("conv_id").orderBy("nth")).isNull().alias("last"))
    rolled = cut(rolled)
    whole = rolled.where("last").groupBy("nth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    begun = rolled.where("not last").select("nth", "a", "b").distinct()
    return whole.join(begun, ["nth", "a", "b"], "left_anti").select("conv_id", F.col("nth").cast("long").alias("n_turns"), "copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered, for the conversations that stay. Marks inside texts and roles are broken by a space."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    kept = maximal(conversations)
    turns = _turns(conversations).join(kept, "conv_id")
    grouped = turns.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_set(F.struct("late", "turn", "role", "text"))).alias("said"))
    one = lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join(F.transform("said", one), "").alias("rendered"))
