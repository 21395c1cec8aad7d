"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

Circulant MinHash needs two permutations.  The first sends a shingle to a place
on a circle of 2**CIRCLE_BITS places (its hash does that); the second is a fixed
permutation of the circle, written out once.  Coordinate k of a signature is the
least value of the second permutation, shifted by k places, over a document's
places.  All coordinates of a shingle are therefore one contiguous slice of the
table, and a signature is the column-wise minimum of such slices.

Steps:

1. One scan gives every document the size of its shingle set, a 128-bit hash of
   the set and the hashes of its bands.  Documents with equal sets form a class;
   its smallest id stands for it from here on, so thousands of copies are one.
2. Classes that share a band are candidates.  A bucket's members are not paired
   with one another but with its smallest id; pairs are verified on the full sets
   and give first components.
3. Buckets that then hold one component need no more.  Members of the others get
   a home: the largest component met in their buckets, or in those of the members
   met there.  Members with one home are compared with those of other components
   in blocks of bounded bytes, by counting common shingles in a sorted index, and
   only links leave a block.  Members of a bucket with different homes are verified
   one by one if the bucket has FEW of them, else compared in blocks as well.  So no
   link between candidates is missed, and no bucket, whatever its size, is written
   out as pairs.
4. Components come from repeated minimum-label steps over the verified links,
   with pointer jumping; tables are written between steps.

With BANDS bands of ROWS coordinates a pair of similarity 0.8 shares no band with
odds below 1e-5.

Defined results: null and wordless texts have no shingles, are linked with
nothing and are kept; a text with fewer words than a shingle has one shingle of
all of them; documents with one id count as one document (with the
smallest of its sets, as bytes); a null id is no document for linking: its row is kept and its
component is null; an empty table gives an empty result.  Other columns than doc_id
and text have no part; keep_one returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.llm import blocks
from lorewalk.llm.shared import checked, cut, fresh

CIRCLE_BITS = 20
BANDS, ROWS = 40, 6
#: Shingles whose slices of the table are gathered at once.
GATHERED = 1 << 13
#: Members of a bucket above which it is dealt to so many tasks.
CROWD, SALTS = 1 << 16, 64
#: Members of a bucket that are paired with one another at most.
FEW = 32
#: Bytes of shingle sets on either side of a block.
BLOCK = 4 << 20

_table: np.ndarray | None = None


def _circle() -> np.ndarray:
    """The second permutation, its beginning repeated at the end so that shifts don't wrap; then windows of one signature's length."""
    global _table
    if _table is None:
        order = np.random.default_rng(20).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        _table = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: BANDS * ROWS]]), BANDS * ROWS)
    return _table


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures of the sets sets[first[k]:first[k + 1]], none of them empty."""
    table, n = _circle(), len(first) - 1
    place = (sets >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    out = np.full((n, BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    k = 0
    for start in range(0, len(sets), GATHERED):
        stop = min(start + GATHERED, len(sets))
        while first[k + 1] <= start:
            k += 1
        last = int(np.searchsorted(first, stop, "left"))
        cuts = np.maximum(first[k:last], start) - start
        low = np.minimum.reduceat(table[place[start:stop]], cuts, axis=0)
        np.minimum(out[k:last], low, out=out[k:last])
    return out


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, with each text's range."""
    hashes, first = blocks.Words(texts, lower=True).shingles(size)
    parts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        if b - a > 1:
            s = s[np.r_[True, s[1:] != s[:-1]]]
        parts.append(s)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else hashes, np.concatenate([[0], np.cumsum(lengths)])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.pieces(batch, "text"):
                sets, first = shingle_sets(part.column("text"), size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                a = np.zeros(len(n), np.uint64)
                b = np.zeros(len(n), np.uint64)
                bands = np.zeros((len(some), BANDS), np.uint64)
                if len(some):
                    starts = first[some]
                    a[some], b[some] = np.add.reduceat(blocks.mix(sets, 101), starts), np.add.reduceat(blocks.mix(sets, 202), starts)
                    signed = signatures(sets, np.append(starts, first[-1])).reshape(len(some), BANDS, ROWS).astype(np.uint64)
                    bands += np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
                    for r in range(ROWS):
                        bands = blocks.mix(bands ^ signed[:, :, r], r)
                places = np.zeros(len(n) + 1, np.int32)
                places[some + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(places, dtype=np.int32)), pa.array(bands.reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), lists],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id and the shingle set (sorted 64-bit hashes, as bytes) of the wanted documents."""
    chosen = docs.join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.pieces(batch, "text"):
                sets, first = shingle_sets(part.column("text"), size)
                whole = sets.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([whole[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return chosen.mapInArrow(run, "doc_id long, shingles binary").groupBy("doc_id").agg(F.min("shingles").alias("shingles"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose sets reach the similarity; sizes are compared before sets travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            u, v = batch.column("su"), batch.column("sv")
            last: tuple[bytes, np.ndarray] | None = None
            for k in range(batch.num_rows):
                x = u[k].as_py()
                if last is None or last[0] != x:
                    last = (x, np.frombuffer(x, np.uint64))
                p, q = last[1], np.frombuffer(v[k].as_py(), np.uint64)
                least = -(-percent * (len(p) + len(q)) // (100 + percent))  # of the intersection: 100 i >= percent (|p| + |q| - i)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                linked.append(both >= least)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    one = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    near = percent * F.greatest(F.length("su"), F.length("sv")) <= 100 * F.least(F.length("su"), F.length("sv"))
    both = pairs.join(one, "u").join(two, "v").where(near).select("u", "v", "su", "sv")
    return both.mapInArrow(run, "u long, v long, linked boolean").where("linked").select("u", "v")


def _links_in_blocks(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between documents that meet (home, own, v, label) and have different labels, one for each label that a document is linked with in a block.

    home says where documents meet, own which label is the larger part there; documents of others are compared with all.
    """
    held = met.join(sets, met["v"] == sets["doc_id"]).select("home", "v", "label", "shingles", (F.col("label") != F.col("own")).alias("guest"))
    weight = F.length("shingles").cast("bigint")
    blocks_of = held.groupBy("home").agg(
        F.ceil(F.sum(weight) / BLOCK).cast("int").alias("all"), F.ceil(F.sum(F.when(F.col("guest"), weight)) / BLOCK).cast("int").alias("guests")
    ).where("guests is not null")
    held = held.join(blocks_of, "home")
    block = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    guests = held.where("guest").select("home", "v", "label", "shingles", F.lit(True).alias("asks"), block("guests").alias("g"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("a"))
    every = held.select("home", "v", "label", "shingles", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("g"), block("all").alias("a"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        asked, asking = rows[~rows["asks"]], rows[rows["asks"]]
        them = [np.frombuffer(x, np.uint64) for x in asked["shingles"]]
        u, v = [], []
        if them and len(asking):
            sizes = np.array([len(x) for x in them])
            flat, owner = np.concatenate(them), np.repeat(np.arange(len(them)), sizes)
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            ids, labels = asked["v"].to_numpy(), asked["label"].to_numpy()
            for me, label, x in zip(asking["v"], asking["label"], asking["shingles"], strict=True):
                mine = np.frombuffer(x, np.uint64)
                low, high = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                each = high - low
                at = np.arange(each.sum()) + np.repeat(low - (np.cumsum(each) - each), each)
                common = np.bincount(owner[at], minlength=len(them))
                linked = np.flatnonzero((100 * common >= percent * (len(mine) + sizes - common)) & (labels != label))
                linked = linked[np.unique(labels[linked], return_index=True)[1]]
                u += [me] * len(linked)
                v += ids[linked].tolist()
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return guests.unionByName(every).groupBy("home", "g", "a").applyInPandas(compare, "u long, v long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(v, label) with the smallest label reachable over links(u, v).

    Each step takes the least label of neighbours, then the label's own label;
    paths halve, so steps are few.  A hub's neighbours are reduced map-side.
    """
    links = cut(links)
    both = cut(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    while True:
        near = both.join(nodes.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        stepped = nodes.join(near, "v", "left").select("v", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        stepped = cut(stepped)
        up = stepped.select(F.col("v").alias("label"), F.col("label").alias("higher"))
        jumped = cut(stepped.join(up, "label", "left").select("v", "was", F.least("label", F.coalesce("higher", "label")).alias("label")))
        changed = jumped.where("was <> label").limit(1).count()
        nodes = jumped.select("v", "label")
        if not changed:
            return nodes


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    size: words a shingle.  percent: least similarity of a link.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_sign(size), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    named = signed.where("doc_id is not null and n_shingles > 0")
    # Documents with one id are one; equal sets are one class.
    classes = cut(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("v"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    key = ["band", "hash"]
    buckets = classes.select("v", "n", F.posexplode("bands").alias("band", "hash"))
    shared = cut(buckets.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    # A crowded bucket's rows are dealt to SALTS tasks; what is joined to it is there in each of them.
    crowded = cut(shared.where(F.col("members") > CROWD).select(*key, F.lit(True).alias("crowded")))
    if crowded.isEmpty():
        salted, dealt = key, buckets
        everywhere = lambda rows: rows
    else:
        salted, crowded = [*key, "salt"], checked(crowded)
        mark = lambda rows: rows.join(crowded, key, "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        everywhere = lambda rows: mark(rows).withColumn("salt", F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("crowded")
        dealt = mark(buckets).withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    buckets = cut(dealt.join(everywhere(shared.select(*key)), salted).select(*salted, "v", "n"))
    members = cut(buckets.select("v").distinct())
    sets = cut(_sets_of(docs, members.select(F.col("v").alias("doc_id")), size))

    near = percent * F.greatest("n", "p_n") <= 100 * F.least("n", "p_n")
    pivots = buckets.groupBy(*key).agg(F.min(F.struct("v", "n")).alias("p")).select(*key, F.col("p.v").alias("p"), F.col("p.n").alias("p_n"))
    pairs = cut(buckets.join(everywhere(pivots), salted).where("v <> p").where(near).select(F.col("p").alias("u"), "v").distinct())
    links = _verify(pairs, sets, percent)
    labels = components(members.select("v", F.col("v").alias("label")), links)

    placed = buckets.join(labels, "v")
    mixed = placed.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select(*key)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    met = cut(placed.join(everywhere(mixed), salted).join(sizes, "label").select(*salted, "v", "n", "label", "members", F.struct("members", "label").alias("home")))
    for _ in range(2):
        largest = met.groupBy(*key).agg(F.max("home").alias("largest"))
        homes = met.join(everywhere(largest), salted).groupBy("v").agg(F.max("largest").alias("home"))
        met = cut(met.drop("home").join(homes, "v"))
    met = met.withColumn("home", F.col("home.label"))
    links = _links_in_blocks(met.select("v", "label", "home", F.col("home").alias("own")).distinct(), sets, percent)
    apart = met.groupBy(*key).agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count(F.lit(1)).alias("there"), F.max_by("label", F.struct("members", "label")).alias("own")).where("low < high")
    apart = met.join(everywhere(apart.select(*key, "there", "own")), salted)
    # Large ones meet in their bucket as at a home; two buckets of one hash would be compared together.
    crowds = apart.where(F.col("there") > FEW).select(F.xxhash64(*key).alias("home"), "own", "v", "label").distinct()
    apart = apart.where(F.col("there") <= FEW)
    other = apart.select(*key, F.col("v").alias("p"), F.col("label").alias("p_label"), F.col("home").alias("p_home"), F.col("n").alias("p_n"))
    strangers = apart.join(other, key).where((F.col("v") < F.col("p")) & (F.col("home") != F.col("p_home")) & (F.col("label") != F.col("p_label")) & near)
    strangers = cut(strangers.select(F.col("v").alias("u"), F.col("p").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti"))
    links = links.union(_links_in_blocks(crowds, sets, percent))
    more = cut(links.union(_verify(strangers, sets, percent)))
    # Links between documents are links between their labels.
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    merged = more.join(of("u"), "u").join(of("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
    top_labels = components(labels.select(F.col("label").alias("v"), "label").distinct(), merged)
    labels = labels.join(top_labels.select(F.col("v").alias("label"), F.col("label").alias("top")), "label").select("v", F.col("top").alias("label"))

    top = classes.select("set_a", "set_b", "v").join(labels, "v", "left").select("set_a", "set_b", F.coalesce("label", "v").alias("component"))
    out = signed.join(top, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near duplicates: of each component the document with its smallest id stays, of several rows with that id one."""
    judged = cut(near_duplicates(docs, size=size, percent=percent).select("doc_id", "kept"))
    gone = cut(judged.where("not kept").select("doc_id").distinct())
    several = cut(judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    out = docs.join(checked(gone), "doc_id", "left_anti")
    if several.isEmpty():
        return out.select(*[f"`{c}`" for c in docs.columns])
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(*[f"`{c}`" for c in docs.columns])))
    (place,) = fresh(docs.columns, "nth")
    one = out.join(checked(several), "doc_id", "left_semi").withColumn(place, nth).where(F.col(place) == 1).drop(place)
    return out.join(checked(several), "doc_id", "left_anti").unionByName(one).select(*[f"`{c}`" for c in docs.columns])
