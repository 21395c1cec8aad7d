"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue, then exact reranking.

Nearness is the largest inner product.  For the trees a vector gets one more
component, sqrt(M * M - |x| * |x|) with M the largest length, and a query a zero
there; the largest inner product is then the smallest distance.

Vectors of one length are searched among themselves.

1. Rows with equal vectors form a class; of its ids the smallest ones that can
   ever be in a result are kept (one more than neighbours asked for), so a vector
   that many rows share is indexed once.  Its ids are cut down in salted groups.
2. The trees are fitted to SAMPLE classes (those with the smallest hashes): a node
   splits at the median along the line between two random points.  Every class is
   then indexed: each tree sends it to one leaf.
3. A query's leaves come from one queue over all trees, ordered by the sum of
   squared distances to the hyperplanes crossed, until the leaves hold `share` of
   all entries.  The share is the least one that reaches RECALL on queries and
   neighbours inside the sample, found by brute force there; of forests of TREES
   trees the one with the least share is taken, so no query visits more entries than
   there are.
4. It is counted how many queries ask for a leaf.  A leaf's queries and members meet
   in blocks of bounded size, and a member goes only to the blocks of queries that
   ask for its leaf; only each query's best of a block leave it.  Scores are inner
   products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id; rows with one id count as one for a query's result; an empty
table gives an empty result;
the two named columns alone are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewalk.llm import blocks
from lorewalk.llm.shared import cut

TREES = (1, 2, 4)
#: Classes that the trees are fitted to and the share is found on.
SAMPLE, PROBES = 20_000, 200
#: Leaves of a tree: 2 ** DEPTH, or more so that a leaf holds LEAF entries at most, as far as the sample goes (FEWEST of it in a leaf).
DEPTH, LEAF, FEWEST = 5, 1 << 14, 16
#: Recall that the share must reach inside the sample.
RECALL = 0.96
#: Vectors on either side of a block.
BLOCK = 4096


class Forest:
    """Trees as nested tuples (direction, threshold, below, above); a leaf is its number."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.leaves: list[int] = []
        self.trees = []
        for _ in range(max(TREES)):
            number = count()
            self.trees.append(self._grow(sample, np.arange(len(sample)), depth, rng, number))
            self.leaves.append(next(number))

    def _grow(self, x: np.ndarray, rows: np.ndarray, depth: int, rng: np.random.Generator, number: count):
        if depth == 0 or len(rows) < 2 * FEWEST:
            return next(number)
        a, b = x[rng.choice(rows, 2, replace=False)]
        way = a - b
        way = way / np.linalg.norm(way)  # classes differ, so points do
        at = x[rows] @ way
        middle = np.median(at)
        low = at <= middle
        if low.all():
            return next(number)
        return way, middle, self._grow(x, rows[low], depth - 1, rng, number), self._grow(x, rows[~low], depth - 1, rng, number)

    def part(self, trees: int) -> "Forest":
        """The first trees alone."""
        out = Forest.__new__(Forest)
        out.trees, out.leaves = self.trees[:trees], self.leaves[:trees]
        return out

    def leaf(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.empty(len(x), np.int32)
        todo = [(self.trees[tree], np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = x[rows] @ node[0] <= node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out

    def search(self, q: np.ndarray, sizes: list[np.ndarray], most: float) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the queue's order, until the leaves hold so many entries."""
        tie, held = count(), 0
        queue = [(0.0, next(tie), t, node) for t, node in enumerate(self.trees)]
        while queue and held < most:
            far, _, t, node = heapq.heappop(queue)
            while not isinstance(node, int):
                side = float(node[0] @ q) - node[1]
                near, other = (node[2], node[3]) if side <= 0 else (node[3], node[2])
                heapq.heappush(queue, (far + side * side, next(tie), t, other))
                node = near
            held += sizes[t][node]
            yield t, node


def _matrix(column: pa.Array, most: float | None = None) -> np.ndarray:
    """Vectors as rows; with the additional component if the largest length is given."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x if most is None else np.column_stack([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))])


def _share(forest: Forest, sample: np.ndarray, k: int) -> float:
    """The least share of entries that finds RECALL of the nearest inside the sample."""
    n = len(sample)
    probes = np.random.default_rng(9).choice(n, min(PROBES, n), replace=False)
    sizes, leaf = [], []
    for t in range(len(forest.trees)):
        leaf.append(forest.leaf(t, sample))
        sizes.append(np.bincount(leaf[t], minlength=forest.leaves[t]))
    needed = []
    for p in probes:
        q = np.append(sample[p, :-1], 0.0)
        score = sample @ q
        score[p] = -np.inf
        best = np.argpartition(-score, min(k, n - 1))[: min(k, n - 1)]
        if not len(best):
            continue
        held, found = 0, np.full(len(best), np.inf)
        for t, number in forest.search(q, sizes, np.inf):
            held += sizes[t][number]
            found[leaf[t][best] == number] = np.minimum(found[leaf[t][best] == number], held)
            if np.isfinite(found).all():
                break
        needed.append(found)
    return float(np.quantile(np.concatenate(needed), RECALL)) / n if needed else 1.0


def _dealt(ids: np.ndarray, salt: int, into: np.ndarray) -> np.ndarray:
    """A number below `into` for each id."""
    return (blocks.mix(ids.astype(np.uint64), salt) % into.astype(np.uint64)).astype(np.int64)


def nearest(table: DataFrame, *, k: int = 20, is_query: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query row its k nearest rows but for itself, nearest first, ties to smaller ids.

    is_query: condition on the columns vec_id and embedding; all rows without it.
    """
    x = F.col("embedding")
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    shapes = rows.groupBy(F.size(x).alias("size")).agg(F.sqrt(F.max(square)).alias("most")).collect()  # a row for each length, which is one as a rule
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in shapes:
        out = out.unionByName(_nearest(rows.where(F.size(x) == r["size"]), r["most"], k, is_query)) if len(shapes) > 1 else _nearest(rows, r["most"], k, is_query)
    return out


def _nearest(rows: DataFrame, most: float, k: int, is_query: Column | None) -> DataFrame:
    """nearest among vectors of one length; most: the largest of them."""
    spark, x = rows.sparkSession, F.col("embedding")
    keyed = rows.withColumns({"a": F.xxhash64(F.lit(1), x), "b": F.xxhash64(F.lit(2), x)})

    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    some = keyed.withColumn("nth", F.dense_rank().over(W.partitionBy("a", "b", salt).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    some = some.withColumn("nth", F.dense_rank().over(W.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = cut(some.groupBy("a", "b").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding")).withColumn("v", F.col("ids")[0]))
    asking = cut((keyed.where(is_query) if is_query is not None else keyed).select("vec_id", "a", "b").distinct())
    n = classes.count()

    sample = _matrix(classes.orderBy(F.xxhash64("a", "b")).limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks(), most)
    forest = Forest(sample, max(DEPTH, int(np.ceil(np.log2(max(1, n / LEAF))))))
    share, trees = min((_share(forest.part(t), sample, k), t) for t in TREES)
    forest = forest.part(trees)
    held = spark.sparkContext.broadcast(forest)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("embedding"), most)
                for t in range(trees):
                    number, c = np.unique(held.value.leaf(t, m), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int32)), pa.array(number), pa.array(c)], names=["tree", "leaf", "c"])

    def by_leaf(counts: DataFrame) -> list[np.ndarray]:
        out = [np.zeros(leaves, np.int64) for leaves in forest.leaves]
        for r in counts.groupBy("tree", "leaf").agg(F.sum("c").alias("c")).collect():  # a row for each leaf
            out[r["tree"]][r["leaf"]] = r["c"]
        return out

    sizes = by_leaf(classes.select("embedding").mapInArrow(tally, "tree int, leaf int, c long"))
    sizes_held = spark.sparkContext.broadcast(sizes)
    enough = max(share * n, trees * (k + 2))  # so many entries are k + 1 classes at least, if there are that many
    kind = classes.schema["embedding"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            visits = [list(held.value.search(np.append(q, 0.0), sizes_held.value, enough)) for q in _matrix(batch.column("embedding"))]
            found = [pa.array([[v[j] for v in x] for x in visits], pa.list_(pa.int32())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("embedding"), *found], names=["v", "embedding", "trees", "leaves"])

    asked = classes.join(asking.select("a", "b").distinct(), ["a", "b"], "left_semi").select("v", "embedding")
    visits = cut(asked.mapInArrow(search, f"v long, embedding {kind}, trees array<int>, leaves array<int>"))
    each = visits.select(F.explode(F.arrays_zip("trees", "leaves")).alias("x")).select(F.col("x.trees").alias("tree"), F.col("x.leaves").alias("leaf"), F.lit(1).alias("c"))
    cuts_held = spark.sparkContext.broadcast([(-(-size // BLOCK), -(-asks // BLOCK)) for size, asks in zip(sizes, by_leaf(each), strict=True)])
    schema = f"tree int, leaf int, block int, part int, asks boolean, v long, embedding {kind}"

    def rows_of(batch: pa.RecordBatch, take: np.ndarray, tree, leaf, block, part, asks: bool) -> pa.RecordBatch:
        chosen = batch.take(pa.array(take))
        fixed = [np.asarray(c, np.int32) for c in (tree, leaf, block, part)]
        return pa.RecordBatch.from_arrays([*map(pa.array, fixed), pa.array(np.full(len(take), asks)), chosen.column("v"), chosen.column("embedding")], names=["tree", "leaf", "block", "part", "asks", "v", "embedding"])

    def several(batch: pa.RecordBatch, row: np.ndarray, tree: np.ndarray, leaf: np.ndarray, one: np.ndarray, times: np.ndarray, asks: bool) -> Iterator[pa.RecordBatch]:
        """Rows (for a tree and leaf, with one number fixed) as often as there are numbers of the other kind."""
        flat = np.repeat(np.arange(len(row)), times)
        other = np.arange(len(flat)) - np.repeat(np.cumsum(times) - times, times)
        for s in range(0, len(flat), 20_000):
            z, o = flat[s : s + 20_000], other[s : s + 20_000]
            block, part = (o, one[z]) if asks else (one[z], o)
            yield rows_of(batch, row[z], tree[z], leaf[z], block, part, asks)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, ids = _matrix(batch.column("embedding"), most), batch.column("v").to_numpy()
            for t in range(trees):
                leaf = held.value.leaf(t, m)
                in_blocks, parts = cuts_held.value[t]
                yield from several(batch, np.arange(len(m)), np.full(len(m), t), leaf, _dealt(ids, t, in_blocks[leaf]), parts[leaf], False)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, leaf = (batch.column(c).flatten().to_numpy() for c in ("trees", "leaves"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("trees").offsets.to_numpy()))
            in_blocks, parts = (np.concatenate([c[j] for c in cuts_held.value])[np.concatenate([[0], np.cumsum(held.value.leaves)])[tree] + leaf] for j in (0, 1))
            yield from several(batch, row, tree, leaf, _dealt(batch.column("v").to_numpy()[row], 99, parts), in_blocks, True)

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        out = []
        if asks.any() and not asks.all():
            ids = group["v"].to_numpy()
            q, c = ids[asks], ids[~asks]
            mine, theirs = (np.stack(group["embedding"].to_numpy()[w]).astype(np.float64) for w in (asks, ~asks))
            for s in range(0, len(q), 512):
                score = mine[s : s + 512] @ theirs.T
                width = min(k + 1, len(c))
                best = np.argpartition(-score, width - 1, axis=1)[:, :width]
                out.append(pd.DataFrame({"q": np.repeat(q[s : s + 512], width), "c": c[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "score": np.zeros(0)})

    entries = classes.select("v", "embedding").mapInArrow(index, schema).unionByName(visits.mapInArrow(probe, schema))
    scored = entries.groupBy("tree", "leaf", "block", "part").applyInPandas(rerank, "q long, c long, score double")
    scored = scored.groupBy("q", "c").agg(F.max("score").alias("score"))
    first = scored.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("nth") <= k + 1)
    ids = first.join(classes.select(F.col("v").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    ids = ids.groupBy("q", "id").agg(F.max("score").alias("score"))
    ids = ids.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1)
    lists = ids.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))
    queries = asking.join(classes.select("a", "b", F.col("v").alias("q")), ["a", "b"]).select("vec_id", "q")
    own = queries.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda s: s["id"] != F.col("vec_id")), 1, k)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
