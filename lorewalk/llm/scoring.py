"""LM scoring: exact unigram counts, and a hashed maximum-entropy model over n-gram and skip features.

Texts are turned into blocks once: a block holds the documents of some megabytes
of text as numbers of its own words, with the words' 64-bit hashes and training
counts.  Counts of all blocks are added up in Spark and each block gets back the
totals of the words it holds, so no vocabulary is ever gathered in one place.

The model gives a token after its context as

    P(class | context) * P(leaf | class, context) * share of the token in its leaf.

There are CLASSES classes of MEMBERS leaves.  Each of the FREQUENT most frequent tokens
is a leaf of its own, in the order of their frequency.  All other tokens, seen or not,
are dealt to the rest of the leaves by a hash; in such a leaf a token has the share
(c + 1) / (n + v + 1) with n and v the leaf's count and number of distinct tokens,
and what was never seen is one such token.  The probabilities of all tokens and
of one unseen token a leaf add up to one.  Both factors are softmaxes over a fixed
number of scores, which are sums of table rows.  A row is picked by hashing a feature:
the word before, the two words before, the second word before (a skip); for leaves
the word before and the skip, each with the class.

Training passes over every training token once, in ROUNDS rounds.  In a round each
task starts from the same tables, takes AdaGrad steps over its part of the blocks
and returns what rows gained; gains are averaged by how often rows were touched.
Tables have a fixed size, so what is broadcast and returned doesn't grow.

Defined results: null text counts as empty and consists of its end; a null id
counts as the empty text for the split; repeated rows are documents of their own;
without training rows N and V are 0 and the model knows nothing but its leaves; an empty table gives an empty result;
doc_id and text alone are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewalk.llm import blocks
from lorewalk.llm.shared import cut, release

#: Bytes of text in a block.
BLOCK = 8 << 20
MEMBERS, CLASSES = 32, 32
LEAVES = MEMBERS * CLASSES
#: Tokens that are leaves of their own; all others share the rest, LEAVES - FREQUENT.
FREQUENT = 512
#: Bits of a row's number, for classes and for leaves.
CLASS_BITS, MEMBER_BITS = 12, 13
CLASS_FEATURES, MEMBER_FEATURES = 3, 2
ROUNDS = 2
#: Tokens of a step, and its size.
STEP, RATE = 4096, 0.15
#: Hashes that stand for the end of a text and for what is before its beginning.
END, BEFORE = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0xB0B0B0B0B0B0B0B0)

_BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<int>, tokens binary, words binary, seen binary"


def is_held_out(doc_id: Column, of: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest


def _pack(tokens: np.ndarray) -> bytes:
    """Numbers of words as bytes, all lowest bytes first: the higher ones are mostly zero and compress well, as frequent words have small numbers."""
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    held: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    weight, nth = 0, count()

    def block() -> pa.RecordBatch:
        flat, n, out = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(held)
        number, words = pd.factorize(flat)
        seen = np.bincount(number[~np.repeat(out, n)], minlength=len(words))
        row = {
            "block": (TaskContext.get().partitionId() << 32) + next(nth),  # the same when a task is run again
            "doc_id": ids,
            "held_out": out.tolist(),
            "n_tokens": n.tolist(),
            "tokens": _pack(number),
            "words": words.astype(np.uint64).tobytes(),
            "seen": seen.astype(np.int64).tobytes(),
        }
        kinds = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

    for batch in batches:
        for part in blocks.pieces(batch, "text", 4 << 20):
            words = blocks.Words(part.column("text"), lower=True)
            hashes.append(np.insert(words.hash, words.first[1:], END))
            sizes.append(np.diff(words.first) + 1)
            held.append(part.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
            ids += part.column("doc_id").to_pylist()
            weight += len(words.data)
            if weight >= BLOCK:
                yield block()
                ids, held, hashes, sizes, weight = [], [], [], [], 0
    if ids:
        yield block()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a block."""
    for batch in batches:
        for k in range(batch.num_rows):
            words = np.frombuffer(batch.column("words")[k].as_py(), np.int64)
            seen = np.frombuffer(batch.column("seen")[k].as_py(), np.int64)
            for s in range(0, len(words), 1 << 16):
                w = words[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w), pa.array(np.full(len(w), batch.column("block")[k].as_py())), pa.array(np.arange(s, s + len(w), dtype=np.int32)), pa.array(seen[s : s + (1 << 16)])],
                    names=["word", "block", "nth", "c"],
                )


def _shared_leaf(words: np.ndarray) -> np.ndarray:
    """The leaf that a token which isn't frequent has with others."""
    return FREQUENT + (blocks.mix(words, 21) % np.uint64(LEAVES - FREQUENT)).astype(np.int64)


class Model:
    """Tables of the two softmaxes; words holds the frequent tokens' hashes in their order, shared the counts and numbers of distinct tokens of the other leaves."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shared: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(words)
        self.words, self.rank = words[order], order
        self.n, self.v = (np.concatenate([np.zeros(FREQUENT, np.int64), x]) for x in shared)
        weight = np.concatenate([counts, np.zeros(FREQUENT - len(counts)), shared[0] + 1.0]).reshape(CLASSES, MEMBERS)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(weight.sum(1) / weight.sum()), -1e9).astype(np.float32)
            self.member_bias = np.maximum(np.log(weight), -1e9).astype(np.float32)
        self.class_rows = np.zeros((CLASS_FEATURES << CLASS_BITS, CLASSES), np.float32)
        self.member_rows = np.zeros((MEMBER_FEATURES << MEMBER_BITS, MEMBERS), np.float32)

    def leaves(self, words: np.ndarray) -> np.ndarray:
        """Each token's leaf."""
        out = _shared_leaf(words)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            out[known] = self.rank[at[known]]
        return out


class _Slice(NamedTuple):
    """Some tokens: their places, and rows and target of either softmax."""

    first: int
    last: int
    class_rows: list[np.ndarray]
    target: np.ndarray
    member_rows: list[np.ndarray]
    member: np.ndarray


def _rows(features: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Table rows of hashed features, each feature in a part of the table of its own."""
    return [(f >> np.uint64(64 - bits)).astype(np.int64) + (k << bits) for k, f in enumerate(features)]


def _slices(model: Model, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[_Slice]:
    """A block's tokens in slices, so that features never exist for a whole block at once."""
    leaves = model.leaves(words)
    one_hash, skip_hash, pair_hash = blocks.mix(words, 1), blocks.mix(words, 4), blocks.mix(words, 2)
    none = [blocks.mix(np.array([BEFORE]), k)[0] for k in (1, 4, 2)]
    of_class = blocks.mix(np.arange(CLASSES, dtype=np.uint64), 6)
    starts = np.cumsum(sizes) - sizes
    for s in range(0, len(tokens), step):
        e = min(s + step, len(tokens))
        at = np.arange(s, e)
        nth = at - starts[np.searchsorted(starts, at, "right") - 1]
        before = [tokens[np.maximum(at - k, 0)] for k in (1, 2)]
        inside = [nth >= k for k in (1, 2)]
        one = np.where(inside[0], one_hash[before[0]], none[0])
        skip = np.where(inside[1], skip_hash[before[1]], none[1])
        pair = np.where(inside[0], pair_hash[before[0]], none[2]) ^ np.where(inside[1], words[before[1]], BEFORE)
        leaf = leaves[tokens[s:e]]
        target, member = leaf // MEMBERS, leaf % MEMBERS
        mine = of_class[target]
        yield _Slice(s, e, _rows([one, blocks.mix(pair, 3), skip], CLASS_BITS), target, _rows([blocks.mix(one ^ mine, 7), blocks.mix(skip ^ mine, 8)], MEMBER_BITS), member)


def _softmax(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities after the scores that are the sums of the bias and the table's rows."""
    z = table[rows[0]] + bias
    for r in rows[1:]:
        z += table[r]
    top = z.max(1, keepdims=True)
    z -= top
    np.exp(z, out=z)
    total = z.sum(1, keepdims=True)
    z /= total
    return z


def log_probability(model: Model, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 of each token's probability; totals: training counts of the block's words."""
    out = np.empty(len(tokens))
    leaves = model.leaves(words)
    share = np.where(leaves < FREQUENT, 1.0, (totals + 1.0) / (model.n[leaves] + model.v[leaves] + 1.0))
    for x in _slices(model, words, tokens, sizes, STEP):
        p = _softmax(model.class_bias, model.class_rows, x.class_rows)
        of = p[np.arange(len(p)), x.target].astype(np.float64)
        p = _softmax(model.member_bias[x.target], model.member_rows, x.member_rows)
        inner = p[np.arange(len(p)), x.member] * share[tokens[x.first : x.last]]
        out[x.first : x.last] = np.log10(np.maximum(of, 1e-30)) + np.log10(np.maximum(inner, 1e-30))
    return out


class _Trainer:
    """AdaGrad over the tables, with counts of how often rows were touched."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = [model.class_rows.copy(), model.member_rows.copy()]
        self.squares = [np.full(len(t), 1e-3, np.float32) for t in self.tables]
        self.touched = [np.zeros(len(t), np.int64) for t in self.tables]

    def _step(self, which: int, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
        table = self.tables[which]
        p = _softmax(bias, table, rows)
        p[np.arange(len(p)), target] -= 1
        for r in rows:
            order = np.argsort((r & 0xFFFF).astype(np.uint16), kind="stable")  # a feature's rows differ in their low bits
            sorted_rows = r[order]
            begin = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
            gradient = np.add.reduceat(p[order], begin, axis=0)
            at, times = sorted_rows[begin], np.diff(np.r_[begin, len(r)])
            self.squares[which][at] += (gradient * gradient).mean(1)
            table[at] -= RATE / np.sqrt(self.squares[which][at])[:, None] * gradient
            self.touched[which][at] += times

    def learn(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        m = self.model
        for x in _slices(m, words, tokens, sizes, STEP):
            self._step(0, m.class_bias, x.class_rows, x.target)
            self._step(1, m.member_bias[x.target], x.member_rows, x.member)


#: Table rows that travel together.
_TOGETHER = 1 << 10


def _train(docs: DataFrame, model: Model) -> Model:
    spark = docs.sparkSession
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, held=held) -> Iterator[pa.RecordBatch]:
            trainer = _Trainer(held.value)
            for batch in batches:
                for k in range(batch.num_rows):
                    sizes = np.array(batch.column("n_tokens")[k].as_py(), np.int64)
                    out = np.array(batch.column("held_out")[k].as_py(), bool)
                    use = ~out & (np.arange(len(sizes)) % ROUNDS == turn)
                    tokens = _unpack(batch.column("tokens")[k].as_py())[np.repeat(use, sizes)]
                    if len(tokens):
                        trainer.learn(np.frombuffer(batch.column("words")[k].as_py(), np.uint64), tokens, sizes[use])
            start = (held.value.class_rows, held.value.member_rows)
            for which in (0, 1):
                gain = (trainer.tables[which] - start[which]) * trainer.touched[which][:, None]
                for s in range(0, len(gain), _TOGETHER):
                    if trainer.touched[which][s : s + _TOGETHER].any():
                        row = [which, s, gain[s : s + _TOGETHER].astype(np.float32).tobytes(), trainer.touched[which][s : s + _TOGETHER].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["which", "first", "gain", "times"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    key = (batch.column("which")[k].as_py(), batch.column("first")[k].as_py())
                    gain = np.frombuffer(batch.column("gain")[k].as_py(), np.float32).astype(np.float64)
                    times = np.frombuffer(batch.column("times")[k].as_py(), np.int64)
                    if key in sums:
                        sums[key][0] += gain
                        sums[key][1] = sums[key][1] + times
                    else:
                        sums[key] = [gain, times]
            for (which, s), (gain, times) in sums.items():
                mean = gain.reshape(len(times), -1) / np.maximum(times, 1)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([s]), pa.array([mean.astype(np.float32).tobytes()])], names=["which", "first", "gain"])

        gains = docs.select("held_out", "n_tokens", "tokens", "words").mapInArrow(learn, "which long, first long, gain binary, times binary")
        gains = gains.repartition(12, "which", "first").mapInArrow(add, "which long, first long, gain binary")
        for r in gains.collect():  # the tables' size in all
            table = (model.class_rows, model.member_rows)[r["which"]]
            gain = np.frombuffer(r["gain"], np.float32).reshape(-1, table.shape[1])
            table[r["first"] : r["first"] + len(gain)] += gain
        held.unpersist()
    return model


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    held_out: condition on the column doc_id; the model learns from the other rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    made = cut(source.mapInArrow(_to_blocks, _BLOCKS))
    entries = made.select("block", "words", "seen").mapInArrow(_entries, "word long, block long, nth int, c long")
    totals = cut(entries.groupBy("word").agg(F.sum("c").alias("total")))
    n, v = (int(x or 0) for x in totals.agg(F.sum("total"), F.count_if(F.col("total") > 0)).first())
    end = int(END.astype(np.int64))
    frequent = totals.where("total > 0").orderBy(F.desc(F.col("word") == end), F.desc("total"), "word").limit(FREQUENT).collect()  # FREQUENT rows at most
    frequent.sort(key=lambda r: (-r["total"], r["word"]))
    words = np.array([r["word"] for r in frequent], np.int64)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and numbers of the tokens that aren't frequent, by leaf."""
        sums = np.zeros((2, LEAVES), np.int64)
        for batch in batches:
            w, c = batch.column("word").to_numpy(), batch.column("total").to_numpy()
            keep = (c > 0) & ~np.isin(w, words)
            leaf = _shared_leaf(w[keep].astype(np.uint64))
            sums[0] += np.bincount(leaf, c[keep], LEAVES).astype(np.int64)
            sums[1] += np.bincount(leaf, minlength=LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FREQUENT, LEAVES)), *(pa.array(x[FREQUENT:]) for x in sums)], names=["leaf", "n", "v"])

    held = totals.select("word", "total").mapInArrow(shared, "leaf long, n long, v long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    rest = np.zeros((2, LEAVES - FREQUENT), np.int64)
    for r in held:  # a row for each leaf
        rest[:, r["leaf"] - FREQUENT] = r["n"], r["v"]
    model = Model(words.astype(np.uint64), np.array([r["total"] for r in frequent], np.float64), (rest[0], rest[1]))
    release(spark)
    if n:
        model = _train(made, model)
        release(spark)
    held = spark.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = []
        total = np.zeros(max(right.num_rows, 1), np.int64)
        total[right.column("nth").to_numpy()] = right.column("total").to_numpy()
        for r in left.select(["doc_id", "held_out", "n_tokens", "tokens", "words"]).to_pylist():
            sizes, tokens = np.array(r["n_tokens"], np.int64), _unpack(r["tokens"])
            starts = np.cumsum(sizes) - sizes
            base = np.log10((total + 1.0) / (n + v + 1.0))
            better = log_probability(held.value, np.frombuffer(r["words"], np.uint64), tokens, sizes, total)
            outs.append(
                pa.table(
                    {
                        "doc_id": pa.array(r["doc_id"], pa.int64()),
                        "held_out": pa.array(r["held_out"], pa.bool_()),
                        "n_tokens": pa.array(sizes),
                        "n_known": pa.array(np.add.reduceat((total > 0)[tokens].astype(np.int64), starts)),
                        "train_tokens": pa.array(np.full(len(sizes), n)),
                        "base_score": pa.array(np.add.reduceat(base[tokens], starts)),
                        "score": pa.array(np.add.reduceat(better, starts)),
                    }
                )
            )
        return pa.concat_tables(outs)

    known = entries.join(totals, "word").select("block", "nth", "total")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.select("block", "doc_id", "held_out", "n_tokens", "tokens", "words").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)
