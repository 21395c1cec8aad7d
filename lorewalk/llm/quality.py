"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity in a band of its language.

The model is modified Kneser-Ney over bytes, a model per language with discounts of
its own.  A text counts as its words with one space after each; the ORDER - 1 bytes
before an event reach over the space into the word before, so the order of words
counts.  Executors count n-grams, Spark adds the counts up and derives
continuation counts, discounts and backed-off probabilities by joins and
aggregations.  The result is a table of hashes and logs; a hash is a bijection of
the n-gram's own bytes and a 24-bit code of its language, so no n-gram is lost or
taken for another.

Looking up: a table of MOST_HELD rows at most is broadcast as sorted hash arrays.
A larger one stays a table: documents are dealt to blocks by a hash, a block asks
for its distinct n-grams by a join and is scored with the sorted hash arrays of
its own answers.  Both ways give the same numbers.

A document's log perplexity is the mean over its events.  Each language has a lower
and an upper bound: the median less or plus WIDTH times the distance to the
quartiles over all its documents that pass the plain rules (LEAST_WIDTH at least),
wider for short texts by SHORT over the root of the number of events, as code points.  What lies
outside goes.

Defined results: null text has no words and fails the plain rules; null
language counts as a language of its own; repeated rows are documents of their
own; an empty table gives an empty result; texts of any length count whole.
Input columns named as new ones (whatever the case) are replaced where a function
says so; keep_good picks names that no input column has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewalk.llm import blocks
from lorewalk.llm.shared import cut, fresh, release, without

ORDER = 5
#: Bytes of text worked on together.
TOGETHER = 1 << 20
#: A worker sends on its counts when it holds so many n-grams.
HELD = 1 << 20
#: Rows of a model that is broadcast (12 bytes each); a larger one is joined.
MOST_HELD = 4 << 20
#: Bytes of text in a block when the model is joined.
BLOCK = 8 << 20
#: A band's width in distances from the median to the quartiles; at least so much below and above the median; and what a text of one event has more there, in log perplexity.
WIDTH, LEAST_WIDTH, SHORT = 2.5, (0.05, 0.06), (3.0, 1.5)
QUANTILES = (0.25, 0.5, 0.75)

LEAST_WORDS, MOST_REPEATED = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MODEL = "n int, hash long, value float"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_PAD = 0x20


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def _again(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def rule_counts(words: blocks.Words) -> dict[str, np.ndarray]:
    """The plain counts of each text."""
    n = len(words.offsets) - 1
    data, number = words.data, np.diff(words.first)
    points = blocks.code_points(data)
    out = {"n_words": number, "word_chars": _per_text(points[words.ends] - points[words.starts], words.first), "n_symbols": _per_text(_SYMBOL[data], words.offsets)}

    breaks = np.flatnonzero(data == 10)
    inner = words.offsets[1:-1]
    starts = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([inner, breaks, words.offsets[-1:]]))
    solid = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[solid], ends[solid]
    owner = np.searchsorted(words.offsets, starts, "right") - 1
    lines, example = np.unique(blocks.mix(blocks.spans_hash(data, starts, ends) ^ blocks.mix(owner.astype(np.uint64), 5)), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[example], minlength=n)

    size = 5
    windows, first = words.shingles(size)
    held = np.diff(first)
    owner = np.repeat(np.arange(n), held)
    whole = np.repeat(number >= size, held)
    place = np.arange(len(windows)) + np.repeat(words.first[:-1] - first[:-1], held)
    windows, owner, place = windows[whole], owner[whole], place[whole]
    at = place[_again(windows ^ blocks.mix(owner.astype(np.uint64), 7))]
    step = np.bincount(at, minlength=len(words) + size + 1) - np.bincount(at + size, minlength=len(words) + size + 1)
    out["n_repeat_words"] = _per_text((np.cumsum(step) > 0)[: len(words)].astype(np.int64), words.first)
    return out


def language_codes(languages: pa.Array) -> np.ndarray:
    """A 24-bit code of each language name."""
    data, offsets = blocks.buffers(languages.cast(pa.string()))
    whole = data.tobytes()
    missing = languages.is_null().to_pylist()
    seen: dict[bytes, int] = {}
    out = np.empty(len(offsets) - 1, np.uint64)
    for k in range(len(out)):
        name = b"-" if missing[k] else b"." + whole[offsets[k] : offsets[k + 1]]
        if name not in seen:
            seen[name] = int(blocks.spans_hash(np.frombuffer(name, np.uint8), np.zeros(1, np.int64), np.array([len(name)]))[0]) >> 40
        out[k] = seen[name]
    return out


def _events(words: blocks.Words, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each event, and each text's range of events.

    An n-gram is the language's code, then ORDER bytes, the last of them the event.
    """
    lengths = words.ends - words.starts
    text = words.text
    pad = ORDER - 1
    stream = np.full(int(lengths.sum()) + len(lengths) + pad * len(codes), _PAD, np.uint8)
    inside = np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    place = np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)) + pad * (text + 1), lengths)
    stream[place] = words.data[inside]
    wide = stream.astype(np.uint64)
    keys = wide.copy()
    for back in range(1, ORDER):
        keys[back:] |= wide[:-back] << np.uint64(8 * back)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[words.first]
    number = np.diff(first)
    at = np.arange(first[-1]) + np.repeat(pad * (np.arange(len(codes)) + 1), number)
    return keys[at] | np.repeat(codes << np.uint64(8 * ORDER), number), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_keys: list[np.ndarray] = []
    held_counts: list[np.ndarray] = []
    held = 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        where, keys = pd.factorize(np.concatenate(held_keys))
        return keys, np.bincount(where, np.concatenate(held_counts), len(keys)).astype(np.int64)

    for batch in batches:
        for part in blocks.pieces(batch, "text", TOGETHER):
            words = blocks.Words(part.column("text"))
            if not len(words):
                continue
            where, keys = pd.factorize(_events(words, language_codes(part.column("lang")))[0])
            held_keys.append(keys)
            held_counts.append(np.bincount(where, minlength=len(keys)))
            held += len(keys)
            if held > HELD:
                keys, counts = together()
                held_keys, held_counts, held = [keys], [counts], len(keys)
                if held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "c"])
                    held_keys, held_counts, held = [], [], 0
    if held_keys:
        keys, counts = together()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "c"])


def _shortened(keys: np.ndarray, n: int) -> np.ndarray:
    """N-grams of the last n bytes, the language before them."""
    return ((keys >> np.uint64(8 * ORDER)) << np.uint64(8 * n)) | (keys & np.uint64((1 << (8 * n)) - 1))


def _asked(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What looking n-grams up may ask for: numbers n (n-grams) and -n (their contexts) with distinct hashes."""
    for n in range(ORDER, 0, -1):
        short = pd.unique(_shortened(keys, n))
        yield n, blocks.mix(short, n)
        yield -n, blocks.mix(pd.unique(short >> np.uint64(8)), n)


class Model:
    """Sorted hash arrays: log probabilities of n-grams under n, logs of back-off weights of their contexts under -n."""

    def __init__(self, n: np.ndarray, hashes: np.ndarray, values: np.ndarray):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in [*range(1, ORDER + 1), *range(-ORDER, 0)]:
            mine = np.flatnonzero(n == k)
            h = hashes[mine]
            order = np.argsort(h)
            self.tables[k] = (h[order], values[mine[order]].astype(np.float32))

    @staticmethod
    def of(table: pa.Table) -> Model:
        n, hashes, values = (table.column(c).to_numpy() for c in ("n", "hash", "value"))
        return Model(n, hashes.astype(np.uint64), values)

    def _find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which were found, by binary search."""
        known, values = self.tables[n]
        if not len(known):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        h = blocks.mix(keys, abs(n))
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(known, h[order]), len(known) - 1)
        return values[at], known[at] == h

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logs of each n-gram's event after its context."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            short = _shortened(keys[left], n)
            value, found = self._find(n, short)
            out[left[found]] += value[found]
            left, short = left[~found], short[~found]
            if not len(left):
                return out
            weight, found = self._find(-n, short >> np.uint64(8))
            out[left[found]] += weight[found]
        out[left] -= np.log(257.0)
        return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n").to_numpy(zero_copy_only=False)
        keys = b.column("key").to_numpy(zero_copy_only=False).astype(np.uint64)
        for k in np.unique(n):
            keys[n == k] = blocks.mix(keys[n == k], abs(int(k)))
        yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(keys.astype(np.int64)), b.column("value")], names=["n", "hash", "value"])


def train(docs: DataFrame) -> DataFrame:
    """The model of docs' columns lang and text, counted over all rows: n, hash and value, a row for each n-gram (n > 0) and each context (n < 0)."""
    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(blocks.thrifty(_count), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << (8 * n)) - 1))
    language = lambda n: F.shiftrightunsigned("key", 8 * n)
    grams = {ORDER: cut(counted)}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: of how many longer n-grams it is the end
        short = F.shiftleft(language(n + 1), 8 * n).bitwiseOR(low(n))
        grams[n] = cut(grams[n + 1].select(short.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")))
    context = F.shiftrightunsigned("key", 8)
    shorter: DataFrame | None = None
    out: DataFrame | None = None
    for n in range(1, ORDER + 1):
        g = grams[n].withColumns({"language": language(n), "context": context})
        # Chen and Goodman's three discounts, from a language's numbers of n-grams that occur once, twice, three and four times.
        of = g.groupBy("language").agg(*[F.greatest(F.lit(1), F.count_if(F.col("c") == k)).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        raw = {1: 1 - 2 * y * F.col("n2") / F.col("n1"), 2: 2 - 3 * y * F.col("n3") / F.col("n2"), 3: 3 - 4 * y * F.col("n4") / F.col("n3")}
        of = of.select("language", *[F.least(F.greatest(x, F.lit(0.1)), F.lit(0.95 * k)).alias(f"d{k}") for k, x in raw.items()])
        g = g.join(of, "language").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        totals = g.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = g.select("key", "c", "context", "d").join(totals, "context")
        own = (F.col("c") - F.col("d")) / F.col("total")
        if shorter is None:
            p = own + F.col("gamma") / 257
        else:
            inner = F.shiftleft(language(n), 8 * (n - 1)).bitwiseOR(low(n - 1))
            rows = rows.withColumn("short", inner).join(shorter.select(F.col("key").alias("short"), F.col("p").alias("less")), "short")
            p = own + F.col("gamma") * F.col("less")
        shorter = cut(rows.select("key", "context", p.alias("p"), "gamma"))
        both = shorter.select(F.lit(n).alias("n"), "key", F.ln("p").cast("float").alias("value")).unionByName(
            shorter.groupBy("context").agg(F.first("gamma").alias("gamma")).select(F.lit(-n).alias("n"), F.col("context").alias("key"), F.ln("gamma").cast("float").alias("value"))
        )
        out = both if out is None else out.unionByName(both)
    whole = cut(out.mapInArrow(_hashed, _MODEL))
    release(docs.sparkSession)
    return whole


def held(model: DataFrame, most: int = MOST_HELD) -> Broadcast | None:
    """The model, broadcast, if its table has `most` rows at most."""
    return model.sparkSession.sparkContext.broadcast(Model.of(model.toArrow())) if model.count() <= most else None


def measure(docs: DataFrame, model: DataFrame, *, keep_text: bool = True, prefix: str = "", sent: Broadcast | None = None) -> DataFrame:
    """Every row with the plain counts and log_perplexity (null without words), named with a prefix; input columns of those names, whatever the case, are replaced.

    model: the table of train.  sent: the same, broadcast; without it the table is joined.
    """
    new = [prefix + c for c in (*COUNTS, "log_perplexity")]
    kept = [c for c in without(docs.columns, new) if keep_text or c != "text"]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, "text", "lang"])])
    schema = T.StructType([f for f in source.schema.fields if f.name in kept] + [T.StructField(c, T.LongType()) for c in new[:-1]] + [T.StructField(new[-1], T.DoubleType())])

    def measured(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        words = blocks.Words(part.column("text"))
        counts = rule_counts(words)
        keys, first = _events(words, language_codes(part.column("lang")))
        where, some = pd.factorize(keys)
        number = np.diff(first)
        mean = _per_text(-model.log_probability(some)[where], first) / np.maximum(number, 1)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(mean, mask=number == 0)], names=schema.names)

    if sent is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks.pieces(batch, "text", TOGETHER):
                    yield measured(part, sent.value)

        return source.mapInArrow(blocks.thrifty(run), schema)

    block, = fresh(source.columns, "block")
    n_blocks = source.agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK).alias("n")).first()["n"] or 1
    dealt = source.withColumn(block, F.pmod(F.xxhash64("text", "lang", F.monotonically_increasing_id()), F.lit(n_blocks)))
    dealt = cut(dealt)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.pieces(batch, "text", TOGETHER):
                words = blocks.Words(part.column("text"))
                keys, first = _events(words, language_codes(part.column("lang")))
                owner = np.repeat(part.column(block).to_numpy(zero_copy_only=False), np.diff(first))
                for b in np.unique(owner):
                    for n, hashes in _asked(pd.unique(keys[owner == b])):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), b, np.int64)), pa.array(np.full(len(hashes), n, np.int32)), pa.array(hashes.astype(np.int64))], names=["b", "n", "hash"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        local = Model.of(right)
        parts = [measured(part, local) for batch in left.to_batches() for part in blocks.pieces(batch, "text", TOGETHER)]
        return pa.Table.from_batches(parts, parts[0].schema) if parts else pa.table({n: pa.array([], t) for n, t in zip(schema.names, _arrow_types(left, kept), strict=True)})

    asked = dealt.select("text", "lang", block).mapInArrow(ask, "b long, n int, hash long").distinct()
    answers = asked.join(model, ["n", "hash"])
    return dealt.groupBy(block).cogroup(answers.groupBy("b")).applyInArrow(answer, schema)


def _arrow_types(left: pa.Table, kept: list[str]) -> list[pa.DataType]:
    return [*(left.schema.field(c).type for c in kept), *[pa.int64()] * len(COUNTS), pa.float64()]


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MOST_REPEATED * n)


def bands(measured: DataFrame) -> DataFrame:
    """band_lang, low and high log perplexity; a row for each language."""
    passed = measured.where(~base_failed()).groupBy("lang").agg(F.percentile_approx("log_perplexity", F.array(*map(F.lit, QUANTILES)), F.lit(10000)).alias("q"))
    q = [F.col("q")[k] for k in range(3)]
    below, above = (F.greatest(WIDTH * x, F.lit(least)) for x, least in zip((q[1] - q[0], q[2] - q[1]), LEAST_WIDTH, strict=True))
    return passed.select(F.col("lang").alias("band_lang"), (q[1] - below).alias("low"), (q[1] + above).alias("high"))


def judged(measured: DataFrame, limits: DataFrame, passes: str, prefix: str = "") -> DataFrame:
    """measured with the boolean column passes: the plain rules hold, and the log perplexity is in its language's band.

    A language without a document that passes the plain rules has no band and needs none.
    """
    band, low, high = fresh([*measured.columns, passes], "band_lang", "low", "high")
    limits = limits.select(F.col("band_lang").alias(band), F.col("low").alias(low), F.col("high").alias(high))
    below, above = (x / F.sqrt(F.greatest(F.lit(1), F.col(f"{prefix}n_words") + F.col(f"{prefix}word_chars"))) for x in SHORT)
    both = measured.join(limits, measured["lang"].eqNullSafe(limits[band]), "left")
    inside = F.col(f"{prefix}log_perplexity").between(F.col(low) - below, F.col(high) + above)
    return both.withColumn(passes, ~base_failed(prefix) & F.coalesce(inside, F.lit(False))).drop(band, low, high)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, log_perplexity, base_failed and kept of every document."""
    model = train(docs)
    measured = cut(measure(docs.select("doc_id", "lang", "text"), model, keep_text=False, sent=held(model)))
    return judged(measured, bands(measured), "kept").withColumn("base_failed", base_failed())


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with docs' columns. Texts are read and measured again rather than carried through a table."""
    model = train(docs)
    sent = held(model)
    limits = cut(bands(measure(docs.select("lang", "text"), model, keep_text=False, sent=sent)))
    prefix = "q__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    rows = judged(measure(docs, model, prefix=prefix, sent=sent), limits, f"{prefix}passes", prefix)
    return rows.where(f"{prefix}passes").select(*[f"`{c}`" for c in docs.columns])
