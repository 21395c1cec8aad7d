"""Language ID: a convolutional network over bytes, trained in numpy, applied to every window of a text.

A text's bytes are cut into windows of LENGTH, the last one padded.  Filters of
several widths slide over a window; as the input is one-hot, a filter bank is a
table per offset whose rows are picked by bytes.  The greatest response of each
filter goes through a softmax over the labels.  A document's probabilities are
its windows' means, weighted by their bytes, so all of a text counts.

The network is fitted on a bounded sample: up to PER_LABEL labelled rows of each
label, those with the smallest hashes of id and text among rows of LONGEST bytes at
most, with all their windows.  Prediction is one scan with the network broadcast (FILTERS, WIDTHS and the
number of labels fix its size).

Defined results: `und` with score 0 for null texts, texts without a letter, and
all texts if no row is labelled; null ids count as the empty text for the split;
repeated rows are documents of their own; an empty table gives an empty result.
Input columns stay; text, and those named as new ones, whatever the case, go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewalk.llm import blocks
from lorewalk.llm.shared import without

LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LABEL = 300
#: Bytes of a row's text that the network is fitted on, at most; longer rows are predicted, not learned from.
LONGEST = 1 << 20
EPOCHS, STEP, RATE = 3, 64, 0.01
#: Windows whose responses are computed together; they stay in the CPU's cache.
TOGETHER = 64
_PAD = 0x20


class Network:
    """tables[w][j] has a row of FILTERS weights for each byte at offset j of filters of the w-th width."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [[rng.normal(0, 0.3 / w, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.top = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.top_bias = np.zeros(len(labels), np.float32)

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        tables = self.tables[w]
        n = LENGTH - len(tables) + 1
        out = np.take(tables[0], x[:, :n], axis=0)
        for j in range(1, len(tables)):
            out += np.take(tables[j], x[:, j : j + n], axis=0)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The greatest response of each filter, not below zero."""
        return np.concatenate([np.maximum(self._responses(x, w).max(1) + self.bias[w], 0) for w in range(len(WIDTHS))], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for s in range(0, len(x), TOGETHER):
            out[s : s + TOGETHER] = _softmax(self.pooled(x[s : s + TOGETHER]) @ self.top + self.top_bias)
        return out

    def _parameters(self) -> list[np.ndarray]:
        return [*(t for bank in self.tables for t in bank), *self.bias, self.top, self.top_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Adam over shuffled steps."""
        rng = np.random.default_rng(seed)
        held = self._parameters()
        first, second = ([np.zeros_like(p) for p in held] for _ in range(2))
        turn = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), STEP):
                some = order[s : s + STEP]
                turn += 1
                for k, g in enumerate(self._gradients(x[some], y[some])):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    held[k] -= RATE * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-7)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        places, parts = [], []
        for w in range(len(WIDTHS)):
            r = self._responses(x, w)
            at = r.argmax(1)
            places.append(at)
            parts.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias[w], 0))
        pooled = np.concatenate(parts, axis=1)
        d = _softmax(pooled @ self.top + self.top_bias)
        d[np.arange(len(d)), y] -= 1
        d /= len(d)
        below = (d @ self.top.T) * (pooled > 0)
        tables, bias = [], []
        for w, width in enumerate(WIDTHS):
            g = below[:, w * FILTERS : (w + 1) * FILTERS]
            bias.append(g.sum(0))
            for j in range(width):
                byte = np.take_along_axis(x, places[w] + j, 1).astype(np.int64)
                tables.append(np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32))
        return [*tables, *bias, pooled.T @ d, d.sum(0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts as rows, the number of each text's windows, and the bytes of the text in each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // LENGTH)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    used = np.minimum(np.repeat(lengths, counts) - nth * LENGTH, LENGTH)
    begin = np.repeat(offsets[:-1], counts) + nth * LENGTH
    if len(data) < LENGTH:
        data = np.append(data, np.full(LENGTH, _PAD, np.uint8))
    full = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = full[np.minimum(begin, len(full) - 1)]  # a copy; padded windows are written anew
    for k in np.flatnonzero((used < LENGTH) | (begin >= len(full))):
        out[k, : used[k]] = data[begin[k] : begin[k] + used[k]]
        out[k, used[k] :] = _PAD
    return out, counts, used


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    folded = data | 0x20
    ascii_letters = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122))])
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    beyond = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for k in np.flatnonzero(~out & (beyond[offsets[1:]] > beyond[offsets[:-1]])):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode())
    return out


def train(labelled: DataFrame, *, per_label: int = PER_LABEL) -> Network | None:
    """A network for the rows' lang, fitted to a sample of per_label rows a label; None if no row has a label and a text."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.octet_length("text") <= LONGEST))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    # Twice the rows wanted pass a label's bound on hashes, then the smallest hashes count.
    bounds = rows.groupBy("lang").agg((F.lit(float((1 << 32) * 2 * per_label)) / F.count(F.lit(1)) + 1).alias("bound"))
    some = rows.select("lang", "text", place.alias("place")).join(bounds, "lang").where("place < bound").select("lang", "place", "text")
    picked = some.mapInArrow(_sample, "lang string, place long, piece binary").toPandas().sort_values(["lang", "place"], kind="stable")
    if picked.empty:
        return None
    labels, x, y = sorted(picked["lang"].unique()), [], []
    for label, group in picked.groupby("lang", sort=False):
        keep = group[group["place"].isin(group["place"].drop_duplicates().head(per_label))]
        x += [np.frombuffer(p, np.uint8) for p in keep["piece"]]
        y += [labels.index(label)] * len(keep)
    network = Network(labels)
    network.fit(np.stack(x), np.array(y))
    return network


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each row."""
    for batch in batches:
        for part in blocks.pieces(batch, "text"):
            x, counts, _ = windows(*blocks.buffers(part.column("text")))
            chosen = part.take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
            yield pa.RecordBatch.from_arrays([chosen.column("lang"), chosen.column("place"), pa.array(list(map(bytes, x)), pa.binary())], names=["lang", "place", "piece"])


def predict(docs: DataFrame, network: Network | None, *, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """doc's columns but text, with the predicted label and its probability."""
    held = docs.sparkSession.sparkContext.broadcast(network)
    names = without(docs.columns, ["text", lang_pred, score])
    kept = [f for f in docs.schema.fields if f.name in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{lang_pred} string", f"{score} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for part in blocks.pieces(batch, "text"):
                data, offsets = blocks.buffers(part.column("text"))
                best, sure = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if net is not None:
                    x, counts, used = windows(data, offsets)
                    owner = np.repeat(np.arange(part.num_rows), counts)
                    sums = np.zeros((part.num_rows, len(net.labels)))
                    np.add.at(sums, owner, net.probabilities(x) * used[:, None])
                    sums /= np.maximum(sums.sum(1, keepdims=True), 1e-30)
                    for k in np.flatnonzero(has_letter(data, offsets)):
                        at = int(sums[k].argmax())
                        best[k], sure[k] = net.labels[at], min(1.0, float(sums[k, at]))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(best, pa.string()), pa.array(sure)], names=[*(f.name for f in kept), lang_pred, score])

    return docs.mapInArrow(run, schema)
