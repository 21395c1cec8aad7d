"""BPE encoding and decoding with a public vocabulary file, in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round forms the key
``left * size + right`` of every neighbouring pair, finds ranks by binary search
over the sorted pair keys, takes each word's lowest rank, and joins those pairs.
A word leaves when none of its pairs has a rank.  Spark's part is one scan:
documents are independent, nothing is shuffled, and each Python worker keeps a
bounded memory of the words it has met.

Defined results: a null text counts as empty, an empty text has no tokens, and
a text of any length is encoded whole; repeated rows are rows of their own; an
empty table gives an empty result.  Input columns stay; one that is named as a new
column, whatever the case, gives way to it.  Files with another normalizer,
splitter or decoder than described at `SETTINGS` are refused.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lorewalk.llm import blocks
from lorewalk.llm.shared import without

#: White space by Unicode's White_Space property.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters where str.split() and White_Space differ.
_ODD = regex.compile(r"[\x1c-\x1f]")

# The settings that are followed here, as tokenizer files write them.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "decoder": None,
    "splitter": {"type": "Split", "behavior": "Removed", "invert": True},
    "bytes": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False},
    "added": {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False},
}
#: Words that a worker remembers before it starts again.
REMEMBERED = 50_000
#: Words whose symbols are merged together.
TOGETHER = 20_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next of U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in prints else chr(free))
        free += b not in prints
    return out


# Letters and numbers of Unicode 16.0 beyond 15.1, and lower-case forms of 17.0 beyond 15.1 as (first, last, distance).
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LOWER_17 = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_LOWER = {c: c + d for a, b, d in LOWER_17 for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}  # each letter on its own, without the rule of the final sigma
_LOWERED = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")


@cache
def _categories() -> dict[str, str]:
    """Ranges of letters and of numbers, as the tokenizers library has them, and of what the regex module's tables take for other than those, for use in brackets.

    The library's classes are those of Unicode 16.0; unicodedata's are those of 15.1.
    """
    classes = {}
    for name, more in (("L", LETTERS_16), ("N", NUMBERS_16)):
        has = np.fromiter((unicodedata.category(chr(c))[0] == name for c in range(0x110000)), bool, 0x110000)
        for a, b in more:
            has[a : b + 1] = True
        classes[name] = has
    every = "".join(map(chr, range(0x110000)))
    other = np.zeros(0x110000, bool)
    for name, has in classes.items():
        theirs = np.zeros(0x110000, bool)
        theirs[[m.start() for m in regex.finditer(rf"\p{{{name}}}", every)]] = True
        other |= theirs != has
    classes["other"] = other

    def ranges(has: np.ndarray) -> str:
        at = np.flatnonzero(has)
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
        return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)

    return {name: ranges(has) for name, has in classes.items()}


def _follows(found: dict | None, wanted: dict | None) -> bool:
    return found == wanted or (isinstance(found, dict) and isinstance(wanted, dict) and all(found.get(k) == v for k, v in wanted.items()))


class Vocabulary:
    """A BPE model read from the JSON of a public tokenizer file with lower-casing words and a word-end suffix."""

    def __init__(self, described: str):
        d = json.loads(described)
        model = d["model"]
        steps = d["pre_tokenizer"].get("pretokenizers", [])
        held = {"normalizer": d.get("normalizer"), "decoder": d.get("decoder"), "model": model} | dict(zip(("splitter", "bytes"), steps, strict=False))
        wrong = [k for k in ("normalizer", "decoder", "splitter", "bytes", "model") if not _follows(held.get(k), SETTINGS[k])]
        if wrong or len(steps) != 2 or any(not _follows(x, SETTINGS["added"]) for x in d["added_tokens"]):
            raise ValueError(f"settings that are not followed here: {wrong or 'pre_tokenizer or added_tokens'}")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.added = added
        self.text = [""] * (max([*self.ids.values(), *added.values()]) + 1)
        for token, i in [*self.ids.items(), *added.items()]:
            self.text[i] = token
        # \s means White_Space there
        pattern = steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_WHITE}")
        classes = _categories()
        self._pattern = regex.compile(pattern)
        self._exact = regex.compile(pattern.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]))
        self._other = regex.compile(f"[{classes['other']}]") if classes["other"] else None
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        letters = _byte_letters()
        self.inner = np.array([self.ids[x] for x in letters])
        self.final = np.array([self.ids[x + self.suffix] for x in letters])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        joined = np.array([self.ids[a + b] for a, b in pairs])
        left, right = np.array([self.ids[a] for a, _ in pairs]), np.array([self.ids[b] for _, b in pairs])
        self.size = np.int64(len(self.text))
        keys = left * self.size + right
        keys, rank = np.unique(keys, return_index=True)  # of equal pairs the first counts
        self.keys, self.ranks = keys, rank
        self.joined = joined
        # A rank is plain if no pair with the symbol it makes ranks lower: then all its places in a word can be joined in one round.
        least = np.full(len(self.text), len(pairs), np.int64)
        np.minimum.at(least, left, np.arange(len(pairs)))
        np.minimum.at(least, right, np.arange(len(pairs)))
        self.plain = least[joined] > np.arange(len(pairs))

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        other = self._other is not None and not text.isascii() and self._other.search(text)
        return (self._exact if other else self._pattern).findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        counts = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts)
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), counts)
        none = len(self.ranks)
        rank = np.full(len(symbols), none)  # of the pair that begins here
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[ends - 1] = none
        done_symbols, done_words = [], []
        while len(symbols):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[begin, len(word)])
            low = np.minimum.reduceat(rank, begin)
            over = low == none
            if over.any():
                out = np.repeat(over, size)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                keep = ~out
                symbols, word, rank, low, size = symbols[keep], word[keep], rank[keep], low[~over], size[~over]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(low, size))
            # In a row of the same symbol every second place joins, from the left.
            close = np.diff(places) == 1
            if close.any():
                nth = np.arange(len(places))
                places = places[(nth - np.maximum.accumulate(np.where(np.r_[True, ~close], nth, 0))) % 2 == 0]
            rough = ~self.plain[rank[places]]
            if rough.any():  # such a word joins its leftmost place alone
                lead = np.r_[True, word[places[1:]] != word[places[:-1]]]
                places = places[lead | ~rough]
            symbols[places] = self.joined[rank[places]]
            stay = np.ones(len(symbols), bool)
            stay[places + 1] = False
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            # Only the pairs on either side of a join are new.
            places = places - np.arange(len(places))
            near = np.concatenate([places, places[places > 0] - 1])
            near = near[near < len(symbols) - 1]
            rank[places] = none
            rank[near] = np.where(word[near] == word[near + 1], self._rank(symbols[near], symbols[near + 1]), none)
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(done_words)
        return np.concatenate(done_symbols)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(raw))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' own text with a space between; ids of added tokens stay."""
        return " ".join(map(self.text.__getitem__, ids))


class Coder:
    """Encodes texts; remembers the pieces between white space that it has met, what they decode to only if it decodes."""

    def __init__(self, vocabulary: Vocabulary, decodes: bool = True):
        self.v, self.decodes = vocabulary, decodes
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.lately: set[str] = set()
        self.numbers = [str(i) for i in range(len(vocabulary.text))]
        self.find = vocabulary.find

    def _normal(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if _LOWERED.search(text):
                text = text.translate(_LOWER)
        text = text.lower()
        return self.v.find(text) if _ODD.search(text) else text.split()

    def split(self, text: str) -> list[str]:
        """Pieces that are encoded on their own; an added token is a piece of its own, marked by a space before it."""
        if self.v.special is None or not self.v.special.search(text):
            return self._normal(text)
        out: list[str] = []
        for k, part in enumerate(self.v.special.split(text)):
            out += [" " + part] if k % 2 else self._normal(part)
        return out

    def learn(self, pieces: list[str]) -> None:
        words: list[list[str]] = [[] if p[0] == " " else self.find(p) for p in pieces]
        distinct = dict.fromkeys(chain.from_iterable(words))
        ids: dict[str, str] = {}
        tokens: dict[str, str] = {}
        for some in batched(distinct, TOGETHER):
            flat, sizes = self.v.merge(some)
            flat = flat.tolist()
            numbers = [self.numbers[i] for i in flat]
            ends = np.cumsum(sizes).tolist()
            ids.update(zip(some, [" ".join(numbers[a:b]) for a, b in zip([0, *ends], ends)], strict=True))
            if self.decodes:
                texts = [self.v.text[i] for i in flat]
                tokens.update(zip(some, [" ".join(texts[a:b]) for a, b in zip([0, *ends], ends)], strict=True))
        for p, x in zip(pieces, words, strict=True):
            self.ids[p] = " ".join([ids[w] for w in x]) if x else str(self.v.added[p[1:]])
            if self.decodes:
                self.decoded[p] = " ".join([tokens[w] for w in x]) if x else self.v.decode([self.v.added[p[1:]]])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, list[str]]]:
        """For each text the decimal ids joined by a space, and its pieces."""
        split = [self.split(t) for t in texts]
        wanted = set(chain.from_iterable(split))
        new = wanted - self.ids.keys()
        if len(self.ids) + len(new) > REMEMBERED:  # pieces met lately stay, so frequent ones do
            kept = (self.lately & self.ids.keys()) | (wanted & self.ids.keys())
            self.ids = {p: self.ids[p] for p in kept}
            self.decoded = {p: self.decoded[p] for p in kept if p in self.decoded}
            self.lately = set()
        self.learn(list(new))
        self.lately = wanted if len(self.lately) > REMEMBERED // 3 else self.lately | wanted
        for pieces in split:
            yield " ".join(map(self.ids.__getitem__, pieces)), pieces


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text; it is read once, on the driver, and its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text", ids: str | None = "ids", n_tokens: str | None = "n_tokens", ids_text: str | None = None, decoded: str | None = None) -> DataFrame:
    """Every row of docs with the columns that are named.

    vocabulary: path of the tokenizer file.  ids: the token ids, array<int>.
    n_tokens: how many.  ids_text: the ids in decimal, joined by a space.
    decoded: the text of those ids, decoded again.
    Null text: as empty.  Input columns of the same names are replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))
    new = [(ids, T.ArrayType(T.IntegerType(), False)), (n_tokens, T.LongType()), (ids_text, T.StringType()), (decoded, T.StringType())]
    new = [(n, t) for n, t in new if n]
    kept = without(docs.columns, [n for n, _ in new])
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([f for f in source.schema.fields if f.name in kept] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(held.value), decodes=decoded is not None)
        for batch in batches:
            for part in blocks.pieces(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                out: dict[str, list] = {n: [] for n, _ in new}
                for joined, pieces in coder.encode(texts):
                    if ids:
                        out[ids].append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
                    if n_tokens:
                        out[n_tokens].append(joined.count(" ") + 1 if joined else 0)
                    if ids_text:
                        out[ids_text].append(joined)
                    if decoded:
                        out[decoded].append(" ".join(map(coder.decoded.__getitem__, pieces)))
                arrays = [part.column(c) for c in part.schema.names if c in kept]
                kinds = {ids: pa.list_(pa.int32()), n_tokens: pa.int64(), ids_text: pa.string(), decoded: pa.string()}
                for n, _ in new:
                    if n == ids:
                        places = np.concatenate([[0], np.cumsum([len(x) for x in out[n]])]).astype(np.int32)
                        arrays.append(pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(out[n]))))
                    else:
                        arrays.append(pa.array(out[n], kinds[n]))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(blocks.thrifty(run), schema)


def decode_documents(docs: DataFrame, vocabulary: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row of docs with the text of its ids; null ids give null. An input column named as the new one is replaced."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))
    kept = without(docs.columns, [decoded])
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept] + [T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(held.value)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
