import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lorewalk.llm import blocks, bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aabcdeé ÉΣσςİıßﬁ́̈ \t\n\x1c\x1f\x85\xa0　'sS'tre0123٣½&&&!!..한글日本😀‍​ǅ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(spark, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "a" * 3000, "&" * 5000, "ab " * 20000, "x<|endoftext|>y <|startoftext|>", "Hello, World's end", None]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "twice", None)] * 2, schema)
    out = bpe.encode_documents(docs, PATH, ids_text="ids_text", decoded="decoded")
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False)
        assert list(r.ids) == want.ids and r.n_tokens == len(want.ids)
        assert r.decoded == library.decode(want.ids, skip_special_tokens=False)
    again = bpe.decode_documents(out.select("doc_id", "ids", "decoded"), PATH, decoded="again").collect()
    assert all(r.decoded == r.again for r in again)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH).collect() == []


def test_a_rank_whose_symbol_has_an_earlier_pair_joins_leftmost_first():
    tokens = ["a", "b", "c", "d"]
    letters = bpe._byte_letters()
    vocab = {x: i for i, x in enumerate(letters)}
    vocab |= {x + "$": 256 + i for i, x in enumerate(letters)}
    for x in ("bc", "abc", "ab", "abca"):
        vocab[x] = len(vocab)
    merges = [["abc", "a"], ["b", "c"], ["a", "bc"]]
    import json

    steps = [bpe.SETTINGS["splitter"] | {"pattern": {"Regex": r"[^\s]+"}}, bpe.SETTINGS["bytes"]]
    d = {"normalizer": bpe.SETTINGS["normalizer"], "decoder": None, "model": bpe.SETTINGS["model"] | {"end_of_word_suffix": "$", "vocab": vocab, "merges": merges}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": steps}}
    v = bpe.Vocabulary(json.dumps(d))
    flat, _ = v.merge(["abcabcd"])
    assert tokens and v.decode(flat) == "abca bc d$"


def test_every_code_point(library):
    """Alone between letters, and before and after others."""
    with open(PATH, encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()))
    points = [c for c in range(0xF0000) if not 0xD800 <= c <= 0xF8FF]
    for s in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b{chr(c)}1 {chr(c)}" for c in points[s : s + 50_000]]
        want = [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids for ids, _ in coder.encode(texts)] == want


def test_other_settings_are_refused():
    import json

    with open(PATH, encoding="utf-8") as f:
        d = json.load(f)
    for change in ({"normalizer": {"type": "NFKC"}}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": d["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(d | change))


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "y")], "doc_id long, text string, N_TOKENS string, Ids string")
    out = bpe.encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"] and out.first().n_tokens == 2


def test_query(spark, library):
    import hashlib

    got = {r.doc_id: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_coder_that_only_encodes_remembers_no_texts_and_gives_memory_back():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    both, ids = bpe.Coder(v), bpe.Coder(v, decodes=False)
    texts = ["The cat sat, e.g. there", "", "x" * 40, "naïve café 12.5"]
    assert [x for x, _ in both.encode(texts)] == [x for x, _ in ids.encode(texts)]
    assert both.decoded and not ids.decoded
    assert list(blocks.thrifty(lambda it: (x + 1 for x in it))(iter([1, 2]))) == [2, 3]
