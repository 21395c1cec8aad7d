"""The pipeline against a plain version of its stages on a small table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorewalk.llm import mixing, quality, secrets
from test_operators_llm import ODD, brute_components, brute_counts, brute_targets, kneser_ney, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage makes, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert stages[-1].columns == [*columns, "ids", "n_tokens"]


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    costs = [sum(c) / len(c) if c else None for c in kneser_ney([(d.lang, d.text) for d in docs])]
    good, per = {}, defaultdict(list)
    for d, cost in zip(docs, costs, strict=True):
        n, *_, repeats = brute_counts(d.text)
        good[d.doc_id] = not (n < 10 or 100 * repeats > 20 * n)
        if good[d.doc_id]:
            per[d.lang].append(cost)
    bounds = {}
    for lang, held in per.items():
        held.sort()
        low, middle, high = (held[max(0, math.ceil(q * len(held)) - 1)] for q in quality.QUANTILES)
        bounds[lang] = (middle - max(quality.WIDTH * (middle - low), quality.LEAST_WIDTH[0]), middle + max(quality.WIDTH * (high - middle), quality.LEAST_WIDTH[1]))
    kept, near = {r.doc_id for r in stages[0].collect()}, 0
    for d, cost in zip(docs, costs, strict=True):
        if not good[d.doc_id]:
            assert d.doc_id not in kept
            continue
        root = math.sqrt(sum(brute_counts(d.text)[:2]))
        low, high = bounds[d.lang][0] - quality.SHORT[0] / root, bounds[d.lang][1] + quality.SHORT[1] / root
        if min(abs(cost - low), abs(cost - high)) > 1e-4:
            assert (d.doc_id in kept) == (low <= cost <= high)
        else:
            near += 1
    assert near < 3


def test_dedup_stage(stages):
    before = stages[0].collect()
    lead = brute_components([(d.doc_id, d.text) for d in before], 5, 80)
    assert sorted(map(tuple, stages[1].collect())) == sorted(tuple(d) for d in before if lead[d.doc_id][1] == d.doc_id)


def test_secrets_stage(stages):
    before, after = ({d.doc_id: d for d in s.collect()} for s in stages[1:3])
    assert before.keys() == after.keys()
    for i, d in before.items():
        text, at, out = d.text, 0, ""
        for _, a, b in secrets.find(pa.array([text]))[0]:
            if a > at or not out:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        out += text[at:]
        assert after[i].text == out and after[i].n_chars == (len(out) if out != text else d.n_chars)


def test_mixing_stage(stages):
    """Streams in md5 order, blocks by middles, an md5 order of the blocks in each pass, whole copies up to the quota."""
    before = stages[2].collect()
    size = {d.doc_id: len(words(d.text)) for d in before}
    totals, streams = Counter(), defaultdict(list)
    md5 = lambda *x: hashlib.md5(":".join(map(str, ("mix", *x))).encode()).hexdigest()
    for d in sorted(before, key=lambda d: (md5(d.doc_id), d.doc_id)):
        streams[d.source].append((d.doc_id, totals[d.source]))
        totals[d.source] += size[d.doc_id]
    targets, want = brute_targets(totals), Counter()
    for rank, source in enumerate(sorted(totals, key=lambda s: (s is None, (s or "").encode())), 1):
        quota, block = math.floor(targets[source] + 0.5), max(mixing.LEAST_BLOCK, -(-totals[source] // mixing.MOST_BLOCKS))
        held = defaultdict(list)
        for i, offset in streams[source]:
            if size[i]:
                held[(offset + size[i] // 2) // block].append(i)
        at = 0
        for epoch in range(3):
            for number in sorted(held, key=lambda b: md5(rank, epoch, b)):
                for i in held[number]:
                    want[i] += 2 * (quota - at) >= size[i]
                    at += size[i]
    after = stages[3].collect()
    assert Counter(d.doc_id for d in after) == +want
    texts = {d.doc_id: d.text for d in before}
    assert all(d.text == texts[d.doc_id] for d in after)


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, ties, columns that clash in name, and an empty table."""
    clash = ["secrets", "Secrets_", "nth", "q__n_words", "low", "band_lang", "row", "part", "IDS", "N_Tokens"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    rows = [(*r, *["mine"] * len(clash)) for r in [*ODD, (11, "a text of ten words or more with password=abcdefgh1 inside it", "en", "a", 9)] * 2]
    for k, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, schema)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if name != "encode":
                assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / f"{k}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{n}"))
            held = docs.collect()
            assert all(r[c] == "mine" for r in held for c in clash if c in docs.columns)
            if name == "redact_secrets":
                assert all("[SECRET]" in r.text for r in held if r.doc_id == 11)
        assert [c for c in docs.columns if c.lower() in ("ids", "n_tokens")] == ["ids", "n_tokens"] and (table or held == [])


def test_encoding_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stages[4].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages[3].collect())
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)


def test_run_gives_the_last_stage(spark, stages):
    a = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())
    assert a == sorted((r.doc_id, r.n_tokens) for r in stages[-1].select("doc_id", "n_tokens").collect())


def test_clean_texts_stay_as_they_are(stages):
    changed = stages[1].alias("a").join(stages[2].alias("b"), "doc_id").where(F.col("a.text") != F.col("b.text")).select("b.text").collect()
    assert all(re.search(r"\[SECRET\]", r.text) for r in changed)
