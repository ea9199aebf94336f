"""Resampling, alignment of tokenizers and quality rules against brute-force versions, on whole small tables and on edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import alignment, perplexity, queries, resampling
from sievework.llm import textbits as tb
from tests.conftest import DATA
from tests.llm import brute

D = f"{DATA}/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, "one two three", "en"), (5, "One TWO-three", "de"), (6, LONG, "en"), (6, LONG, "en"), (7, LONG + "x", "en"), (None, "one two three", None), (None, None, None),
    (8, "café 你好　x  y  z ▁ q", "zh"), (9, "café 你好　x  y  z   q \x1c r\x85 ﬁ ① \U0001f600 ", "zh"), (10, "<s> <|endoftext|> </s> <unk> <0x41>\x00 it's  I'll\r\n x \n\n  y ", "en"), (11, " ", "en"), (12, "  ", "en"), (13, "tab\there ", "en"),
    (14, " ".join(f"w{i % 30}" for i in range(90)), "en"), (14, " ".join(f"v{i}" for i in range(90)), "en"), (15, "a\nb\na\n \n \nA\na b\na b\r\na b", "en"), (16, "x" * 5_000, "en"),
]
SPEC = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SPEC).withColumns({"n": F.lit(1), "row": F.lit("x"), "score": F.lit(None).cast("double"), "Rank": F.lit(0), "key": F.lit("k"), "cost": F.lit(2)})


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_equals_brute_force(spark, documents):
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    got = rows(queries.op11_importance_resampling(spark, D))
    assert got == sorted(brute.resampled([d[:2] for d in documents], items), key=str)
    assert sum(r[4] is not None for r in got) > 30


@pytest.mark.parametrize("items", [["one two three four", None, "", "one two three four"], []])
def test_resampling_edges(spark, edge, items):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    many = EDGE + [(100 + i % 7, " ".join(f"u{(i % 7) * j}" for j in range(25)), "en") for i in range(40)]
    docs = edge.unionByName(spark.createDataFrame(many[len(EDGE) :], SPEC), allowMissingColumns=True)
    got = rows(resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank"))
    assert got == sorted(brute.resampled([d[:2] for d in many], items), key=str)
    drawn = resampling.drawn_documents(docs, target)
    assert drawn.columns == docs.columns and sorted(map(str, (r.doc_id for r in drawn.collect()))) == sorted(str(g[0]) for g in got if g[4])
    assert rows(resampling.resample(docs.filter("false"), target)) == [] and rows(resampling.drawn_documents(docs.filter("doc_id < 3"), target)) == []


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_runs_are_all_ngrams(length):
    rng = random.Random(length)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 40, 200)]
    for part in tb.parts(pa.array(texts)):
        suffixes = resampling.Suffixes(part, length)
        words = [part.buf[a:b].tobytes() for a, b in zip(part.starts, part.ends, strict=True)]
        text_of = np.repeat(np.arange(part.n), np.diff(part.w))
        for k, at, many, crc in suffixes.runs():
            want = {i: brute.zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1) if text_of[i] == text_of[i + k - 1]}
            assert dict(zip(at.tolist(), np.repeat(crc, many).tolist(), strict=True)) == want
            assert len(crc) == len(set(want.values()))


def paths():
    return alignment.path(alignment.TOKENIZER_A), alignment.path(alignment.TOKENIZER_B)


def test_alignment_equals_brute_force(spark, documents):
    assert rows(queries.op12_tokenizer_alignment(spark, D)) == sorted(brute.aligned([d[:2] for d in documents], *paths()), key=str)


@pytest.mark.parametrize("broadcast,known", [(10**6, 10**6), (0, 10**6), (10**6, 3)])
def test_alignment_edges(spark, edge, monkeypatch, broadcast, known):
    """By broadcast and by a shuffled join alike; a worker that forgets its pieces gives the same."""
    monkeypatch.setattr(alignment, "KNOWN_PIECES", known)
    got = rows(alignment.align(edge, *paths(), broadcast))
    want = sorted(brute.aligned([d[:2] for d in EDGE], *paths()), key=str)
    assert got == want and any(r[1] == 0 for r in want if r[0] == 8) and all(r[1] > 0 for r in want if r[0] in (9, 10, 11, 12))
    assert rows(alignment.align(edge.filter("false"), *paths(), broadcast)) == []


def test_quality_rules_equal_brute_force(spark, documents):
    got = {r[0]: r[1:] for r in rows(queries.op13_quality_rules(spark, D))}
    assert len(got) == len(documents)
    for doc_id, text, _ in documents:
        assert got[doc_id][:6] == brute.plain_rules(text)
        assert not (got[doc_id][6] and got[doc_id][5])


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_costs_equal_brute_force(spark, documents, broadcast):
    some = [d for d in documents if len(d[1] or "") < 1500][:40] + [(10**6 + i, t, lang) for i, (_, t, lang) in enumerate(EDGE) if len(t or "") < 6000]
    df = spark.createDataFrame(some, SPEC)
    for order in (2, 5):
        found = {r.doc_id: r.cost for r in perplexity.scores(df, perplexity.Model(df, order), broadcast).collect()}
        want = brute.kneser_ney([(lang or "", t) for _, t, lang in some], order)
        assert max(abs(found[d] - w) / max(len((t or "").encode()), 1) for (d, t, _), w in zip(some, want, strict=True)) < 0.01


def test_a_model_falls_back_alike(spark, documents):
    """Texts that the model hasn't seen: by arrays and by joins."""
    seen = spark.createDataFrame([d for d in documents if len(d[1] or "") < 1500][:30], SPEC)
    other = spark.createDataFrame([(1, "Qxz 你 the on zzz", "en"), (2, "the", "xx"), (3, None, None), (4, "on the ing er", "de")], SPEC)
    model = perplexity.Model(seen)
    assert rows(perplexity.scores(other, model, 10**7)) == rows(perplexity.scores(other, model, 0).select(*perplexity.scores(other, model, 10**7).columns))


def test_quality_rules_edges(spark, edge):
    got = rows(perplexity.quality_rules(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((d, *brute.plain_rules(t)) for d, t, _ in EDGE), key=str)
    kept = perplexity.kept_documents(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} <= {14}
    assert rows(perplexity.quality_rules(edge.filter("false"))) == [] and perplexity.quality_rules(edge.drop("lang")).count() == len(EDGE)


def test_bands_take_junk_and_leave_prose(spark):
    """Prose of one vocabulary stays; the same words over and over, and characters at random, go by their perplexity alone."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["the", "in", "er", "on", "tion", "re", "st"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(800)]
    prose = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 400]))), "en") for i in range(300)]
    noise = [(1000 + i, " ".join("".join(rng.choice("qxzjkvw0123456789") for _ in range(7)) for _ in range(80)), "en") for i in range(3)]
    easy = [(2000, " ".join("on" * (100 + 7 * i) for i in range(60)), "en")]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(prose + noise + easy, SPEC)).collect()}
    assert all(got[i].kept for i, *_ in prose)
    assert not any(got[i].kept for i, *_ in noise) and all(got[i].perplexity > got[i].high for i, *_ in noise)
    assert not got[2000].kept and not got[2000].base_failed and got[2000].perplexity < got[2000].low


def test_good_documents_stay(spark):
    """Of labelled good documents that pass the plain rules nearly all are kept, of bad ones fewer."""
    at = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = queries.op13_quality_rules(spark, at).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.97 and kept[0] < 0.75
