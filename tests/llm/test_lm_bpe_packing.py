import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import bpe, lm, packing

from .cases import SCHEMA, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_rows_of_one_id_have_their_own_scores(spark):
    texts = [(1, "a b"), (1, "c c c d"), (1, "a b"), (2, "a b c"), (3, "b"), (None, "a b"), (None, "")]
    got = lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(t.split()) + 1) for i, t in texts)
    assert len({(r.n_tokens, r.score, r.base_score) for r in got if r.doc_id == 1}) == 2


def test_words_that_share_leading_bits_are_told_apart():
    word = np.array([7 << 24 | 1, 9 << 24], dtype=np.uint64)
    frequent = lm.Frequent(word, word >> lm.SHORT, np.array([50, 60]), 110, 2, 1)
    asked = np.array([7 << 24 | 1, 7 << 24 | 2, 9 << 24, 8 << 24], dtype=np.uint64)
    assert frequent.of_word(asked).tolist() == [50, -1, 60, -1] and frequent.of(asked >> lm.SHORT).tolist() == [50, 50, 60, -1]


def test_books_of_many_values():
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=20_000), np.repeat([1.0, 2.0], 5), np.zeros(0)):
        code, book = lm.quantised(values)
        assert len(book) == 256 and (not len(values) or np.abs(book[code] - values).mean() < 0.01)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300), st.lists(st.integers(0, 2**63), max_size=50))
def test_elias_fano(values, others):
    values = np.unique(np.array(values, dtype=np.uint64))
    n, width = lm.EliasFano.encode(values)[0].tolist()
    code = lm.EliasFano(n, width, *lm.EliasFano.encode(values)[1:])
    if len(values):
        assert (code.get(np.arange(len(values))) == values).all()
    asked = np.concatenate((values, np.array(others, dtype=np.uint64)))
    want = [int(np.searchsorted(values, x)) if x in values else -1 for x in asked]
    assert code.find(asked).tolist() == want


def corpus():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "W1 w1")]


@pytest.mark.parametrize("limits", [{}, {"SHARD": 3000, "PART": 1000, "HOT": 20}, {"SHARD": 2000, "PART": 2000, "HOT": 1}])
def test_scores_equal_brute_force(spark, monkeypatch, limits):
    """Also over many shards, with few words frequent, and with one word in every place."""
    for name, value in limits.items():
        monkeypatch.setattr(lm, name, value)
    texts = corpus() + [(600 + i, "the " * 200 + f"w{i}") for i in range(20)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    docs = {i: WORD.findall((t or "").lower()) + ["</s>"] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    single, pairs, n_docs = Counter(), Counter(), 0
    for i, w in docs.items():
        if not held[i]:
            single.update(w)
            pairs.update(zip(["<s>", *w], w, strict=False))
            n_docs += 1
    n, v = sum(single.values()), len(single)
    single["<s>"] = 0
    one = lambda x: math.log10((single[x] + 0.5) / (n + 0.5 * (v + 1)))
    base_held = score_held = 0.0
    for i, w in docs.items():
        r, k = got[i], lm.STRENGTH
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(single[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(map(one, w)), rel_tol=1e-9)
        model = 0.0
        for c, x in zip(["<s>", *w], w, strict=False):
            model += (math.log10(pairs[c, x]) if pairs[c, x] else math.log10(k) + one(x)) - math.log10((n_docs if c == "<s>" else single[c]) + k)
        assert math.isclose(r.score, model, rel_tol=0.01, abs_tol=0.02 * len(w))
        if held[i]:
            base_held, score_held = base_held + r.base_score, score_held + r.score
    assert score_held > 1.2 * base_held  # of the order of the unigram's even where words are drawn at random


@functools.cache
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.Encoder(path, bpe.compile_lexicon(path))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé'st-_ 12.A\n²日", max_size=30), min_size=1, max_size=5))
def test_bpe_equals_the_library(texts):
    exact, encoder = both()
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = exact.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == exact.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="’—“Ελ日本語Жя\u0301İẞﬁ①\x1c\u2028 <|endoftext|>", max_size=40), min_size=1, max_size=4))
def test_bpe_of_all_scripts_equals_the_library(texts):
    exact, encoder = both()
    texts = [t.encode(errors="ignore").decode() for t in texts] + [f"{texts[0].encode(errors='ignore').decode()}<|endoftext|>x <|startoftext|>"]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        want = exact.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == exact.decode(want, skip_special_tokens=False)


def test_long_words_equal_the_library():
    rng = random.Random(1)
    exact, encoder = both()
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (999, 1000, 5000, 60_000)] + ["x" * 50_000, "aab" * 5000, "日本" * 2000]
    for text, (ids, _) in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = {b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [5], b"": [9]}
    words.pop(b"")
    lexicon = bpe.Lexicon(bpe.Lexicon.build(words))
    number = lexicon.numbers([b"tap", b"taps", b"top", b"tops", b"ta", b"x", b"", b"tapss"])
    assert number.tolist() == [0, 1, 2, 3, -1, -1, -1, -1]
    assert [lexicon.ids[lexicon.offset[i] : lexicon.offset[i + 1]].tolist() for i in range(4)] == [[1], [2, 3], [4], [5]]
    assert len(lexicon.final) == 5  # root, t, ta/to, tap/top, end: suffixes are shared


def test_bpe_digest(spark):
    rows = spark.createDataFrame([(1, "Hello, world's end"), (2, None)], "doc_id long, text string")
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.digest(rows).collect()}
    ids = exact.encode("Hello, world's end", add_special_tokens=False).ids
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_pieces_restore_the_ids(spark):
    texts = [(1, "some words here " * 900), (2, ""), (3, None), (4, "a b"), (4, "a b")]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in texts:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        times = sum(x == i for x, _ in texts)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own[::times]]).tolist() == ids
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids) for r in own)
    first = next(r for r in packing.digest(packing.pack(spark.createDataFrame(texts[:1], "doc_id long, text string"))).collect() if r.start == 0)
    assert first.ids_crc32 == zlib.crc32(np.array(exact.encode(texts[0][1], add_special_tokens=False).ids[:2048], "<u4").tobytes())


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in packing.pack(rows).dropDuplicates(["doc_id"]).collect():
        if r.doc_id in (10, 11, 9):
            assert r.doc_tokens == len(exact.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    assert lm.score(rows).count() == rows.count()
    assert bpe.digest(rows).count() == rows.count()
    assert set(rows.columns) <= set(bpe.encode(rows).columns)
    for run in (lm.score, bpe.digest, packing.pack):
        assert run(rows.limit(0)).count() == 0
