import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import neardup, suffix
from evidentia.llm.common import Workspace, word_hash
from evidentia.llm.components import components

from .cases import SCHEMA, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_components(texts, k, percent=80):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for copy in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"e{group}x{copy}x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["Short one", "short ONE", "", None, "lone"] + texts[:5]
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    texts = near_texts()
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, k).collect()}
    want = brute_components(texts, k)
    assert got == want
    assert {r.doc_id for r in neardup.keep_one(rows, k).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 2)
    texts = near_texts()
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 4).collect()} == brute_components(texts, 4)


def saved_tables(monkeypatch):
    names, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    return names


def test_few_pairs_left_are_tested_at_once(spark, monkeypatch):
    names, texts = saved_tables(monkeypatch), near_texts()
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 4).collect()} == brute_components(texts, 4)
    assert [x for x in names if x.startswith("hubs")] == ["hubs0"] and "all1" in names


@pytest.mark.parametrize("large", [2, 32])
def test_rounds_of_hubs_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "AT_ONCE", -1)
    names, texts = saved_tables(monkeypatch), near_texts()
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 4).collect()} == brute_components(texts, 4)
    assert "hubs1" in names and not [x for x in names if x.startswith("all")]


def test_large_bucket_links_its_reference(spark, monkeypatch):
    mix, bands = np.uint64(0x9E3779B97F4A7C15), neardup.BANDS

    def one_shared_bucket(sketches):
        keys = sketches.sum(axis=1, dtype=np.uint64)[:, None] * mix + np.arange(bands, dtype=np.uint64)
        keys[:, 0] = 7
        return keys

    monkeypatch.setattr(neardup, "band_keys", one_shared_bucket)
    words = lambda name, n: [f"{name}x{j}" for j in range(n)]
    for own in (6, 8, 10):  # Jaccard 0.887, 0.852, 0.818; the highest id is the reference of a bucket without links
        texts = [(i, " ".join(words(f"lone{i}", 100))) for i in range(neardup.LARGE + 8)]
        texts += [(i, " ".join(words("both", 100 - own) + words(f"own{i}", own))) for i in (500, 900)]
        rows = spark.createDataFrame(texts, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 1).collect()}
        assert got == brute_components(texts, 1) and got[900] == (100, 500)


def test_sketch_has_a_value_in_every_bin():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        values = np.unique(rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2))
        sketch = neardup.signature(values)
        assert np.isin(sketch, values).all()


def test_components_of_a_chain(spark):
    work = Workspace(spark, "test")
    edges = work.save(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long"), "edges")
    roots = {r.node: r.root for r in components(edges, work, "cc").collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


def brute_repeats(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + size] for b in raw for s in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(9)
    letters = "abcdefgh é\n"
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, other = fresh(500), fresh(220)
    texts = [fresh(rng.randrange(50, 300)) + passage[rng.randrange(0, 40) : rng.randrange(180, 500)] + fresh(rng.randrange(0, 300)) for _ in range(60)]
    texts += [other, fresh(10) + other, passage, passage, "a" * 500, "abcde" * 70, "ab" * 100, "ab" * 101, "é" * 150, "x" * 199, "x" * 200, "", None, fresh(900)]
    return texts


@pytest.mark.parametrize("most", [256, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST", most)
    texts = repeat_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    weak = lambda x: np.asarray(x, dtype=np.uint64) % np.uint64(5)
    monkeypatch.setattr(suffix, "mix64", weak)
    monkeypatch.setattr(suffix, "MOST", 8)
    texts = repeat_texts() + [x * 3 for x in doubled(512)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def doubled(n):
    """The two complementary strings of a and b that doubling makes, of n letters: polynomials modulo 2**64 give them one hash."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_of_doubling_strings_differ(spark):
    texts = []
    for n in (8, 1024, 4096, 65536):
        texts += [" ".join(f"{w}{i}" for i in range(6)) + f" {w}" for w in doubled(n)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1).collect()}
    assert got == {i: i for i in range(len(texts))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70).filter(lambda b: not set(b) & set(b" \t\n\x0b\x0c\r")), max_size=20))
def test_word_hash_is_one_of_its_bytes(words):
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    got = word_hash(data, start, start + size).tolist()
    alone = [int(word_hash(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert got == alone and len(set(got)) == len(set(words))


def test_suffix_sort_is_the_order_of_the_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, size=400, dtype=np.uint8)
    start = np.arange(300)
    group = np.zeros(300, dtype=np.int64)
    sort = suffix.SuffixSort(data, 64)
    want = sorted(range(300), key=lambda i: (data[i : i + 64].tobytes(), i))
    assert sort.sort(start, group).tolist() == want
    ends = {data[i : i + 64].tobytes() for i in start}
    assert len(ends) == 300 or sort.repeats(start, group).any()


def test_remove_repeats_keeps_columns_and_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    out = suffix.remove_repeats(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    assert {r.doc_id: r.text for r in out.collect()}[4] == "one two three"


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    near = neardup.near_duplicates(rows).collect()
    assert len(near) == rows.count()
    of = {r.doc_id: r.component_id for r in near}
    assert of[5] == 4 and of[7] == 6 and of[13] == 12 and of[1] == 1 and of[2] == 2
    kept = neardup.keep_one(rows)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 8, 9, 10, 11, 12] and kept.filter("doc_id is null").count() == 2
    digest = suffix.digest(rows).collect()
    assert len(digest) == rows.count() and {r.doc_id: r.n_removed for r in digest}[1] == 0
    for run in (neardup.near_duplicates, neardup.keep_one, suffix.digest, suffix.remove_repeats):
        assert run(rows.limit(0)).count() == 0
