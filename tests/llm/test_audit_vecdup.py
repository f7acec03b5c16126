"""Operators 11 and 12 against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import audit, vecdup

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    occ, docs, groups = defaultdict(Counter), defaultdict(Counter), {(g, s) for g, s, _ in rows}
    for lang, source, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        occ[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: E731,B023
        total = {s: sum(occ[lang, s][t] for t in kept) for s in own}
        p = {s: {t: share(occ[lang, s][t], total[s]) for t in kept} for s in own}
        q = {t: share(sum(occ[lang, s][t] for s in own), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if occ[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)}
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")


def found(frame):
    return {tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()}


@pytest.mark.parametrize(("tile", "rows_of_chunk"), [(256, 25_000), (7, 150)])
def test_audit_equals_the_plain_sums_over_light_and_heavy_terms(spark, monkeypatch, tile, rows_of_chunk):
    monkeypatch.setattr(audit, "TILE", tile)
    monkeypatch.setattr(audit, "ROWS", rows_of_chunk)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        source = f"s{int(rng.integers(40))}"
        common = [f"Common{chr(97 + int(x))}" for x in rng.integers(8, size=10)]
        rare = [f"{source}x{chr(97 + int(x))}é" for x in rng.integers(5, size=4)]  # digits part it: the letters are shared by all
        few = ["word" + "abcdefgh"[int(source[1:]) % 8] * 3, "près" + "abcdefghijklmnopqrst"[int(source[1:]) // 2]]
        rows.append((["aa", "bb"][i % 3 == 0], source, " ".join(common + rare + few)))
    got = found(audit.audit(documents(spark, rows)))
    assert got == plain_audit(rows, 30, 50)
    assert any(r[2] == "term" for r in got)


def test_audit_odd_rows(spark):
    rows = [(None, None, None), ("en", "a", ""), ("en", "b", "12 34 ?!"), ("en", "c", "Ab" * 200_000), ("en", None, "x"), ("de", "only", None)]
    rows += [("fr", "u", "Même mot MOT\x00mot")] * 31 + [("fr", "v", None), ("fr", "u", "été")]
    assert found(audit.audit(documents(spark, rows))) == plain_audit(rows, 30, 50)
    assert found(audit.audit(documents(spark, rows[:0]))) == set()


def test_tiles_add_up_for_large_counts():
    rng = np.random.default_rng(1)
    zero = rng.integers(1, 10**9, size=12)
    p = np.where(rng.random((12, 60)) < 0.3, rng.integers(1, 10**9 + 2, size=(12, 60)), zero[:, None])
    has = p != zero[:, None]
    g, t = np.nonzero(has)
    for heavy in (np.zeros(60, bool), np.ones(60, bool), has.sum(0) > 3):
        side = {"zero": zero, "group": g, "term": t, "p": p[g, t], "heavy": heavy[t]}
        light = int((~heavy & has.any(0)).sum())
        got = audit.tile_sums(side, side, False) + light * np.abs(zero[:, None] - zero[None])
        seen = has.any(0)
        assert (got == np.abs(p[:, None, seen] - p[None][:, :, seen]).sum(axis=2)).all()


def plain_links(ids, labels, x, threshold=0.93):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links, root = np.zeros(len(ids), dtype=int), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        near = unit[at] @ unit[at].T >= threshold
        np.fill_diagonal(near, False)
        links[at] = near.sum(axis=1)
        for i, j in zip(*np.nonzero(near), strict=True):
            root[find(at[i])] = find(at[j])
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((int(ids[i]), int(links[i]), int(least[find(i)]), bool(ids[i] == least[find(i)])) for i in range(len(ids)))


def frame_of(spark, ids, labels, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], int(g), 0) for i, v, g in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int, unit int")


@pytest.mark.parametrize(("dim", "n", "groups", "noise", "depth"), [(8, 1500, 20, 0.12, None), (48, 1500, 100, 0.042, 2), (65, 1200, 3, 0.036, None)])
def test_embedding_links_equal_all_pairs(spark, monkeypatch, dim, n, groups, noise, depth):
    """Pairs on both sides of the threshold, chains, copies, one group of a third of all rows, split cells."""
    monkeypatch.setattr(vecdup, "PART", 200)
    monkeypatch.setattr(vecdup, "CELL", 60)
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(groups, dim))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(groups, size=n))
    x = centre[of] + rng.normal(size=(n, dim)) * noise * rng.uniform(0.2, 1.5, size=(n, 1))
    x[::7] = x[(np.arange(n) // 9)[::7]]  # copies
    x[::5] *= 3.5
    labels, ids = rng.integers(2, size=n), rng.permutation(n)
    got = sorted(tuple(r) for r in vecdup.near_duplicates(frame_of(spark, ids, labels, x), depth=depth).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == plain_links(ids, labels, x)
    assert any(r[1] for r in got)


def test_a_tight_group_meets_as_balls(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=64)
    x = x / np.linalg.norm(x) + rng.normal(size=(2000, 64)) * 0.01
    sizes = [len(own) for own, _, _ in vecdup.balls(vecdup.unit_of(x), math.acos(0.93))]
    assert len(sizes) < 20 and sum(sizes) == 2000


def test_codes_estimate_without_bias_and_within_their_bounds():
    rng = np.random.default_rng(2)
    x = vecdup.unit_of(rng.normal(size=(400, 64)))
    y = vecdup.unit_of(0.93 * x + math.sqrt(1 - 0.93**2) * vecdup.unit_of(rng.normal(size=(400, 64))))
    data, query = vecdup.encode(x), vecdup.encode(y)
    gap = np.diag(vecdup.estimates(data, query, 64)) - (x * y).sum(axis=1)
    assert abs(gap.mean()) < 0.01 and gap.std() < 0.06
    data["radius"] = query["radius"] = np.zeros(400)
    may = vecdup.may_link(data, query, 64, math.acos(0.93))
    true = x @ y.T >= 0.93
    assert may[true].all() and may.mean() < 0.1


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1)]
    rows += [(8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [1e300, 1e298], 1), (10, [1e-310, 0.0], 1), (11, [], 1), (12, [1.0], 2), (13, [2.0], 2), (14, [-2.0], 2), (1, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in vecdup.near_duplicates(frame).collect()), key=repr)
    linked = {1: (4, 1), 9: (4, 1), 10: (4, 1), 12: (1, 12), 13: (1, 12)}
    want = [(i, *linked.get(i, (0, i)), i is None or linked.get(i, (0, i))[1] == i) for i, _, _ in rows]
    assert got == sorted(want, key=repr)
    assert vecdup.near_duplicates(frame.limit(0)).collect() == []
    assert len(vecdup.near_duplicates(frame.filter("vec_id = 4")).collect()) == 1
