"""Embedding by a model: loaded once a worker, groups by length, checks in the stream."""

import os

import numpy as np
import pytest

from evidentia.operators import vectors


def stub(folder, dimensions=4, scale=1.0):
    """A model that says when it is loaded and how large its groups are."""

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(texts):
            with open(f"{folder}/groups", "a") as f:
                f.write(f"{max(len(t.split()) for t in texts) * len(texts)} {len(texts)}\n")
            out = np.array([[len(t) + 1.0, t.count("a") + 1.0, 1.0, 2.0][:dimensions] for t in texts])
            return scale * out / np.linalg.norm(out, axis=1, keepdims=True)

        return model

    return load


def test_a_worker_loads_its_model_once(spark, tmp_path):
    texts = [(i, "a word " * (i % 50)) for i in range(500)] + [(500, None), (501, "")]
    frame = spark.createDataFrame(texts, "id long, text string").repartition(12)
    embedder = vectors.model_embedder(f"stub-{tmp_path}", 4, stub(tmp_path), budget=300)
    got = {r.id: r.embedding for r in embedder.embed(frame).collect()}
    assert got.pop(500) is None and len(got) == 501
    for i, text in texts:
        if text is not None:
            want = np.array([len(text) + 1.0, text.count("a") + 1.0, 1.0, 2.0])
            assert np.allclose(got[i], want / np.linalg.norm(want))
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 12
    assert all(int(size) <= 300 or int(n) == 1 for size, n in map(str.split, (tmp_path / "groups").read_text().splitlines()))


@pytest.mark.parametrize(("dimensions", "scale", "what"), [(3, 1.0, "3"), (4, 1.1, "unit length"), (4, float("nan"), "unit length")])
def test_what_a_model_must_not_give(spark, tmp_path, dimensions, scale, what):
    embedder = vectors.model_embedder(f"bad-{tmp_path}", 4, stub(tmp_path, dimensions, scale))
    with pytest.raises(Exception, match=what):
        embedder.embed(spark.createDataFrame([("text",)], "text string")).collect()


def test_groups_by_length():
    assert vectors.runs_of(np.array([], dtype=np.int64), 10) == []
    sizes = np.array([9, 1, 1, 30, 2, 5])
    groups = vectors.runs_of(sizes, 10)
    assert sorted(i for g in groups for i in g.tolist()) == list(range(6))
    assert all(len(g) == 1 or sizes[g].max() * len(g) <= 10 for g in groups)
