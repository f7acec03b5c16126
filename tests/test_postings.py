"""The block index against scoring every chunk."""

import random

import pytest

from evidentia.operators import lexical, postings

CHUNK, ASKED = "chunk_id long, text string, lang string, report string", "query_id long, query string, lang string"


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    common, rare = [f"w{a}{b}" for a in "abcdef" for b in "abcde"], ["rare" + chr(97 + i) * 3 for i in range(20)]
    rows = []
    for i in range(n):
        words = rng.choices(common, weights=[1 / (j + 1) for j in range(30)], k=rng.randrange(1, 60))
        if rng.random() < 0.03:
            words += [rng.choice(rare)] * rng.randrange(1, 4)
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), f"r{i % 7}"))
    rows += [(n, None, "en", "x"), (n + 1, "", "en", "x"), (n + 2, rows[0][1], rows[0][2], "x"), (n + 3, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, CHUNK), rows


def questions(spark, rows):
    asked = ["raraa wab", "rareaaa rarebbb waa", "rareccc", "waa", "waa wab wac wad wae wba", "nothing known", rows[0][1], rows[5][1], "rareddd rareddd wed"]
    return spark.createDataFrame([(i, q, ["en", "de"][i % 2]) for i, q in enumerate(asked)], ASKED)


def shown(hits):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in hits.collect())


@pytest.mark.parametrize("by", [(), ("lang",)])
@pytest.mark.parametrize(("k", "block"), [(5, 16), (1, 128), (40, 50)])
def test_hits_equal_those_of_all_chunks(spark, tmp_path, monkeypatch, by, k, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    chunks, rows = corpus(spark, 800)
    asked = questions(spark, rows)
    index = postings.build(chunks, f"{tmp_path}/index", by)
    hits, report = postings.search(spark, index, asked, k)
    assert shown(hits) == shown(lexical.bm25(chunks, asked, k, by=list(by)))
    for r in report.collect():
        assert r.read <= r.held <= r.blocks


def test_rare_words_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    chunks, rows = corpus(spark)
    index = postings.build(chunks, f"{tmp_path}/index")
    _, report = postings.search(spark, index, questions(spark, rows))
    share = {r.query_id: r.read / r.blocks for r in report.collect()}
    assert share[2] < 0.2 and share[8] < 0.2  # rare words, alone or beside one in half of the chunks
    assert share[1] < 0.3


def test_odd_input(spark, tmp_path):
    chunks, rows = corpus(spark, 20)
    index = postings.build(chunks, f"{tmp_path}/index")
    with pytest.raises(ValueError, match="blank"):
        postings.search(spark, index, spark.createDataFrame([(1, " ")], "query_id long, query string"))
    with pytest.raises(ValueError):
        postings.search(spark, index, questions(spark, rows), 0)
    with pytest.raises(ValueError):
        postings.build(chunks, f"{tmp_path}/index", k1=0)
    assert postings.search(spark, index, spark.createDataFrame([(1, "unknown")], "query_id long, query string"))[0].collect() == []
    empty = postings.build(chunks.limit(0), f"{tmp_path}/empty")
    assert postings.search(spark, empty, questions(spark, rows))[0].collect() == []
