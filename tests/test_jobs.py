"""The jobs: reruns, growing input, replaced documents, a run that is cut short, the command line."""

import json
import os
import subprocess
import sys
from collections import Counter

import pytest

from evidentia.operators import lexical
from jobs import chunk_corpus, term_index

DOCS = "doc_id long, text string, lang string, source string, extra int"
PAGE = "Licensed under terms {0}.\nPage {0} says one thing. It says another thing, and more of it.\nFooter of all pages\n"


def page_rows():
    rows = [(i, PAGE.format(i) * (1 + i % 7), "en", f"report{i % 3}", 1) for i in range(60)]
    return [*rows, (100, None, "en", "report0", 1), (101, "", "en", "blank", 1), (None, "no number", "en", "report1", 1), (102, "no document", "en", None, 1)]


def chunk_rows(spark, output):
    return sorted(tuple(r) for r in chunk_corpus.corpus(spark, output).collect())


@pytest.mark.parametrize("strategy", ["baseline", "structured"])
def test_corpus_is_the_same_after_every_run(spark, tmp_path, strategy):
    spark.createDataFrame(page_rows(), DOCS).write.parquet(f"{tmp_path}/docs")
    settings = chunk_corpus.Settings(f"{tmp_path}/docs", f"{tmp_path}/out", strategy, size=300, overlap=50)
    counts = chunk_corpus.run(spark, settings)
    first = chunk_rows(spark, settings.output)
    assert counts == {"read": 64, "rejected": 2, "documents": 4, "pages": 62, "flagged": counts["flagged"], "chunks": len(first)}
    assert counts["flagged"] >= 2 and len(first) > 20
    assert not any("Footer of all pages" in r[3] for r in first)  # a margin line
    assert {r[0] for r in first} == {"report0", "report1", "report2"}
    assert any(name.startswith("shard=") for name in os.listdir(f"{tmp_path}/out/chunks"))
    for folder in ("quality", "chunks/" + next(n for n in os.listdir(f"{tmp_path}/out/chunks") if n.startswith("shard="))):  # cut short
        os.rename(f"{tmp_path}/out/{folder}", f"{tmp_path}/gone-{folder[:5]}")
    assert chunk_corpus.run(spark, settings) == counts
    assert chunk_rows(spark, settings.output) == first


def test_corpus_follows_its_input(spark, tmp_path):
    settings = chunk_corpus.Settings(f"{tmp_path}/docs", f"{tmp_path}/out")
    rows = spark.createDataFrame(page_rows(), DOCS)
    rows.write.parquet(settings.documents)
    chunk_corpus.run(spark, settings)
    rows.filter("source = 'report2'").write.mode("overwrite").parquet(settings.documents)
    chunk_corpus.run(spark, settings)
    assert {r[0] for r in chunk_rows(spark, settings.output)} == {"report2"}  # nothing stays of what is gone
    rows.filter("source = 'report2'").union(rows.filter("doc_id = 2")).write.mode("overwrite").parquet(settings.documents)
    with pytest.raises(ValueError, match="repeat"):
        chunk_corpus.run(spark, settings)
    assert {r[0] for r in chunk_rows(spark, settings.output)} == {"report2"}  # and nothing was written
    rows.limit(0).write.mode("overwrite").parquet(settings.documents)
    assert chunk_corpus.run(spark, settings)["chunks"] == 0
    assert chunk_rows(spark, settings.output) == []
    with pytest.raises(ValueError):
        chunk_corpus.Settings("a", "b", "no such strategy")


def plain_terms(documents):
    """documents: the last state, doc_id -> (lang, text)."""
    df, cf, n, total = Counter(), Counter(), Counter(), Counter()
    for lang, text in documents.values():
        tokens = lexical.tokens_of(text)
        n[lang] += 1
        total[lang] += len(tokens)
        cf.update((lang, t) for t in tokens)
        df.update((lang, t) for t in set(tokens))
    return sorted((lang, t, df[lang, t], cf[lang, t], n[lang], total[lang]) for lang, t in cf)


def found_terms(spark, output):
    return sorted(tuple(r) for r in term_index.terms(spark, output).select("lang", "token", "df", "cf", "n_docs", "total_tokens").collect())


def arrive(spark, rows, folder, name):
    """One more file in the folder."""
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{folder}-made-{name}")
    part = next(f for f in os.listdir(f"{folder}-made-{name}") if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-made-{name}/{part}", f"{folder}/{name}.parquet")


def test_index_grows_with_its_input(spark, tmp_path):
    copy = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, 1) for r in copy]
    settings = term_index.Settings(f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/checkpoint", files_per_batch=1)
    arrive(spark, rows[:50], settings.documents, "a")
    assert term_index.run(spark, settings)["batches"] == 1
    state = {r[0]: (r[2], r[1]) for r in rows[:50]}
    assert found_terms(spark, settings.output) == plain_terms(state)
    # new documents, some that replace others (another language, no text), one without an id, one twice in a batch
    arrive(spark, rows[50:], settings.documents, "b")
    odd = [(rows[0][0], "entirely new words", "xx", "s", 1), (rows[1][0], None, "en", "s", 1), (None, "not counted", "en", "s", 1), (7000, "short", "en", "s", 1), (7000, "a longer text", None, "s", 1)]
    arrive(spark, odd, settings.documents, "c")
    counts = term_index.run(spark, settings)
    state |= {r[0]: (r[2], r[1]) for r in rows[50:]} | {rows[0][0]: ("xx", "entirely new words"), rows[1][0]: ("en", ""), 7000: ("", "a longer text")}
    assert counts["batches"] == 2 and counts["documents"] == len(state)
    assert found_terms(spark, settings.output) == plain_terms(state)
    # the same document again, back to its first text; then nothing new
    arrive(spark, rows[:1], settings.documents, "d")
    term_index.run(spark, settings)
    state[rows[0][0]] = (rows[0][2], rows[0][1])
    after = found_terms(spark, settings.output)
    assert after == plain_terms(state)
    assert term_index.run(spark, settings)["batches"] == 0
    assert found_terms(spark, settings.output) == after


def test_index_survives_a_run_that_is_cut_short(spark, tmp_path, monkeypatch):
    settings = term_index.Settings(f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    arrive(spark, [(1, "one two two", "en", "s", 1), (2, "two three", "en", "s", 1)], settings.documents, "a")
    term_index.run(spark, settings)
    arrive(spark, [(2, "four", "en", "s", 1), (3, "two", "en", "s", 1)], settings.documents, "b")
    true = term_index.statistics
    monkeypatch.setattr(term_index, "statistics", lambda *a: (_ for _ in ()).throw(OSError("cut")))  # after the index, before the deltas
    with pytest.raises(Exception, match="cut"):
        term_index.run(spark, settings)
    monkeypatch.setattr(term_index, "statistics", true)
    want = plain_terms({1: ("en", "one two two"), 2: ("en", "four"), 3: ("en", "two")})
    monkeypatch.setattr(term_index, "total", lambda *a: (_ for _ in ()).throw(OSError("cut")))  # after the deltas, before the totals
    with pytest.raises(OSError, match="cut"):
        term_index.run(spark, settings)
    monkeypatch.undo()
    term_index.run(spark, settings)
    assert found_terms(spark, settings.output) == want


def test_index_without_input(spark, tmp_path):
    settings = term_index.Settings(f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    os.makedirs(settings.documents)
    assert term_index.run(spark, settings) == {"batches": 0, "terms": 0, "documents": 0}
    with pytest.raises(ValueError):
        term_index.Settings("a", "b", "c", files_per_batch=0)


def test_command_line(spark, tmp_path):
    spark.createDataFrame(page_rows()[:9], DOCS).write.parquet(f"{tmp_path}/docs")
    (tmp_path / "own.json").write_text(json.dumps({"documents": f"{tmp_path}/docs", "output": "nowhere", "size": 400}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.chunk_corpus", "--config", f"{tmp_path}/own.json", "--output", f"{tmp_path}/out"], env=env, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote 9 pages" in done.stderr
    assert len(chunk_rows(spark, f"{tmp_path}/out")) > 0
