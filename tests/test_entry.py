import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_equal_their_sql(spark):
    import duckdb

    folder, names = "/root/testdata/sf0.001", ("compact_chars", "bm25_top5", "margin_lines", "fixed_chunk_quality", "vector_top5_filtered", "rrf", "answer_case")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in names:
        frame = entry.queries()[name](spark, folder)
        cols = sorted(frame.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
        found = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr), name
