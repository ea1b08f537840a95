import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(0)
    syllables = {"en": ["th", "er", "on"], "fr": ["eau", "oi", "é"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang, f"s{i % 3}", 0) for i, lang in enumerate(["en", "fr"] * 40)]
    bench = text("en", 20)
    rows += [(100, rows[4][1], "en", "s0", 0), (101, f"{text('en', 10)} {bench}", "en", "s1", 0), (102, "12345 !!", "en", "s1", 0), (103, None, None, None, None)]
    rows += [(104, f"{text('en', 30)} password=hunter2222", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {r[0] for r in rows}
    assert set(kept["language"]) == every - {102, 103}
    assert set(kept["near_duplicates"]) == every - {100, 102, 103}
    assert set(kept["decontamination"]) == every - {100, 101, 102, 103}
    assert kept["secret_masking"][104].endswith("*" * len("password=hunter2222"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == every - {100, 101, 102, 103}


def test_near_duplicates_by_row_not_by_id(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (7, c), (7, d), (8, d), (None, e), (None, e), (9, f), (None, f), (3, f), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(None, a), (None, b), (7, c), (7, d), (None, e), (3, f), (None, None), (None, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, repeated rows, null texts, very long texts, and columns of the operators' names."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice(["th", "er", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(30), "en", f"s{i % 3}", 0, "kept", "here", 7) for i in range(40)]
    rows += [(None, text(30), "en", None, 0, "a", None, 1), (None, text(30), None, "s1", 0, "b", None, 2), (7, text(30), "en", "s1", 0, "c", "x", 3)]
    rows += [(60, text(60_000), "en", "s1", 0, "long", "x", 3), (61, None, "en", "s1", 0, "null", "x", 3), (62, "", "en", "s1", 0, "empty", "x", 3), (63, "123 !", "en", "s1", 0, "no letter", "x", 3)]
    rows += [rows[3], rows[3]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rejected string, hits string, n_words bigint"
    spark.createDataFrame([(1, text(20)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.materialize(stage(spark, out, str(tmp_path)), name)
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        taken = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
        want = [r for r in rows[:-2] if r[5] not in ("null", "empty", "no letter")] if given is docs else []
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
        assert taken.count() == len(want)
    # given to a later stage, rows without words pass unchanged
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, str(tmp_path)).filter("rejected in ('null', 'empty', 'no letter')").collect()
        assert len(got) == 3, name
