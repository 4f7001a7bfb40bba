import corpus_pipeline as C

from rowforge.llm import decontaminate, neardup, packing, quality, secrets

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_acts_on_its_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    steps = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "packing"]
    every = {r.doc_id: tuple(r) for r in docs.collect()}

    good = steps["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.resample(docs, labels).where("kept").collect()}
    got = {r.doc_id: tuple(r) for r in good.collect()}
    assert got == {i: every[i] for i in kept} and 0.7 * len(every) < len(got) < len(every)

    single = steps["near_duplicates"](spark, docs, FOLDER)
    first = {r.doc_id for r in neardup.near_duplicates(docs, 5).where("kept").collect()}
    assert single.columns == docs.columns and {r.doc_id: tuple(r) for r in single.collect()} == {i: every[i] for i in first}
    assert len(first) < len(every)

    clean = steps["benchmark"](spark, docs, FOLDER)
    hits = {r.doc_id for r in decontaminate.find(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert hits and clean.columns == docs.columns and {r.doc_id: tuple(r) for r in clean.collect()} == {i: v for i, v in every.items() if i not in hits}

    safe = {r.doc_id: r for r in steps["secrets"](spark, docs, FOLDER).collect()}
    spans = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    assert len(safe) == len(every)
    for i, r in safe.items():
        assert (r.text == every[i][1]) == (not spans[i]) and r.n_chars == len(r.text)
    assert not any(r.spans for r in secrets.report(spark.createDataFrame(list(safe.values()), docs.schema)).collect())

    packed = steps["packing"](spark, docs, FOLDER)
    assert rows(packed.select("doc_id", "piece", "length")) == rows(packing.tokenize(docs).select("doc_id", "piece", "length"))


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in C.STAGES:
        docs = step(spark, docs, FOLDER)
        if name != "packing":
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    want = rows(docs.select("doc_id", "piece", "start", "length", "ids_crc32"))
    assert rows(C.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32")) == want and want


def test_odd_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _key long, kept string"
    data = [(None, None, None, None, None, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (2, "the same words as before in here", "en", "s", 5, 1, "x"), (2, "the same words as before in here", "en", "s", 5, 1, "x"), (3, "w " * 30_000, "en", "s", 9, 1, "x")]
    for name, part in (("full", data), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(part, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, step in C.STAGES[:-1]:
            out = step(spark, docs, folder)
            assert out.columns == docs.columns
            assert out.count() == (0 if not part else 4 if stage == "near_duplicates" else 5)
        got = C.run(spark, folder).collect()
        assert {r.doc_id for r in got} == ({None, 1, 2, 3} if part else set())
