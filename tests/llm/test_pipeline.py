"""The pipeline, stage by stage, against what its operators say and against planted rows."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    clean = max((r for r in real if "\n" in r.text and "#" not in r.text and r.lang == "en"), key=lambda r: len(r.text) < 3000 and len(set(r.text.split())))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()
    planted = [(9001, "short", "en", "p", 5), (9002, clean.text + " end", "en", "p", 1), (9003, None, None, None, None), (9004, clean.text[::-1] + " " + bench.text, "en", "p", 1)]
    docs = spark.createDataFrame([tuple(r) for r in real] + planted, SCHEMA)
    for name, stage in pipeline.STAGES:
        before = docs
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert sorted(docs.columns) == sorted(before.columns)
        if name == "quality rules":
            assert not ids & {9001, 9003} and clean.doc_id in ids
        if name == "near-duplicates":
            assert 9002 not in ids
        if name == "decontamination":
            assert 9004 not in ids
        if name == "secret scans":
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
            assert docs.where("text RLIKE 'AKIA[A-Z0-9]{16}' OR n_chars <> length(text)").count() == 0
    assert ids == {r.doc_id for r in before.select("doc_id").collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_rows_without_an_id_or_with_the_same(spark):
    """Each row has its own verdict; of repeated rows and near copies one stays."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    text = " ".join(f"alpha{i} beta{i}" for i in range(40))
    other = " ".join(f"gamma{i} delta{i}" for i in range(40))
    stages = dict(pipeline.STAGES)

    def left(name, rows, sf="/root/testdata/sf0.001"):
        out = stages[name](spark, spark.createDataFrame(rows, SCHEMA), sf)
        return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)

    row = lambda doc, t, source="s": (doc, t, "en", source, 1)
    kept = left("decontamination", [row(None, bench), row(None, other), row(5, bench), row(5, other), row(6, None), row(6, None)])
    assert kept == sorted([(None, other, "s"), (5, other, "s"), (6, None, "s"), (6, None, "s")], key=str)
    kept = left("near-duplicates", [row(None, text), row(7, text), row(3, text + " end"), row(3, other), row(9, other, "t"), row(8, None), row(8, None)])
    assert kept == sorted([(3, text + " end", "s"), (3, other, "s"), (8, None, "s")], key=str)
    assert left("near-duplicates", [row(None, text), row(None, text)]) == [(None, text, "s")]
    rows = [tuple(r) for r in real.collect()]
    kept = left("quality rules", [*rows, row(rows[0][0], "few words"), row(None, "few words")])
    assert not [k for k in kept if k[1] == "few words"]
