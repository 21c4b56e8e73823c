"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
from helixframe.llm import neardup, packing, toxicity
from helixframe.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = after.count()
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, SF, "labels"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.passages(docs, model).collect()}
            assert {r["doc_id"] for r in after.collect()} == {i for i, s in scores.items() if s < 0.7}
        if name == "near_duplicates":
            heads = {r["class_id"] for r in neardup.classes(docs).collect()}
            assert {r["doc_id"] for r in after.collect()} == heads
        if name == "secrets":
            assert after.count() == docs.count() and after.where("text rlike 'AKIA[0-9A-Z]{16}'").count() == 0
        if name == "packing":
            assert after.count() == packing.pack(docs).count()
        else:
            assert after.columns == columns
        docs = after
    assert list(rows) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and rows["near_duplicates"] <= rows["toxicity"]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, empty and long texts, clashing columns; then no row at all."""
    text = " ".join(f"word{i % 700}" for i in range(9000))
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, None, None), (3, "", "b"), (None, "a text without id", "b"), (None, None, None), (4, text, "a"), (5, text + " end", "c")]
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, 0.5) for i, t, s in rows]
    odd = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, label int, size double")
    for k, docs in enumerate((odd, odd.where("1 = 0"))):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
            assert name == "packing" or docs.columns == columns
            if name == "near_duplicates" and k == 0:
                kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in docs.collect())
                assert kept == [(False, 1, False), (False, 2, True), (False, 3, False), (False, 4, False), (True, 0, False), (True, 0, True)]
        assert (docs.count() > 0) == (k == 0)
