import corpus_pipeline
from tessera.llm import decontaminate, neardup, quality
from tessera.llm.common import table

from .conftest import DATA, frame, needs_data


@needs_data
def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == docs.columns
            after = {r.doc_id: r for r in out.collect()}
            assert set(after) <= set(before)
            if name == "quality_classifier":
                m = quality.train(docs, table(spark, DATA, "labels"))
                assert set(after) == {k for k, t in before.items() if m.score([quality.features((t or "").encode())] @ __import__("numpy").eye(15))[0] >= 0.5}
            if name == "near_dedup":
                assert set(after) == {r.doc_id for r in neardup.groups(docs).collect() if r.kept}
            if name == "decontamination":
                gone = {r.doc_id for r in decontaminate.leaks(docs, table(spark, DATA, "benchmark")).collect()}
                assert set(after) == set(before) - gone
            if name == "secret_scan":
                assert set(after) == set(before) and all(len(r.text) == r.n_chars for r in after.values())
                assert not any("token = \"" in r.text for r in after.values())
            docs = out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
    assert len(corpus_pipeline.STAGES) == 5


@needs_data
def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() > 50


@needs_data
def test_stages_take_empty_and_odd_rows(spark):
    odd = frame(spark, [(1, None), (2, ""), (None, None), (3, "x"), (3, "x")])
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).collect()
