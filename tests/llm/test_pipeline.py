"""The pipeline's stages beside plain versions of them."""

import collections

import corpus_pipeline as pipeline
from test_operators import base_spans, classes, shingles

from fluxframe.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit_quality(docs, quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in quality.score_quality(docs, model).filter("predicted = 1").collect()}
    expected = []
    sets = [(d, shingles(rows[d].text)) for d in sorted(kept)]
    expected = {d for (d, s), c in zip(sets, classes(sets)) if not s or c == d}
    for name, stage in pipeline.STAGES:
        place = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(place)
        columns, docs = docs.columns, spark.read.parquet(place)
        if name == "quality":
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} == expected
        if name == "personal_data":
            got = {r.doc_id: r for r in docs.collect()}
            assert set(got) == expected
            for d, r in got.items():
                assert not base_spans(r.text) and r.n_chars == len(r.text)
                assert r.text == rows[d].text or base_spans(rows[d].text)
        if name != "packing":
            assert docs.columns == columns
    lengths = collections.Counter()
    for p in docs.collect():
        lengths[p.doc_id, p.doc_tokens] += p.length
    assert {d for d, _ in lengths} == expected and all(n == total for (_, n), total in lengths.items())


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert len([n for n in entry.queries() if n.startswith("op")]) >= 10
