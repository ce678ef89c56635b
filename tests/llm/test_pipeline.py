"""The pipeline's stages, each on what the one before kept, against brute force on a small input."""

import corpus_pipeline
from grantweave.llm import decontam, jaccard, lang_id, mixing, pii

from .test_operators import SCHEMA, components, rows


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = rows()[4][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:2] for r in d.collect()]
        d = stage(spark, d, str(tmp_path))
        if name != names[-1]:
            assert d.columns == docs.columns
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, d.collect())
    before, after = seen["language_id"]
    judged = {r.doc_id for r in lang_id.documents(docs).where("accepted").collect()}
    assert {r.doc_id for r in after} == judged
    assert {r.doc_id for r in after} >= set(range(24)) and not {80, 81, 82, 84} & {r.doc_id for r in after}
    before, after = seen["near_duplicates"]
    known = components(before)
    assert {r.doc_id for r in after} == {known[t or ""][0] for _, t in before}
    before, after = seen["decontamination"]
    held = {i for i, t in before if decontam.normal(item) in decontam.normal(t)}
    assert {r.doc_id for r in after} == {i for i, _ in before} - held and held
    before, after = seen["personal_data"]
    assert {r.doc_id: r.text for r in after} == {i: pii.redacted(t) for i, t in before}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["source_mixing"]
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "personal_data"))).where("selected").collect()
    assert {(r.doc_id, round(r.sampling_p, 9)) for r in after} == {(r.doc_id, round(r.p, 9)) for r in mixed}
    assert 0 < len(after) < len(before) and {r.doc_id for r in after} <= {i for i, _ in before}
    assert jaccard.SHINGLE == 5 and jaccard.THRESHOLD == 0.8 and mixing.FRACTION == 0.5


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
