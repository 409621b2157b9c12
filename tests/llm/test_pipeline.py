"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline as p
from tickloom.llm import decontaminate, jaccard, pii, sentencepiece
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components

D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(120).cache()
    columns = docs.columns
    one = p.near_duplicate_stage(spark, docs, D)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in components(rows).values()})
    two = p.benchmark_stage(spark, docs, D)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert two.columns == columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in contaminated(rows, items) if not r[5])
    three = p.personal_data_stage(spark, docs, D).collect()
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in three) and len(three) == 120
    four = p.token_stage(spark, docs, D)
    assert four.columns == [*columns, "ids"]
    m = sentencepiece.Model(sentencepiece.read_model())
    assert all(m.decode(r.ids) == r.text for r in four.collect())


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "tokens"]
    out = p.run(spark, D)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "ids"}
    n = out.count()
    assert 0 < n < spark.read.parquet(f"{D}/documents.parquet").count()
    assert jaccard.near_duplicates(out.select("doc_id", "text")).select("component_id").distinct().count() <= n
    assert decontaminate.contamination(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")).count() > n
