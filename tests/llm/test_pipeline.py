from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from paceline.llm import bpe, common, pii
from tests.conftest import SMALL


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]
    docs = common.read_table(spark, SMALL, "documents")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    before = set(seen)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = common.stored(stage(spark, docs, SMALL))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
        if k < 4:
            assert docs.columns == columns
    assert len(before) > 0.5 * len(seen)
    made, own = pii.model(), bpe.tokenizer(bpe.tokenizer_path())
    for r in docs.collect():
        clean = pii.redacted(seen[r.doc_id], pii.find(seen[r.doc_id], made))
        assert bytes(r.token_ids) == own.encode(clean) and r.round_trip and r.n_chars == len(clean)


def test_stages_take_empty_tables(spark):
    docs = common.read_table(spark, SMALL, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Null and empty texts, null and repeated ids, and columns named like those that stages use."""
    docs = common.read_table(spark, SMALL, "documents").limit(60)
    columns = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "A text without an id, long enough to be kept by the stages.", "en", "x", 3), (-1, "", "en", "x", 0), (-1, "", "en", "x", 0), (-2, "x" * 50_000, "fr", None, None)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"key": F.lit(1), "Data": F.lit("d"), "component_id": F.lit(2), "_quality": F.lit(3.0), "_spans": F.lit("s"), "words": F.lit(4)})
    wide = docs.columns
    before = docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = common.stored(stage(spark, docs, SMALL))
        assert 0 < docs.count() <= before
        before = docs.count()
        if k < 4:
            assert set(columns) <= set(docs.columns) <= set(wide)
    assert docs.where("not round_trip").isEmpty()
