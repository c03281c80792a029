import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import docs, read


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages_take_effect_one_after_another(spark, tiny, tmp_path):
    now = read(spark, tiny, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, tiny).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == now.columns and [t for _, t in after.dtypes] == [t for _, t in now.dtypes]
        before_ids, after_ids = ({r.doc_id for r in x.select("doc_id").collect()} for x in (now, after))
        assert after_ids <= before_ids and len(after_ids) >= 0.5 * len(before_ids), name
        if k < 3:  # what is kept is kept as it was
            assert after.exceptAll(now).count() == 0
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, tiny)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, tiny)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))


def test_stages_stand_odd_and_empty_tables(spark, tiny):
    schema = read(spark, tiny, "documents").columns
    for table in (docs(spark).select(schema), docs(spark, []).select(schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, tiny).collect()
