
import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        assert docs.columns == columns if i < 4 else set(columns) < set(docs.columns)
        before = set(ids)
    assert before
    assert pipeline.run(spark, SF).count() == len(before)


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g h", "en", None, 15), (2, "a b c d e f g h", "en", None, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.where("false"), SF).count() == 0
    one = pipeline.one_of_each(spark, docs, SF).select("doc_id").collect()
    assert sorted(str(r[0]) for r in one) == ["1", "2", "None"]


def test_every_operator_is_registered(spark):
    names = entry.queries()
    assert [n for i in range(1, 11) for n in names if n.startswith(f"op{i}_")].__len__() == 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
