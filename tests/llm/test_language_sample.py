"""Which rows the classifier learns from."""

from rillview.llm import language


def test_copies_do_not_empty_or_fill_the_sample(spark):
    rows = [(f"the thing number {i}", "en") for i in range(50)] + [(t, f"l{k}") for k in range(12) for t in [f"der schon pflicht {k}"] * 400]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), 10)
    assert sorted(sum(model.families.values(), [])) == sorted({k for _, k in rows})
    assert language.fit(spark.createDataFrame(rows[:0], "text string, lang string")).names == []


def test_rows_with_letters_stay_without_a_model(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the thing", None), (2, "12 ...", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()] == [1]
