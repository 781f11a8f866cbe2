from tallyspark.llm import language_id


def test_every_language_gets_a_model(spark):
    rows = [(i, f"text number {i}", f"l{i % 230:03d}") for i in range(690)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=2)
    assert sorted(model.languages) == [f"l{i:03d}" for i in range(230)]
