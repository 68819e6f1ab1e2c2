from pyspark.sql import functions as F

from palimpsest.plans import texts


def test_whole_texts_are_compared(spark, tmp_path, monkeypatch):
    text = "word " * 60 + "until 2019-03-04"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    none = F.array().cast("array<string>")
    monkeypatch.setattr(texts.texts, "date_verdict", lambda old, new: F.struct(F.col(old).alias("verdict"), none.alias("removed"), none.alias("added")))
    assert texts.deferral_detector(spark, str(tmp_path)).first().verdict == text + " applies from 2024-01-02"
