"""The whole pipeline: what it keeps, odd rows, and an empty table."""

import corpus_pipeline
from pyspark.sql import functions as F

from sitegauge.llm import secrets


def test_run_keeps_clean_documents_and_handles_odd_rows(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "password: hunter22 for the shed"), (-3, "password: hunter22 for the shed"), (None, "nobody wrote this line")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).withColumn("_text", F.lit("mine")).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r._text for r in out} == {"mine"}
    assert not any("hunter22" in (r.text or "") for r in out)
    ids = {r.doc_id for r in out}
    assert ids <= {*(r.doc_id for r in docs.collect()), -1, -2, -3, None} and not {-1, -2} <= ids
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_redact_leaves_other_columns_alone(spark):
    rows = [(1, "password: hunter22 x", "mine", "own"), (2, None, "a", "b"), (3, "", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _candidates string")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert (out[1].text, out[1]._text, out[1]._candidates) == ("[SECRET] x", "mine", "own")
    assert out[2].text is None and out[3].text == "" and (out[2]._text, out[3]._candidates) == ("a", "d")
