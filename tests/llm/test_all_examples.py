"""Trees of personal data learn from all examples."""

from pyspark.sql import functions as F

from humsearch.llm import pii


def test_no_example_is_left_out(spark, monkeypatch):
    seen, kept = {}, pii.keep
    monkeypatch.setattr(pii, "keep", lambda df, tag: seen.setdefault(tag, kept(df, tag)))
    rows = spark.range(30_000).select(F.lit("phone").alias("kind"), F.concat(F.lit("00"), (F.col("id") % 7 + 20).cast("string"), F.lit("-123-4567")).alias("said"), F.when(F.col("id") % 3 == 0, "call ").otherwise("no. ").alias("before"), F.lit("").alias("after"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").alias("draw"))
    model, thresholds = pii.train(rows)
    got = {r["label"]: r["w"] for r in seen["pii-train"].groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert {k: round(v) for k, v in got.items()} == {0.0: 15_000, 1.0: 15_000}
    assert seen["pii-train"].count() < 100 and thresholds["phone"] <= 1
