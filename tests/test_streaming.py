"""Streams give what the same transformation gives on the table."""

from pyspark.sql import functions as F

from inkwell.streaming import judged as S

SF = "/root/testdata/sf0.001"


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_labels_as_stream(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/ensemble.parquet").select(F.col("judged_at").cast("timestamp").alias("judged_at"), "tp_fp_label", "total_tokens")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), table.schema)
    got = drain(S.windowed_labels(stream), "w", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.windowed_labels(table).collect()))


def test_running_consensus(spark, tmp_path):
    rows = [("u", "TP", "2024-01-01 00:00:00"), ("u", "FP1", "2024-01-01 00:01:00"), ("w", "TP", "2024-01-01 00:02:00"), ("w", "TP", "2024-01-01 00:03:00"), ("w", "FP2", "2024-01-01 00:04:00")]
    v = spark.createDataFrame(rows, "unit_id string, label string, voted_at string").withColumn("voted_at", F.to_timestamp("voted_at"))
    v.coalesce(1).write.parquet(str(tmp_path / "v"))
    got = drain(S.running_consensus(S.file_stream(spark, str(tmp_path / "v"), v.schema)), "c", "update")
    assert {(r.unit_id, r.label, r.votes) for r in got.collect()} == {("u", "FP1", 2), ("w", "TP", 3)}
