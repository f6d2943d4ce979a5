"""Streams against batches on the same rows."""

from pyspark.sql import functions as F

from kinmesh.streaming import increments


def test_stream_equals_batch(spark, tmp_path):
    t = spark.createDataFrame([(i, n, f"2010-01-{1 + i:02d} 00:00:00") for i, n in enumerate(["Siemens AG", "Müller GmbH", "Siemens AG"])], "id long, name string, at string").withColumn("at", F.to_timestamp("at"))
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = []
    q = increments.into_batches(increments.cleaned(stream, "name"), lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = increments.cleaned(t, "name").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r["firm_legal_id"] for r in got} == {"AG", "GMBH"}
    q = increments.arrivals(stream, "at", "name").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert spark.table("arrivals").agg(F.sum("n")).first()[0] == 3
