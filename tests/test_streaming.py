from pyspark.sql import functions as F

from tessera.streaming.ingest import known_schema, typed_stream, windowed_counts


def test_stream_has_the_inferred_types(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"t":"2024-01-01T00:10:00","k":"x","v":1}\n{"t":"2024-01-01T00:20:00","k":"x","v":2.5}\n')
    schema = known_schema(spark, str(folder))
    assert schema.simpleString() == "struct<k:string,t:string,v:double>"
    (folder / "b.jsonl").write_text('{"t":"2024-01-01T01:10:00","k":"y","v":3}\n{"v":"no number"}\n\n')
    stream = typed_stream(spark, str(folder), schema)
    query = stream.writeStream.format("memory").queryName("typed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("typed").collect()
    assert sorted(r.v for r in rows if r.v is not None) == [1.0, 2.5, 3.0] and [r["_unread"] for r in rows if r["_unread"]] == ['{"v":"no number"}']
    counts = windowed_counts(stream.where("t is not null").withColumn("at", F.to_timestamp("t")), "at", "k")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [("x", 2), ("y", 1)]
