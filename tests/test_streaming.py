import datetime as dt

from urban_spark import streaming


def test_runs_on_a_stream(spark, tmp_path):
    rows = [("s1", dt.datetime(2024, 1, 1, h, 10 * k), 40.0 + h, 80.0) for h in range(3) for k in range(3)]
    spark.createDataFrame(rows, "station string, ts timestamp, pm2_5 double, pm10 double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, ts timestamp, pm2_5 double, pm10 double").parquet(str(tmp_path / "in"))
    query = streaming.windowed_sums(streaming.with_aqi(stream), "pm2_5").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted((r.start.hour, r.total, r.n) for r in spark.table("sums").collect()) == [(0, 120.0, 3), (1, 123.0, 3), (2, 126.0, 3)]
