from pyspark.sql import functions as F

from pagelens.operators import catalogue
from pagelens.sources import captures as source
from pagelens.streaming import pages as streams


def test_detect_stream_and_cache(spark, tmp_path):
    page = source.overlay(spark.range(24).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example.com/"), F.col("id") % 6).alias("url"), F.lit("").alias("html"))).withColumn("at", F.timestamp_seconds("page_id"))
    page.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(page.schema).parquet(str(tmp_path / "in"))
    streams.detect_stream(stream, catalogue.core(spark), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("tech_id = 'wordpress'").count() == 2
    query = streams.once_per_page(stream).writeStream.format("memory").queryName("cached").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("cached").count() == 7  # six paths and the overlay's own URL


def test_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", t) for t in (0, 10, 20, 30, 70)] + [("b", 1)], "key string, s int").select("key", F.timestamp_seconds("s").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streams.limit_stream(stream, 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, r.at.second + 60 * r.at.minute, r.recent, r.limited) for r in spark.table("limited").collect())
    assert got == [("a", 0, 1, False), ("a", 10, 2, False), ("a", 20, 3, False), ("a", 30, 4, True), ("a", 70, 3, False), ("b", 1, 1, False)]
