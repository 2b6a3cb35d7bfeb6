"""Tables landed for the streaming queries."""

from marketloom.registry import streams


def test_landed_files_grow_with_the_table(spark, folder, monkeypatch):
    """A table of any size used to be landed by three tasks."""
    at = folder("tables")
    spark.range(20_000).selectExpr("id", "md5(string(id)) AS text").repartition(2).write.parquet(f"{at}/notes.parquet")
    whole = {r.id for r in spark.read.parquet(f"{at}/notes.parquet").collect()}
    for size, most in ((1 << 30, 3), (64 << 10, 100)):
        monkeypatch.setattr(streams, "LANDED_BYTES", size)
        stream = streams._stream(spark, at, "notes")
        out = folder(f"out-{size}")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(f"c-{size}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 2
        assert {r.id for r in spark.read.parquet(out).collect()} == whole
        files = streams._files(spark.read.parquet(f"{at}/notes.parquet"))
        assert files == 3 if most == 3 else 3 < files < most


def test_an_empty_table_lands(spark, folder):
    at = folder("tables")
    spark.range(0).write.parquet(f"{at}/notes.parquet")
    assert streams._files(spark.read.parquet(f"{at}/notes.parquet")) == 3
