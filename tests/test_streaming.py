from pyspark.sql import functions as F

from discweave.operators import windows as win
from discweave.streaming import twins


def feed(spark, df, path, parts, name, plan):
    """Run a streaming plan over the rows of ``df`` in ``parts`` micro-batches; returns its result."""
    cut = df.withColumn("_part", F.floor(F.col("seq") * parts / (df.agg(F.max("seq")).first()[0] + 1)))
    for k in range(parts):
        cut.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_packets_as_stream_equal_batch(spark, rows, tmp_path):
    data = b"".join((n + 2).to_bytes(2, "big") + bytes([n]) * n for n in (5, 1, 9, 30, 2))
    cut = [(s, i, bytearray(data[a : a + 7])) for s in "ab" for i, a in enumerate(range(0, len(data), 7))]
    df = spark.createDataFrame(cut, "stream string, seq long, payload binary")
    want = rows(twins.reassemble(df))
    assert len(want) == 10
    assert rows(feed(spark, df, str(tmp_path / "p"), 3, "packets", twins.reassemble_stream)) == want


def test_pages_as_stream_equal_batch(spark, rows, tmp_path):
    frames = [("a", i, [float(i // 3 * 10)] * 4) for i in range(9)] + [("b", i, [float(i * 10)] * 4) for i in range(4)]
    df = spark.createDataFrame(frames, "stream string, seq long, frame array<double>")
    want = rows(win.page_segments(df, ["stream"], ["seq"], "frame", 4.0).select("stream", "seq", F.col("page").cast("int")))
    assert rows(feed(spark, df, str(tmp_path / "f"), 2, "pages", lambda s: twins.page_segments_stream(s, 4.0))) == want


def test_sessions(spark, rows):
    df = spark.createDataFrame([("u", 0), ("u", 100), ("u", 900)], "user string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert [r[3] for r in rows(twins.sessions(df, "user", "at", "5 minutes", "1 minute"))] == [2, 1]
