import datetime as dt

from conftest import rows
from sylvan.engine import Engine
from sylvan.sources.trees import register_extractor
from sylvan.streaming.texts import newest_scan, stream_table

PY = "def add(a, b):\n    return log(a)\n"


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_of_texts(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [("a.py", PY), ("b.go", "package m\nfunc run() { add(1) }\n"), ("c.txt", "x"), (None, PY), ("d.py", None)]
    spark.createDataFrame(data, "file string, text string").write.parquet(src)
    stream = spark.readStream.schema("file string, text string").parquet(src)
    got = run(stream_table(stream, "calls"), "streamed_calls", "append", tmp_path)
    assert rows(got.select("file", "caller", "callee")) == [("a.py", "add", "log"), ("b.go", "run", "add")]


def test_newest_scan(spark, tmp_path):
    src = str(tmp_path / "in")
    t = lambda h, d=1: dt.datetime(2025, 1, d, h)
    spark.createDataFrame([("f", 1, t(3)), ("f", 2, t(5)), ("g", 3, t(1)), ("f", 4, t(1, 2))], "name string, complexity long, at timestamp").write.parquet(src)
    stream = spark.readStream.schema("name string, complexity long, at timestamp").parquet(src)
    got = run(newest_scan(stream, ["name"], "at", "1 hour", ["complexity"]), "newest", "complete", tmp_path)
    assert rows(got.select("name", "complexity")) == [("f", 2), ("f", 4), ("g", 3)]


def test_table_function_and_views(spark):
    register_extractor(spark)
    spark.createDataFrame([("a.py", PY)], "file string, text string").createOrReplaceTempView("sources")
    got = spark.sql("SELECT e.kind, e.s1 FROM sources, LATERAL extract_source('python', file, text) e WHERE e.kind = 'functions'")
    assert rows(got) == [("functions", "add")]
    e = Engine.from_texts(spark, spark.table("sources"), persist=False)
    assert "v_similarities" in e.create_views("v_") and spark.sql("SELECT count(*) FROM v_calls").first()[0] == 1
