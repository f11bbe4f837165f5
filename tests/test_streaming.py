import datetime as dt

from lutrin.streaming import ingest


def test_pages_and_counts(spark, tmp_path):
    pages = tmp_path / "in"
    pages.mkdir()
    (pages / "1.htm").write_text('<p class="style96"><span class="style95">le four</span></p>')
    counts = ingest.running_term_counts(ingest.stream_articles(spark, str(pages)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        (pages / "2.htm").write_text('<p class="style96"><span class="style95">le froid</span></p>')
        q.processAllAvailable()
        assert {(r.term, r.n) for r in spark.table("running").collect()} == {("le", 2), ("four", 1), ("froid", 1)}
    finally:
        q.stop()


def test_repeats_and_windows(spark, tmp_path):
    source = str(tmp_path / "rows")
    schema = "article string, titre string, texte string, ingested_at timestamp"
    at = dt.datetime(2020, 1, 1)
    rows = [("1", "a", "x", at), ("1", "a", "x", at + dt.timedelta(days=1)), ("2", None, "x", at + dt.timedelta(days=2))]
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for name, df, mode in (("once", ingest.first_once(stream), "append"), ("windows", ingest.monthly_term_counts(stream), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.article for r in spark.table("once").collect()) == ["1", "2"]
    assert {(r.term, r.n) for r in spark.table("windows").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {("a", 2), ("x", 3)}
