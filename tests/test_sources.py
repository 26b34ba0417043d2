import pytest
from pyspark.sql import functions as F

from papyrine.functions import html
from papyrine.operators import corpus
from papyrine.sources import files
from papyrine.streaming import passages


def test_lines_keep_their_place(spark, tmp_path):
    path = tmp_path / "q.txt"
    path.write_text("one\n\n two \nthree\n")
    assert [(r.line_no, r.value) for r in files.lines(spark, str(path)).orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    assert [r.value for r in files.lines(spark, str(path), blanks=True).orderBy("line_no").collect()] == ["one", "", " two ", "three"]
    assert files.count_lines(spark, str(path)) == 4


def test_strict_csv(spark, tmp_path):
    good, bad = tmp_path / "g.csv", tmp_path / "b.csv"
    good.write_text("﻿question,answer\nq1,a1\n")
    assert [tuple(r) for r in files.strict_csv(spark, str(good), ["question", "answer"]).collect()] == [("q1", "a1")]
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(good), ["question"])
    bad.write_text("question,answer\nq1,\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(bad), ["question", "answer"])
    assert files.strict_csv(spark, str(bad), ["question", "answer"], blanks=True).count() == 1
    bad.write_text("question,answer\nq1,a,b\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(bad), ["question", "answer"])


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (0, "a")], "line_no int, value string")
    files.write_lines(rows, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    found = spark.createDataFrame([(1, 2, 0.5, "c2"), (1, 1, 0.9, "c1")], "qid int, rank int, score double, chunk_id string")
    files.write_traces(found, spark.createDataFrame([(1, "x")], "qid int, answer string"), str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).first()
    assert back.answer == "x" and [r.chunk_id for r in back.retrieved] == ["c1", "c2"]
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert len(files.file_hashes(spark, str(tmp_path / "t")).first().sha256) == 64
    assert files.bar_chart([{"system": "<s>", "em": 50}], ["em"], "system").count("<rect") == 1
    assert spark.range(1).select(files.safe_name(F.lit("https://A.b/c?d"), ".html")).first()[0].startswith("a-b-c-d-")


def test_settings():
    assert files.parse_env("A=1\n# B=2\nC='x'\n", {"A": "0"}) == {"A": "0", "C": "x"}


def test_fetch_makes_rows_of_failures(spark):
    def client(url):
        import gzip

        if url.endswith("down"):
            raise OSError("no route")
        return (404, "text/html", b"") if url.endswith("gone") else (200, "text/html", gzip.compress(b"<p>hi</p>"))

    urls = spark.createDataFrame([("u/ok",), ("u/gone",), ("u/down",)], "url string")
    assert {r.url: r.status for r in files.fetch(urls, client).collect()} == {"u/ok": "ok", "u/gone": "http_404", "u/down": "url_error"}
    assert {r.status for r in files.fetch(urls, None).collect()} == {"skipped"}


def test_load_status(spark):
    page = ("<p>" + "word " * 50 + "</p>").encode()
    rows = [("a", "ok", "text/html", page), ("b", "http_500", None, None), ("c", "ok", None, b"<p>few</p>"), ("d", "ok", None, b"\xff " * 60), ("e", "ok", None, None)]
    fetched = spark.createDataFrame(rows, "url string, status string, content_type string, body binary")
    got = {r.url: r.fetch_status for r in corpus.load_status(fetched).collect()}
    assert got == {"a": "ok", "b": "http_500", "c": "too_short", "d": "decode_error", "e": "error"}
    assert {r.fetch_status for r in corpus.load_status(fetched, fetch=False).collect()} == {"skipped"}


def test_html(spark):
    page = """<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t="</p>x"</script><table><tr><td>1</td><td>2</td></tr></table><p>x<b>y</p></body>"""
    r = spark.range(1).select(html.visible_text(F.lit(page)).alias("t"), html.title(F.lit(page), F.lit("f")).alias("h")).first()
    assert r.t.split("\n") == ["A & B", "1 | 2", "xy"] or [x for x in r.t.split("\n") if x] == ["A & B", "1 | 2", "xy"]
    assert r.h == "A & B"


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "w " * 150, "h1", "d"), (2, "w " * 150, "h1", "d")], "doc_id long, text string, content_sha256 string, domain string").withColumn("ingested_at", F.to_timestamp(F.lit("2025-01-01")))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("chunks", passages.chunks(stream)), ("once", passages.once(stream)), ("arrivals", passages.arrivals(stream))):
        mode = "complete" if name == "arrivals" else "append"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("chunks").count() == 4 and spark.table("once").count() == 1 and spark.table("arrivals").first().documents == 2
