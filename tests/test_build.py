"""Building of data sets: exchange with clients, crawls, annotations, files, HTML."""

import json

import pytest
from pyspark.sql import functions as F

from papyrine.functions import classify, html
from papyrine.operators import corpus, generation, reader
from papyrine.sources import files

CHUNKS = "chunk_id string, text string"


def generator():
    def reply_to(prompt):
        """A generator: one pair per passage; passages that say `fail` break the batch, others come back twice."""
        chunks = json.loads(prompt)["chunks"]
        if any("fail" in c["text"] for c in chunks):
            raise ConnectionError("refused")
        item = {"question": "What is said in {}?", "answer": "a word", "evidence": ""}
        return "```json\n" + json.dumps({"items": [item | {"chunk_id": c["chunk_id"], "question": item["question"].format(c["chunk_id"])} for c in chunks + chunks]}) + "\n```"

    return reply_to


def test_generation_stops_at_the_target_and_resumes(spark, tmp_path):
    reply_to = generator()
    chunks = spark.createDataFrame([(f"c{i:02d}", "fail" if i == 3 else "text") for i in range(12)], CHUNKS)
    made = generation.generate_until(chunks, reply_to, str(tmp_path / "w"), target=3, rules=("r",), size=2, wave=2, wait=0)
    assert made.count() == 6  # two waves of two batches, of which the one with c03 failed
    done = {r.chunk_id for r in spark.read.parquet(str(tmp_path / "w/processed")).collect()}
    assert "c02" not in done and "c03" not in done
    again = generation.generate_until(chunks, reply_to, str(tmp_path / "w"), target=99, rules=("r",), size=2, wave=2, wait=0)
    ids = sorted(r.chunk_id for r in again.collect())
    assert len(ids) == len(set(ids)) and "c03" not in ids and {"c00", "c04", "c11"} <= set(ids)
    none = generation.generate_until(chunks, None, str(tmp_path / "n"), target=5, rules=("r",), wait=0)
    assert none.count() == 0
    assert generation.generate_until(chunks.limit(0), reply_to, str(tmp_path / "e"), target=5, rules=("r",)).count() == 0


def test_failures_have_names():
    class Coded(Exception):
        code, body = 429, "slow down"

    assert generation.failure_of(Coded()) == "http_429: slow down" and generation.failure_of(TimeoutError()) == "timeout"
    assert generation.failure_of(OSError("x")) == "x" and generation.failure_of(ValueError("bad")) == "bad"


def test_refine_sends_weak_questions_only(spark):
    rows = spark.createDataFrame([("a", "What is it?", "x", None, "s"), ("b", "How many seats has it?", "y", "e", "s"), (None, "What is it?", "z", None, "s")], "id string, question string, answer string, evidence string, annotation_status string")

    def client(prompt):
        return json.dumps({"items": [{"id": i["id"], "question": "What is the capacity?", "answer": ""} for i in json.loads(prompt)["items"]] + [{"id": "zz", "question": "Q?", "answer": "A"}]})

    got = {r.id: tuple(r)[1:] for r in generation.refine(rows, client, rules=("r",), wait=0).select("id", "question", "answer", "annotation_status").collect()}
    assert got["a"] == ("What is the capacity?", "x", "llm_refined_needs_human_review") and got["b"] == ("How many seats has it?", "y", "s") and got[None][2] == "s"
    same = generation.refine(rows, None, rules=("r",)).select("id", "question").collect()
    assert {r.id: r.question for r in same} == {r.id: r.question for r in rows.collect()}


@pytest.mark.parametrize("n, train, test", [(500, 100, 100), (150, 60, 90), (10, 100, 3), (90, 0, 40), (30, 40, 0), (0, 3, 3)])
def test_interleaved_split_equals_row_by_row(spark, n, train, test):
    want, counts = {}, {"train": 0, "test": 0}
    for place in range(1, min(n, train + test) + 1):
        side = "test" if counts["test"] < test and place % 3 == 0 or counts["train"] >= train else "train"
        counts[side] += 1
        want[place] = side
    placed = spark.range(1, n + 1).withColumnRenamed("id", "place")
    assert {r.place: r.split for r in generation.interleaved_split(placed, train, test).collect()} == want


def test_crawl_keeps_the_order_of_discovery_under_one_limit(spark):
    page = lambda *paths: "".join(f"<a href='{p}'>x</a>" for p in paths)
    pages = spark.createDataFrame([("https://a.example/", page("/z", "/b")), ("https://a.example/b", page("/m", "/z")), ("https://a.example/z", page("/a", "/m", "/skip"))], "url string, html string")
    seeds = pages.limit(1).select("url")
    order = [r.url.split("example")[1] for r in corpus.crawl(seeds, pages, rounds=4).orderBy("place").collect()]
    assert order == ["/", "/b", "/z", "/m", "/a", "/skip"]
    few = corpus.crawl(seeds, pages, rounds=4, most=4, relevant=~F.col("url").contains("skip")).orderBy("place").collect()
    assert [(r.url.split("example")[1], r.depth) for r in few] == [("/", 0), ("/b", 1), ("/z", 1), ("/m", 2)]
    assert corpus.crawl(seeds.limit(0), pages).count() == 0


def test_crawled_documents_are_gated_unique_and_failures_reported(spark):
    order = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "url string, place long")
    text = "admission " * 5
    fetched = spark.createDataFrame([("u0", "ok", text), ("u1", "http_404", None), ("u2", "ok", text), ("u3", "ok", "other words here now " * 2), ("u4", None, None), ("u5", "ok", text + "more")], "url string, status string, text string")
    docs, failures = corpus.crawled_documents(order, fetched, ("admission",), least_words=5)
    assert [(r.id, r.url) for r in docs.orderBy("id").collect()] == [("doc_0000", "u0"), ("doc_0001", "u5")]
    assert {(r.url, r.status) for r in failures.collect()} == {("u1", "http_404"), ("u4", None)}
    forced, _ = corpus.crawled_documents(order, fetched, ("admission",), least_words=5, mandatory=F.col("url") == "u3")
    assert forced.count() == 3


def test_annotations_follow_a_seed(spark):
    pairs = spark.createDataFrame([(f"What is {i}?", f"answer{i}", "u1" if i % 2 else "u2") for i in range(8)] * 2, "question string, answer string, source_url string")
    docs = spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "document_id string, url string")
    chunks = spark.createDataFrame([("d1", "d1_0", 0, "it is answer1"), ("d1", "d1_1", 1, "What is 3? answer3"), ("d2", "d2_0", 0, None)], "document_id string, chunk_id string, chunk_index int, text string")
    got = corpus.annotations(pairs, docs, chunks, split="train").orderBy("id").collect()
    assert [r.id for r in got] == [f"train_{i:04d}" for i in range(16)] and [r.question for r in got] != sorted(r.question for r in got)
    assert {r.chunk_id for r in got if r.answer == "answer3"} == {"d1_1"} and all(r.answers == [r.answer] for r in got)
    again = corpus.annotations(pairs, docs, chunks, split="train").orderBy("id").collect()
    assert [r.question for r in got] == [r.question for r in again]
    test = corpus.annotations(pairs, docs, chunks, split="test", seed=1)
    assert test.filter("source_id IS NULL AND chunk_id IS NULL AND source_url IS NULL").count() == 16
    with pytest.raises(KeyError, match="u2"):
        corpus.with_documents(pairs, docs.filter("url = 'u1'"))
    assert corpus.annotations(pairs.limit(0), docs, chunks, split="train").count() == 0


def test_split_files_snapshots_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("b", "train", "Second\nline?", ["x", "y"], "x; y"), ("a", "train", "First?", None, "z"), ("c", "test", None, [], None)], "id string, split string, question string, answers array<string>, answer string")
    files.write_splits(rows, str(tmp_path / "s"))
    read = lambda name: [r.value for r in spark.read.text(str(tmp_path / "s" / name)).collect()]
    assert read("train/questions.txt") == ["First?", "Second line?"] and read("train/reference_answers.txt") == ["z", "x;y"] and read("test/questions.txt") == [""]
    files.write_json(rows, str(tmp_path / "j"))
    assert '"answer":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    pages = spark.createDataFrame([("https://a.example/x.PDF", None, b"%PDF"), ("https://a.example/y", "application/pdf", b"%"), ("https://a.example/z", None, b"<p>"), ("u", None, None)], "url string, content_type string, body binary")
    files.write_snapshots(pages, str(tmp_path / "raw"))
    names = sorted(r.name.rsplit(".", 1)[1] for r in spark.read.parquet(str(tmp_path / "raw")).collect())
    assert names == ["html", "pdf", "pdf"]


def test_strict_csv_names_the_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"first, one",second\n1,2\n3,4\n5,6,7\n')
    with pytest.raises(ValueError, match="line 4"):
        files.strict_csv(spark, str(tmp_path / "a.csv"), ["first, one", "second"]).collect()
    (tmp_path / "b.csv").write_text('"first, one",second\n1,"2\n3"\n')
    assert files.strict_csv(spark, str(tmp_path / "b.csv"), ["first, one", "second"]).collect()[0][1] == "2\n3"
    with pytest.raises(ValueError, match="line 1"):
        files.strict_csv(spark, str(tmp_path / "b.csv"), ["x"])


def test_bodies_are_read_in_their_charset(spark):
    text = "Đại học: “Trường”"
    cases = [(text.encode("utf-8"), None, text), ("Größe".encode("iso-8859-15"), 'text/html; charset="ISO-8859-15"', "Größe"), ("Кафедра".encode("koi8-r"), "text/html;charset=koi8-r", "Кафедра"), ("café".encode("latin-1"), "text/html; charset=latin-1", "café"), ("“x”".encode("windows-1258"), "text/html; charset=windows-1258", "“x”"), ("ab".encode("utf-16"), "text/html; charset=utf-16", "ab"), (b"a\xffb", "text/html; charset=nonsense", "a�b"), (None, None, None), (b"", "text/html", "")]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(cases)], "i int, body binary, kind string")
    got = {r.i: r.t for r in rows.select("i", html.decoded(F.col("body"), F.col("kind")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(cases)}


def test_text_of_escaped_scripts(spark):
    page = r'<p>Seen</p><script>self.push("\u003cdiv\u003eHidden \u0026amp; shown\u003c/div\u003e")</script><script>var x = "<b>no</b>"</script>'
    rows = spark.createDataFrame([(1, page), (2, "<p>Seen</p>"), (3, None), (4, "")], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", html.page_text(F.col("html")).alias("t")).collect()}
    assert got == {1: "Seen\nHidden & shown", 2: "Seen", 3: "", 4: ""}


def test_all_spans_compete(spark):
    logits = spark.createDataFrame([(1, [0.0] * 40 + [3.0], [0.0] * 40 + [2.0]), (2, [5.0] + [1.0] * 20, [float(i) / 10 for i in range(21)])], "qid int, start_logits array<double>, end_logits array<double>")
    got = {r.qid: (r.start, r.end, r.score) for r in reader.best_spans(logits, longest=4).collect()}
    assert got == {1: (40, 40, 5.0), 2: (0, 3, 5.3)}
    assert {r.qid: r.end for r in reader.best_spans(logits).collect()} == {1: 40, 2: 20}


def test_every_question_is_answered(spark):
    questions = spark.createDataFrame([(1, "Who wrote it?"), (2, "How many points does it take?"), (3, "What is this about?"), (4, "Anything?")], "qid int, question string")
    retrieved = spark.createDataFrame([(1, 1, 0.5, "Question: How many seats are there? Answer: 20 seats."), (2, 1, 0.4, "It takes 22.5 points."), (3, 1, 0.3, "This text is about nothing but itself.")], "qid int, rank int, score double, text string")
    none = spark.createDataFrame([], "qid int, rank int, answer string, raw double")
    got = {r.qid: (r.answer, r.source) for r in reader.reranked(questions, retrieved, none).collect()}
    assert got[1] == ("20 seats", "fallback_fact") and got[2] == ("22.5 points", "score") and got[3][1] == "fallback_sentence" and got[4] == ("Unknown", "fallback_unknown")


def test_nulls_of_the_answer_rules(spark):
    rows = spark.createDataFrame([(None, None), ("", "entity"), ("x", None)], "answer string, kind string")
    got = rows.select(classify.invalid_for_kind(F.col("answer"), F.col("kind")).alias("i"), classify.normalized_for_kind(F.col("answer"), F.col("kind")).alias("n"), classify.action(F.col("answer")).alias("a"), classify.good_sentence(F.col("answer")).alias("g"), generation.answer_unit(F.col("answer"), F.col("kind")).alias("u")).collect()
    assert [r.i for r in got] == [True, True, False] and got[0].a is None and not any(r.g for r in got) and got[0].u == "items"
