import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine import runtime
from papyrine.operators import chunking, corpus, evaluation, generation, reader, retrieval


def brute_windows(n, size, overlap):
    step, out, at = size - overlap, [], 0
    while n and True:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            break
        at += step
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 6, 9, 10, 11, 40])
def test_sliding_windows_equal_brute_force(spark, n):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)), "x")], "doc_id long, text string, chunk_index string")
    got = [(r.start_word, r.end_word) for r in chunking.sliding(docs.select("doc_id", "text"), size=6, overlap=2).orderBy("chunk_index").collect()]
    assert got == brute_windows(n, 6, 2)


def test_sliding_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n ")], "doc_id long, text string")
    assert chunking.sliding(docs).count() == 0 and chunking.paragraphs(docs).count() == 0
    with pytest.raises(ValueError):
        chunking.sliding(docs, size=5, overlap=5)


def test_paragraph_packing(spark):
    text = "a b c\nd e\nFact 1 x y\nf g h i j k l m\nn o"
    got = chunking.paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=5, overlap=1).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["a b c d e", "Fact 1 x y", "f g h i j", "j k l m", "n o"]
    assert [(r.start_word, r.end_word) for r in got] == [(0, 5), (5, 9), (9, 14), (13, 17), (17, 19)]


def test_rejected_chunks_take_no_index_and_a_document_keeps_one(spark):
    docs = spark.createDataFrame([(1, "bad words here\ngood words here now"), (2, "bad only")], "doc_id long, text string")
    got = chunking.paragraphs(docs, size=4, overlap=1, useful=F.col("text").contains("good")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.chunk_index, r.text) for r in got] == [(1, 0, "good words here now"), (2, 0, "bad only")]


def test_tfidf_equals_brute_force(spark):
    texts = {"c1": "red blue red", "c2": "blue green", "c3": "green green yellow"}
    index = retrieval.tfidf(spark.createDataFrame(list(texts.items()), "chunk_id string, text string")).collect()

    def terms(t):
        w = t.split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    df = {}
    for t in texts.values():
        for x in set(terms(t)):
            df[x] = df.get(x, 0) + 1
    for c, t in texts.items():
        raw = {x: (1 + math.log(terms(t).count(x))) * (math.log(4 / (1 + df[x])) + 1) for x in set(terms(t))}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        got = {r.term: r.weight for r in index if r.chunk_id == c}
        assert got == pytest.approx({x: v / norm for x, v in raw.items()})


def test_dense_search_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[10] = v[11]  # a tie
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    got = retrieval.dense_search(vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), vectors, 5, query_block=2, passage_block=70)
    found = {(r.qid, r.rank): r.vec_id for r in got.collect()}
    scores = np.round(v.astype(float) @ v.astype(float).T, 6)
    for q in range(0, 300, 50):
        best = sorted(range(300), key=lambda i: (-scores[q, i], -i))[:5]
        assert [found[q, k + 1] for k in range(5)] == best


def test_unit_and_mean_vectors(spark):
    vectors = spark.createDataFrame([(0, [3.0, 4.0]), (0, [0.0, 0.0]), (1, [0.0, 0.0])], "label int, embedding array<float>")
    assert sorted(r[0] for r in vectors.select(retrieval.unit("embedding")).collect()) == [[0.0, 0.0], [0.0, 0.0], [0.6, 0.8]]
    assert {r.label: r.embedding for r in retrieval.mean_pool(vectors, "label").collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0]}


def test_answers_by_strategy(spark):
    questions = spark.createDataFrame([(1, "What is the admission score for History?"), (2, "Who chairs the Board?"), (3, "zz?")], "qid int, question string")
    retrieved = spark.createDataFrame(
        [(1, 1, 0.9, "Question: What is the admission score for History? Answer: 22.5 points."), (1, 2, 0.1, "The score was 20.1 points."), (2, 1, 0.3, "The meeting was led by Professor Mai Lan of Arts.")],
        "qid int, rank int, score double, text string",
    )
    got = {r.qid: (r.answer, r.strategy) for r in reader.answers(questions, retrieved).collect()}
    assert got[1] == ("22.5 points", "fact") and got[2][1] == "name" and "Mai Lan" in got[2][0] and got[3] == ("Unknown", "none")


def test_best_spans_respect_order_and_length(spark):
    logits = spark.createDataFrame([(1, [0.0, 5.0, 1.0], [9.0, 0.0, 2.0])], "qid int, start_logits array<double>, end_logits array<double>")
    assert [(r.start, r.end, r.score) for r in reader.best_spans(logits).collect()] == [(0, 0, 9.0)]
    assert [(r.start, r.end) for r in reader.best_spans(logits, keep=1).collect()] == []


def test_agreement_and_alignment(spark):
    a = spark.createDataFrame([("1", "q", "1,200", None), ("2", "q", "x y", None), ("3", "q", None, None)], "id string, question string, annotator_answer string, notes string")
    b = spark.createDataFrame([("1", "q", "1200", "n"), ("2", "p", "x z", None), ("4", "q", "w", None)], "id string, question string, annotator_answer string, notes string")
    rows = evaluation.aligned(a, b)
    r = evaluation.agreement(rows).first()
    assert (r.item_count, r.exact_agreement_count, r.disagreement_count, r.mean_token_f1) == (2, 1, 1, 0.75)
    assert [x.token_f1 for x in evaluation.disagreements(rows).collect()] == ["0.5000"]
    assert tuple(evaluation.alignment(a, b).first()) == (1, 1, 1)
    assert evaluation.agreement(rows.filter("false")).first().item_count == 0


def test_positional_join_checks_counts(spark):
    p, r = spark.createDataFrame([(0, "a")], "line_no int, prediction string"), spark.createDataFrame([(0, "a"), (1, "b")], "line_no int, references string")
    with pytest.raises(ValueError):
        evaluation.by_position(p, r)


def test_candidates_first_wins_and_split(spark):
    s = spark.createDataFrame([(1, "In 2020 the Old Town gave 30 credits and 30 credits on 5 May 2020.")], "k int, sentence string")
    got = [(r.answer_type, r.answer) for r in generation.candidates(s).orderBy("place").collect()]
    assert got == [("date", "5 May 2020"), ("credits", "30 credits"), ("year", "2020"), ("entity", "Old Town")]
    placed = spark.range(1, 13).withColumnRenamed("id", "place")
    split = {r.place: r.split for r in generation.interleaved_split(placed, 5, 2).collect()}
    assert [k for k in sorted(split) if split[k] == "test"] == [3, 6] and [k for k in sorted(split) if split[k] == "train"] == [1, 2, 4, 5, 7]


def test_permutation_is_the_twisters():
    import random

    rng = random.Random(42)
    want = []
    for n in (6, 4):
        x = list(range(n))
        rng.shuffle(x)
        want.append(x)
    assert generation.permutation([6, 4]) == want


def test_generation_round_trip(spark):
    chunks = spark.createDataFrame([("c1", "text one"), ("c2", "text two")], "chunk_id string, text string")
    asked = generation.prompts(generation.batches(chunks, 1, key="chunk_id"), ("rule",))
    assert {r.error for r in generation.generate(asked, None).collect()} == {"no client"}

    def client(prompt):
        import json

        chunk = json.loads(prompt)["chunks"][0]["chunk_id"]
        if chunk == "c2":
            raise OSError("down")
        return '```json\n{"items":[{"chunk_id":"c1","question":"What is said in one?","answer":"one","evidence":"e"},{"chunk_id":"zz","question":"What is said in one?","answer":"one","evidence":"e"}]}\n```'

    replies = generation.generate(asked, client)
    assert [tuple(r) for r in generation.items_of(replies, chunks).collect()] == [("c1", "What is said in one?", "one", "e")]
    assert sorted(r.error for r in replies.collect() if r.error) == ["down"]


def test_ordinals_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = corpus.with_ordinal(rows, "k").collect()
    assert all(r.ordinal == r.k + 1 for r in got) and len(got) == 1000


def test_first_wins_and_clean_documents(spark):
    text = "Short line here now ok\nCookie notice of this page here\nshort line here now ok\nFact 1. a\nFact 1. a"
    got = corpus.clean_documents(spark.createDataFrame([(1, "T", text), (2, None, None), (3, "T", "")], "doc_id long, title string, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Short line here now ok\nFact 1. a\nFact 1. a", 2: None, 3: ""}


def test_crawl_levels(spark):
    pages = spark.createDataFrame([("https://a.example/", "<a href='/x'>x</a><a href='/y#z'>y</a>"), ("https://a.example/x", "<script>var t='</p>'</script><a href='/y'>y</a><a href='/z'>z</a>")], "url string, html string")
    got = corpus.crawl(pages.limit(1).select("url"), pages, rounds=5)
    assert {r.url.split("example")[1]: r.depth for r in got.collect()} == {"/": 0, "/x": 1, "/y": 1, "/z": 2}


def test_sized_join_salts_beyond_the_limit(spark, monkeypatch):
    left = spark.range(1000).select("id", F.floor(F.col("id") % 3 / 2).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    small = sorted(tuple(r) for r in runtime.sized_join(left, right, ["k"]).select("id", "v").collect())
    large = sorted(tuple(r) for r in runtime.sized_join(left, right, ["k"], limit=0).select("id", "v").collect())
    assert small == large and len(small) == 1000
    wide = right.withColumn("v", F.array(F.repeat("v", 1_000), F.lit(None).cast("string"))).withColumn("n", F.lit(None).cast("array<int>"))
    assert wide.agg(F.sum(runtime.bytes_of(wide))).first()[0] > 2_000
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 1_000)
    plan = runtime.sized_join(left, wide, ["k"])._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan and runtime.sized_join(left, wide, ["k"]).count() == 1000
