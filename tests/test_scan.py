"""The scanning search against the joined one, and its parts against plain loops."""

import collections
import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.operators import reader, retrieval, scan

ODD = ["Điểm chuẩn ngành Công nghệ", "Diém chu ẩn a.b_c - x- -9", "KELVIN Kİ Straße", "a\x00b\x85c d", "", None, "§", "ab  ab ab", "Điểm chuẩn ngành Công nghệ"]


def test_counter_has_the_terms_of_the_column_function(spark):
    made = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select("i", T.terms(F.col("text")).alias("t")).collect()
    terms, doc, at, tf = scan.Counter().counts(ODD)
    want = sorted(n for r in made for n in collections.Counter(r.t or ()).values())
    assert sorted(tf) == want
    assert [int((doc == r.i).sum()) for r in made] == [len(set(r.t or ())) for r in made]
    assert len(terms) == len({t for r in made for t in r.t or ()}) == len(set(terms[at]))


def test_best_keeps_ties_by_the_greater_key():
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 9, (5, 400)) / 8
    scores[4] = 0
    scores[4, 3] = 1e-9
    keys = np.array([f"k{i:03d}" for i in rng.permutation(400)], object)
    best = scan.Best(5, 6, 0.0)
    for begin in range(0, 400, 37):
        best.add(0, scores[:3, begin : begin + 37], keys[begin : begin + 37])
        best.add(3, scores[3:, begin : begin + 37], keys[begin : begin + 37])
    q, key, score = best.settle()
    for i in range(5):
        want = sorted(((round(s, 6), k) for s, k in zip(scores[i], keys, strict=True) if s > 0), reverse=True)[:6]
        assert list(zip(score[q == i], key[q == i], strict=True)) == want


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(30)]
    texts = [(f"c{i:03d}", " ".join(rng.choice(words, 6))) for i in range(150)] + [(f"o{i}", t) for i, t in enumerate(ODD)] + [(None, "word1 word2 word3 word9")]
    asked = [("q1", "word1 word2 word3"), ("q2", "§ §"), ("q3", "word9 unknown"), ("q4", "điểm chuẩn"), ("q5", None)]
    return spark.createDataFrame(asked, "qid string, text string"), spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)


def rows(found):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in found.collect())


def test_search_passages_equals_search_by_postings(tables):
    queries, passages = tables
    want = rows(retrieval.search(queries, retrieval.tfidf(passages), 8))
    assert len(want) == 35 and rows(retrieval.search_passages(queries, passages, 8)) == want
    twice = passages.unionByName(passages.filter("chunk_id < 'c010'"))  # keys in several rows: their texts count together
    assert rows(retrieval.search_passages(queries, twice, 8)) == rows(retrieval.search(queries, retrieval.tfidf(twice), 8))


def test_search_moves_no_postings(tables):
    queries, passages = tables
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        scan.search(queries, retrieval.stored(passages), 8).explain()
    assert "MapInArrow" in said.getvalue() and "Exchange" not in said.getvalue()


def test_hybrid_passages_equals_hybrid_search(spark, tables):
    queries, passages = tables

    def vector(text):
        return [float((text or "").count(c)) for c in "abcdefor"]

    asked = spark.createDataFrame([(r.qid, r.text, vector(r.text)) for r in queries.collect()], "qid string, text string, embedding array<double>")
    stored = spark.createDataFrame([(r.chunk_id, r.text, vector(r.text)) for r in passages.collect()], "chunk_id string, text string, embedding array<double>").repartition(3)
    want = rows(retrieval.hybrid_search(asked, stored, retrieval.tfidf(passages), 170))
    assert len({p for _, _, p, _ in want if p}) == 150 + len(ODD)  # passages without terms too
    key = lambda r: (r[0], r[2] or "")
    got = sorted(((q, 0, p, s) for q, _, p, s in rows(retrieval.hybrid_passages(asked, stored, 170))), key=key)
    for x, y in zip(got, sorted(((q, 0, p, s) for q, _, p, s in want), key=key), strict=True):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 2e-5


def test_best_sentences_makes_tokens_once(spark):
    questions = spark.createDataFrame([("q", "When did the new library open")], "qid string, question string")
    found = spark.createDataFrame([("q", 1, 0.5, "The library is new. It opened in May.\nMore on the library")], "qid string, rank int, score double, text string")
    best = reader.best_sentences(questions, found)
    assert [(r.place, r.sentence, r.score) for r in best.orderBy("place").collect()] == [(1, "The library is new.", 2.5), (2, "More on the library", 1.5), (3, "It opened in May.", 0.5)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert not any("aggregate(" in line and "regexp_extract_all" in line for line in plan.splitlines())
