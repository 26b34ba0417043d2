"""Queries and operators that must leave no part of their input out."""

import numpy as np
from pyspark.sql import functions as F

from papyrine.operators import retrieval
from papyrine.plans import data_queries


def test_sentences_of_every_source_type(spark):
    text = "The university opened a new library with 1,200 seats in 2020 for all its students and staff."
    docs = spark.createDataFrame([(i, kind, "en", text) for i, kind in enumerate(("web_source_text", "pdf_source_text", None))] + [(3, "web_source_text", "en", None)], "doc_id long, source_type string, source_language string, text string")
    for query in (data_queries.answer_candidates, data_queries.generated_pairs):
        assert {r.doc_id for r in query({"documents": docs}.get).collect()} == {0, 1, 2}
    pairs = data_queries.generated_pairs({"documents": docs}.get).count()
    assert data_queries.capped_pairs({"documents": docs}.get).agg(F.sum("pairs")).first()[0] == pairs


def test_hybrid_search_equals_full_fusion(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(30)]
    texts = [(f"c{i:03d}", " ".join(rng.choice(words, 6)) if i else "§") for i in range(120)]
    asked = [("q1", "word1 word2 word3"), ("q2", "§ §"), ("q3", "word9 unknown")]
    pv, qv = ({k: rng.normal(size=8).round(3).tolist() for k, _ in rows} for rows in (texts, asked))
    passages = spark.createDataFrame(texts, "chunk_id string, text string")
    vectors = spark.createDataFrame(list(pv.items()), "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(k, t, qv[k]) for k, t in asked], "qid string, text string, embedding array<double>")
    index = retrieval.tfidf(passages)
    lexical = {(r.qid, r.chunk_id): r.score for r in retrieval.lexical_scores(queries, index).collect()}
    want = {}
    for q in qv:
        scores = sorted(((round(0.7 * float(np.dot(qv[q], pv[p])) + 0.3 * lexical.get((q, p), 0), 6), p) for p in pv), reverse=True)
        want |= {(q, n): (p, score) for n, (score, p) in enumerate(scores[:12], 1)}
    got = {(r["qid"], r["rank"]): (r.chunk_id, r.score) for r in retrieval.hybrid_search(queries, vectors, index, 12, query_block=2, passage_block=25).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    # the two lists with the dense one cut, as before, aren't the whole fusion
    dense = retrieval.dense_search(queries.drop("text"), vectors, 5, key="chunk_id").select("qid", "chunk_id", "score")
    part = {(r["qid"], r["rank"]): r.chunk_id for r in retrieval.hybrid(dense, retrieval.lexical_scores(queries, index), 12).collect()}
    assert part != {x: p for x, (p, _) in want.items()}


def test_crawl_order_has_no_limit(spark):
    made = spark.range(100_200).select(F.format_string("https://a.example/p%06d", "id").alias("url"), F.format_string("%s", F.lit("a.example")).alias("domain"))
    assert data_queries.crawl_order({"documents": made}.get).count() == 100_201
