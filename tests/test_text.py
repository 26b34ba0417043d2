import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import classify, metrics
from papyrine.functions import text as T


def column(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_folds_differ_in_case_and_stroke(spark):
    v = F.col("v")
    got = column(spark, ["Đại học", "Über", "", None, "nghê"], T.ascii_fold(v), T.ascii_fold(v, lower=False), T.ascii_fold(v, stroke=True))
    assert got == [("đai hoc", "Đai hoc", "dai hoc"), ("uber", "Uber", "uber"), ("", "", ""), (None, None, None), ("nghe", "nghe", "nghe")]


def test_accent_map_follows_canonical_decomposition():
    chars, bases = T.accent_map()
    assert len(chars) == len(bases) and len(chars) > 400
    assert all(unicodedata.normalize("NFD", c)[0] == b for c, b in zip(chars, bases, strict=True))


def test_tokens_and_terms(spark):
    got = column(spark, ["What is the Tuition fee?", "", "x", None], T.tokens(F.col("v")), T.terms(F.col("v")))
    assert got[0] == (["tuition", "fee"], ["what", "is", "the", "tuition", "fee", "what is", "is the", "the tuition", "tuition fee"])
    assert got[1] == ([], []) and got[2] == (["x"], []) and got[3] == (None, None)


def test_normalize_text(spark):
    got = column(spark, ["a&amp;b c\n\n\n\n ★ d \n", None, ""], T.normalize_text(F.col("v")))
    assert got == [("a&b c\n\nd",), (None,), ("",)]


def test_clean_page_keeps_first_of_repeated_lines(spark):
    page = "A line that is long enough\nHome\nA line that is long enough\nhttps://x.example/a\n20 in short\nThis site uses cookies here"
    assert column(spark, [page], T.clean_page(F.col("v"), boilerplate=("cookie",))) == [("A line that is long enough\n20 in short",)]


def test_clean_answers(spark):
    got = column(spark, ['  "Answer:  12 points." ', "is: x", None, "x" * 300], T.clean_answer(F.col("v")), T.clean_answer(F.col("v"), prefixes=False))
    assert got[0] == ("12 points", "Answer: 12 points") and got[1] == ("x", "is: x") and got[2] == (None, None) and len(got[3][0]) == 220


def test_sentences(spark):
    assert column(spark, ["One two. Three? four\n- five;", "", None], T.sentences(F.col("v"))) == [(["One two.", "Three?", "four", "five"],), ([],), (None,)]


def test_facts(spark):
    got = column(spark, ["Fact 1. Question: What is it? Answer: A thing, maybe.", "no fact", None], T.fact_question(F.col("v")), T.fact_answer(F.col("v")))
    assert got == [("What is it?", "A thing, maybe"), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("link", "want"),
    [("../b.html#t", "https://h.example/b.html"), ("/c", "https://h.example/c"), ("d", "https://h.example/a/d"), ("//o.example/x", "https://o.example/x"), ("mailto:a@b.c", None), ("#t", None), ("x.PNG", None), ("javascript:void(0)", None), ("ftp://h/x", None)],
)
def test_normalize_url(spark, link, want):
    assert column(spark, [link], T.normalize_url(F.lit("https://h.example/a/index.html"), F.col("v"))) == [(want,)]


def test_titles_from_urls(spark):
    got = column(spark, ["https://h.example/a/my-page_one.html?x=1", "https://h.example/", None], T.title_from_url(F.col("v")))
    assert got == [("my page one",), ("h.example",), (None,)]


def test_replies_in_fences(spark):
    got = column(spark, ['```json\n{"items":[{"id":"a"}]}\n```', "no json", None], T.json_of_reply(F.col("v"), "items array<struct<id:string>>")["items"][0]["id"])
    assert got == [("a",), (None,), (None,)]


def test_js_escapes(spark):
    assert column(spark, [r"<p>a \"b\"\n", "plain", None], T.decode_js(F.col("v"))) == [('<p>a "b"\n',), ("plain",), (None,)]


def brute_f1(a: str, b: str) -> float:
    def norm(x):
        x = re.sub(r"[!-/:-@\[-`{-~]", "", x.lower())
        return [t for t in x.split() if t not in ("a", "an", "the")]

    p, g = norm(a), norm(b)
    if not p or not g:
        return float(p == g)
    shared = sum(min(p.count(t), g.count(t)) for t in set(p))
    return 0.0 if not shared else 2 * (shared / len(p)) * (shared / len(g)) / (shared / len(p) + shared / len(g))


@given(st.lists(st.tuples(st.text("ab ,the.", max_size=14), st.text("ab ,the.", max_size=14)), min_size=5, max_size=25))
@settings(max_examples=8, deadline=None)
def test_token_f1_equals_brute_force(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.f for r in rows.select("i", metrics.token_f1(F.col("a"), F.col("b")).alias("f")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(brute_f1(a, b)), (a, b)


def test_best_score_splits_references(spark):
    rows = spark.createDataFrame([("x", "x; y"), ("x; y", "x; y"), ("", ""), ("z", ";")], "p string, r string")
    assert [r[0] for r in rows.select(metrics.best_score(F.col("p"), F.col("r"), metrics.exact_match)).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_question_kinds(spark):
    got = column(spark, ["Does it?", "What is the fee?", "How many students?", "When was it?", "Who?", "", None], classify.question_kind(F.col("v")))
    assert [g[0] for g in got] == ["yesno", "tuition", "count", "date", "entity", "entity", "entity"]


def test_boilerplate_lines(spark):
    got = column(spark, ["", "Home", "1. First", "2020", "A sentence that says quite a lot.", "see https://x.example", None, "My Title"], classify.boilerplate_line(F.col("v"), F.lit("My title")))
    assert [g[0] for g in got] == [True, True, True, True, False, True, True, True]
