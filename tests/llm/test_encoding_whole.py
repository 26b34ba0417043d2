"""The character model is trained on all rows."""

from collections import Counter

from papyrine.llm import encoding


def test_fit_counts_the_words_of_all_rows(spark):
    texts = [f"Đại học số {i % 7} Ngành ngành" + (" hiếm" if i % 1_000 == 0 else "") for i in range(4_000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter(w for t in texts if t for w in t.split())
    got = {r.word: r.n for r in encoding.word_counts(rows).collect()}
    assert got == {**want, None: 4_000}
    model = encoding.fit(rows)
    assert model == encoding.learned(want, 4_000)
    assert "ngành" in model.known and "hiếm" not in model.known  # 1.5 times in PER_TEXTS texts


def test_rare_garbled_words_never_become_known(spark):
    texts = ["Trường đại học"] * 60_000 + ["Tröôøng"] * 30  # more than known words need, were they not taken per PER_TEXTS texts
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert encoding.fit(rows).known == {"trường", "đại", "học"}
