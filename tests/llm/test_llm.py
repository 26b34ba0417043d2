"""Small tests of every operator: meaning, nulls, empty and long texts, repeats, empty tables, clashing names."""

import bisect
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import consensus, content, encoding, language, lines, overlap, packing, pairs, queries, subjects, tokens, values, wordsplit

DOCS = "doc_id long, title string, url string, domain string, source_type string, source_language string, lang string, collected_at string, text string"
LONG = "word " * 60_000


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return table(spark, folder, "documents")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty, blank and long texts, a repeated row; extra columns named like inner ones."""
    rows = [(1, None, None, None, None, None, None, None, None), (2, "", "", "d", "web_source_text", "", "", "", ""), (3, "T", "u", "d", "web_source_text", "en", "en", "2025-01-01", " \n\t "), (4, "T", "u", "d", "web_source_text", "en", "en", "2025-01-01", LONG), (4, "T", "u", "d", "web_source_text", "en", "en", "2025-01-01", LONG), (5, "T", "u", None, "pdf_source_text", "vi", None, "x", "Một văn bản ngắn về sinh viên và chương trình đào tạo của trường.")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("lines", "_key", "_text", "_block", "hash", "word", "ids", "size", "rank", "container", "paths", "heads", "h", "cluster", "day", "label", "item", "subject"):
        df = df.withColumn(name, F.lit(7))
    return df


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# --- words and ids ---


def test_split_equals_the_pattern():
    import random

    import regex

    find, rng = regex.compile(tokens.PATTERN).findall, random.Random(3)
    signs = list("ab 1'sStmdrelv \n\t\xa0é½²Ж.,!-字")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["it's 'round", "''s", "a'", None, "", LONG[:5000]]
    for a, b in wordsplit.chunks(texts, 3000):
        joined, starts, ends, owner = wordsplit.split(texts[a:b])
        got = [[] for _ in range(b - a)]
        for s, e, o in zip(starts, ends, owner, strict=True):
            got[o].append(joined[s:e])
        assert got == [find(t or "") for t in texts[a:b]]


def test_ids_equal_the_tokenizer(spark, documents, edge, monkeypatch):
    import tiktoken

    monkeypatch.setattr(tokens, "BLOCK_CHARS", 30_000)

    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.vocabulary_path()), special_tokens={})
    for docs in (documents, edge):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))
        got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(docs).collect())
        assert got == [(k, plain.encode_ordinary(t)) for k, t in texts]
        back = sorted((r.doc_id, r.text) for r in tokens.decode(tokens.encode(docs)).collect())
        assert back == texts
        assert sorted((r.doc_id, r.size) for r in tokens.encode(docs, sizes=True).collect()) == [(k, len(ids)) for k, ids in got]
    assert tokens.encode(empty(spark, DOCS)).count() == 0
    odd = spark.createDataFrame([(1, [0, 99_999_999, -3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(odd).collect()} == {1: "!", 2: "", 3: ""}


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(wordsplit, "mix", lambda x: x & np.uint64(3))
    joined, starts, ends, _ = wordsplit.split(["one two three two one", "four one"])
    words, back = wordsplit.dictionary(joined, starts, ends)
    assert [words[i] for i in back] == ["one", " two", " three", " two", " one", "four", " one"]


# --- packing ---


def best_fit(sizes, capacity):
    """Containers that best-fit decreasing opens."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_need_no_more_containers_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([100, 500, 2048]))
    sizes = np.minimum(rng.lognormal(np.log(capacity * 0.3), 0.7, 2_000).astype(int) + 1, capacity)
    values, counts = np.unique(sizes, return_counts=True)
    plan = packing.solve(values, counts, capacity)
    laid = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= capacity
        for s, n in pattern:
            laid[s] = laid.get(s, 0) + n * times
    assert laid == dict(zip(values.tolist(), counts.tolist(), strict=True))  # every item stands in a pattern
    assert sum(n for _, n in plan) <= best_fit(sizes.tolist(), capacity)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes, values, most = rng.integers(1, 9, 4), rng.random(4), rng.integers(1, 4, 4)
        got = packing.knapsack(sizes, values, most, 17)
        ways = [w for w in itertools.product(*(range(m + 1) for m in most)) if np.dot(w, sizes) <= 17]
        assert all(n <= most[k] for k, n in got.items()) and sum(sizes[k] * n for k, n in got.items()) <= 17
        assert abs(sum(values[k] * n for k, n in got.items()) - max(np.dot(w, values) for w in ways)) < 1e-9


def test_packing_is_whole_tight_and_within_capacity(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 100, 400), np.full(300, 37), [0, 0, 250, 1000]])]
    rows = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9999, None, "x")], "doc_id long, size int, container string")
    got = packing.pack(rows, capacity=100).collect()
    load, per = {}, {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.size
        assert (r.container is None) == (r.size == 0)
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.size
    assert max(load.values()) <= 100 and per == {**dict(enumerate(sizes)), 9999: 0}
    assert all(sum(1 for r in got if r.doc_id == i) == 1 for i, s in enumerate(sizes) if s <= 100)
    assert len(load) <= best_fit([min(100, s - k) for s in sizes for k in range(0, s, 100)], 100)
    assert packing.pack(empty(spark, "doc_id long, size int")).count() == 0


# --- lines and main content ---


def test_repeated_lines_equal_brute_force(documents):
    rows = [(r.doc_id, r.domain, r.text) for r in documents.collect() if r.text and r.text.strip()]
    seen, total = {}, {}
    for _, d, t in rows:
        total[d] = total.get(d, 0) + 1
        for x in {x for x in lines.comparable(t) if x}:
            seen[d, x] = seen.get((d, x), 0) + 1
    want = {(k, i) for k, d, t in rows for i, x in enumerate(lines.comparable(t)) if x and seen[d, x] >= 3 and seen[d, x] >= 0.1 * total[d]}
    assert {(r.doc_id, r.line_no) for r in lines.occurrences(documents, least_docs=3).collect()} == want and want


def test_lines_of_edge_rows(spark, edge):
    assert lines.occurrences(edge).count() == 0 and lines.occurrences(empty(spark, DOCS)).count() == 0
    assert {r.doc_id: r.removed_lines for r in lines.without_repeated(edge.dropDuplicates(["doc_id"])).collect()} == dict.fromkeys(range(1, 6), 0)


def test_republished_articles_keep_their_lines(spark):
    day = lambda i: f"2025-01-{i % 28 + 1:02d}"
    article = "The one article\nthat everybody prints"
    rows = [(i, None, None, "d", None, None, None, day(i), article) for i in range(30)]
    rows += [(100 + i, None, None, "d", None, None, None, day(i), f"Text {chr(97 + i)}\nLegal notice {i}") for i in range(12)]
    rows += [(200 + i, None, None, "d", None, None, None, day(3), f"Other {chr(97 + i)}\nProgramme of the open day") for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r.removed_lines for r in lines.without_repeated(docs).collect()}
    assert all(n == (1 if 100 <= i < 200 else 0) for i, n in found.items())
    assert lines.occurrences(docs).filter("doc_id < 30").count() == 60  # the cases are defined over documents


def test_sets_per_domain_are_joined_beyond_the_bound(spark, documents, monkeypatch):
    want = {(r.doc_id, r.line_no) for r in content.furniture_lines(documents).collect()}
    monkeypatch.setattr(lines, "SET_LONGS", 0)
    assert {(r.doc_id, r.line_no) for r in content.furniture_lines(documents).collect()} == want and want


def topic(i):
    return f"{chr(97 + i // 26)}{chr(97 + i % 26)}zu"


def page(i):
    return f"Home\nNews\nHome > News > Report {topic(i)}\nReport on {topic(i)}, 2020\nPosted by the web team on 0{i % 9}/02/2020\nThis is the first paragraph of article {topic(i)}, and it goes on for a while. It has words.\nRelated posts:\nReport on {topic(i + 1)}, 2019\n© 2020 The site. All rights reserved."


def test_main_content(spark):
    docs = spark.createDataFrame([(i, f"Report on {topic(i)}, 2020", f"u{i}", "a.example", "web_source_text", "en", "en", "2025", page(i)) for i in range(60)], DOCS)
    got = {}
    for r in content.furniture_lines(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.line_no)
    assert all(got[i] == {0, 1, 2, 4, 6, 7, 8} for i in range(60))
    text = {r.doc_id: r.text for r in content.main_text(docs).collect()}
    assert text[5].split("\n")[0] == f"Report on {topic(5)}, 2020" and len(text[5].split("\n")) == 2


def test_recurring_body_is_not_furniture(spark):
    long = "The council of the faculty met in spring; it discussed the timetable, the rooms, and the library, and it agreed on a new plan for all courses. Who wants to read it, finds it at the office."

    def text(i):
        return page(i) + (f"\n{long}" if i < 5 else "")  # a paragraph on 8 % of the pages

    texts = [text(i) for i in range(60)] + ["Ours alone\nA short line of it"] * 9
    docs = spark.createDataFrame([(i, None, f"u{i}", "a.example", "web_source_text", "en", "en", "2025", x) for i, x in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.line_no) for r in content.furniture_lines(docs).collect()}
    assert all((i, 9) not in got for i in range(5)) and all((i, n) in got for i in range(60) for n in (0, 1, 8))
    assert not any(i >= 60 for i, _ in got)  # one text published nine times


def test_pooled_share_knows_rare_furniture_and_spares_chance(spark):
    def text(site, i):
        tail = ["Write to the help desk of the house"] if site < 4 or i < 1 else []
        return "\n".join([f"The {topic(i + 40 * site)} of {topic(i + 7)} was read aloud, and {topic(i + 9)} came next; all agreed."] + tail)

    rows = [(100 * s + i, None, f"u{s}-{i}", f"site{s}.example", "web_source_text", "en", "en", "2025", text(s, i)) for s in range(5) for i in range(40)]
    got = {(r.doc_id, r.line_no) for r in content.furniture_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert (400, 1) in got and (0, 1) in got and not any(n == 0 for _, n in got)


def test_text_ratio_decides_between_paths_of_one_share(spark):
    long = "The council met in spring; it discussed rooms, books, and dates, and it agreed on a plan, a budget, and a date for the next session, as it does every year. Who wants to read it, finds it at the office."
    docs = spark.createDataFrame([(i, None, f"u{i}", "a.example", "web_source_text", "en", "en", "2025", f"{topic(i)} text of its own, with words.\n" + (f"{long}\nSend to print" if i < 6 else "")) for i in range(60)], DOCS)
    ratios = {r.path: r for r in content.path_ratios(docs).collect()}
    assert len({r.share for r in ratios.values()}) == 1 and len(ratios) == 2  # both stand on a tenth of the pages
    assert {(r.doc_id, r.line_no) for r in content.furniture_lines(docs).collect()} == {(i, 2) for i in range(6)}


def test_tag_paths_of_html(spark):
    def html(i):
        menu = "".join(f"<li><a href=/{k}>{k}</a></li>" for k in ("Home", "News", "Staff"))
        body = f"<h1>On {topic(i)}</h1><div><p>The survey of {topic(i)}, which ran for weeks, says yes; it was read by many, and it was liked.<br>It goes on, and on.</p><p>Then {topic(i + 1)} came up, was discussed, and was put off.</p></div>"
        return f"<html><head><title>T</title><style>p {{}}</style></head><body><ul>{menu}</ul>{body}<script>x</script><p2>Imprint</p2></body></html>".encode("utf-16" if i == 1 else "utf-8")

    rows = [(f"http://a.example/{i}", "text/html" + ("; charset=utf-16" if i == 1 else "; charset=nonsense" if i == 2 else ""), html(i)) for i in range(8)] + [("http://a.example/x", None, None), (None, None, b"<p>alone"), ("http://a.example/0", "text/html", html(0))]
    got = content.html_nodes(spark.createDataFrame(rows, "url string, content_type string, body binary")).collect()
    for i in (0, 1, 2):
        kept = [r.text for r in sorted(got, key=lambda r: r.node_no) if r.url == f"http://a.example/{i}" and r.content]
        assert kept[0] == f"On {topic(i)}" and len(kept) == 4 and not {"Home", "News", "Staff", "Imprint"} & set(kept)
    assert [r.content for r in got if r.url is None] == [True] and not any("x" == r.text for r in got)


def test_content_of_edge_rows(spark, edge):
    assert content.furniture_lines(edge).filter("doc_id < 4").count() == 0
    assert content.main_text(edge).count() == edge.count() and content.main_text(empty(spark, DOCS)).count() == 0


# --- languages ---


@pytest.fixture(scope="session")
def tongue(spark):
    return language.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_languages_of_lines(tongue):
    said = ["The students of the university read many books about the law.", "Sinh viên của trường đại học đọc nhiều sách về pháp luật.", "Les étudiants de l'université lisent beaucoup de livres sur le droit.", "Die Studierenden der Universität lesen viele Bücher über das Recht."]
    assert [language.LANGUAGES[k] for k in tongue.confidences(said).argmax(axis=1)] == ["en", "vi", "fr", "de"]
    assert tongue.confidences([]).shape == (0, 4)


def test_mislabelled_and_mixed(spark, tongue):
    en, de = "The course on number theory also introduces algebra and closes with a practical test in week nine.", "Der Kurs über Zahlentheorie führt auch in die Algebra ein und endet mit einer praktischen Prüfung."
    rows = [(1, "en", en), (2, "de", en), (3, "eng", f"{en}\n{de}"), (4, "mul", f"{en}\n{de}"), (5, None, de), (6, "EN-us", en + " Danke schön!"), (7, "en", None), (8, "en", "1 2 3")]
    docs = spark.createDataFrame([(k, None, f"u{k}", f"d{k}", "pdf_source_text", s, s, "2025", t) for k, s, t in rows], DOCS)
    got = sorted((r.doc_id, r.lang) for r in language.mislabelled(docs, model=tongue).collect())
    assert got == [(2, "en"), (3, "de"), (3, "en"), (5, "de")]


def test_language_of_edge_rows(spark, edge, tongue):
    got = {r.doc_id: r.languages for r in language.identify(edge, model=tongue).collect()}
    assert got[5] == ["vi"] and set(got) == {4, 5}
    assert language.identify(empty(spark, DOCS)).count() == 0


# --- encodings ---


def test_repair_round_trip(spark, documents):
    model = encoding.train([r.text for r in documents.collect() if r.text])
    clean = "Sinh viên đăng ký học phần tại phòng đào tạo của trường đại học"
    for codec in ("cp1252", "latin-1", "mac_roman", "cp437"):
        bad = "".join(chr(b) if codec == "cp1252" and b in encoding.UNDEFINED else bytes([b]).decode(codec) for b in clean.encode())
        rows = spark.createDataFrame([("documents", "1", bad), ("documents", "2", clean), ("documents", "3", None), ("documents", "4", ""), ("documents", "5", "ph�ng"), ("documents", "6", "Кафедра 日本語 “Übung” jusqu’à")], "record_table string, record_key string, text string")
        got = {r.record_key: (r.restored, r.complete) for r in encoding.repair(rows, model=model).collect()}
        assert set(got) == {"1", "5"} and got["5"][1] is False
        same = sum(a == b for a, b in zip(got["1"][0].split(), clean.split(), strict=False))
        assert same >= 0.8 * len(clean.split())
    assert encoding.repair(rows.limit(0)).count() == 0


# --- consensus ---


def test_values():
    v = values.value_of
    assert v("54.6 million VND per academic year", "tuition") == v("54,600,000 VND", "tuition") == v("54,6 triệu đồng", "tuition")
    assert v("2 December 2015", "deadline") == v("December 2, 2015.", "deadline") == v("on 02/12/2015", "deadline") == v("ngày 2 tháng 12 năm 2015", "deadline")
    assert v("5.5 years", "duration") == v("11 main semesters", "duration") == v("5.5 years (11 main semesters)", "duration")
    assert v("K05; H01", "combination") == v("H01 and K05.", "combination") and v("1,970 STUDENTS", "quota") == v("1970", "quota")
    assert v("Decision No. 9/QD-X", "decision") == v("9/qd-x.", "decision") and v("In 2020 they needed 22.50 points", "score", "2020") == "22.5"
    assert v(None, "score") is None and v("  ", None) is None


def test_consensus_learns_who_is_reliable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        for who, right in (("good", 0.97), ("fair", 0.9), ("bad1", 0.3), ("bad2", 0.3)):
            value = 10 + i if rng.random() < right else 500 + int(rng.integers(0, 3))
            rows.append((f"q{i}", "How many credits does it carry in 2020?", f"{value} credits", None, who, None))
    rows += rows[:5] + [("q0", "How many credits?", None, None, "good2", None), (None, None, None, None, None, None)]
    answers = consensus.answers_of([spark.createDataFrame(rows, "id string, question string, annotator_answer string, notes string, annotator_id string, labelled_at timestamp")])
    own, post, rate = consensus.estimate(answers)
    right = sum(r.value == str(10 + int(r.id[1:])) for r in consensus.consensus(post).collect())
    quality = {r.annotator_id: r.reliability for r in consensus.reliability(rate).collect()}
    assert own.count() == 480 and right >= 112 and quality["good"] > quality["fair"] > max(quality["bad1"], quality["bad2"])
    assert consensus.against_consensus(own, post).count() > 100
    assert -1 <= consensus.agreement(own).first().kappa <= 1
    none = answers.limit(0)
    assert consensus.against_consensus(*consensus.estimate(none, rounds=1)[:2]).count() == 0


# --- overlaps and broken pairs ---

QA = "id string, split string, question string, answers array<string>, answer string, source_url string, evidence string, qa_language string, updated_at timestamp"


def asked(id_, question, answers, split=None, lang="en", evidence=None):
    return (id_, split or id_.split("_")[0], question, answers, None, "u", evidence, lang, None)


def test_overlaps(spark, folder):
    sites = table(spark, folder, "sites")
    s = sites.first()
    p = f"the master programme in Digital Music Design (history track) on the Hill Campus at {s.institution}"
    rows = [
        asked("train_1", f"What was the 2020 admission score for {p}?", ["22.50 points"]),
        asked("test_1", f"how many points did {p.replace(s.institution, s.acronym)} require in 2020", ["Applicants needed 22.5 points in 2020."]),
        asked("test_2", f"What was the 2021 admission score for {p}?", ["22.50 points"]),
        asked("dev_3", f"What was the 2020 admission score for {p.replace('Hill', 'Lake')}?", ["22.50 points"]),
        asked("dev_4", f"What was the 2020 admission score for {p}?", ["23.50 points"]),
        asked("dev_5", f"What was the 2020 admission score for {p.replace('Music', 'Muisc')}?", ["22.50 points"]),
        asked("dev_6", None, ["22.50 points"]),
        asked("dev_7", f"What was the 2020 admission score for {p}?", None),
    ] + [asked(f"train_{i}", f"What was the 201{i % 9} admission score for {p}?", [f"1{i}.50 points"]) for i in range(20, 40)]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, QA)
    assert sorted(tuple(r) for r in overlap.overlap_pairs(docs, sites).collect()) == [("dev_5", "train_1"), ("test_1", "train_1")]
    counts = overlap.overlap_counts(docs, sites).collect()
    assert sorted((r.split, r.eval_records, r.pairs) for r in counts) == [("dev", 1, 1), ("test", 1, 1)]
    assert overlap.overlap_pairs(docs.limit(0), sites).count() == 0 and overlap.overlap_counts(docs.limit(0), sites).count() == 0


def test_bands_miss_few_pairs_at_the_least_similarity():
    assert (1 - overlap.LEAST_JACCARD**overlap.ROWS) ** overlap.BANDS < 1 / 5_400


def test_broken_pairs(spark, folder, documents):
    own = table(spark, folder, "train_qa").select(QA.replace(" string", "").replace(" array<string>", "").replace(" timestamp", "").split(", "))
    p = "the master programme in Digital Music Design (history track) at LVUSS0"
    q = f"How many credits does {p} carry in 2020?"
    rows = [
        asked("x_1", q, ["120 credits"]), asked("x_2", q, ["", None, "N/A"]), asked("x_3", q, None), asked("x_4", q, ["I cannot answer this question."]),
        asked("x_5", q, [q]), asked("x_6", q, ["The credit total of the master progr"]), asked("x_7", q, ["Sinh viên phải tích luỹ đủ 120 tín chỉ."]), asked("x_8", q, ["", "120 credits"]), asked("x_9", None, [LONG]),
    ]
    docs = own.unionByName(spark.createDataFrame(rows, QA))
    got = {r.id: r.defect_type for r in pairs.defects(docs, documents).collect() if r.id.startswith("x_")}
    got.pop("x_9", None)  # a null question: defined, of no type in particular
    assert got == {"x_2": "empty", "x_3": "empty", "x_4": "refusal", "x_5": "copy", "x_6": "truncated", "x_7": "other_language"}


# --- subjects ---


def test_subjects_on_held_out_documents(spark):
    topics = {"law": ("appeals courts", "civil evidence", "contract disputes"), "sport": ("rowing crews", "relay sprinting", "archery rounds"), "arts": ("film editing", "silk prints", "folk dance")}
    rows, labels = [], []
    for i in range(240):
        name = list(topics)[i % 3]
        a, b, c = topics[name]
        rows.append((i, None, f"u{i}", f"d{i}", "pdf_source_text", "en", "en", "2025", f"The reading list covers {a} and {b}. Few visitors know that {c} was taught here in {i}. The team compared {a} with {c}."))
        if i % 4:
            labels.append((i, name))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.subject for r in subjects.areas(docs, spark.createDataFrame(labels, "doc_id long, subject string")).collect()}
    assert sum(got.get(i) == list(topics)[i % 3] for i in range(0, 240, 4)) >= 57


def test_subjects_without_labels(spark, edge):
    assert subjects.areas(edge, empty(spark, "doc_id long, subject string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs_on_the_smallest_tables(spark, folder, name):
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    assert queries.queries()[name](spark, folder).count() >= 0
