"""Queries over the building of data sets: questions, rubric, splits, annotations, crawls, statistics and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import classify, html
from papyrine.functions import text as T
from papyrine.operators import corpus, generation, reader
from papyrine.plans.data_queries import WORDS_SQL
from papyrine.plans.registry import query
from papyrine.plans.text_queries import clean_answer_sql, fine_sql
from papyrine.sources import files

#: A third of the pairs, all of one kind, get a made question, so that every opening of the rubric is met.
_OPENINGS = ("When was {} founded?", "What abbreviation is used for {}?", "Which faculty has {}?", "Which acronym appears in {}?", "What is discussed in {}? And why?", "Where is {}")
_RUBRIC_SQL = f"""WITH p AS (SELECT DISTINCT id, question, question_type, source_language, regexp_extract(id, '(\\d+)$', 1)::BIGINT AS n FROM train_qa WHERE question IS NOT NULL AND question_type IS NOT NULL),
q AS (SELECT id, question_type, source_language, CASE n % 12 {' '.join(f"WHEN {i} THEN replace('{o}', '{{}}', id)" for i, o in enumerate(_OPENINGS))} WHEN 6 THEN 'It is discussed in ' || id || ', is discussed in it?' WHEN 7 THEN question || repeat(' and so on', 20) ELSE question END AS question FROM p),
scored AS (SELECT *, CASE WHEN regexp_matches(question, '^(When |In what year |How many |What rank |What percentage |What school code |Who )') THEN 20 WHEN starts_with(question, 'What abbreviation ') THEN 16
WHEN regexp_matches(question, '^Which (university|school|faculty|institute|center|program|organization|field) ') THEN 10 ELSE 0 END + CASE WHEN string_split(question_type, ':')[1] <> 'entity' THEN 12 ELSE 0 END + CASE WHEN source_language = 'en' THEN 4 ELSE 0 END
- CASE WHEN contains(question, ' is discussed in ') THEN 8 ELSE 0 END - CASE WHEN starts_with(question, 'Which acronym appears') THEN 12 ELSE 0 END + CASE WHEN length(question) - length(replace(question, '?', '')) = 1 THEN 2 ELSE 0 END - CASE WHEN length(question) > 180 THEN 4 ELSE 0 END AS score FROM q)"""


def _scored(table):
    rows = table("train_qa").filter(F.col("question").isNotNull() & F.col("question_type").isNotNull()).select("id", "question", "question_type", "source_language").distinct()
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 12
    made = F.col("question")
    for i, form in enumerate(_OPENINGS):
        made = F.when(n == i, F.replace(F.lit(form), F.lit("{}"), F.col("id"))).otherwise(made)
    made = F.when(n == 6, F.concat(F.lit("It is discussed in "), F.col("id"), F.lit(", is discussed in it?"))).when(n == 7, F.concat("question", F.lit(" and so on" * 20))).otherwise(made)
    asked = rows.withColumn("question", made)
    return asked.withColumn("score", generation.rubric(F.col("question"), F.col("question_type"), F.col("source_language")))


@query(_RUBRIC_SQL + " SELECT id, question_type, source_language, score::INTEGER AS score FROM scored")
def pair_scores(table):
    return _scored(table).select("id", "question_type", "source_language", "score")


@query(_RUBRIC_SQL + " SELECT id, question, score::INTEGER AS score FROM scored ORDER BY score DESC, id, question LIMIT 200")
def best_pairs(table):
    """The 200 pairs of greatest score: a top-k report."""
    return generation.best_rows(_scored(table).select("id", "question", "score"), F.col("score"), [F.col("id"), F.col("question")], 200)


@query("SELECT id, question FROM (SELECT id, min(question) AS question FROM train_qa WHERE split = 'test' AND question IS NOT NULL GROUP BY id) ORDER BY id LIMIT 25")
def first_questions(table):
    """The first 25 test questions: the limit option of a run."""
    rows = table("train_qa").filter((F.col("split") == "test") & F.col("question").isNotNull()).groupBy("id").agg(F.min("question").alias("question"))
    return generation.first_questions(rows, 25, order="id")


_UNITS = ("students", "MASTER", "master", "doctoral", "Ph.D. programs")


@query("""SELECT p_partkey, n || ' ' || u AS answer, t AS answer_type, CASE WHEN t = 'count:labs' THEN 'labs' WHEN t = 'count' THEN CASE u WHEN 'MASTER' THEN 'master' WHEN 'master' THEN 'master programs' WHEN 'doctoral' THEN 'doctoral programs' ELSE u END WHEN t = 'credits' THEN 'credits' ELSE 'items' END AS unit,
CASE WHEN t = 'count' THEN n WHEN t = 'credits' AND starts_with(u, 'credit') THEN n ELSE n || ' ' || u END AS bare
FROM (SELECT p_partkey, p_size::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN ',500' ELSE '' END AS n, CASE WHEN p_partkey % 7 = 6 AND p_partkey % 3 <> 0 THEN 'credits' ELSE list_extract(['students', 'MASTER', 'master', 'doctoral', 'Ph.D. programs'], (p_partkey % 5 + 1)::INTEGER) END AS u,
CASE WHEN p_partkey % 7 = 6 AND p_partkey % 3 <> 0 THEN 'credits' WHEN p_partkey % 11 = 0 THEN 'count:labs' WHEN p_partkey % 11 = 1 THEN 'rank' ELSE 'count' END AS t FROM part)""")
def answer_units(table):
    """Units and bare numbers of made counts and credits."""
    key = F.col("p_partkey")
    credits = (key % 7 == 6) & (key % 3 != 0)
    n = F.concat(F.col("p_size").cast("string"), F.when(key % 3 == 0, ",500").otherwise(""))
    unit = F.when(credits, "credits").otherwise(F.element_at(F.array(*map(F.lit, _UNITS)), (key % 5 + 1).cast("int")))
    kind = F.when(credits, "credits").when(key % 11 == 0, "count:labs").when(key % 11 == 1, "rank").otherwise("count")
    rows = table("part").select("p_partkey", F.concat(n, F.lit(" "), unit).alias("answer"), kind.alias("answer_type"))
    return rows.withColumns({"unit": generation.answer_unit(F.col("answer"), F.col("answer_type")), "bare": generation.reference_answer(F.col("answer"), F.col("answer_type"))})


_ACTIONS_SQL = "CASE " + " ".join(f"WHEN contains(lower(evidence), '{a}') THEN '{a}'" for a in classify.ACTIONS) + " ELSE 'mentioned' END"


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, {_ACTIONS_SQL} AS action FROM train_qa WHERE evidence IS NOT NULL")
def sentence_actions(table):
    rows = table("train_qa").filter(F.col("evidence").isNotNull())
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), classify.action(F.col("evidence")).alias("action"))


_GOOD_SQL = " OR ".join(f"contains(' ' || lower(evidence) || ' ', '{t}')" for t in classify.GOOD_TERMS)


@query(f"""SELECT id, epoch_us(updated_at) AS updated_us FROM train_qa WHERE evidence IS NOT NULL AND len({WORDS_SQL.replace('text', 'evidence')}) >= 8 AND length(regexp_replace(evidence, '[^\\p{{L}}]', '', 'g')) >= length(evidence) * 0.52
AND length(regexp_replace(evidence, '[^0-9]', '', 'g')) <= length(regexp_replace(evidence, '[^\\p{{L}}]', '', 'g')) * 0.45 AND ({_GOOD_SQL})""")
def good_sentences(table):
    return table("train_qa").filter(classify.good_sentence(F.col("evidence"))).select("id", F.unix_micros("updated_at").alias("updated_us"))


@query("""SELECT doc_id, trim(CASE WHEN s - 1 > 20 AND (contains(substring(line, 1, s - 1), 'Home') OR contains(substring(line, 1, s - 1), 'Library') OR len(list_filter(string_split(substring(line, 1, s - 1), ' '), lambda w: w <> '')) > 12) THEN substring(line, s) ELSE line END, ' -') AS sentence
FROM (SELECT doc_id, line, CASE WHEN regexp_matches(line, 'The (university|faculty|course|reading)') THEN strpos(line, regexp_extract(line, 'The (?:university|faculty|course|reading)', 0)) ELSE 0 END AS s
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL))""")
def sentences_without_navigation(table):
    """Texts as one line, without what stands before their first sentence about a thing."""
    docs = table("documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", generation.without_navigation(F.col("text"), starts=(r"The (?:university|faculty|course|reading)",), terms=("Home", "Library")).alias("sentence"))


@query("""SELECT s_suppkey, CASE WHEN length(v) < 3 OR lower(v) IN ('it', 'they', 'there', 'this', 'these', 'those') THEN 'the source' ELSE v END AS subject FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'it' WHEN 1 THEN s_name WHEN 2 THEN 'w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16' WHEN 3 THEN s_name ELSE 'No' END AS v FROM supplier)""")
def clean_subjects(table):
    """Subjects made of suppliers: pronouns, openers and brackets, long ones, articles, short ones."""
    key = F.col("s_suppkey") % 5
    long = " ".join(f"w{i}" for i in range(1, 17))
    value = F.when(key == 0, "It").when(key == 1, F.concat(F.lit("In the year 2020, "), F.lit("the "), F.col("s_name"), F.lit(" (founded in 1990) ,"))).when(key == 2, long).when(key == 3, F.concat(F.lit("Currently, a  "), F.col("s_name"), F.lit(".;"))).otherwise("No")
    made = generation.clean_subject(value, F.lit("the source"))
    return table("supplier").select("s_suppkey", F.when(key == 0, F.when(made == "the source", "the source")).otherwise(made).alias("subject"))


@query("""SELECT split, (row_number() OVER (PARTITION BY split ORDER BY id, question) - 1)::INTEGER AS line_no, regexp_replace(coalesce(question, ''), '[\\r\\n]+', ' ', 'g') AS question, regexp_replace(coalesce(array_to_string(answers, ';'), answer, ''), '[\\r\\n]+', ' ', 'g') AS answers
FROM (SELECT id, split, any_value(question) AS question, any_value(answers) AS answers, any_value(answer) AS answer FROM train_qa GROUP BY id, split)""")
def split_files(table):
    rows = table("train_qa").groupBy("id", "split").agg(F.any_value("question", True).alias("question"), F.any_value("answers", True).alias("answers"), F.any_value("answer", True).alias("answer"))
    return files.split_lines(rows)


@query("""SELECT CASE WHEN lower(content_type) LIKE '%pdf%' OR lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS kind, count(*) AS snapshots, count(DISTINCT url) AS urls, sum(octet_length(body))::BIGINT AS bytes FROM fetched_resources WHERE body IS NOT NULL GROUP BY 1""")
def fetch_snapshots(table):
    """Kinds and sizes of the raw snapshots, by the names they get."""
    made = files.snapshots(table("fetched_resources"))
    return made.groupBy(F.substring_index("name", ".", -1).alias("kind")).agg(F.count("*").alias("snapshots"), F.count_distinct("name").alias("urls"), F.sum(F.octet_length("body")).alias("bytes"))


@query("""SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(DISTINCT url) FROM documents) AS unique_source_url_count, (SELECT count(*) FROM documents WHERE fetch_status = 'ok') AS fetched_source_count, (SELECT count(*) FROM documents WHERE fetch_status IS DISTINCT FROM 'ok') AS fallback_source_count,
(SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(*) FROM train_qa WHERE split = 'train') AS train_count, (SELECT count(*) FROM train_qa WHERE split = 'test') AS test_count,
(SELECT map_from_entries(list((fetch_status, n) ORDER BY fetch_status)) FROM (SELECT fetch_status, count(*) AS n FROM documents WHERE fetch_status IS NOT NULL GROUP BY 1)) AS fetch_status_counts""")
def dataset_metadata(table):
    return corpus.dataset_metadata(table("documents"), table("chunks"), table("train_qa"))


@query("SELECT DISTINCT source_url FROM train_qa WHERE source_url IS NOT NULL AND source_url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL AND fetch_status = 'ok')")
def missing_sources(table):
    return corpus.missing_sources(table("train_qa"), table("documents").filter(F.col("fetch_status") == "ok"))


@query("""WITH d AS (SELECT url, min(id) AS document_id FROM documents WHERE url IS NOT NULL GROUP BY url) SELECT t.id, t.source_url, d.document_id FROM (SELECT DISTINCT id, source_url FROM train_qa) t JOIN d ON d.url = t.source_url""")
def sourced_pairs(table):
    """Pairs with the document of their source; sources without one would be an error, so these are left out before."""
    documents = table("documents").filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("document_id"))
    pairs = table("train_qa").select("id", "source_url").distinct().join(documents.select(F.col("url").alias("source_url")), "source_url", "left_semi")
    return corpus.with_documents(pairs, documents).select("id", "source_url", "document_id")


_BEST_CHUNK = "CASE WHEN contains(lower(coalesce(c.text, '')), lower(coalesce(p.answer, chr(1)))) AND contains(lower(coalesce(c.text, '')), lower(coalesce(p.question, chr(1)))) THEN 0 WHEN contains(lower(coalesce(c.text, '')), lower(coalesce(p.answer, chr(1)))) THEN 1 ELSE 2 END"


@query(f"""WITH d AS (SELECT url, min(id) AS document_id FROM documents WHERE url IS NOT NULL GROUP BY url), p AS (SELECT DISTINCT question, answer, source_url, document_id FROM train_qa JOIN d ON d.url = source_url WHERE split = 'train'),
b AS (SELECT p.*, c.chunk_id, row_number() OVER (PARTITION BY p.question, p.answer, p.source_url ORDER BY {_BEST_CHUNK}, c.chunk_index, c.chunk_id) AS r FROM p LEFT JOIN chunks c ON c.document_id = p.document_id)
SELECT 'train' AS split, question, [answer] AS answers, answer, document_id AS source_id, source_url, chunk_id, 'en' AS qa_language, 'manual_curated' AS annotation_status FROM b WHERE r = 1""")
def train_annotations(table):
    """Annotation rows of the train split, each pair once; ids follow the seeded order and are left out here."""
    documents = table("documents").filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("id").alias("document_id"))
    pairs = table("train_qa").filter(F.col("split") == "train").select("question", "answer", "source_url").distinct()
    known = pairs.join(documents.select(F.col("url").alias("source_url")), "source_url", "left_semi")
    return corpus.annotations(known, documents, table("chunks"), split="train").drop("id")


@query("""WITH RECURSIVE s AS (SELECT 1 AS place, 1 AS train, 0 AS test, 'train' AS split UNION ALL SELECT place + 1, train + (NOT t AND train < 60)::INTEGER, test + (t OR train >= 60)::INTEGER, CASE WHEN t OR train >= 60 THEN 'test' ELSE 'train' END
FROM (SELECT *, test < 90 AND (place + 1) % 3 = 0 AS t FROM s) WHERE place < 150) SELECT vec_id, split FROM s JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings) USING (place)""")
def overflowing_split(table):
    """60 to train and 90 to test, where thirds don't fill the test split; the SQL goes row by row."""
    placed = corpus.with_ordinal(table("embeddings").select("vec_id"), "vec_id", name="place")
    return generation.interleaved_split(placed, 60, 90).select("vec_id", "split")


@query(r"""SELECT url, fetched_us, count(*) AS n, regexp_replace(any_value(text), '\s+', ' ', 'g') AS text FROM (SELECT url, epoch_us(fetched_at) AS fetched_us, try(decode(body)) AS text FROM fetched_resources WHERE body IS NOT NULL AND content_type = 'text/html; charset=utf-8') WHERE text IS NOT NULL GROUP BY ALL""")
def decoded_bodies(table):
    rows = table("fetched_resources").filter(F.col("body").isNotNull() & (F.col("content_type") == "text/html; charset=utf-8") & F.is_valid_utf8(F.col("body").cast("string")))
    text = F.regexp_replace(html.decoded(F.col("body"), F.col("content_type")), r"\s+", " ")
    return rows.groupBy("url", F.unix_micros("fetched_at").alias("fetched_us"), text.alias("text")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE len(" + WORDS_SQL + ") >= 70 AND (regexp_matches(lower(coalesce(url, '') || ' ' || substring(coalesce(text, ''), 1, 5000)), 'admission|tuition') OR coalesce(source_type = 'manual_qa_facts', false))")
def gated_or_mandatory(table):
    return corpus.quality_gate(table("documents"), ("admission", "tuition"), mandatory=F.col("source_type") == "manual_qa_facts").select("doc_id")


def _html_pages(table):
    docs = table("documents").filter(F.col("url").isNotNull()).select("url", "domain").distinct()
    root = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    anchors = docs.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<a href='"), u, F.lit("'>x</a>"))), "").alias("html"))
    return docs.select(root.alias("url")).distinct(), anchors.select(root.alias("url"), "html")


@query(f"""WITH roots AS (SELECT url, row_number() OVER (ORDER BY url) AS place, domain FROM (SELECT DISTINCT 'https://' || domain || '/' AS url, domain FROM documents WHERE url IS NOT NULL)),
linked AS (SELECT d.url, min((r.place, d.url)) AS origin FROM (SELECT DISTINCT url, domain FROM documents WHERE url IS NOT NULL) d JOIN roots r USING (domain) WHERE d.url NOT IN (SELECT url FROM roots) GROUP BY d.url),
visited AS (SELECT url, place FROM roots UNION ALL SELECT url, row_number() OVER (ORDER BY origin) + (SELECT count(*) FROM roots) FROM linked),
f AS (SELECT url, arg_min(text, doc_id) AS text, min(fetch_status) AS status FROM documents WHERE url IS NOT NULL AND text IS NOT NULL GROUP BY url),
good AS (SELECT v.url, v.place, f.text, sha256(f.text) AS h FROM visited v JOIN f USING (url) WHERE f.status = 'ok' AND len({WORDS_SQL}) >= 70 AND regexp_matches(lower(v.url || ' ' || substring(f.text, 1, 5000)), 'admission|tuition|programme')),
kept AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY h ORDER BY place) = 1)
SELECT printf('doc_%04d', row_number() OVER (ORDER BY place) - 1) AS id, url, place::BIGINT AS place, h AS content_sha256 FROM kept""")
def crawled_documents(table):
    """The documents of a crawl from every site's root, gated, one per content, numbered in the order of the crawl."""
    seeds, pages = _html_pages(table)
    docs = table("documents").filter(F.col("url").isNotNull() & F.col("text").isNotNull())
    fetched = docs.groupBy("url").agg(F.min_by("text", "doc_id").alias("text"), F.min("fetch_status").alias("status"))
    order = corpus.crawl(seeds, pages, rounds=2)
    found, _ = corpus.crawled_documents(order, fetched, ("admission", "tuition", "programme"))
    return found.select("id", "url", "place", "content_sha256")


@query("""WITH d AS (SELECT p_partkey, 'A00: Mathematics; Physics; Chemistry. ' AS a FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Mathematics; Physics; Chemistry' WHEN 1 THEN 'Literature; History; Geography' WHEN 2 THEN 'Biology; English' END AS subjects,
CASE p_partkey % 4 WHEN 0 THEN 'Bachelor degree' WHEN 1 THEN 'Engineer degree' WHEN 2 THEN 'Bachelor degree' END AS degree, CASE p_partkey % 4 WHEN 0 THEN 'Hue' WHEN 1 THEN 'Engineering' ELSE 'Group' END AS place, CASE p_partkey % 4 WHEN 2 THEN 'Law; Art History' WHEN 3 THEN 'Marine Science' END AS programmes FROM d""")
def extracted_answers(table):
    """What the extractors of subjects, degrees, places and programmes read out of made passages, one of four per part."""
    key = F.col("p_partkey") % 4
    texts = ("a00: mathematics; physics; chemistry and a Bachelor's degree in hue", "(literature; history; geography) is asked under a00 for an Engineering degree", "Group a00 in the list has the subjects Biology; English; Biology\n1 | Law | 24.5\n2 | Art History | Bachelor degree\n3 | Law | 22\n4 | 30 years | 20", "Group of majors. Question: Which major is it? Answer: Marine Science.")
    text = F.element_at(F.array(*map(F.lit, texts)), (key + 1).cast("int"))
    rows = table("part").select("p_partkey", F.lit("Which subjects are in A00?").alias("question"), text.alias("text"))
    return rows.select("p_partkey", reader.school_subjects(F.col("question"), F.col("text")).alias("subjects"), reader.degree_of(F.col("text")).alias("degree"), reader.place_of(F.col("text"), places=("Hue",)).alias("place"), reader.programmes(F.col("text")).alias("programmes"))


@query("""WITH s AS (SELECT id AS qid, unnest(answers) AS answer, generate_subscripts(answers, 1) AS i FROM (SELECT id, any_value(answers) AS answers FROM train_qa WHERE answers IS NOT NULL GROUP BY id)),
c AS (SELECT qid, """ + clean_answer_sql("answer") + """ AS answer, 1.0 / i AS score FROM s WHERE answer IS NOT NULL), f AS (SELECT *, lower(strip_accents(answer)) AS fold FROM c WHERE answer <> '' AND regexp_full_match(answer, '[ -~]*')),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid, fold ORDER BY score DESC, answer) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, answer)::INTEGER AS place, answer, round(score, 6) AS score FROM d QUALIFY place <= 4""")
def distinct_spans(table):
    """Up to four answers per id that differ in folded form, of those in plain ASCII."""
    rows = table("train_qa").filter(F.col("answers").isNotNull()).groupBy("id").agg(F.any_value("answers").alias("answers"))
    spans = rows.select(F.col("id").alias("qid"), F.posexplode("answers").alias("i", "answer")).filter(F.col("answer").isNotNull() & F.col("answer").rlike(r"^[ -~]*$"))
    found = reader.distinct_answers(spans.select("qid", "answer", (1.0 / (F.col("i") + 1)).alias("score")))
    return found.select("qid", "place", "answer", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT DISTINCT id, question, answer, annotation_status FROM train_qa WHERE id IS NOT NULL), n AS (SELECT *, regexp_extract(id, '(\\d+)$', 1)::BIGINT % 4 AS n FROM p)
SELECT id, CASE WHEN n = 0 THEN 'What is asked under ' || id || '?' ELSE question END AS question, CASE WHEN n IN (0, 1) THEN 'refined' ELSE answer END AS answer, CASE WHEN n < 3 THEN 'llm_refined_needs_human_review' ELSE annotation_status END AS annotation_status FROM n""")
def refined_rows(table):
    """Refinements put in field by field: both, the answer alone (its question isn't one), neither, and no item at all."""
    rows = table("train_qa").filter(F.col("id").isNotNull()).select("id", "question", "answer", "annotation_status").distinct()
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 4
    items = rows.select("id").distinct().filter(n < 3).select("id", F.when(n == 0, F.concat(F.lit(" What is asked under "), F.col("id"), F.lit("?"))).otherwise("No question").alias("question"), F.when(n < 2, "refined ").otherwise(" ").alias("answer"))
    return generation.refined_rows(rows, items)


@query("""WITH b AS (SELECT id, question, answer, evidence, ((row_number() OVER (ORDER BY id)) - 1) // 12 AS batch FROM (SELECT id, min(question) AS question, min(answer) AS answer, min(evidence) AS evidence FROM train_qa WHERE question IS NOT NULL GROUP BY id))
SELECT batch::BIGINT AS batch, count(*) AS items, sum(length(substring(coalesce(evidence, ''), 1, 700)))::BIGINT AS chars FROM b GROUP BY batch""")
def refine_batches(table):
    rows = table("train_qa").filter(F.col("question").isNotNull()).groupBy("id").agg(F.min("question").alias("question"), F.min("answer").alias("answer"), F.min("evidence").alias("evidence"))
    made = generation.refine_prompts(generation.batches(rows, 12, key="id"), ("Keep the meaning.",))
    parsed = F.from_json("prompt", "items array<struct<id:string,evidence:string>>")["items"]
    return made.select("batch", F.size(parsed).cast("long").alias("items"), F.aggregate(parsed, F.lit(0).cast("long"), lambda s, c: s + F.length(c["evidence"])).alias("chars"))
