"""Queries over corpus building, chunking and the making of pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import classify
from papyrine.functions import text as T
from papyrine.operators import chunking, corpus, generation
from papyrine.plans.registry import query
from papyrine.plans.text_queries import fold_sql

WORDS_SQL = "list_filter(regexp_split_to_array(trim(coalesce(text, ''), ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 110 THEN 1 ELSE ceil((len(w) - 110) / 85.0)::BIGINT + 1 END)) AS k FROM d WHERE len(w) > 0)
SELECT doc_id, k::INTEGER AS chunk_index, (k * 85)::INTEGER AS start_word, least(k * 85 + 110, len(w))::INTEGER AS end_word, array_to_string(w[k * 85 + 1 : k * 85 + 110], ' ') AS text FROM c""")
def sliding_chunks(table):
    return chunking.sliding(table("documents"))


@query(f"""WITH d AS (SELECT len({WORDS_SQL}) AS n FROM documents), s AS (SELECT * FROM (VALUES (0, 110, 25), (1, 90, 25), (2, 75, 20), (3, 60, 15), (4, 50, 12)) t(i, size, overlap)),
c AS (SELECT i, size, overlap, sum(CASE WHEN n = 0 THEN 0 WHEN n <= size THEN 1 ELSE ceil((n - size) / (size - overlap)::DOUBLE) + 1 END) AS c FROM d, s GROUP BY ALL)
SELECT size::INTEGER AS size, overlap::INTEGER AS overlap FROM c WHERE i = coalesce((SELECT min(i) FROM c WHERE c >= 10000), 4)""")
def chosen_window(table):
    docs = table("documents")
    size, overlap = chunking.choose_window(docs, target=10_000)
    return docs.limit(1).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))


@query()
def paragraph_chunks(table):
    return chunking.paragraphs(table("documents"), useful=chunking.useful_chunk(F.col("text")))


@query(f"""SELECT chunk_id FROM chunks WHERE len({WORDS_SQL}) >= 18 AND NOT contains(lower(text), 'cookie') AND NOT contains(lower(text), 'log in')
AND (length(text) - length(replace(text, '|', '')) >= 4 OR regexp_matches(text, '[.!?](?:[ \\t\\n\\x0b\\f\\r]|$)'))""")
def useful_chunks(table):
    return table("chunks").filter(chunking.useful_chunk(F.col("text"))).select("chunk_id")


@query(f"""SELECT chunk_id FROM chunks WHERE source_language = 'en' AND len({WORDS_SQL}) >= 65 AND regexp_matches(lower(text), 'student|programme|course|credit|regulation') AND NOT regexp_matches(lower(text), 'cookie|javascript|\\x{{fffd}}')""")
def good_chunks(table):
    return table("chunks").filter(generation.good_chunk(F.col("text"), F.col("source_language"))).select("chunk_id")


@query()
def cleaned_documents(table):
    return corpus.clean_documents(table("documents"))


@query(f"""SELECT doc_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS domain, sha256(coalesce(text, '')) AS content_sha256, length(coalesce(text, ''))::INTEGER AS char_count, len({WORDS_SQL})::INTEGER AS word_count FROM documents""")
def enriched_documents(table):
    return corpus.enrich(table("documents")).select("doc_id", "domain", "content_sha256", "char_count", "word_count")


FACTS_SQL = """rows_ AS (SELECT DISTINCT source_url, id, question, coalesce(nullif(answer, ''), array_to_string(answers, '; '), CASE WHEN answers IS NOT NULL THEN '' END) AS answer FROM train_qa WHERE source_url IS NOT NULL AND question IS NOT NULL AND coalesce(nullif(answer, ''), array_to_string(answers, '; '), CASE WHEN answers IS NOT NULL THEN '' END) IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY id, question, answer) AS n FROM rows_),
facts AS (SELECT source_url, 'Curated facts' || chr(10) || string_agg('Fact ' || n || '. Question: ' || question || ' Answer: ' || answer || '.', chr(10) ORDER BY n) AS text FROM numbered GROUP BY source_url)"""


@query(f"WITH {FACTS_SQL} SELECT source_url, md5(text) AS digest FROM facts")
def fact_texts(table):
    return corpus.fact_lines(table("train_qa")).select("source_url", F.md5("text").alias("digest"))


@query(f"""WITH {FACTS_SQL}, counts AS (SELECT source_url AS url, count(DISTINCT id) AS manual_train_qa_count FROM train_qa WHERE source_url IS NOT NULL GROUP BY ALL),
loaded AS (SELECT url, min(text) AS text FROM documents WHERE fetch_status = 'ok' AND text IS NOT NULL AND url IS NOT NULL GROUP BY url)
SELECT printf('doc_%04d', row_number() OVER (ORDER BY c.url)) AS id, c.url, CASE WHEN l.url IS NULL THEN 'skipped' ELSE 'ok' END AS fetch_status, md5(CASE WHEN l.url IS NULL THEN coalesce(f.text, '') ELSE l.text END) AS digest, manual_train_qa_count
FROM counts c LEFT JOIN loaded l ON l.url = c.url LEFT JOIN facts f ON f.source_url = c.url""")
def documents_from_sources(table):
    ok = table("documents").filter((F.col("fetch_status") == "ok") & F.col("text").isNotNull() & F.col("url").isNotNull())
    loaded = ok.groupBy("url").agg(F.min("text").alias("text"), F.lit("ok").alias("fetch_status"))
    built = corpus.from_sources(table("train_qa"), loaded)
    return built.select("id", "url", "fetch_status", F.md5("text").alias("digest"), "manual_train_qa_count")


@query()
def fetch_states(table):
    """What came of the last fetch of each URL."""
    last = corpus.latest(table("fetched_resources"), ["url"], ["fetched_at", "arrived_at"])
    return corpus.load_status(last, least_words=5).select("url", "fetch_status")


@query("SELECT map_from_entries(list((status, n) ORDER BY status)) AS counts FROM (SELECT status, count(*) AS n FROM fetched_resources WHERE status IS NOT NULL GROUP BY status)")
def fetch_histogram(table):
    return corpus.histogram(table("fetched_resources"), "status")


@query("SELECT url, status, epoch_us(arrived_at) AS arrived_us FROM fetched_resources WHERE status = 'ok' AND body IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, arrived_at DESC) = 1")
def last_good_fetch(table):
    good = table("fetched_resources").filter((F.col("status") == "ok") & F.col("body").isNotNull())
    return corpus.latest(good, ["url"], ["fetched_at", "arrived_at"]).select("url", "status", F.unix_micros("arrived_at").alias("arrived_us"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def distinct_contents(table):
    docs = table("documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("h"))
    return corpus.first_wins(docs, [F.col("h")], [F.col("doc_id")]).select("doc_id")


@query(f"""SELECT doc_id FROM documents WHERE len({WORDS_SQL}) >= 70 AND regexp_matches(lower(coalesce(url, '') || ' ' || substring(coalesce(text, ''), 1, 5000)), 'admission|tuition|programme')""")
def gated_documents(table):
    return corpus.quality_gate(table("documents"), ("admission", "tuition", "programme")).select("doc_id")


@query("SELECT count(*) AS documents, count_if(fetch_status = 'ok') AS fetched, count(DISTINCT url) AS urls, count(DISTINCT domain) AS domains, sum(word_count)::BIGINT AS words FROM documents")
def corpus_statistics(table):
    return table("documents").agg(F.count("*").alias("documents"), F.count_if(F.col("fetch_status") == "ok").alias("fetched"), F.count_distinct("url").alias("urls"), F.count_distinct("domain").alias("domains"), F.sum("word_count").alias("words"))


@query("SELECT count(DISTINCT (lower(question), lower(answer))) AS pairs FROM train_qa WHERE question IS NOT NULL AND answer IS NOT NULL")
def distinct_pairs(table):
    return table("train_qa").agg(F.count_distinct(F.lower("question"), F.lower("answer")).alias("pairs"))


@query("""WITH roots AS (SELECT url, row_number() OVER (ORDER BY url) AS place, domain FROM (SELECT DISTINCT 'https://' || domain || '/' AS url, domain FROM documents WHERE url IS NOT NULL)),
linked AS (SELECT d.url, min((r.place, d.url)) AS origin FROM (SELECT DISTINCT url, domain FROM documents WHERE url IS NOT NULL) d JOIN roots r USING (domain) WHERE d.url NOT IN (SELECT url FROM roots) GROUP BY d.url)
SELECT url, 0::INTEGER AS depth, place::BIGINT AS place FROM roots UNION ALL SELECT url, 1, (row_number() OVER (ORDER BY origin) + (SELECT count(*) FROM roots))::BIGINT FROM linked""")
def crawl_order(table):
    """Two levels from every site's root over pages that link to the documents of their domain."""
    docs = table("documents").filter(F.col("url").isNotNull()).select("url", "domain").distinct()
    seeds = docs.select(F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url")).distinct()
    anchors = docs.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<a href='"), u, F.lit("'>x</a>"))), "").alias("html"))
    pages = anchors.select(F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url"), "html")
    return corpus.crawl(seeds, pages, rounds=2)


def _sentences(table):
    docs = table("documents").filter(F.col("text").isNotNull())
    rows = docs.select("doc_id", "source_language", F.posexplode(T.long_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.filter(T.sentence_letters_ok(F.col("sentence")))


@query()
def answer_candidates(table):
    return generation.candidates(_sentences(table).select("doc_id", "pos", "sentence"))


def _generated(table):
    found = generation.candidates(_sentences(table).select("doc_id", "pos", "source_language", "sentence"))
    asked = found.withColumn("question", generation.question_for(F.col("answer_type"), generation.subject_of(F.col("sentence"))))
    return asked.withColumn("score", generation.rubric(F.col("question"), F.col("answer_type"), F.col("source_language")))


@query()
def generated_pairs(table):
    return _generated(table).select("doc_id", "pos", "place", "question", "answer", "score")


@query()
def capped_pairs(table):
    order = [F.col("score").desc(), F.col("pos"), F.col("place")]
    taken = generation.capped(_generated(table), by="doc_id", order=order)
    return taken.groupBy("pass").agg(F.count("*").alias("pairs"))


@query("""WITH RECURSIVE s AS (SELECT 1 AS place, 1 AS train, 0 AS test, 'train' AS split UNION ALL SELECT place + 1, train + (NOT t AND train < 100)::INTEGER, test + (t OR train >= 100)::INTEGER, CASE WHEN t OR train >= 100 THEN 'test' ELSE 'train' END
FROM (SELECT *, test < 40 AND (place + 1) % 3 = 0 AS t FROM s) WHERE place < 140) SELECT vec_id, split FROM s JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings) USING (place)""")
def interleaved_split(table):
    placed = corpus.with_ordinal(table("embeddings").select("vec_id"), "vec_id", name="place")
    return generation.interleaved_split(placed, 100, 40).select("vec_id", "split")


@query("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 100 THEN 'train' ELSE 'test' END AS split FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id) <= 150")
def contiguous_split(table):
    placed = corpus.with_ordinal(table("embeddings").select("vec_id"), "vec_id", name="place")
    return generation.contiguous_split(placed, 100, 50).select("vec_id", "split")


@query()
def shuffled_pairs(table):
    return generation.shuffled(table("train_qa").select("id").distinct()).select("id", "place")


@query("""SELECT id, epoch_us(updated_at) AS updated_us, ends_with(q, '?') AND length(q) >= 12 AND length(trim(answer, ' ')) BETWEEN 1 AND 120 AND NOT contains(q, 'according to the text') AND NOT contains(q, 'in the passage') AND NOT contains(q, 'this document') AND NOT contains(q, 'the above')
AND regexp_matches(q, '^(?:what|which|who|when|where|how|why|does|is|are|can|under|on|by)\\b') AS valid FROM (SELECT id, updated_at, answer, lower(trim(question, ' ')) AS q FROM train_qa WHERE answer IS NOT NULL)""")
def valid_items(table):
    rows = table("train_qa").filter(F.col("answer").isNotNull())
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), generation.valid_item(F.col("question"), F.col("answer")).alias("valid"))


@query("""SELECT id, epoch_us(updated_at) AS updated_us FROM (SELECT id, updated_at, CASE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 40 WHEN 0 THEN 'What is stated in the passage on ' || id || '?' WHEN 1 THEN 'What is it?' WHEN 2 THEN 'Which name is linked with ' || id || '?' ELSE question END AS question FROM train_qa)
WHERE contains(lower(question), 'according to the text') OR contains(lower(question), 'in the passage') OR contains(lower(question), 'this document') OR contains(lower(question), 'the above')
OR regexp_matches(lower(question), '^(?:what is (?:it|this|that)|what value is given|which name is linked)\\b')""")
def weak_questions(table):
    """Weak questions among all, some of which are put in place of the table's, which has none."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 40
    made = F.when(n == 0, F.concat(F.lit("What is stated in the passage on "), F.col("id"), F.lit("?"))).when(n == 1, "What is it?").when(n == 2, F.concat(F.lit("Which name is linked with "), F.col("id"), F.lit("?"))).otherwise(F.col("question"))
    return table("train_qa").filter(generation.needs_rewrite(made)).select("id", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT chunk_id FROM chunks WHERE chunk_index % 2 = 1 AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_index % 2 = 0)")
def unprocessed_chunks(table):
    chunks = table("chunks").select("chunk_id", "chunk_index")
    return generation.unprocessed(chunks, chunks.filter(F.col("chunk_index") % 2 == 0)).select("chunk_id")


@query("""WITH b AS (SELECT chunk_id, text, ((row_number() OVER (ORDER BY chunk_id)) - 1) // 5 AS batch FROM chunks WHERE text IS NOT NULL) SELECT batch::BIGINT AS batch, count(*) AS chunks, sum(length(substring(text, 1, 1500)))::BIGINT AS chars FROM b GROUP BY batch""")
def prompt_batches(table):
    rows = generation.batches(table("chunks").filter(F.col("text").isNotNull()).select("chunk_id", "text"), 5, key="chunk_id")
    made = generation.prompts(rows, ("Ask only what the passage answers.",))
    parsed = F.from_json("prompt", "chunks array<struct<chunk_id:string,text:string>>")["chunks"]
    return made.select("batch", F.size(parsed).cast("long").alias("chunks"), F.aggregate(parsed, F.lit(0).cast("long"), lambda s, c: s + F.length(c["text"])).alias("chars"))


@query("""SELECT id, CASE WHEN regexp_extract(id, '(\\d+)$', 1)::BIGINT % 2 = 0 THEN 'What is asked under ' || id || '?' ELSE question END AS question, CASE WHEN regexp_extract(id, '(\\d+)$', 1)::BIGINT % 2 = 0 THEN 'refined' ELSE answer END AS answer,
CASE WHEN regexp_extract(id, '(\\d+)$', 1)::BIGINT % 2 = 0 THEN 'refined_needs_human_review' ELSE annotation_status END AS annotation_status FROM (SELECT DISTINCT id, question, answer, annotation_status FROM train_qa)""")
def merged_refinements(table):
    rows = table("train_qa").select("id", "question", "answer", "annotation_status").distinct()
    even = rows.select("id").distinct().filter(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 2 == 0)
    refined = even.select("id", F.concat(F.lit("What is asked under "), F.col("id"), F.lit("?")).alias("question"), F.lit("refined").alias("answer"))
    return generation.merged(rows, refined)


@query("""SELECT id, epoch_us(updated_at) AS updated_us, answers[1] AS first_reply FROM train_qa WHERE len(answers) >= 1 AND answers[1] IS NOT NULL""")
def parsed_replies(table):
    """Replies in a code fence, built from the pairs and parsed again."""
    rows = table("train_qa").filter((F.size("answers") >= 1) & F.get("answers", F.lit(0)).isNotNull())
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("id").alias("chunk_id"), F.get("answers", F.lit(0)).alias("answer"))).alias("items"))), F.lit("\n```"))
    items = T.json_of_reply(reply, "items array<struct<chunk_id:string,answer:string>>")["items"]
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), F.get(items, F.lit(0))["answer"].alias("first_reply"))


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE category WHEN 'tuition' THEN 0 WHEN 'admission' THEN 1 WHEN 'academic_program' THEN 2 ELSE 9 END, doc_id)::BIGINT AS place FROM documents QUALIFY place <= 100")
def priority_documents(table):
    """The hundred documents that come first: a top-k report by category, then id."""
    rank = F.when(F.col("category") == "tuition", 0).when(F.col("category") == "admission", 1).when(F.col("category") == "academic_program", 2).otherwise(9)
    top = table("documents").select("doc_id", rank.alias("r")).orderBy("r", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("r", "doc_id")).cast("long").alias("place"))


@query("""SELECT count(*) AS documents, count(DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))) AS domains, (SELECT list(url ORDER BY url) FROM (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL ORDER BY url LIMIT 800)) AS urls FROM documents""")
def crawl_manifest(table):
    return corpus.manifest(table("documents"))


@query()
def refreshed_documents(table):
    return corpus.refreshed(table("documents"), table("train_qa"))


@query()
def repaired_titles(table):
    return corpus.repaired_titles(table("documents")).select("doc_id", "title", "category")


@query("SELECT id, updated_us, kind, n FROM (SELECT id, epoch_us(updated_at) AS updated_us, 'question' AS kind, len(list_filter(regexp_split_to_array(trim(question, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))::INTEGER AS n FROM train_qa WHERE question IS NOT NULL)")
def question_lengths(table):
    rows = table("train_qa").filter(F.col("question").isNotNull())
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), F.lit("question").alias("kind"), T.word_count(F.col("question")).alias("n"))
