"""Queries over retrieval, reading and scoring. Stated query sets are the rows whose id number is divisible by 50, of train_qa those of the test split."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import metrics
from papyrine.functions import text as T
from papyrine.operators import chunking, evaluation, reader, retrieval
from papyrine.plans.data_queries import WORDS_SQL
from papyrine.plans.registry import query
from papyrine.plans.text_queries import fold_sql, label_sql, normal_sql, sentences_sql, terms_sql, tokens_sql
from papyrine.runtime import BROADCAST_ROWS, cut


def _questions(table):
    """(qid, question, text) of the test questions whose number is divisible by 50, one per id."""
    rows = table("train_qa").filter((F.col("split") == "test") & (F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 50 == 0) & F.col("question").isNotNull())
    return rows.groupBy(F.col("id").alias("qid")).agg(F.min("question").alias("question")).withColumn("text", F.col("question"))


def _corpus(table, facts: bool = True):
    return retrieval.corpus(table("chunks"), table("train_qa"), facts=facts)


def _retrieved(table, k: int = 8):
    passages = retrieval.stored(_corpus(table))
    questions = cut(_questions(table))
    found = cut(retrieval.search_passages(questions.select("qid", "text"), passages, k))
    near = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return questions.select("qid", "question"), cut(passages.join(near, "chunk_id").select("qid", "rank", "chunk_id", "score", "source", "title", "url", "text"))


QUESTIONS_SQL = "questions AS (SELECT id AS qid, min(question) AS text FROM train_qa WHERE split = 'test' AND regexp_extract(id, '(\\d+)$', 1)::BIGINT % 50 = 0 AND question IS NOT NULL GROUP BY id)"
CORPUS_SQL = """corpus AS (SELECT chunk_id, 'corpus_chunk' AS source, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(title, '') || chr(10) || coalesce(text, '') AS text FROM chunks
UNION ALL SELECT id, 'train_fact', coalesce(arg_max(source_title, updated_at), ''), coalesce(arg_max(source_url, updated_at), ''), 'Question: ' || any_value(question) || ' Answer: ' || any_value(coalesce(nullif(answer, ''), array_to_string(answers, '; '), CASE WHEN answers IS NOT NULL THEN '' END)) || '.'
FROM train_qa WHERE split = 'train' AND question IS NOT NULL AND coalesce(nullif(answer, ''), array_to_string(answers, '; '), CASE WHEN answers IS NOT NULL THEN '' END) IS NOT NULL GROUP BY id)"""


def search_sql(passages: str, k: int) -> str:
    return f"""postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({terms_sql('text')}) AS term FROM {passages}) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM {passages} WHERE text IS NOT NULL), idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1.0 AS idf FROM postings GROUP BY term),
raw AS (SELECT chunk_id, term, idf, (1.0 + ln(tf)) * idf AS w FROM postings JOIN idf USING (term)), norm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY chunk_id),
asked AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({terms_sql('text')}) AS term FROM questions) GROUP BY ALL),
q AS (SELECT qid, term, (1.0 + ln(tf)) * idf AS w FROM asked JOIN idf USING (term)), qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM q GROUP BY qid),
scores AS (SELECT qid, chunk_id, round(sum(q.w / qn.norm * raw.w / norm.norm), 6) AS score FROM q JOIN qn USING (qid) JOIN raw USING (term) JOIN norm USING (chunk_id) GROUP BY ALL),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank, chunk_id, score FROM scores QUALIFY rank <= {k})"""


@query(f"WITH {QUESTIONS_SQL}, {CORPUS_SQL}, {search_sql('corpus', 8)} SELECT * FROM ranked")
def tfidf_topk(table):
    questions = cut(_questions(table))
    return retrieval.search_passages(questions.select("qid", "text"), retrieval.stored(_corpus(table).select("chunk_id", "text")), 8)


@query("""WITH q AS (SELECT 'none' AS qid) SELECT qid, row_number() OVER (ORDER BY chunk_id)::INTEGER AS rank, chunk_id, 0.0::DOUBLE AS score FROM q, (SELECT DISTINCT chunk_id FROM chunks WHERE regexp_matches(strip_accents(lower(coalesce(text, ''))), '[a-z0-9][a-z0-9_.-]+') ORDER BY chunk_id LIMIT 8)""")
def tfidf_no_match(table):
    """A question without any known term gets the first passages."""
    passages = table("chunks").select("chunk_id", "text")
    asked = passages.limit(1).select(F.lit("none").alias("qid"), F.lit("§ §").alias("text"))
    return retrieval.search(asked, retrieval.tfidf(passages), 8)


@query(f"WITH {CORPUS_SQL} SELECT source, count(*) AS passages, sum(length(text)) AS chars FROM corpus GROUP BY source")
def corpus_union(table):
    return _corpus(table).groupBy("source").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query("""SELECT qid, rank, vec_id, score FROM (SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id DESC)::INTEGER AS rank,
b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 8""")
def dense_topk(table):
    vectors = table("embeddings")
    return retrieval.dense_search(vectors.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "qid"), vectors, 8)


@query(f"SELECT vec_id, list_transform({_UNIT}, lambda x: round(x, 6)) AS embedding FROM embeddings")
def unit_vectors(table):
    return table("embeddings").select("vec_id", F.transform(retrieval.unit("embedding"), lambda x: F.round(x, 6)).alias("embedding"))


@query("""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, list(x ORDER BY d) AS embedding FROM (SELECT label, d, avg(x) AS x FROM p GROUP BY ALL) GROUP BY label)
SELECT label, list_transform(embedding, lambda x: round(x / sqrt(list_sum(list_transform(embedding, lambda y: y * y))), 6)) AS embedding FROM m""")
def mean_vectors(table):
    return retrieval.mean_pool(table("embeddings"), "label").select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def keyword_sql(q: str, t: str) -> str:
    return f"(SELECT coalesce(sum(CASE WHEN c > 0 THEN 1 + ln(c) ELSE 0 END), 0.0) FROM (SELECT len(list_filter({t}, lambda x: x = w)) AS c FROM (SELECT unnest(list_distinct({q})) AS w)))"


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, round(list_sum(list_transform(list_distinct(q), lambda w: CASE WHEN len(list_filter(t, lambda x: x = w)) > 0 THEN 1 + ln(len(list_filter(t, lambda x: x = w))) ELSE 0.0 END)), 6) AS score FROM (SELECT id, updated_at, {tokens_sql('question')} AS q, {tokens_sql('evidence')} AS t FROM train_qa WHERE question IS NOT NULL AND evidence IS NOT NULL)")
def keyword_scores(table):
    rows = table("train_qa").filter(F.col("question").isNotNull() & F.col("evidence").isNotNull())
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), F.round(metrics.keyword_score(T.tokens(F.col("question")), T.tokens(F.col("evidence"))), 6).alias("score"))


@query(f"""WITH {QUESTIONS_SQL}, {CORPUS_SQL}, {search_sql('corpus', 8)},
s AS (SELECT qid, rank, score, question, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT r.qid, r.rank, r.score, questions.text AS question, {sentences_sql('corpus.text')} AS s FROM ranked r JOIN corpus USING (chunk_id) JOIN questions ON questions.qid = r.qid)),
t AS (SELECT qid, rank, pos, sentence, score, {tokens_sql('question')} AS q, {tokens_sql('sentence')} AS t FROM s),
k AS (SELECT qid, rank, pos, sentence, {fold_sql('sentence')} AS fold, round(score + coalesce(list_sum(list_transform(list_distinct(q), lambda w: CASE WHEN len(list_filter(t, lambda x: x = w)) > 0 THEN 1 + ln(len(list_filter(t, lambda x: x = w))) ELSE 0.0 END)), 0), 6) AS score FROM t),
d AS (SELECT * FROM k WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid, fold ORDER BY score DESC, rank, pos) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos)::INTEGER AS place, sentence, score FROM d QUALIFY place <= 8""")
def best_sentences(table):
    questions, found = _retrieved(table)
    return reader.best_sentences(questions, found)


@query()
def answer_cascade(table):
    return reader.answers(*_retrieved(table))


@query()
def rule_candidates(table):
    questions, found = _retrieved(table, 12)
    return reader.best_candidate(reader.candidates(questions, found, least=0.25))


@query(f"""WITH {QUESTIONS_SQL}, {CORPUS_SQL}, {search_sql('corpus', 8)}, f AS (SELECT qid, rank, text, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ranked JOIN corpus USING (chunk_id))
SELECT qid, string_agg(substring(text, 1, 2200 - before), chr(10) ORDER BY rank) AS context FROM f WHERE before < 2200 GROUP BY qid""")
def reader_context(table):
    return reader.context(_retrieved(table)[1])


@query()
def retrieval_trace(table):
    from papyrine.sources import files

    questions, found = _retrieved(table)
    return files.nested(found, reader.answers(questions, found)).select("qid", "answer", F.to_json("retrieved").alias("retrieved"))


@query(f"""SELECT id, epoch_us(updated_at) AS updated_us, nullif(trim(regexp_replace(coalesce(nullif(regexp_extract(evidence, '(?i)\\b\\d{{1,2}}(?:\\.\\d{{1,2}})?\\s+points\\b', 0), ''), nullif(regexp_extract(evidence, '(?i)\\b\\d{{1,2}}\\.\\d{{1,2}}\\b', 0), '')), '\\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '"''`.,;:'), '') AS answer FROM train_qa
WHERE evidence IS NOT NULL AND question_type = 'score' AND qa_language = 'en'""")
def typed_score_answers(table):
    rows = table("train_qa").filter(F.col("evidence").isNotNull() & (F.col("question_type") == "score") & (F.col("qa_language") == "en"))
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), reader.typed_answer(F.col("question"), F.col("evidence"), F.lit("score")).alias("answer"))


@query()
def named_answers(table):
    rows = table("train_qa").filter(F.col("evidence").isNotNull() & (F.col("question_type") == "decision"))
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), reader.named_answer(F.col("question"), F.col("evidence")).alias("answer"))


@query("""SELECT p1.p_partkey AS partkey, CASE WHEN p1.p_size >= p2.p_size THEN 'part ' || p1.p_partkey ELSE 'part ' || p2.p_partkey END AS answer
FROM part p1 JOIN part p2 ON p2.p_partkey = p1.p_partkey + 1 WHERE p1.p_size <> p2.p_size""")
def compared_options(table):
    """Which of two neighbouring parts is larger, read out of made sentences."""
    a, b = (table("part").select(F.col("p_partkey").alias(f"{x}k"), F.col("p_size").alias(f"{x}s")) for x in "ab")
    rows = a.join(b, F.col("bk") == F.col("ak") + 1).filter(F.col("as") != F.col("bs"))
    question = F.format_string("Between part %d and part %d, which one has the higher size?", F.col("ak"), F.col("bk"))
    text = F.format_string("The size of part %d is given as %d units. The size of part %d is given as %d units.", F.col("ak"), F.col("as"), F.col("bk"), F.col("bs"))
    return rows.select(F.col("ak").alias("partkey"), reader.compared_option(question, text).alias("answer"))


@query("""WITH s AS (SELECT vec_id AS qid, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), x AS (SELECT qid, i, j, round(a[i] + b[j], 6) AS score FROM s, range(1, 33) r(i), range(1, 33) t(j) WHERE i <= j AND j - i < 24)
SELECT qid, (i - 1)::INTEGER AS start, (j - 1)::INTEGER AS "end", score FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, i, j) = 1""")
def span_argmax(table):
    """The best span, with the halves of a vector as start and end logits."""
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    logits = table("embeddings").select(F.col("vec_id").alias("qid"), half(1).alias("start_logits"), half(33).alias("end_logits"))
    return reader.best_spans(logits, keep=32)


ANNOTATED_SQL = """annotated AS (SELECT 'a' AS system, * FROM annotator_a UNION ALL SELECT 'b', * FROM annotator_b UNION ALL SELECT 'more', * FROM annotator_more),
predictions AS (SELECT DISTINCT system, id, annotator_id, trim(coalesce(annotator_answer, ''), ' ') AS prediction FROM annotated WHERE annotator_id IS NOT NULL),
refs AS (SELECT id, array_to_string(any_value(answers), ';') AS r FROM train_qa WHERE answers IS NOT NULL GROUP BY id),
paired AS (SELECT p.*, coalesce(r, '') AS r FROM predictions p JOIN refs USING (id)),
alternatives AS (SELECT system, id, annotator_id, prediction, trim(unnest(string_split(r, ';')), ' ') AS ref FROM paired),
bags AS (SELECT *, list_filter(string_split(pn, ' '), lambda w: w <> '') AS p, list_filter(string_split(rn, ' '), lambda w: w <> '') AS g FROM (SELECT *, """ + normal_sql("prediction") + " AS pn, " + normal_sql("ref") + """ AS rn FROM alternatives WHERE ref <> '')),
shared AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS s FROM bags),
each AS (SELECT system, id, annotator_id, prediction, CASE WHEN pn = rn THEN 1.0 ELSE 0.0 END AS em, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR s = 0 THEN 0.0
ELSE 2 * (s / len(p)) * (s / len(g)) / ((s / len(p)) + (s / len(g))) END AS f1 FROM shared),
best AS (SELECT p.system, p.id, p.annotator_id, p.prediction, coalesce(max(em), 0.0) AS em, coalesce(max(f1), 0.0) AS f1 FROM paired p LEFT JOIN each e USING (system, id, annotator_id, prediction) GROUP BY ALL)"""


def _predictions(table):
    rows = None
    for name, system in (("annotator_a", "a"), ("annotator_b", "b"), ("annotator_more", "more")):
        part = table(name).select(F.lit(system).alias("system"), "id", "annotator_id", F.trim(F.coalesce("annotator_answer", F.lit(""))).alias("prediction"))
        rows = part if rows is None else rows.unionByName(part)
    refs = table("train_qa").filter(F.col("answers").isNotNull()).groupBy("id").agg(F.first(F.array_join("answers", ";")).alias("references"))
    return rows.filter(F.col("annotator_id").isNotNull()).distinct().join(refs, "id")


@query(f"WITH {ANNOTATED_SQL} SELECT system, id, annotator_id, prediction, em, round(f1, 6) AS f1 FROM best")
def answer_scores(table):
    return evaluation.scored(_predictions(table)).select("system", "id", "annotator_id", "prediction", "em", F.round("f1", 6).alias("f1"))


@query(f"WITH {ANNOTATED_SQL} SELECT system, count(*) AS examples, round(avg(em) * 100, 4) AS exact_match, round(avg(f1) * 100, 4) AS token_f1, round(avg(CASE WHEN f1 > 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS answer_recall FROM best GROUP BY system")
def system_comparison(table):
    return evaluation.comparison(_predictions(table))


def _latest(table, name):
    from papyrine.operators.corpus import latest

    return latest(table(name), ["id"], ["labelled_at"])


IAA_SQL = """la AS (SELECT id, question, annotator_answer, notes FROM annotator_a QUALIFY row_number() OVER (PARTITION BY id ORDER BY labelled_at DESC NULLS LAST, question DESC NULLS LAST, annotator_answer DESC NULLS LAST, notes DESC NULLS LAST, annotator_id DESC NULLS LAST) = 1),
lb AS (SELECT id, question, annotator_answer, notes FROM annotator_b QUALIFY row_number() OVER (PARTITION BY id ORDER BY labelled_at DESC NULLS LAST, question DESC NULLS LAST, annotator_answer DESC NULLS LAST, notes DESC NULLS LAST, annotator_id DESC NULLS LAST) = 1),
al AS (SELECT la.id, la.question, trim(coalesce(la.annotator_answer, ''), ' ') AS a, trim(coalesce(lb.annotator_answer, ''), ' ') AS b, trim(coalesce(la.notes, ''), ' ') AS notes_a, trim(coalesce(lb.notes, ''), ' ') AS notes_b FROM la JOIN lb USING (id)),
no AS (SELECT *, """ + label_sql("a") + " AS na, " + label_sql("b") + """ AS nb FROM al),
bg AS (SELECT *, list_filter(string_split(na, ' '), lambda w: w <> '') AS p, list_filter(string_split(nb, ' '), lambda w: w <> '') AS g FROM no),
sh AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS s FROM bg),
fs AS (SELECT *, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR s = 0 THEN 0.0 ELSE 2 * (s / len(p)) * (s / len(g)) / ((s / len(p)) + (s / len(g))) END AS f1 FROM sh)"""


@query(f"""WITH {IAA_SQL} SELECT count(*) AS item_count, count_if(a = '' OR b = '') AS blank_answer_count, count_if(na = nb) AS exact_agreement_count, count_if(f1 >= 0.8) AS soft_agreement_count, round(avg(f1), 6) AS mean_token_f1,
round(count_if(na = nb) / count(*), 6) AS exact_agreement, round(count_if(f1 >= 0.8) / count(*), 6) AS soft_agreement, count(*) - count_if(na = nb) AS disagreement_count FROM fs""")
def annotator_agreement(table):
    return evaluation.agreement(evaluation.aligned(_latest(table, "annotator_a"), _latest(table, "annotator_b")))


@query(f"WITH {IAA_SQL} SELECT id, question, a AS annotator_a_answer, b AS annotator_b_answer, na AS normalized_a, nb AS normalized_b, printf('%.4f', f1) AS token_f1, notes_a, notes_b FROM fs WHERE na <> nb")
def annotator_disagreements(table):
    return evaluation.disagreements(evaluation.aligned(_latest(table, "annotator_a"), _latest(table, "annotator_b")))


@query("""SELECT count_if(b.id IS NULL)::BIGINT AS only_a, count_if(a.id IS NULL)::BIGINT AS only_b, count_if(a.id IS NOT NULL AND b.id IS NOT NULL AND a.question IS DISTINCT FROM b.question)::BIGINT AS other_question
FROM (SELECT id, arg_max(question, labelled_at) AS question FROM annotator_a GROUP BY id) a FULL JOIN (SELECT id, arg_max(question, labelled_at) AS question FROM annotator_b GROUP BY id) b ON a.id = b.id""")
def annotator_alignment(table):
    return evaluation.alignment(_latest(table, "annotator_a"), _latest(table, "annotator_b"))


@query("""WITH p AS (SELECT DISTINCT id, source_id, question, answer FROM train_qa), j AS (SELECT p.id, c.chunk_id, c.chunk_index, CASE WHEN contains(lower(coalesce(c.text, '')), lower(coalesce(answer, chr(1)))) AND contains(lower(coalesce(c.text, '')), lower(coalesce(question, chr(1)))) THEN 0 WHEN contains(lower(coalesce(c.text, '')), lower(coalesce(answer, chr(1)))) THEN 1 ELSE 2 END AS r
FROM p LEFT JOIN chunks c ON c.document_id = p.source_id) SELECT id, arg_min(chunk_id, (r, chunk_index, chunk_id)) AS chunk_id FROM j GROUP BY id""")
def chunk_of_answer(table):
    return chunking.with_answer(table("train_qa").select("id", "source_id", "question", "answer").distinct(), table("chunks"))


_SENTENCE_WORDS = WORDS_SQL.replace("text", "lower(sentence)")
_CHUNK_WORDS = WORDS_SQL.replace("text", "lower(text)")


@query(f"""WITH p AS (SELECT DISTINCT id, source_id, evidence AS sentence FROM train_qa WHERE evidence IS NOT NULL), j AS (SELECT p.id, c.chunk_id, c.chunk_index, coalesce(contains(c.text, substring(sentence, 1, 80)), false) AS hit,
CASE WHEN c.text IS NULL THEN 0 ELSE len(list_intersect(list_distinct(({_SENTENCE_WORDS})[1:20]), list_distinct({_CHUNK_WORDS}))) END AS shared FROM p LEFT JOIN chunks c ON c.document_id = p.source_id)
SELECT id, CASE WHEN hit OR shared > 0 THEN chunk_id END AS chunk_id FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE shared END DESC, chunk_index, chunk_id DESC) = 1""")
def chunk_of_sentence(table):
    rows = table("train_qa").filter(F.col("evidence").isNotNull()).select("id", "source_id", F.col("evidence").alias("sentence")).distinct()
    return chunking.with_sentence(rows, table("chunks"))


def _predictions_of(questions, found):
    """What a reader would say: the typed answer of each passage, with its length as raw score."""
    rows = found.join(questions, "qid")
    said = rows.select("qid", "rank", F.explode(F.array(reader.typed_answer(F.col("question"), F.col("text")))).alias("answer"))
    return said.filter(F.col("answer").isNotNull()).withColumn("raw", 1.0 / (1 + F.length("answer")))


@query()
def model_answers(table):
    questions, found = _retrieved(table)
    return reader.model_answers(questions, found, _predictions_of(questions, found))


@query()
def reranked_answers(table):
    questions, found = _retrieved(table, 12)
    return reader.reranked(questions, found, _predictions_of(questions, found))


def _letters(texts):
    """An encoder: counts of letters."""
    import numpy as np

    return np.array([[t.lower().count(c) for c in "abcdefgh"] for t in texts], dtype=float).reshape(len(texts), 8)


def letters_sql(c: str) -> str:
    """Unit counts of the letters a to h, in single precision as an encoder gives them."""
    counts = f"list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda x: length(lower({c})) - length(replace(lower({c}), x, '')))"
    return f"list_transform({counts}, lambda n: (n::FLOAT / (CASE WHEN list_sum({counts}) = 0 THEN 1 ELSE sqrt(list_sum(list_transform({counts}, lambda m: m * m))) END)::FLOAT)::FLOAT)"


@query(f"SELECT chunk_id, {letters_sql("('passage: ' || coalesce(text, ''))")} AS embedding FROM chunks")
def encoded_passages(table):
    """Passages under an injected encoder, here counts of letters."""
    return retrieval.embedded(table("chunks").select("chunk_id", "text"), _letters, prefix="passage: ")


@query(f"""WITH {QUESTIONS_SQL}, {CORPUS_SQL}, {search_sql('corpus', 8)}, lexical AS (SELECT qid, chunk_id, sum(q.w / qn.norm * raw.w / norm.norm) AS l FROM q JOIN qn USING (qid) JOIN raw USING (term) JOIN norm USING (chunk_id) GROUP BY ALL),
pv AS (SELECT chunk_id, {letters_sql("('passage: ' || coalesce(text, ''))")} AS v FROM corpus), qv AS (SELECT qid, {letters_sql("('query: ' || text)")} AS v FROM questions),
mixed AS (SELECT qv.qid, pv.chunk_id, round(0.7 * list_inner_product(qv.v::DOUBLE[], pv.v::DOUBLE[]) + (1 - 0.7) * coalesce(l, 0), 6) AS score FROM qv CROSS JOIN pv LEFT JOIN lexical ON lexical.qid = qv.qid AND lexical.chunk_id = pv.chunk_id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank, chunk_id, score FROM mixed QUALIFY rank <= 12""")
def hybrid_topk(table):
    """The best passages by dense and lexical scores together, over all passages, with counts of letters as vectors."""
    questions = cut(_questions(table))
    passages = retrieval.stored(retrieval.embedded(_corpus(table), _letters, prefix="passage: ", keep=("text",)))
    asked = cut(retrieval.embedded(questions, _letters, key="qid", prefix="query: ", keep=("text",)))
    return retrieval.hybrid_passages(asked, passages, 12)
