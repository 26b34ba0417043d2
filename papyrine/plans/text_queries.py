"""Queries over text functions and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import classify, html
from papyrine.functions import text as T
from papyrine.plans.registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def fold_sql(c: str, stroke: bool = False) -> str:
    out = f"strip_accents(lower({c}))"
    return f"translate({out}, 'đ', 'd')" if stroke else out


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all({fold_sql(c)}, '[a-z0-9]+'), lambda x: x NOT IN ({STOP}))"


def terms_sql(c: str) -> str:
    w = f"regexp_extract_all({fold_sql(c, True)}, '[a-z0-9][a-z0-9_.-]*[a-z0-9_]')"
    return f"(SELECT CASE WHEN len(w) > 1 THEN list_concat(w, list_transform(list_zip(w[:len(w)-1], w[2:]), lambda p: p[1] || ' ' || p[2])) ELSE w END FROM (SELECT {w} AS w))"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ')"


def clean_answer_sql(c: str, prefixes: bool = True) -> str:
    trimmed = "' ' || chr(9) || chr(10) || chr(13) || '\"''`.,;:'"
    out = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), {trimmed})"
    if prefixes:
        out = f"regexp_replace({out}, '^(?i:answer|is|was|are|were)\\s*:\\s*', '')"
    return f"trim(substring({out}, 1, 220), {trimmed})"


def normal_sql(c: str) -> str:
    """Answers for scoring. Articles are dropped token by token, since RE2's word boundary is ASCII."""
    punct = T.PUNCTUATION.replace("'", "''")
    bare = f"translate(lower({c}), '{punct}', '')"
    return f"array_to_string(list_filter(string_split(regexp_replace({bare}, '\\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def label_sql(c: str) -> str:
    out = f"replace({fold_sql('trim(' + c + ')')}, '&', ' and ')"
    for _ in range(3):
        # no look-ahead in RE2: what follows the group of three digits is kept as it is
        out = f"regexp_replace({out}, '(\\d)[.,](\\d\\d\\d)(\\D|$)', '\\1\\2\\3', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\w]|_', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def entities_sql(c: str) -> str:
    for name, sign in T.ENTITIES:
        c = f"replace({c}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return c


def normalize_sql(c: str) -> str:
    out = f"replace({entities_sql(c)}, chr(160), ' ')"
    out = f"regexp_replace({out}, '(?m)^[ \\t]*[✯★☆✭✰][ \\t\\n\\x0b\\f\\r]*', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\r\\f\\x0b]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n[ \\t\\n\\x0b\\f\\r]*\\n+', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, ' *\\n *', chr(10), 'g')"
    return f"regexp_replace({out}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"


def sentences_sql(c: str) -> str:
    marked = f"regexp_replace(regexp_replace({c}, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    return f"list_transform(list_filter(string_split({marked}, chr(1)), lambda p: len(trim(p, ' ')) > 2), lambda p: trim(p, ' ' || chr(9) || ';:-'))"


@query(f"""SELECT domain, strip_accents(lower(institution_vi)) AS folded, strip_accents(institution_vi) AS cased,
translate(strip_accents(lower(institution_vi)), 'đ', 'd') AS plain FROM sites""")
def fold_variants(table):
    name = F.col("institution_vi")
    return table("sites").select("domain", T.ascii_fold(name).alias("folded"), T.ascii_fold(name, lower=False).alias("cased"), T.ascii_fold(name, stroke=True).alias("plain"))


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, {tokens_sql('question')} AS tokens FROM train_qa")
def question_tokens(table):
    return table("train_qa").select("id", F.unix_micros("updated_at").alias("updated_us"), T.tokens(F.col("question")).alias("tokens"))


@query(f"SELECT doc_id, md5({normalize_sql('text')}) AS normalized FROM documents")
def normalized_texts(table):
    return table("documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normalized"))


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace({fold_sql('l', True)}, '\\W+', '', 'g')), '|')) AS keys FROM documents""")
def line_keys(table):
    keys = F.transform(F.split("text", "\n", -1), T.line_key)
    return table("documents").select("doc_id", F.md5(F.array_join(keys, "|")).alias("keys"))


@query("""SELECT doc_id, md5(array_to_string(list_distinct_first, chr(10))) AS cleaned FROM (
SELECT doc_id, list_transform(list_filter(list_zip(ls, range(1, len(ls) + 1)), lambda p: list_position(ls, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_first FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(trim(regexp_replace(l, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '), ' -|' || chr(9))),
 lambda l: l <> '' AND NOT (len(l) <= 16 AND NOT regexp_matches(l, '[0-9]')) AND NOT (regexp_matches(lower(l), '^https?://\\S*$') AND len(l) < 100) AND NOT contains(lower(l), 'cookie') AND NOT contains(lower(l), 'copyright')) AS ls
FROM documents WHERE text IS NOT NULL))""")
def crawled_text(table):
    cleaned = T.clean_page(F.col("text"), boilerplate=("cookie", "copyright"))
    return table("documents").filter(F.col("text").isNotNull()).select("doc_id", F.md5(cleaned).alias("cleaned"))


@query(f"SELECT chunk_id, {collapse_sql('replace(text, chr(65533), chr(32) || chr(32))').replace('chr(32) || chr(32)', chr(39) * 2)} AS cleaned FROM chunks")
def generated_text(table):
    return table("chunks").select("chunk_id", T.clean_generated(F.col("text")).alias("cleaned"))


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, {clean_answer_sql('answer')} AS with_prefixes, {clean_answer_sql('answer', False)} AS plain FROM train_qa")
def cleaned_answers(table):
    return table("train_qa").select("id", F.unix_micros("updated_at").alias("updated_us"), T.clean_answer(F.col("answer")).alias("with_prefixes"), T.clean_answer(F.col("answer"), prefixes=False).alias("plain"))


@query(f"SELECT doc_id, len(s)::INTEGER AS sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentence_split(table):
    s = T.sentences(F.col("text"))
    return table("documents").filter(F.col("text").isNotNull()).select("doc_id", F.size(s).alias("sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, {normal_sql('answer')} AS scoring, {label_sql('answer')} AS agreement FROM train_qa WHERE answer IS NOT NULL")
def normalized_answers(table):
    rows = table("train_qa").filter(F.col("answer").isNotNull())
    return rows.select("id", F.unix_micros("updated_at").alias("updated_us"), T.normalize_answer(F.col("answer")).alias("scoring"), T.normalize_label(F.col("answer")).alias("agreement"))


FACT_SQL = f"""facts AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
FROM documents WHERE source_type = 'manual_qa_facts') WHERE starts_with(line, 'Fact '))"""


@query(
    f"""WITH {FACT_SQL} SELECT doc_id, line_no::INTEGER AS line_no,
nullif({clean_answer_sql("regexp_extract(line, '(?is)\\bQuestion:\\s*(.+?)\\s+Answer:\\s*', 1)")}, '') AS question,
nullif({clean_answer_sql("regexp_extract(line, '(?is)\\bAnswer:\\s*(.+?)(?:\\.\\s*$|\\n|$)', 1)")}, '') AS answer FROM facts"""
)
def fact_fields(table):
    docs = table("documents").filter(F.col("source_type") == "manual_qa_facts")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.col("line").startswith("Fact "))
    return rows.select("doc_id", "line_no", T.fact_question(F.col("line")).alias("question"), T.fact_answer(F.col("line")).alias("answer"))


@query(r"""SELECT doc_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
substring(coalesce(nullif(trim(regexp_replace(regexp_replace(translate(regexp_extract(rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '-_', '  '), '\.[A-Za-z0-9]+$', ''), '\s+', ' ', 'g'), ' '), ''),
 lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))), 1, 120) AS title FROM documents WHERE url IS NOT NULL""")
def url_titles(table):
    return table("documents").filter(F.col("url").isNotNull()).select("doc_id", T.host(F.col("url")).alias("host"), T.title_from_url(F.col("url")).alias("title"))


@query()
def url_headlines(table):
    return table("documents").select("doc_id", T.headline_from_url(F.col("url")).alias("headline"), T.compact_title(F.col("title")).alias("compact"), F.concat(T.host(F.col("url")), F.lit("/")).alias("root"))


@query(r"""SELECT doc_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/b.html' AS absolute, NULL::VARCHAR AS mail, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x?y=1' AS rooted FROM documents WHERE url IS NOT NULL""")
def url_normalized(table):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    link = lambda x: T.normalize_url(F.concat(base, F.lit("/a/c/d.html")), F.lit(x))
    return table("documents").filter(F.col("url").isNotNull()).select("doc_id", link("../b.html#top").alias("absolute"), link("mailto:x@y.z").alias("mail"), link("/x?y=1").alias("rooted"))


@query(r"""SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, length(coalesce(text, ''))::INTEGER AS char_count,
len(list_filter(regexp_split_to_array(trim(coalesce(text, ''), ' '), '[ \t\n\x0b\f\r]+'), lambda w: w <> ''))::INTEGER AS word_count FROM documents""")
def document_stats(table):
    text = F.coalesce("text", F.lit(""))
    return table("documents").select("doc_id", F.sha2(text, 256).alias("content_sha256"), F.length(text).alias("char_count"), T.word_count(text).alias("word_count"))


def _first_hit_sql(subject: str, rules) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({subject}, ' + chr(39) + t + chr(39) + ')' for t in terms)} THEN '{name}'" for name, terms in rules)
    return f"CASE {cases} ELSE 'general' END"


@query(
    f"""SELECT doc_id, {_first_hit_sql("folded", classify.CATEGORIES)} AS by_fold, {_first_hit_sql("raw", classify.RAW_CATEGORIES)} AS by_text FROM (SELECT doc_id,
{fold_sql("coalesce(url, '') || ' ' || substring(coalesce(text, ''), 1, 4000)", True)} AS folded,
lower(coalesce(url, '') || ' ' || coalesce(title, '') || ' ' || substring(coalesce(text, ''), 1, 1200)) AS raw FROM documents)"""
)
def categories(table):
    return table("documents").select("doc_id", classify.category(F.col("url"), F.col("text")).alias("by_fold"), classify.category_raw(F.col("url"), F.col("title"), F.col("text")).alias("by_text"))


_VI = " + ".join(f"CASE WHEN contains(o, '{t}') THEN 3 ELSE 0 END" for t in classify.VIETNAMESE)
_EN = " + ".join(f"CASE WHEN contains(p, ' {t} ') THEN 1 ELSE 0 END" for t in classify.ENGLISH)
_VC = " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)}.0" for t in classify.VIETNAMESE)
_EC = " + ".join(f"(length(low) - length(replace(low, ' {t} ', ''))) / {len(t) + 2}.0" for t in classify.ENGLISH)


@query(
    f"""SELECT doc_id, CASE WHEN vi > 8 AND en > 5 THEN 'mixed' WHEN vi > 8 THEN 'vi' ELSE 'en' END AS by_marker, CASE WHEN vc > ec + 2 THEN 'vi' ELSE 'en' END AS by_count FROM (
SELECT doc_id, length(regexp_replace(o, '[^àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]', '', 'g')) + {_VI} AS vi, {_EN} AS en, {_VC} AS vc, {_EC} AS ec FROM (
SELECT doc_id, o, low, ' ' || regexp_replace(o, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') || ' ' AS p FROM (SELECT doc_id, lower(substring(coalesce(text, ''), 1, 4000)) AS o, lower(coalesce(text, '')) AS low FROM documents)))"""
)
def marker_languages(table):
    return table("documents").select("doc_id", classify.marker_language(F.col("text")).alias("by_marker"), classify.counted_language(F.col("text")).alias("by_count"))


TOPICS = ("admission", "tuition", "programme", "chương trình")


@query(f"SELECT doc_id FROM documents WHERE {' OR '.join(f'contains(lower(coalesce(url, {chr(39) * 2}) || {chr(39)} {chr(39)} || substring(coalesce(text, {chr(39) * 2}), 1, 5000)), {chr(39)}{t}{chr(39)})' for t in TOPICS)}")
def relevant_documents(table):
    return table("documents").filter(classify.relevant(F.col("url"), F.col("text"), TOPICS)).select("doc_id")


@query(
    f"""WITH l AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
f AS (SELECT *, lower(trim(line, ' ')) AS low, {fold_sql("trim(line, ' ')", True)} AS folded FROM l), w AS (SELECT *, trim(regexp_replace(folded, '[^a-z0-9]+', ' ', 'g'), ' ') AS words FROM f)
SELECT doc_id, line_no::INTEGER AS line_no FROM w WHERE low = ''
OR coalesce(trim(title, ' ') <> '' AND regexp_replace({fold_sql('line', True)}, '\\W+', '', 'g') = regexp_replace({fold_sql('title', True)}, '\\W+', '', 'g'), false)
OR low IN ('menu', 'home', 'search', 'email', 'library') OR regexp_matches(low, '^\\d+\\s*\\.\\s+') OR length(line) - length(replace(line, '.', '')) >= 8 OR regexp_matches(low, 'https?://')
OR regexp_matches(folded, '\\d{{4}}-\\d{{2}}-\\d{{2}}t\\d{{2}}:\\d{{2}}:\\d{{2}}') OR regexp_matches(words, '^(?:nam )?(?:19|20)\\d{{2}}$')
OR contains(words, 'copyright') OR contains(words, 'read more') OR contains(words, 'related posts') OR contains(words, 'cookie')
OR (len(list_filter(regexp_split_to_array(trim(line, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) <= 3 AND NOT regexp_matches(line, '\\d{{4}}|[A-Z]{{3,}}'))
OR ({' + '.join(f"CASE WHEN contains(folded, '{t}') THEN 1 ELSE 0 END" for t in ('home', 'contact', 'news', 'library', 'careers', 'sitemap'))}) >= 3"""
)
def boilerplate_lines(table):
    rows = table("documents").select("doc_id", "title", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.filter(classify.boilerplate_line(F.col("line"), F.col("title"))).select("doc_id", "line_no")


def kind_sql(c: str) -> str:
    cases = []
    for kind, prefixes, parts in classify.KINDS:
        tests = [f"starts_with({c}, '{p}')" for p in prefixes] + [f"contains({c}, '{p}')" for p in parts]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'entity' END"


def fine_sql(c: str) -> str:
    return f"CASE {' '.join(f'WHEN regexp_matches({c}, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, p in classify.FINE_KINDS)} ELSE 'entity' END"


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, {kind_sql('lower(question)')} AS kind, {fine_sql('lower(question)')} AS fine FROM train_qa")
def question_kinds(table):
    return table("train_qa").select("id", F.unix_micros("updated_at").alias("updated_us"), classify.question_kind(F.col("question")).alias("kind"), classify.fine_kind(F.col("question")).alias("fine"))


@query(
    f"""WITH k AS (SELECT DISTINCT {kind_sql('lower(question)')} AS kind FROM train_qa)
SELECT a.kind AS wanted, b.kind AS offered, a.kind = b.kind OR (a.kind = 'count' AND b.kind = 'quota') OR (a.kind = 'entity' AND b.kind NOT IN ('tuition', 'score', 'quota', 'duration')) AS compatible FROM k a CROSS JOIN k b"""
)
def compatible_kinds(table):
    kinds = table("train_qa").select(classify.question_kind(F.col("question")).alias("kind")).distinct()
    offered = kinds.agg(F.collect_set("kind").alias("all"))  # as many as there are kinds
    rows = kinds.withColumn("one", F.lit(1)).join(F.broadcast(offered.withColumn("one", F.lit(1))), "one").select(F.col("kind").alias("wanted"), F.explode("all").alias("offered"))
    return rows.withColumn("compatible", classify.compatible(F.col("wanted"), F.col("offered")))


_INVALID = """(answer = '' OR CASE kind WHEN 'program' THEN regexp_matches(lower(answer), '[0-9]|points|vnd|tuition|semester|year')
WHEN 'location' THEN len(list_filter(regexp_split_to_array(trim(answer, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) > 5 OR contains(lower(answer), 'university')
WHEN 'subjects' THEN NOT regexp_matches(lower(answer), '\\b(mathematics|literature|english|history|geography|physics|chemistry|biology)\\b')
WHEN 'degree' THEN NOT contains(lower(answer), 'degree') AND NOT contains(lower(answer), 'engineer') AND NOT contains(lower(answer), 'bachelor')
WHEN 'score' THEN NOT regexp_matches(answer, '[0-9]') WHEN 'tuition' THEN NOT regexp_matches(answer, '[0-9]') WHEN 'count' THEN NOT regexp_matches(answer, '[0-9]')
WHEN 'duration' THEN NOT regexp_matches(answer, '[0-9]') WHEN 'date' THEN NOT regexp_matches(answer, '[0-9]')
WHEN 'url' THEN NOT starts_with(lower(answer), 'http://') AND NOT starts_with(lower(answer), 'https://') WHEN 'yesno' THEN lower(answer) NOT IN ('yes', 'no') ELSE false END)"""
#: Questions whose kinds reach every branch, beside those of the table.
_ASKED = [("Does it offer a degree?", "Yes"), ("Does it rank higher?", "It does."), ("Which is higher, A or B?", "A"), ("Which of the majors pay most?", "Law"), ("Which program has it?", "30 points"), ("What are the subjects of A00?", "Mathematics; Physics"), ("Which combination counts?", "D01"), ("How long is the study period?", "four years"), ("When was it founded?", "in 1945"), ("What is the website?", "www.example.org"), ("What is the homepage?", "https://example.org"), ("Where is it?", "Hue"), ("In which city is the University?", "at the University of X"), ("What degree is given?", "Bachelor's degree"), ("What degree follows?", "a diploma"), ("What is it recognized as?", "a centre"), ("Who leads it?", ""), ("How many sites are there?", "several")]
_ASKED_SQL = "SELECT 'made_' || i AS id, NULL::TIMESTAMP AS updated_at, q AS question, a AS answer FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, q, a.replace("'", "''")) for i, (q, a) in enumerate(_ASKED)) + ") v(i, q, a)"


def _asked(table):
    rows = table("train_qa").filter(F.col("answer").isNotNull()).select("id", F.unix_micros("updated_at").alias("updated_us"), "question", "answer")
    made = rows.sparkSession.createDataFrame([(f"made_{i}", None, q, a) for i, (q, a) in enumerate(_ASKED)], "id string, updated_us long, question string, answer string")
    return rows.unionByName(made)


@query(
    f"""SELECT id, epoch_us(updated_at) AS updated_us, kind, {_INVALID} AS invalid, CASE WHEN {_INVALID} THEN -8.0 WHEN kind IN ('program', 'degree', 'subjects', 'location', 'yesno') THEN 3.0
WHEN kind IN ('score', 'tuition', 'count', 'duration', 'date') THEN 2.0 ELSE 0.0 END AS bonus
FROM (SELECT id, updated_at, answer, {fine_sql('lower(question)')} AS kind FROM (SELECT id, updated_at, question, answer FROM train_qa WHERE answer IS NOT NULL UNION ALL {_ASKED_SQL}))"""
)
def answer_validity(table):
    rows = _asked(table).withColumn("kind", classify.fine_kind(F.col("question")))
    return rows.select("id", "updated_us", "kind", classify.invalid_for_kind(F.col("answer"), F.col("kind")).alias("invalid"), classify.kind_bonus(F.col("answer"), F.col("kind")).alias("bonus"))


@query(
    f"""SELECT id, epoch_us(updated_at) AS updated_us, CASE WHEN kind = 'location' AND regexp_matches(answer, '(?i)\\bHue\\b') THEN 'Hue' WHEN kind = 'degree' AND regexp_matches(answer, '(?i)\\bBachelor(''s)?\\s+degree\\b') THEN 'Bachelor degree'
WHEN kind = 'degree' AND regexp_matches(answer, '(?i)\\bEngineer(ing)?\\s+degree\\b') THEN 'Engineer degree' ELSE {clean_answer_sql('answer')} END AS answer
FROM (SELECT id, updated_at, answer, {fine_sql('lower(question)')} AS kind FROM (SELECT id, updated_at, question, answer FROM train_qa WHERE answer IS NOT NULL UNION ALL {_ASKED_SQL}))"""
)
def canonical_answers(table):
    rows = _asked(table)
    return rows.select("id", "updated_us", classify.normalized_for_kind(F.col("answer"), classify.fine_kind(F.col("question")), places=("Hue",)).alias("answer"))


@query(
    f"""WITH k AS (SELECT DISTINCT {fine_sql('lower(question)')} AS kind FROM ({_ASKED_SQL}))
SELECT a.kind AS wanted, b.kind AS offered, CASE WHEN a.kind = b.kind THEN true WHEN a.kind IN ('program', 'description') THEN b.kind IN ('entity', 'description') WHEN a.kind = 'entity' THEN b.kind NOT IN ('tuition', 'score', 'count', 'duration') ELSE false END AS compatible FROM k a, k b"""
)
def compatible_fine_kinds(table):
    """All pairs of the kinds of a fixed list of questions, as many as there are kinds."""
    kinds = table("train_qa").sparkSession.createDataFrame([(q,) for q, _ in _ASKED], "question string").select(classify.fine_kind(F.col("question")).alias("kind")).distinct()
    offered = kinds.agg(F.collect_set("kind").alias("all"))
    rows = kinds.withColumn("one", F.lit(1)).join(F.broadcast(offered.withColumn("one", F.lit(1))), "one").select(F.col("kind").alias("wanted"), F.explode("all").alias("offered"))
    return rows.withColumn("compatible", classify.compatible_fine(F.col("wanted"), F.col("offered")))


@query(
    r"""WITH h AS (SELECT url, epoch_us(fetched_at) AS fetched_us, try(decode(body)) AS html FROM fetched_resources WHERE body IS NOT NULL AND status = 'ok' AND content_type IN ('text/html', 'text/html; charset=utf-8'))
SELECT url, fetched_us, trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), '?'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS title, count(*) AS n
FROM h WHERE html IS NOT NULL AND NOT contains(html, '&') GROUP BY ALL"""
)
def html_titles(table):
    """Titles of fetches that are declared or taken as UTF-8, by the pattern rules (entities apart)."""
    pages = table("fetched_resources").filter(F.col("body").isNotNull() & (F.col("status") == "ok") & F.col("content_type").isin("text/html", "text/html; charset=utf-8"))
    page = pages.select("url", F.unix_micros("fetched_at").alias("fetched_us"), html.decoded(F.col("body"), F.col("content_type")).alias("html"), F.is_valid_utf8(F.col("body").cast("string")).alias("valid"))
    good = page.filter(F.col("valid") & ~F.col("html").contains("&"))
    return good.groupBy("url", "fetched_us", F.substring(html.title(F.col("html"), F.lit("?"), most=10_000), 1, 10_000).alias("title")).agg(F.count("*").alias("n"))


@query()
def html_pages(table):
    pages = table("fetched_resources").filter(F.col("body").isNotNull() & F.col("content_type").startswith("text/html"))
    page = html.decoded(F.col("body"), F.col("content_type"))
    return pages.select("url", "fetched_at", html.title(page, T.title_from_url(F.col("url"))).alias("title"), html.visible_text(page).alias("text"), F.size(html.links(page, F.col("url"))).alias("links"))
