"""Making question-answer data: candidates in sentences, questions, rubric, splits, and the exchange with a generator."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.runtime import cut

#: Typed answers in sentences, in the order in which they are looked for; a parameter of candidates().
TYPES = (
    ("date", r"\b\d{1,2} [A-Z][a-z]+ \d{4}\b"),
    ("percentage", r"\b\d+(?:\.\d+)? ?%"),
    ("money", r"\b\d+(?:[.,]\d+)* (?:million )?VND\b"),
    ("credits", r"\b\d+ credits\b"),
    ("points", r"\b\d+(?:\.\d+)? points\b"),
    ("duration", r"\b\d+(?:\.\d+)? (?:weeks|years|semesters|days|months)\b"),
    ("count", r"\b\d+ (?:students|people|listeners|places|projects|reports)\b"),
    ("code", r"\b[A-Z]\d{2}\b"),
    ("year", r"\b(?:19|20)\d{2}\b"),
    ("entity", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"),
)
BANNED = ("according to the text", "in the passage", "this document", "the above")


def candidates(sentences: DataFrame, *, types=TYPES) -> DataFrame:
    """(keys of sentences, answer_type, answer, place): typed answers of a column `sentence`, each once, the first wins."""
    def typed(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("sentence", F.lit(f"({pattern})")), lambda a: F.struct(F.lit(name).alias("answer_type"), a.alias("answer")))

    found = [typed(name, pattern) for name, pattern in types]
    keys = [c for c in sentences.columns if c != "sentence"]
    rows = sentences.select(*keys, "sentence", F.posexplode(F.concat(*found)).alias("place", "c")).select(*keys, "sentence", "place", "c.answer_type", "c.answer")
    once = Window.partitionBy(*keys, F.lower("answer")).orderBy("place")
    return rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")


#: Units of counts that stand for programmes. Fixed values.
PROGRAMME_UNITS = ("master", "doctor", "doctoral", "undergraduate")


def answer_unit(answer: Column, answer_type: Column) -> Column:
    """What a count counts: the unit its type names, else the words after its number; `credits`, else `items`."""
    unit = F.trim(F.regexp_extract(answer, r"(?s)^\d{1,4}(?:,\d{3})?\s+(.+)", 1))
    lettered = (F.upper(unit) == unit) & (F.lower(unit) != unit)
    named = F.when(lettered, F.lower(unit)).when(unit.isin(*PROGRAMME_UNITS), F.concat(unit, F.lit(" programs"))).otherwise(unit)
    return (
        F.when(answer_type.startswith("count:"), F.substring(answer_type, 7, 10_000))
        .when((answer_type == "count") & (unit != ""), named)
        .when(answer_type == "credits", "credits")
        .otherwise("items")
    )


def reference_answer(answer: Column, answer_type: Column) -> Column:
    """The bare number of a count or of credits; other answers stay."""
    count, credits = F.regexp_extract(answer, r"^(\d{1,4}(?:,\d{3})?)\s", 1), F.regexp_extract(answer, r"(?i)^(\d{1,3})\s+credits?", 1)
    return F.when((answer_type == "count") & (count != ""), count).when((answer_type == "credits") & (credits != ""), credits).otherwise(answer)


def without_navigation(sentence: Column, *, starts: tuple[str, ...], terms: tuple[str, ...] = (), least: int = 20, words: int = 12) -> Column:
    """A sentence without the navigation before its true beginning.

    `starts` are patterns of beginnings. The first one that is found beyond `least` signs, behind a navigation term or
    more than `words` words, cuts what stands before it; white space is collapsed, outer dashes go.
    """
    flat = T.collapse(sentence)
    out = flat
    for pattern in reversed(starts):
        at = F.regexp_instr(flat, F.lit(f"({pattern})"))
        prefix = F.substring(flat, F.lit(1), F.greatest(at - 1, F.lit(0)))
        hit = T.word_count(prefix) > words
        for t in terms:
            hit = hit | prefix.contains(t)
        out = F.when((at - 1 > least) & hit, F.substring(flat, at, F.length(flat))).otherwise(out)
    return F.btrim(out, F.lit(" -"))


def subject_of(sentence: Column, *, most: int = 13) -> Column:
    """What a sentence is about: the words before its first verb, as clean_subject() leaves them; at most `most` words."""
    head = F.regexp_extract(F.regexp_replace(sentence, r"^(?i:in|since|from|between|according to)\b[^,]{0,60},\s*", ""), r"^(.*?)\s+(?:is|are|was|were|has|have|had|will|shows?|covers?|must|may|can)\b", 1)
    return clean_subject(head, F.lit("this topic"), most=most)


def clean_subject(value: Column, fallback: Column, *, most: int = 13) -> Column:
    """A subject without short brackets, openers of time and manner and its article: its last `most` words.

    The fallback stands for pronouns and for less than three signs.
    """
    out = F.regexp_replace(value, r"\([^)]{0,80}\)", "")
    out = F.regexp_replace(out, r"^(?i:In|On|By|As of|Since)\s+[^,]{1,80},\s*", "")
    out = F.regexp_replace(out, r"^(?i:Every year|Currently|Presently|Besides|Moreover|Therefore),?\s*", "")
    out = F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ,.;:-"))
    words = F.split(F.regexp_replace(out, r"^(?i:the|a|an)\s+", ""), " ", -1)
    short = F.array_join(F.slice(words, F.greatest(F.size(words) - most + 1, F.lit(1)), F.lit(most)), " ")
    return F.when((F.length(short) < 3) | F.lower(short).isin("it", "they", "there", "this", "these", "those"), fallback).otherwise(short)


def question_for(answer_type: Column, subject: Column) -> Column:
    """A question of the type about the subject."""
    forms = {"date": "On what date is %s mentioned?", "year": "In what year is %s mentioned?", "count": "What number is given for %s?", "duration": "How long does %s take?", "money": "What sum is given for %s?", "entity": "Which name is linked with %s?"}
    out = F.format_string("What value is given for %s?", subject)
    for name, form in forms.items():
        out = F.when(answer_type == name, F.format_string(form, subject)).otherwise(out)
    return out


#: Openings of questions and what they are worth, first hit wins. Fixed values.
OPENINGS = (
    (20, ("When ", "In what year ", "How many ", "What rank ", "What percentage ", "What school code ", "Who ")),
    (16, ("What abbreviation ",)),
    (10, ("Which university ", "Which school ", "Which faculty ", "Which institute ", "Which center ", "Which program ", "Which organization ", "Which field ")),
)


def rubric(question: Column, question_type: Column, language: Column) -> Column:
    """An additive score of a pair: how it opens, a typed answer, English, vague forms, one question mark, length."""
    opening = F.lit(0)
    for worth, starts in reversed(OPENINGS):
        hit = F.lit(False)
        for start in starts:
            hit = hit | question.startswith(start)
        opening = F.when(hit, worth).otherwise(opening)
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    return (
        opening
        + F.when(F.split_part(question_type, F.lit(":"), F.lit(1)) != "entity", 12).otherwise(0)
        + F.when(language == "en", 4).otherwise(0)
        - F.when(question.contains(" is discussed in "), 8).otherwise(0)
        - F.when(question.startswith("Which acronym appears"), 12).otherwise(0)
        + F.when(marks == 1, 2).otherwise(0)
        - F.when(F.length(question) > 180, 4).otherwise(0)
    ).cast("int")


def best_rows(rows: DataFrame, score: Column, order: list[Column], n: int) -> DataFrame:
    """The n rows of greatest score, equals in the stated order; a top-k that is cut in every task before it is merged."""
    return rows.orderBy(score.desc(), *order).limit(n)


def first_questions(questions: DataFrame, n: int | None, *, order: str = "line_no") -> DataFrame:
    """The first n questions in order of their line, all for None or a number below 1: the limit option of a run."""
    return questions.orderBy(order).limit(n) if n and n > 0 else questions


def interleaved_split(ranked: DataFrame, train: int, test: int) -> DataFrame:
    """The first train + test rows by `place` 1..n, with split: every third goes to test until that is full, the others
    to train until that is full, then to test. In closed form: of the places up to p, min(p / 3, test) are thirds."""
    thirds = F.least(F.floor(F.col("place") / 3), F.lit(test))
    third = (F.col("place") % 3 == 0) & (F.floor(F.col("place") / 3) <= test)
    split = F.when(third, "test").when(F.col("place") - thirds <= train, "train").otherwise("test")
    return ranked.filter(F.col("place") <= train + test).withColumn("split", split)


def contiguous_split(ranked: DataFrame, train: int, test: int) -> DataFrame:
    """Adds split: the first `train` places, then `test` more; others are dropped."""
    return ranked.filter(F.col("place") <= train + test).withColumn("split", F.when(F.col("place") <= train, "train").otherwise("test"))


def capped(rows: DataFrame, *, by: str, order: list[Column], limits: tuple[int, ...] = (2, 5, 99), target: int = 600) -> DataFrame:
    """Rows in passes: pass p admits what ranks within limits[p] of its group, until `target` rows are taken.

    A row's pass follows from its rank, so one window per group and one global top-n do it.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    step = F.lit(None).cast("int")
    for p, most in reversed(list(enumerate(limits))):
        step = F.when(F.col("_r") <= most, p).otherwise(step)
    return ranked.withColumn("pass", step).filter(F.col("pass").isNotNull()).orderBy("pass", "_r", by).limit(target).drop("_r")


def permutation(sizes: list[int], seed: int = 42) -> list[list[int]]:
    """For each size the shuffled places 0..n-1, one after another from one Mersenne Twister."""
    rng = random.Random(seed)
    out = []
    for n in sizes:
        places = list(range(n))
        rng.shuffle(places)
        out.append(places)
    return out


def shuffled(rows: DataFrame, *, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds `place` in a seeded order that any executor can compute: by hash of seed and key, then key."""
    from papyrine.operators.corpus import with_ordinal

    hashed = rows.withColumn("_h", F.concat(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(key))), 16, "0"), F.lit("|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return with_ordinal(hashed, "_h", name="place").drop("_h")


def good_chunk(text: Column, language: Column, *, terms: tuple[str, ...] = ("student", "programme", "course", "credit", "regulation"), junk: tuple[str, ...] = ("cookie", "javascript", "�"), least_words: int = 65) -> Column:
    """Whether a passage is worth a generator's call."""
    low = F.lower(text)
    hit, bad = F.lit(False), F.lit(False)
    for t in terms:
        hit = hit | low.contains(t)
    for t in junk:
        bad = bad | low.contains(t)
    return (language == "en") & (T.word_count(text) >= least_words) & hit & ~bad


def valid_item(question: Column, answer: Column) -> Column:
    """Whether a generated pair is a question with a question word, long enough, with a short answer and no banned phrase."""
    q = F.lower(F.trim(question))
    bad = F.lit(False)
    for b in BANNED:
        bad = bad | q.contains(b)
    return q.endswith("?") & (F.length(q) >= 12) & F.length(F.trim(answer)).between(1, 120) & ~bad & q.rlike(r"^(?:what|which|who|when|where|how|why|does|is|are|can|under|on|by)\b")


def needs_rewrite(question: Column) -> Column:
    q = F.lower(question)
    bad = q.rlike(r"^(?:what is (?:it|this|that)|what value is given|which name is linked)\b")
    for b in BANNED:
        bad = bad | q.contains(b)
    return bad


def batches(rows: DataFrame, size: int, *, key: str) -> DataFrame:
    """Adds `batch`: slices of `size` rows in order of key."""
    from papyrine.operators.corpus import with_ordinal

    return with_ordinal(rows, key).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("long")).drop("ordinal")


def prompts(rows: DataFrame, rules: tuple[str, ...], *, most: int = 1_500) -> DataFrame:
    """(batch, prompt): per batch one JSON payload with the rules and its passages, cut to `most` signs."""
    item = F.struct("chunk_id", F.substring("text", 1, most).alias("text"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    return grouped.select("batch", F.to_json(F.struct(F.array(*map(F.lit, rules)).alias("rules"), "chunks")).alias("prompt"))


def refine_prompts(rows: DataFrame, rules: tuple[str, ...], *, most: int = 700) -> DataFrame:
    """(batch, prompt): per batch one JSON payload with the rules and its pairs, evidence cut to `most` signs."""
    item = F.struct("id", "question", "answer", F.substring(F.coalesce("evidence", F.lit("")), 1, most).alias("evidence"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("batch", F.to_json(F.struct(F.array(*map(F.lit, rules)).alias("rules"), "items")).alias("prompt"))


def failure_of(error: Exception) -> str:
    """What a failed call says: http_<code> with the first signs of the body, timeout, or the error itself."""
    code, body = getattr(error, "code", None), getattr(error, "body", "")
    if code is not None:
        return f"http_{code}: {str(body)[:500]}".rstrip(": ")
    return "timeout" if isinstance(error, TimeoutError) else str(error)[:200]


def generate(asked: DataFrame, client: Callable[[str], str] | None, *, attempts: int = 3, wait: float = 1.5) -> DataFrame:
    """(batch, reply, error): the client's reply to each prompt, called within tasks; a failed batch has an error row.

    Between attempts wait, wait + 1, .. seconds pass. Without a client nothing is sent: every batch gets the error
    `no client`.
    """

    def run(parts: Iterator) -> Iterator:
        for pdf in parts:
            replies, errors = [], []
            for prompt in pdf.prompt:
                reply, error = None, "no client"
                for attempt in range(attempts if client else 0):
                    try:
                        reply, error = client(prompt), None
                        break
                    except Exception as e:
                        error = failure_of(e)
                        if attempt + 1 < attempts:
                            time.sleep(wait + attempt if wait else 0)
                replies.append(reply)
                errors.append(error)
            yield pdf[["batch"]].assign(reply=replies, error=errors)

    return asked.mapInPandas(run, "batch long, reply string, error string")


def generate_until(chunks: DataFrame, client: Callable[[str], str] | None, path: str, *, target: int, rules: tuple[str, ...], size: int = 5, wave: int = 200, attempts: int = 3, wait: float = 1.5) -> DataFrame:
    """(chunk_id, question, answer, evidence) of valid items, in waves of batches until `target` distinct pairs are there.

    Each wave is appended to `path` (items and processed): a run that starts again leaves out processed chunks.
    Chunks of failed batches aren't marked as processed. The waves are the only loop of the driver; calls run in tasks.
    """
    spark = chunks.sparkSession
    empty = {"items": spark.createDataFrame([], "chunk_id string, question string, answer string, evidence string"), "processed": spark.createDataFrame([], "chunk_id string")}
    for name, frame in empty.items():
        frame.write.mode("append").parquet(f"{path}/{name}")

    def stored(name: str) -> DataFrame:
        return spark.read.schema(empty[name].schema).parquet(f"{path}/{name}")

    def pairs() -> int:
        return stored("items").select(F.lower("question"), F.lower("answer")).distinct().count()

    batched = cut(batches(unprocessed(chunks, cut(stored("processed"))), size, key="chunk_id"))
    most = batched.agg(F.max("batch")).first()[0]
    for begin in range(0, (most if most is not None else -1) + 1, wave):
        if pairs() >= target:
            break
        part = batched.filter(F.col("batch").between(begin, begin + wave - 1))
        replies = cut(generate(prompts(part, rules), client, attempts=attempts, wait=wait))
        items_of(replies, part).write.mode("append").parquet(f"{path}/items")
        answered = replies.filter(F.col("error").isNull()).select("batch")
        part.join(answered, "batch", "left_semi").select("chunk_id").write.mode("append").parquet(f"{path}/processed")
    return stored("items")


def refine(rows: DataFrame, client: Callable[[str], str] | None, *, rules: tuple[str, ...], all_rows: bool = False, size: int = 12, attempts: int = 3, wait: float = 1.5) -> DataFrame:
    """rows (id, question, answer, evidence, annotation_status) with the client's refinements put in.

    Only questions that need_rewrite are sent, unless all_rows. A question is taken if it ends in a question mark and
    has twelve signs, an answer if it isn't empty, each by itself; unknown ids and failed batches change nothing.
    """
    weak = rows if all_rows else rows.filter(needs_rewrite(F.col("question")))
    batched = batches(weak.filter(F.col("id").isNotNull()).select("id", "question", "answer", "evidence").dropDuplicates(["id"]), size, key="id")
    replies = generate(refine_prompts(batched, rules), client, attempts=attempts, wait=wait)
    items = replies.select(F.explode(T.json_of_reply(F.col("reply"), "items array<struct<id:string,question:string,answer:string>>")["items"]).alias("i")).select("i.*")
    return refined_rows(rows, items)


def refined_rows(rows: DataFrame, items: DataFrame, *, status: str = "llm_refined_needs_human_review") -> DataFrame:
    """rows with items (id, question, answer) put in, field by field; of several items of an id the least wins."""
    one = items.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("question", "answer")).alias("i"))
    new = one.select("id", F.trim("i.question").alias("_q"), F.trim("i.answer").alias("_a"), F.lit(True).alias("_hit"))
    joined = rows.join(new, "id", "left")
    asked = F.coalesce(F.col("_q").endswith("?") & (F.length("_q") >= 12), F.lit(False))
    changed = {
        "question": F.when(asked, F.col("_q")).otherwise(F.col("question")),
        "answer": F.coalesce(F.nullif("_a", F.lit("")), "answer"),
        "annotation_status": F.when(F.col("_hit"), status).otherwise(F.col("annotation_status")),
    }
    return joined.withColumns(changed).drop("_q", "_a", "_hit")


def items_of(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, question, answer, evidence) of all replies: parsed, valid, of a known chunk, each pair once."""
    parsed = replies.select(F.explode(T.json_of_reply(F.col("reply"), "items array<struct<chunk_id:string,question:string,answer:string,evidence:string>>")["items"]).alias("i")).select("i.*")
    valid = parsed.filter(valid_item(F.col("question"), F.col("answer"))).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    once = Window.partitionBy(F.lower("question"), F.lower("answer")).orderBy("chunk_id", "question", "answer")
    return valid.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks whose id isn't among the processed ones; what a resumed run has left to do."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def merged(rows: DataFrame, refined: DataFrame, *, status: str = "refined_needs_human_review") -> DataFrame:
    """rows (id, question, answer, annotation_status) with valid refined (id, question, answer) put in; unknown ids are ignored."""
    new = refined.select("id", F.col("question").alias("_q"), F.col("answer").alias("_a")).filter(valid_item(F.col("_q"), F.col("_a")))
    joined = rows.join(new, "id", "left")
    hit = F.col("_q").isNotNull()
    changed = {"question": F.coalesce("_q", "question"), "answer": F.coalesce("_a", "answer"), "annotation_status": F.when(hit, status).otherwise(F.col("annotation_status"))}
    return joined.withColumns(changed).drop("_q", "_a")
