"""Reading answers out of retrieved passages: sentence ranking, typed patterns, candidates and the cascade of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import classify, metrics
from papyrine.functions import text as T
from papyrine.runtime import once

#: Patterns of typed answers per kind, first match wins; general defaults.
PATTERNS = {
    "url": (r"https?://[^\s,;.)]+(?:\.[^\s,;.)]+)*",),
    "date": (r"\b\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\b", r"\b[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\b", r"\b(?:19|20)\d{2}\b"),
    "count": (r"\b\d{1,3}(?:,\d{3})?\s+(?:credits|points|students|places|members|programs|departments)\b", r"\b\d{1,3}(?:,\d{3})?\b"),
    "quota": (r"\b\d{1,3}(?:,\d{3})*\s+(?:students|places)\b", r"\b\d{1,3}(?:,\d{3})*\b"),
    "tuition": (r"\b\d{1,3}(?:[.,]\d{1,3})?\s*million\s+VND(?:\s+per\s+(?:academic\s+)?year)?", r"\b\d{3,9}\s*VND\b"),
    "score": (r"\b\d{1,2}(?:\.\d{1,2})?\s+points\b", r"\b\d{1,2}\.\d{1,2}\b"),
    "duration": (r"\b\d+\s+(?:main\s+)?semesters\b", r"\b\d+(?:\.\d+)?\s+years?\b"),
    "combination": (r"\b[A-Z]\d{2}\b",),
}
#: Patterns of the numeric fine kinds, first match wins. Fixed values.
NUMERIC = {
    "score": (r"\b\d{1,2}(?:\.\d{1,2})?\s+points\b", r"\b\d{1,2}(?:\.\d{1,2})?\b"),
    "tuition": (
        r"\b\d{1,3}(?:,\d{3})?\s*million\s+VND(?:\s+per\s+(?:student\s+)?(?:year|academic year|credit))?(?:\s+in\s+\d{4}(?:-\d{4})?)?",
        r"\b\d{3,7}\s*VND\s+per\s+credit\b",
        r"\b\d{1,3}(?:,\d{3})?\s*VND\b",
    ),
    "count": (
        r"\b(?:about|approximately|more than|at least)?\s*\d{1,3}(?:,\d{3})?\s+(?:quotas|credits|points|hectares|students|institutions|countries|programs|laboratories|methods|faculties|departments|members?)\b",
        r"\b\d{1,3}(?:,\d{3})?\b",
    ),
    "duration": (r"\b\d+(?:\s+to\s+\d+)?\s+(?:main\s+)?semesters\b", r"\b\d+(?:\.\d+)?\s+years?\b", r"\bat least\s+\d+\s+percent\s+longer\b"),
    "date": (r"\b\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\b", r"\b[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\b", r"\b(?:19|20)\d{2}\b"),
}
#: Verbs that let a text say yes. Fixed values.
AFFIRMING = r"\b(?:participates?|conducts?|involved|cooperates?|has|includes?|offers?|provides?)\b"
SUBJECT_NAMES = "Mathematics|Literature|English|History|Geography|Physics|Chemistry|Biology"
LINKING = r"\b(?:participates?|involved|conducts?|cooperates?|has|includes?)\b"
NAME = r"\b[A-Z][A-Za-z&-]*(?:\s+(?:and|of|for|in|the|[A-Z][A-Za-z&-]*))*"


def best_sentences(questions: DataFrame, retrieved: DataFrame, *, limit: int = 8) -> DataFrame:
    """(qid, place, sentence, score): the best sentences of a question's passages, without repeats in folded form.

    questions has (qid, question), retrieved (qid, rank, score, text). Ties go by rank and position.
    """
    asked = once(questions.select("qid", "question"), asked=T.tokens(F.col("question"))).select("qid", "asked")
    rows = retrieved.join(asked, "qid").select("qid", "rank", "asked", "score", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    # the score looks the tokens up for each word of the question, so they are made before
    folded = once(rows, fold=T.ascii_fold(F.col("sentence")), tokens=T.tokens(F.col("sentence")))
    scored = once(folded, score=F.round(metrics.keyword_score(F.col("asked"), F.col("tokens")) + F.col("score"), 6)).filter(F.col("score") > 0)
    order = [F.col("score").desc(), F.col("rank"), F.col("pos")]
    first = scored.select("qid", "rank", "pos", "sentence", "score", "fold").withColumn("n", F.row_number().over(Window.partitionBy("qid", "fold").orderBy(*order))).filter("n = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return placed.filter(F.col("place") <= limit).select("qid", "place", "sentence", "score")


def typed_answer(question: Column, text: Column, kind: Column | None = None) -> Column:
    """The first match of the patterns of the question's kind; Yes for a yes/no question with a linking verb; else null."""
    kind = classify.question_kind(question) if kind is None else kind
    by_kind = F.create_map(*(x for name, ps in PATTERNS.items() for x in (F.lit(name), F.array(*(F.lit(p if name == "date" else f"(?i){p}") for p in ps)))))
    patterns = F.when(kind == "yesno", F.array(F.lit(f"(?i){LINKING}"))).otherwise(F.element_at(by_kind, kind))
    found = F.filter(F.transform(patterns, lambda p: F.call_function("regexp_extract", text, p, F.lit(0))), lambda x: x != "")
    first = F.get(found, F.lit(0))
    return F.when(kind == "yesno", F.when(first.isNotNull(), F.lit("Yes"))).otherwise(F.nullif(T.clean_answer(first), F.lit("")))


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of the first pattern that matches, without regard to case; null without one."""
    found = F.filter(F.array(*(F.regexp_extract(text, f"(?i)({p})", 1) for p in patterns)), lambda x: x != "")
    return F.nullif(T.clean_answer(F.get(found, F.lit(0))), F.lit(""))


def numeric_answer(text: Column, kind: Column) -> Column:
    """The first number of the fine kind that the text states; null for other kinds."""
    out = F.lit(None).cast("string")
    for name, patterns in NUMERIC.items():
        out = F.when(kind == name, _first_match(text, patterns)).otherwise(out)
    return out


def school_subjects(question: Column, text: Column) -> Column:
    """The distinct subjects that the text gives for the question's combination code, joined by `; `, else null."""
    code = F.upper(F.regexp_extract(question, r"(?i)\b([A-D]\d{2})\b", 1))
    tails = (r"\s*[:|-]\s*([A-Za-z;\s,]+)", rf"\b[^\n.]{{0,120}}?((?:{SUBJECT_NAMES})(?:;\s*(?:{SUBJECT_NAMES}))+)")
    head = r"([A-Za-z]+;\s*[A-Za-z]+;\s*[A-Za-z]+)[^\n.]{0,80}?\b"
    patterns = (F.concat(F.lit("(?is)"), code, F.lit(tails[0])), F.concat(F.lit("(?is)" + head), code, F.lit(r"\b")), F.concat(F.lit(r"(?is)\b"), code, F.lit(tails[1])))
    named = [F.regexp_extract_all(F.call_function("regexp_extract", text, p, F.lit(1)), F.lit(rf"(?i)\b({SUBJECT_NAMES})\b")) for p in patterns]
    first = F.get(F.filter(F.array(*named), lambda x: F.size(x) > 0), F.lit(0))
    return F.when(code != "", F.nullif(F.array_join(F.array_distinct(F.transform(first, lambda x: F.initcap(x))), "; "), F.lit("")))


def place_of(text: Column, *, places: tuple[str, ...] = ()) -> Column:
    """The first of `places` that the text names, else its first capitalised word or two words; null without one."""
    first = F.nullif(T.clean_answer(F.regexp_extract(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1)), F.lit(""))
    out = first
    for place in reversed(places):
        out = F.when(text.rlike(rf"(?i)\b\Q{place}\E\b"), place).otherwise(out)
    return out


def degree_of(text: Column, *, degrees=classify.DEGREES) -> Column:
    """The canonical degree that the text names, the earlier of the table; null without one."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(degrees):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def programmes(text: Column, *, most: int = 8) -> Column:
    """Names of programmes: the first valid answer of the text's facts, else the names of its table rows that end in a
    score or degree, each once, `most` at most as the answer's form, joined by `; `; null without one."""
    valid = lambda x: ~classify.invalid_for_kind(x, F.lit("program"))
    facts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)\bAnswer:\s*(.+?)(?:\.\s*$|\n|$)"), F.lit(1)), lambda x: T.clean_answer(x)), valid)
    row = r"(?:^|\n)\s*\d+\s*\|\s*([^|\n]+?)\s*\|[^\n]*?(?:\b\d{1,2}(?:\.\d{1,2})?\b|Bachelor degree|Engineer degree)"
    rows = F.filter(F.transform(F.regexp_extract_all(text, F.lit(row), F.lit(1)), lambda x: T.clean_answer(x)), valid)
    return F.coalesce(F.get(facts, F.lit(0)), F.nullif(F.array_join(F.slice(F.array_distinct(rows), 1, most), "; "), F.lit("")))


def named_answer(question: Column, text: Column) -> Column:
    """The capitalised phrase with most tokens that the question lacks, a little for length; the first of equals."""
    asked = T.tokens(question)
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda p: T.clean_answer(p)), lambda p: (p != "") & (T.word_count(p) <= 12) & ~F.lower(p).isin("question", "answer"))
    scored = F.transform(phrases, lambda p, i: F.struct((F.size(F.array_except(T.tokens(p), asked)) + F.when(F.size(F.array_except(T.tokens(p), asked)) > 0, T.word_count(p) * 0.05).otherwise(0.0)).alias("s"), (-i).alias("i"), p.alias("p")))
    best = F.array_max(F.filter(scored, lambda c: c["s"] >= 1))
    return best["p"]


def compared_option(question: Column, text: Column, *, gap: int = 80) -> Column:
    """Of two options of a comparison (`between X and Y`) the one with the greater or smaller number near it in the text."""
    options = F.regexp_extract(question, r"(?i)\bbetween\b(.*?)(?:\bwhich\b.*)?$", 1)
    parts = F.filter(F.transform(F.split(options, r"(?i)\band\b|,|;", -1), lambda o: T.clean_answer(o)), lambda o: T.word_count(o) >= 2)

    def valued(option: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), option, F.lit(r"\E"))
        after = F.call_function("regexp_extract", text, F.concat(F.lit("(?i)"), quoted, F.lit(r".{0,%d}?(\d{1,2}(?:\.\d{1,2})?)" % gap)), F.lit(1))
        before = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?i)(\d{1,2}(?:\.\d{1,2})?).{0,%d}?" % gap), quoted), F.lit(1))
        return F.struct(F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit(""))).cast("double").alias("v"), option.alias("o"))

    values = F.filter(F.transform(parts, valued), lambda x: x["v"].isNotNull())
    low = question.rlike(r"(?i)\b(?:lower|lowest|below)\b")
    asked = question.rlike(r"(?i)\b(?:higher|highest|lower|lowest|above|below)\b")
    return F.when(asked & (F.size(values) >= 2), F.when(low, F.array_min(values)["o"]).otherwise(F.array_max(values)["o"]))


def fine_facts(retrieved: DataFrame, questions: DataFrame, *, least: float, places: tuple[str, ...] = ()) -> DataFrame:
    """(qid, question, answer, score): every valid answer of a compatible fact, by the finer kinds, that scores `least`."""
    sure = retrieved.filter(F.col("score") >= least)
    rows = once(sure.join(questions, "qid"), fact_question=T.fact_question(F.col("text")), said=T.fact_answer(F.col("text")))
    rows = rows.filter(F.col("said").isNotNull() & F.col("fact_question").isNotNull())
    kinds = once(rows, wanted=classify.fine_kind(F.col("question")), offered=classify.fine_kind(F.col("fact_question")))
    fit = kinds.filter(classify.compatible_fine(F.col("wanted"), F.col("offered")))
    named = once(fit, answer=classify.normalized_for_kind(F.col("said"), F.col("wanted"), places=places))
    return named.filter(~classify.invalid_for_kind(F.col("answer"), F.col("wanted"))).select("qid", "question", "answer", "score")


def facts_of(retrieved: DataFrame, questions: DataFrame, *, least: float) -> DataFrame:
    """(qid, answer, score, sure): each question's best compatible fact; sure if its score reaches `least`."""
    rows = once(retrieved.join(questions, "qid"), fact_question=T.fact_question(F.col("text")), answer=T.fact_answer(F.col("text")))
    rows = rows.filter(F.col("answer").isNotNull() & F.col("fact_question").isNotNull())
    kinds = once(rows, wanted=classify.question_kind(F.col("question")), offered=classify.question_kind(F.col("fact_question")))
    fit = kinds.filter(classify.compatible(F.col("wanted"), F.col("offered")))
    best = fit.groupBy("qid").agg(F.min_by(F.struct("answer", "score"), "rank").alias("b"))
    return best.select("qid", "b.answer", "b.score", (F.col("b.score") >= least).alias("sure"))


def answers(questions: DataFrame, retrieved: DataFrame, *, least: float = 0.25, limit: int = 8) -> DataFrame:
    """(qid, answer, strategy) by the cascade: sure fact, comparison, typed pattern, any fact, name, first sentence, Unknown."""
    facts = facts_of(retrieved, questions, least=least)
    said = best_sentences(questions, retrieved, limit=limit).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"]).alias("s"))
    rows = questions.join(facts.withColumnRenamed("answer", "fact"), "qid", "left").join(said, "qid", "left")
    rows = once(rows, joined=F.array_join(F.coalesce("s", F.array().cast("array<string>")), " "))
    text = F.col("joined")
    steps = (
        ("fact", F.when(F.col("sure"), F.col("fact"))),
        ("comparison", compared_option(F.col("question"), text)),
        ("pattern", typed_answer(F.col("question"), text)),
        ("any_fact", F.col("fact")),
        ("name", named_answer(F.col("question"), text)),
        ("sentence", T.clean_answer(F.get("s", F.lit(0)))),
    )
    tried = F.array(*(F.struct(a.alias("answer"), F.lit(n).alias("strategy")) for n, a in (*steps, ("none", F.lit("Unknown")))))
    chosen = F.get(F.filter(tried, lambda c: c["answer"].isNotNull()), F.lit(0))
    return rows.select("qid", F.explode(F.array(chosen)).alias("c")).select("qid", "c.answer", "c.strategy")


def candidates(questions: DataFrame, retrieved: DataFrame, *, least: float = 0.72, places: tuple[str, ...] = ()) -> DataFrame:
    """(qid, answer, score, source): all rule-based candidates with their fixed priorities.

    Eight sources: fact (50 + its score), comparison 40, subjects 35, location 34, degree 33, yesno 32, numbers 30 and
    programmes 24. Rules read the passages by rank and below them the best sentences.
    """
    facts = fine_facts(retrieved, questions, least=least, places=places).select("qid", "answer", (50.0 + F.col("score")).alias("score"), F.lit("fact").alias("source"))
    passages = retrieved.select("qid", F.lit(0).alias("part"), F.col("rank").alias("at"), "text")
    said = best_sentences(questions, retrieved).select("qid", F.lit(1).alias("part"), F.col("place").alias("at"), F.col("sentence").alias("text"))
    parts = passages.unionByName(said).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "text"))), lambda r: r["text"]), "\n").alias("text"))
    joined = once(parts.join(questions, "qid"), kind=classify.fine_kind(F.col("question")))
    kind, text = F.col("kind"), F.col("text")
    yes = F.when(F.lower("question").startswith("does ") & text.rlike(f"(?i){AFFIRMING}"), "Yes")
    ruled = (
        (compared_option(F.col("question"), text, gap=140), 40.0, F.lit("comparison")),
        (F.when(kind == "subjects", school_subjects(F.col("question"), text)), 35.0, F.lit("subjects")),
        (F.when(kind == "location", place_of(text, places=places)), 34.0, F.lit("location")),
        (F.when(kind == "degree", degree_of(text)), 33.0, F.lit("degree")),
        (F.when(kind == "yesno", yes), 32.0, F.lit("yesno")),
        (numeric_answer(text, kind), 30.0, kind),
        (F.when(kind == "program", programmes(text)), 24.0, F.lit("program")),
    )
    made = F.array(*(F.struct(a.alias("answer"), F.lit(n).alias("score"), source.alias("source")) for a, n, source in ruled))
    rows = joined.select("qid", F.explode(F.filter(made, lambda c: c["answer"].isNotNull())).alias("c")).select("qid", "c.answer", "c.score", "c.source")
    return facts.unionByName(rows).select("qid", "answer", F.round("score", 6).alias("score"), "source")


def best_candidate(found: DataFrame) -> DataFrame:
    """(qid, answer, score, source): the greatest score, ties by source and answer."""
    best = F.min_by(F.struct("answer", "score", "source"), F.struct((-F.col("score")).alias("s"), "source", "answer"))
    return found.groupBy("qid").agg(best.alias("b")).select("qid", "b.answer", "b.score", "b.source")


def best_spans(logits: DataFrame, *, longest: int = 24, keep: int | None = None, top: int = 1) -> DataFrame:
    """(qid, start, end, score): the spans with the greatest sum of start and end logit, at most `longest` tokens.

    logits has (qid, start_logits, end_logits). All spans compete; with `keep` only the `keep` best starts and ends are
    combined, as some readers do.
    """
    if keep is None:
        rows = logits.select("qid", F.posexplode("start_logits").alias("start", "s"), "end_logits")
        rows = rows.select("qid", "start", "s", F.posexplode(F.slice("end_logits", F.col("start") + 1, F.lit(longest))).alias("more", "e"))
        scored = rows.select("qid", "start", (F.col("start") + F.col("more")).alias("end"), F.round(F.col("s") + F.col("e"), 6).alias("score"))
    else:

        def best(column: str) -> Column:
            pairs = F.transform(column, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
            return F.slice(F.array_sort(pairs), 1, keep)

        rows = logits.select("qid", F.explode(best("start_logits")).alias("a"), best("end_logits").alias("ends")).select("qid", "a", F.explode("ends").alias("b"))
        ok = rows.filter((F.col("a.i") <= F.col("b.i")) & (F.col("b.i") - F.col("a.i") < longest))
        scored = ok.select("qid", F.col("a.i").alias("start"), F.col("b.i").alias("end"), F.round(-(F.col("a.s") + F.col("b.s")), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "start", "end")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top).select("qid", "start", "end", "score")


def distinct_answers(spans: DataFrame, *, top: int = 4) -> DataFrame:
    """(qid, place, answer, score): the best `top` answers per question, those equal in folded form once; blanks go.

    spans has (qid, answer, score); ties go to the smaller answer.
    """
    clean = spans.select("qid", T.clean_answer(F.col("answer")).alias("answer"), "score").filter(F.col("answer") != "")
    order = [F.col("score").desc(), F.col("answer")]
    folded = clean.withColumn("fold", T.ascii_fold(F.col("answer")))
    first = folded.withColumn("n", F.row_number().over(Window.partitionBy("qid", "fold").orderBy(*order))).filter("n = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return placed.filter(F.col("place") <= top).select("qid", "place", "answer", "score")


def context(retrieved: DataFrame, *, most: int = 2_200) -> DataFrame:
    """(qid, context): the passages in order of rank within a running budget of signs; the last is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = retrieved.withColumn("before", before).filter(F.col("before") < most).withColumn("part", F.substring("text", F.lit(1), (F.lit(most) - F.col("before")).cast("int")))
    return parts.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda r: r["part"]), "\n").alias("context"))


def model_answers(questions: DataFrame, retrieved: DataFrame, predictions: DataFrame, *, least: float = 0.84) -> DataFrame:
    """(qid, answer, score): a sure fact, else the model's span of greatest raw x max(0.1, passage score), else any fact, else Unknown.

    predictions has (qid, rank, answer, raw) of an injected reader, a row per passage at most.
    """
    facts = facts_of(retrieved, questions, least=least).select("qid", F.col("answer").alias("fact"), F.col("score").alias("fact_score"), "sure")
    spans = predictions.join(retrieved.select("qid", "rank", "score"), ["qid", "rank"]).filter(F.length(F.trim("answer")) > 0)
    value = F.round(F.col("raw") * F.greatest(F.lit(0.1), F.col("score")), 6)
    best = spans.select("qid", "rank", "answer", value.alias("value")).groupBy("qid").agg(F.min_by(F.struct("answer", "value"), F.struct((-F.col("value")).alias("v"), "rank")).alias("b"))
    rows = questions.select("qid").join(facts, "qid", "left").join(best, "qid", "left")
    sure = F.coalesce(F.col("sure"), F.lit(False))
    answer = F.when(sure, F.col("fact")).otherwise(F.coalesce("b.answer", "fact", F.lit("Unknown")))
    score = F.when(sure, F.col("fact_score")).otherwise(F.coalesce("b.value", "fact_score", F.lit(0.0)))
    return rows.select("qid", answer.alias("answer"), score.alias("score"))


def reranked(questions: DataFrame, retrieved: DataFrame, predictions: DataFrame, *, least: float = 0.72, places: tuple[str, ...] = ()) -> DataFrame:
    """(qid, answer, score, source) for every question: the best of rule candidates and the model's.

    predictions has (qid, rank, answer, raw), several rows per passage allowed; a model's answer scores raw x max(0.1,
    passage score) + the bonus of its kind. Without any candidate a question gets the first fact, else its best
    sentence, else Unknown.
    """
    model = predictions.join(retrieved.select("qid", "rank", F.col("score").alias("passage")), ["qid", "rank"]).join(questions, "qid").filter(F.length(F.trim("answer")) > 0)
    model = once(model, kind=classify.fine_kind(F.col("question")))
    model = once(model, said=classify.normalized_for_kind(F.col("answer"), F.col("kind"), places=places))
    scored = model.select("qid", F.col("said").alias("answer"), F.round(F.col("raw") * F.greatest(F.lit(0.1), F.col("passage")) + classify.kind_bonus(F.col("said"), F.col("kind")), 6).alias("score"), F.lit("reader").alias("source"))
    best = best_candidate(candidates(questions, retrieved, least=least, places=places).unionByName(scored))
    return with_fallbacks(questions, retrieved, best, places=places)


def with_fallbacks(questions: DataFrame, retrieved: DataFrame, best: DataFrame, *, places: tuple[str, ...] = ()) -> DataFrame:
    """(qid, answer, score, source): best, and for every question without a row the first fact, sentence or Unknown."""
    facts = once(retrieved.join(questions, "qid"), said=T.fact_answer(F.col("text")), kind=classify.fine_kind(F.col("question"))).filter(F.coalesce(F.col("said") != "", F.lit(False)))
    facts = facts.groupBy("qid").agg(F.min_by(F.struct("said", "kind", "score"), "rank").alias("f"))
    said = best_sentences(questions, retrieved, limit=1).select("qid", T.clean_answer(F.col("sentence")).alias("sentence"))
    top = retrieved.groupBy("qid").agg(F.min_by("score", "rank").alias("top"))
    rows = questions.select("qid").join(best, "qid", "left").join(facts, "qid", "left").join(said, "qid", "left").join(top, "qid", "left")
    ways = F.array(
        F.struct("answer", "score", "source"),
        F.struct(classify.normalized_for_kind(F.col("f.said"), F.col("f.kind"), places=places).alias("answer"), F.col("f.score").alias("score"), F.lit("fallback_fact").alias("source")),
        F.struct(F.col("sentence").alias("answer"), F.col("top").alias("score"), F.lit("fallback_sentence").alias("source")),
        F.struct(F.lit("Unknown").alias("answer"), F.lit(0.0).alias("score"), F.lit("fallback_unknown").alias("source")),
    )
    return rows.select("qid", F.get(F.filter(ways, lambda w: w["answer"].isNotNull()), F.lit(0)).alias("w")).select("qid", "w.answer", "w.score", "w.source")
