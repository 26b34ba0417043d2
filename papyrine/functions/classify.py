"""Classifiers by ordered keyword rules, over Columns. Keyword tables are parameters; defaults are general words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import text

#: Categories of documents, first hit wins; terms are folded substrings. Fixed values.
CATEGORIES = (
    ("tuition", ("tuition", "hoc phi", "fee")),
    ("admission", ("admission", "tuyen sinh", "quota", "diem chuan")),
    ("training_regulation", ("regulation", "quy che", "credit")),
    ("history", ("history", "lich su", "established")),
    ("academic_program", ("program", "curriculum", "chuong trinh")),
)
#: Function words per language for counting. Fixed values.
VIETNAMESE = ("của", "và", "được", "trong", "các", "sinh viên", "đào tạo", "chương trình")
ENGLISH = ("the", "and", "of", "students", "university", "program", "with", "for")

#: Kinds of questions in the order of their rules: (kind, prefixes, substrings). Fixed values.
KINDS = (
    ("yesno", ("does ",), ()),
    ("tuition", (), ("tuition", "fee", "pay")),
    ("score", (), ("score", "points")),
    ("quota", (), ("quota",)),
    ("duration", (), ("duration", "how long", "study period", "maximum study")),
    ("date", ("when ",), ("in what year", "which year")),
    ("combination", (), ("combination", "subjects")),
    ("degree", (), ("degree",)),
    ("url", (), ("homepage", "website")),
    ("location", ("where ",), ("city",)),
    ("abbreviation", (), ("abbreviation", "stand for")),
    ("count", ("how many ",), ()),
)
#: The finer kinds, by patterns in order. Fixed values.
FINE_KINDS = (
    ("yesno", r"^does "),
    ("comparison", r"\b(?:higher|highest|lower|lowest|above|below)\b"),
    ("program", r"\bwhich\b.*\b(?:program|programs|major|majors)\b"),
    ("subjects", r"combination|subjects"),
    ("tuition", r"tuition|fee|pay|vnd"),
    ("score", r"score|points"),
    ("count", r"^how many |number of|quota"),
    ("duration", r"duration|how long|study period|maximum study"),
    ("date", r"^when |in what year|which year"),
    ("url", r"homepage|website"),
    ("location", r"city|^where "),
    ("degree", r"degree"),
    ("description", r"recognized as"),
)
#: What answers of the finer kinds must or must not hold. Fixed values.
SCHOOL_SUBJECTS = r"\b(?:mathematics|literature|english|history|geography|physics|chemistry|biology)\b"
NO_PROGRAM = r"\d|points|vnd|tuition|semester|year"
DEGREE_WORDS = r"degree|engineer|bachelor"
#: Canonical degrees and their patterns. Fixed values.
DEGREES = (("Bachelor degree", r"(?i)\bBachelor(?:'s)?\s+degree\b"), ("Engineer degree", r"(?i)\bEngineer(?:ing)?\s+degree\b"))
#: Categories over URL, title and opening, first hit wins. Fixed values.
RAW_CATEGORIES = (
    ("admission", ("admission", "tuyen-sinh", "enroll")),
    ("academic_program", ("curriculum", "academic program", "undergraduate", "graduate")),
    ("organization", ("organization", "structure", "member")),
    ("overview_history", ("history", "mission", "vision", "overview")),
    ("research_faculty", ("research", "institute", "faculty")),
)
#: What happened to a thing, in the order in which it is looked for. Fixed values.
ACTIONS = ("founded", "established", "reorganized", "renamed", "issued", "approved", "honored", "ranked", "launched", "created", "formed")
#: Terms of which a good sentence has one. Fixed values.
GOOD_TERMS = (" is ", " are ", " was ", " were ", " has ", " have ", " offers ", " provides ", " established ", " founded ", " ranked ", " includes ", " consists ", " aims ", " requires ", " admitted ", " admission ", " program", " university", " faculty", " school", " institute")


def first_hit(subject: Column, rules, default: str) -> Column:
    """The name of the first rule of which the subject contains a term."""
    out = F.lit(default)
    for name, terms in reversed(rules):
        hit = F.lit(False)
        for term in terms:
            hit = hit | subject.contains(term)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def category(url: Column, body: Column, *, rules=CATEGORIES, prefix: int = 4_000) -> Column:
    """Category by folded URL and opening of the text; nulls count as empty."""
    subject = text.ascii_fold(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, prefix)), stroke=True)
    return first_hit(subject, rules, "general")


def category_raw(url: Column, title: Column, body: Column, *, rules=RAW_CATEGORIES, prefix: int = 1_200) -> Column:
    """As category(), over lower-case URL, title and opening without folding."""
    parts = (F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, prefix))
    return first_hit(F.lower(F.concat_ws(" ", *parts)), rules, "general")


def occurrences(subject: Column, term: str) -> Column:
    return (F.length(subject) - F.length(F.replace(subject, F.lit(term), F.lit("")))) / F.lit(len(term))


def marker_language(body: Column, *, prefix: int = 4_000) -> Column:
    """en, vi or mixed: accented letters plus thrice the Vietnamese terms, against English function words."""
    opening = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, prefix))
    accents = F.length(F.regexp_replace(opening, r"[^àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]", ""))
    vietnamese = accents + sum((F.when(opening.contains(t), 3).otherwise(0) for t in VIETNAMESE), F.lit(0))
    padded = F.concat(F.lit(" "), F.regexp_replace(opening, r"\s+", " "), F.lit(" "))
    english = sum((F.when(padded.contains(f" {t} "), 1).otherwise(0) for t in ENGLISH), F.lit(0))
    return F.when((vietnamese > 8) & (english > 5), "mixed").when(vietnamese > 8, "vi").otherwise("en")


def counted_language(body: Column) -> Column:
    """vi if its terms occur at least three times more often than the English ones, else en."""
    low = F.lower(F.coalesce(body, F.lit("")))
    vi = sum((occurrences(low, t) for t in VIETNAMESE), F.lit(0.0))
    en = sum((occurrences(low, f" {t} ") for t in ENGLISH), F.lit(0.0))
    return F.when(vi > en + 2, "vi").otherwise("en")


def relevant(url: Column, body: Column, terms: tuple[str, ...], *, prefix: int = 5_000) -> Column:
    subject = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, prefix)))
    hit = F.lit(False)
    for term in terms:
        hit = hit | subject.contains(term)
    return hit


def boilerplate_line(line: Column, title: Column, *, terms: tuple[str, ...] = ("copyright", "read more", "related posts", "cookie"), headings: tuple[str, ...] = ("menu", "home", "search", "email", "library"), navigation: tuple[str, ...] = ("home", "contact", "news", "library", "careers", "sitemap")) -> Column:
    """Whether a line is page furniture: blank, the title again, a heading, numbering, leaders, links, stamps, terms, or
    three words at most without a year or an acronym, or three navigation terms."""
    low, folded = F.lower(F.trim(line)), text.ascii_fold(F.trim(line), stroke=True)
    words = F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))
    has_term = F.lit(False)
    for t in terms:
        has_term = has_term | words.contains(t)
    nav = sum((F.when(folded.contains(t), 1).otherwise(0) for t in navigation), F.lit(0))
    rules = (
        (low == "")
        | F.coalesce((F.trim(title) != "") & (text.line_key(line) == text.line_key(title)), F.lit(False))
        | low.isin(*headings)
        | low.rlike(r"^\d+\s*\.\s+")
        | (F.length(line) - F.length(F.replace(line, F.lit("."), F.lit(""))) >= 8)
        | low.rlike(r"https?://")
        | folded.rlike(r"\d{4}-\d{2}-\d{2}t\d{2}:\d{2}:\d{2}")
        | words.rlike(r"^(?:nam )?(?:19|20)\d{2}$")
        | has_term
        | ((text.word_count(line) <= 3) & ~line.rlike(r"\d{4}|[A-Z]{3,}"))
        | (nav >= 3)
    )
    return F.coalesce(rules, F.lit(True))


def question_kind(question: Column) -> Column:
    """Kind by ordered substrings; `entity` if none fits."""
    q = F.lower(question)
    out = F.lit("entity")
    for kind, prefixes, parts in reversed(KINDS):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | q.startswith(p)
        for p in parts:
            hit = hit | q.contains(p)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def fine_kind(question: Column) -> Column:
    """Kind by ordered patterns; `entity` if none fits."""
    q = F.lower(question)
    out = F.lit("entity")
    for kind, pattern in reversed(FINE_KINDS):
        out = F.when(q.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def compatible(wanted: Column, offered: Column) -> Column:
    """Whether a fact about one kind may answer a question of another."""
    return (wanted == offered) | ((wanted == "count") & (offered == "quota")) | ((wanted == "entity") & ~offered.isin("tuition", "score", "quota", "duration"))


def compatible_fine(wanted: Column, offered: Column) -> Column:
    """As compatible(), between the finer kinds: names and descriptions also answer for programmes."""
    named = offered.isin("entity", "description")
    return (wanted == offered) | (wanted.isin("program", "description") & named) | ((wanted == "entity") & ~offered.isin("tuition", "score", "count", "duration"))


def invalid_for_kind(answer: Column, kind: Column) -> Column:
    """Whether an answer can't be of its fine kind; an empty or null one never is."""
    low, number = F.lower(answer), answer.rlike(r"\d")
    rules = (
        ("program", low.rlike(NO_PROGRAM)),
        ("location", (text.word_count(answer) > 5) | low.contains("university")),
        ("subjects", ~low.rlike(SCHOOL_SUBJECTS)),
        ("degree", ~low.rlike(DEGREE_WORDS)),
        ("url", ~low.rlike("^https?://")),
        ("yesno", ~low.isin("yes", "no")),
    )
    out = F.when(kind.isin("score", "tuition", "count", "duration", "date"), ~number).otherwise(F.lit(False))
    for name, bad in rules:
        out = F.when(kind == name, bad).otherwise(out)
    return F.coalesce((answer == "") | out, F.lit(True))


def kind_bonus(answer: Column, kind: Column) -> Column:
    """-8 for an answer that can't be of the kind, 3 for one of a named kind, 2 for a number, else 0."""
    return (
        F.when(invalid_for_kind(answer, kind), -8.0)
        .when(kind.isin("program", "degree", "subjects", "location", "yesno"), 3.0)
        .when(kind.isin("score", "tuition", "count", "duration", "date"), 2.0)
        .otherwise(0.0)
    )


def normalized_for_kind(answer: Column, kind: Column, *, places: tuple[str, ...] = (), degrees=DEGREES) -> Column:
    """The canonical degree or place that an answer of that kind names, else the cleaned answer. `places` are names."""
    out = text.clean_answer(answer)
    for name, pattern in reversed(degrees):
        out = F.when((kind == "degree") & answer.rlike(pattern), name).otherwise(out)
    for place in reversed(places):
        out = F.when((kind == "location") & answer.rlike(rf"(?i)\b\Q{place}\E\b"), place).otherwise(out)
    return out


def action(sentence: Column, *, actions: tuple[str, ...] = ACTIONS) -> Column:
    """The first of the actions that the sentence has, else `mentioned`; null stays null."""
    out = first_hit(F.lower(sentence), tuple((a, (a,)) for a in actions), "mentioned")
    return F.when(sentence.isNotNull(), out)


def good_sentence(sentence: Column, *, terms: tuple[str, ...] = GOOD_TERMS) -> Column:
    """Whether a sentence is worth asking about: eight words, mostly letters, few digits, and one of the terms."""
    letters = F.length(F.regexp_replace(sentence, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(sentence, r"[^0-9]", ""))
    padded, hit = F.concat(F.lit(" "), F.lower(sentence), F.lit(" ")), F.lit(False)
    for t in terms:
        hit = hit | padded.contains(t)
    return F.coalesce((text.word_count(sentence) >= 8) & (letters >= F.length(sentence) * 0.52) & (digits <= letters * 0.45) & hit, F.lit(False))
