"""Reading short answers: accents folded, and one canonical form per value whatever its notation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: What a question asks for, by words that stand outside the programme's name (accents folded). Fixed values.
MATTERS = (
    ("vname", r"\bvietnamese\b"),
    ("combination", r"\bcombinations?\b|\bto hop\b"),
    ("decision", r"\bdecision\b|\bquyet dinh\b"),
    ("deadline", r"\bdeadline\b|\bby when\b|\bwhat date\b|\bhan nop\b|\bhan cuoi\b"),
    ("score", r"\bscore\b|\bcut-?off\b|\bpoints\b|\bdiem chuan\b"),
    ("tuition", r"\btuition\b|\bfees?\b|\bcosts?\b|\bhoc phi\b"),
    ("quota", r"\bquota\b|\bplaces\b|\bmany students\b|\bchi tieu\b"),
    ("credits", r"\bcredits?\b|\btin chi\b"),
    ("duration", r"\bduration\b|\bhow long\b|\bmany years\b|\bthoi gian\b|\bbao lau\b"),
    ("rule", r"\bregulation\b|\bput off\b|\bpostpone\b|\bdefer\b|\bhoan\b|\bquy che\b"),
)
MATTER_PATTERNS = tuple((name, re.compile(pattern)) for name, pattern in MATTERS)
MONTHS = {name: i + 1 for i, name in enumerate("january february march april may june july august september october november december".split())}
YEAR = re.compile(r"\b(?:19|20)\d\d\b")
NUMBER = re.compile(r"(?<!\w)\d+(?:[.,]\d+)*")
CODE = re.compile(r"\b[a-z]\d\d\b")
DECREE = re.compile(r"(\d+)\s*/\s*(qd[\w-]*)")
WORD = re.compile(r"[a-z0-9]+")
FRAME = re.compile(r"^(?:it is called|it is|answer:?|on|about|a score of|ngay)\s+|\s+in vietnamese$|^(?:the answer is)\s+")


@lru_cache(maxsize=200_000)
def fold_word(word: str) -> str:
    plain = unicodedata.normalize("NFKD", word)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower().replace("đ", "d").replace("ð", "d")


def fold(text: str) -> str:
    """Lower case without accents, white space collapsed."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join([fold_word(w) for w in text.split()])


def number(token: str) -> float:
    """A number in English or continental notation: groups of three digits are thousands."""
    if re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", token):
        return float(re.sub(r"[.,]", "", token))
    parts = re.split(r"[.,]", token)
    return float("".join(parts[:-1]) + "." + parts[-1]) if len(parts) > 1 else float(token)


def plain(value: float) -> str:
    return f"{value:.4f}".rstrip("0").rstrip(".")


def matter_of(question: str) -> str | None:
    """The first matter whose words the folded question has."""
    for name, pattern in MATTER_PATTERNS:
        if pattern.search(question):
            return name
    return None


def date_of(text: str) -> str | None:
    found = re.search(r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?([a-z]+)\.?,?\s+(\d{4})\b", text)
    if found and (month := MONTHS.get(found[2]) or month_of(found[2])):
        return f"{found[3]}-{month:02d}-{int(found[1]):02d}"
    found = re.search(r"\b([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", text)
    if found and (month := MONTHS.get(found[1]) or month_of(found[1])):
        return f"{found[3]}-{month:02d}-{int(found[2]):02d}"
    found = re.search(r"\b(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})\b", text) or re.search(r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", text)
    if found:
        return f"{found[3]}-{int(found[2]):02d}-{int(found[1]):02d}"
    found = re.search(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", text)
    return f"{found[1]}-{int(found[2]):02d}-{int(found[3]):02d}" if found else None


def month_of(word: str) -> int | None:
    return next((i for name, i in MONTHS.items() if len(word) >= 3 and name.startswith(word)), None)


def value_of(answer: str | None, matter: str | None, year: str | None = None) -> str | None:
    """The canonical value that an answer states, None for a blank one.

    `year` is the year of the question: beside another number it isn't the value.
    """
    if answer is None:
        return None
    text = fold(answer).strip(" .;,:!?\"'()")
    if not text:
        return None
    found = None
    if matter == "combination":
        codes = sorted(set(CODE.findall(text)))
        found = ";".join(codes) or None
    elif matter == "decision":
        decree = DECREE.search(text)
        found = f"{decree[1]}/{decree[2].rstrip('.')}" if decree else None
    elif matter == "deadline":
        found = date_of(text)
    elif matter in ("score", "tuition", "quota", "credits", "duration"):
        found = quantity(text, matter, year)
    if found is None:
        last = None
        while last != text:
            last, text = text, FRAME.sub("", text)
        found = " ".join(WORD.findall(text)) or None
    return found


def quantity(text: str, matter: str, year: str | None) -> str | None:
    if matter == "duration":
        years = re.search(r"(\d+(?:[.,]\d+)?)\s*(?:years?|nam\b)", text)
        terms = re.search(r"(\d+)\s*(?:main\s+)?(?:semesters?|terms?|hoc ky)", text)
        if terms:
            return plain(float(terms[1]))
        return plain(number(years[1]) * 2) if years and not YEAR.fullmatch(years[1]) else None
    tokens = NUMBER.findall(text)
    if matter == "tuition":
        millions = re.search(r"(\d+(?:[.,]\d+)?)\s*(?:million|trieu)", text)
        if millions:
            return plain(float(millions[1].replace(",", ".")) * 1e6)
        big = [number(t) for t in tokens if number(t) >= 1e5]
        return plain(big[0]) if big else None
    rest = [t for t in tokens if t != year] or tokens
    return plain(number(rest[0])) if rest else None
