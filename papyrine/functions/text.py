"""Text functions: folding, tokens, cleaning, sentences, answers, URLs. All are Column to Column and stay in the JVM.

A null in gives a null out unless a function says otherwise; an empty text is handled as a text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no content. Fixed values.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had", "has", "have", "how", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with")
#: ASCII punctuation, as string libraries define it.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Named entities that text of web pages uses. Fixed values; numeric ones are not resolved here.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
TRIMMED = " \t\n\r\"'`.,;:"


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """(characters, their bases) of all letters with a canonical decomposition into one ASCII letter and marks."""
    pairs = {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        plain = unicodedata.normalize("NFD", char)
        if len(plain) > 1 and plain[0].isascii() and all(map(unicodedata.combining, plain[1:])):
            pairs[char] = plain[0]
    return "".join(pairs), "".join(pairs.values())


def strip_accents(text: Column) -> Column:
    """Letters without their accents, composed or not; case and other signs stay."""
    chars, bases = accent_map()
    return F.translate(F.regexp_replace(text, r"[\u0300-\u036f]", ""), chars, bases)


def ascii_fold(text: Column, *, lower: bool = True, stroke: bool = False) -> Column:
    """Without accents; lower-case if asked; with `stroke` also đ becomes d."""
    out = strip_accents(text)
    if stroke:
        out = F.translate(out, "đĐ", "dD")
    return F.lower(out) if lower else out


def tokens(text: Column) -> Column:
    """Folded runs of ASCII letters and digits without stop words."""
    return F.filter(F.regexp_extract_all(ascii_fold(text), F.lit("([a-z0-9]+)")), lambda t: ~t.isin(*STOPWORDS))


def terms(text: Column) -> Column:
    """Index terms: folded tokens of two or more signs, then the pairs of neighbours.

    đ is folded too and a token is a run of ASCII signs, so that Vietnamese words stay whole and every engine agrees.
    """
    words = F.regexp_extract_all(ascii_fold(text, stroke=True), F.lit("([a-z0-9][a-z0-9_.-]*[a-z0-9_])"))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def unescape(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def normalize_text(text: Column) -> Column:
    """Entities resolved, star bullets dropped, blanks collapsed, at most one blank line."""
    out = F.translate(unescape(text), "\u00a0", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*[✯★☆✭✰]\s*", "")
    out = F.regexp_replace(out, r"[ \t\r\f\x0b]+", " ")
    out = F.regexp_replace(out, r"\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r" *\n *", "\n"), r"^\s+|\s+$", "")


def clean_field(text: Column) -> Column:
    """normalize_text without byte order marks."""
    return F.replace(normalize_text(text), F.lit("\ufeff"), F.lit(""))


def line_key(line: Column) -> Column:
    """Folded ASCII letters, digits and underscores of a line."""
    return F.regexp_replace(ascii_fold(line, stroke=True), r"\W+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_generated(text: Column) -> Column:
    """Without replacement characters, white space collapsed."""
    return collapse(F.replace(text, F.lit("\ufffd"), F.lit("")))


def clean_page(text: Column, *, boilerplate: tuple[str, ...] = (), end_markers: tuple[str, ...] = (), least_chars: int = 16, after: int = 1_200) -> Column:
    """Lines of a crawled page that may be content.

    Drops blank lines, lines with a boilerplate term, short ones without a digit, bare links and repeated lines (the
    first stays); then cuts at the first end marker behind `after` characters, marker by marker.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(collapse(x), F.lit(" -|\t")))

    def kept(line: Column) -> Column:
        low = F.lower(line)
        bad = (line == "") | ((F.length(line) <= least_chars) & ~line.rlike("[0-9]")) | (low.rlike(r"^https?://\S*$") & (F.length(line) < 100))
        for term in boilerplate:
            bad = bad | low.contains(term)
        return ~bad

    out = F.array_join(F.array_distinct(F.filter(lines, kept)), "\n")
    for marker in end_markers:
        at = F.locate(marker, F.lower(out), after + 1)
        out = F.when(at > 0, F.rtrim(F.substring(out, F.lit(1), at - 1))).otherwise(out)
    return out


def clean_answer(answer: Column, *, prefixes: bool = True, most: int = 220) -> Column:
    """White space collapsed, quotes and stops trimmed, a leading `answer:` dropped (if prefixes), at most `most` signs."""
    out = F.btrim(F.regexp_replace(answer, r"\s+", " "), F.lit(TRIMMED))
    if prefixes:
        out = F.regexp_replace(out, r"^(?i:answer|is|was|are|were)\s*:\s*", "")
    return F.btrim(F.substring(out, 1, most), F.lit(TRIMMED))


def sentences(text: Column) -> Column:
    """Sentences and lines of more than two signs, trimmed of blanks and separators."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+", -1)
    return F.transform(F.filter(parts, lambda p: F.length(F.trim(p)) > 2), lambda p: F.btrim(p, F.lit(" \t;:-")))


def long_sentences(text: Column, *, least: int = 45, most: int = 420) -> Column:
    """Clauses between stops, colons and semicolons of `least` to `most` signs."""
    parts = F.split(collapse(text), r"(?<=[.!?:;])\s+", -1)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p).between(least, most))


def normalize_answer(answer: Column) -> Column:
    """For scoring: lower case, punctuation deleted, articles dropped, white space collapsed."""
    bare = F.translate(F.lower(answer), PUNCTUATION, "")
    return collapse(F.regexp_replace(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def normalize_label(answer: Column) -> Column:
    """For agreement: folded, & as and, no thousands separators, slashes and dashes as spaces, other punctuation too."""
    out = F.lower(ascii_fold(F.trim(answer), lower=False))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    for _ in range(3):
        out = F.regexp_replace(out, r"(\d)[.,](\d{3})(?!\d)", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\w]|_", " "), r"\s+", " "))


def fact_answer(text: Column) -> Column:
    """The cleaned answer of a `Question: … Answer: …` text; null if there is none."""
    found = F.regexp_extract(text, r"(?is)\bAnswer:\s*(.+?)(?:\.\s*$|\n|$)", 1)
    return F.nullif(clean_answer(found), F.lit(""))


def fact_question(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?is)\bQuestion:\s*(.+?)\s+Answer:\s*", 1)
    return F.nullif(clean_answer(found), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case authority of a URL, with its port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def title_from_url(url: Column, *, most: int = 120) -> Column:
    """The last segment of the path as words without extension, else the host."""
    last = F.regexp_extract(F.rtrim(url_path(url), F.lit("/")), r"([^/]*)$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.translate(last, "-_", "  "), r"\.[A-Za-z0-9]+$", ""), r"\s+", " "))
    return F.substring(F.coalesce(F.nullif(words, F.lit("")), host(url)), 1, most)


def headline_from_url(url: Column, *, most: int = 140) -> Column:
    """title_from_url without post numbers, every word capitalised."""
    last = F.regexp_extract(F.rtrim(url_path(url), F.lit("/")), r"([^/]*)$", 1)
    words = F.regexp_replace(F.regexp_replace(last, r"-?post\d+.*$", ""), r"\.[A-Za-z0-9]+$", "")
    return F.substring(F.initcap(F.trim(F.regexp_replace(F.translate(words, "-_", "  "), r"\s+", " "))), 1, most)


def compact_title(title: Column, *, default: str = "the document", most: int = 110) -> Column:
    """White space collapsed, a trailing ` - site name` dropped; the default for nothing."""
    out = F.regexp_replace(collapse(title), r"\s+[-|–]\s+[^-|–]*$", "")
    return F.substring(F.coalesce(F.nullif(out, F.lit("")), F.lit(default)), 1, most)


def normalize_url(base: Column, link: Column, *, blocked: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "svg", "css", "js", "ico", "zip", "rar", "mp4", "mp3", "doc", "xls")) -> Column:
    """The absolute http(s) URL of a link without its fragment; null for other schemes and blocked extensions.

    Relative paths are resolved against the base's folder; `../` segments are resolved once each.
    """
    bare = F.regexp_replace(F.trim(link), r"#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(url_path(base), r"^(.*/)[^/]*$", 1), F.lit("")), F.lit("/")))
    joined = (
        F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .otherwise(F.concat(folder, bare))
    )
    joined = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(3):
        joined = F.regexp_replace(joined, r"(?<![:/])/[^/.][^/]*/\.\./", "/")
    ok = (bare != "") & joined.rlike(r"^https?://[^/?#]+") & ~F.lower(url_path(joined)).rlike(rf"\.(?:{'|'.join(blocked)})$")
    return F.when(ok, joined)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def sentence_letters_ok(sentence: Column, *, least_words: int = 8, letters: float = 0.52, digits: float = 0.45) -> Column:
    """Whether a sentence has enough words, mostly letters, and not too many digits."""
    n_letters = F.length(F.regexp_replace(sentence, r"[^\p{L}]", ""))
    n_digits = F.length(F.regexp_replace(sentence, r"[^0-9]", ""))
    return (word_count(sentence) >= least_words) & (n_letters >= letters * F.length(sentence)) & (n_digits <= digits * n_letters)


def decode_js(text: Column) -> Column:
    r"""JavaScript escapes (\uXXXX, \", \/, \n, \t) resolved by the JSON reader; text that is no JSON string stays."""
    safe = F.concat(F.lit('{"t":"'), F.regexp_replace(F.regexp_replace(text, r'(?<!\\)"', r'\\"'), r"[\r\n\t]", " "), F.lit('"}'))
    return unescape(F.coalesce(F.get_json_object(safe, "$.t"), text))


def json_of_reply(reply: Column, schema: str) -> Column:
    """The JSON of a generated reply, whose code fence is dropped; null if it doesn't parse."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.from_json(bare, schema)
