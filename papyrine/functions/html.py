"""Text, title and links of HTML, as Column expressions: scripts go first, balance of tags is never assumed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import text as T

SKIPPED = "script|style|noscript|svg|canvas"
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul|title"


#: Single-byte charsets that can be declared, as Python spells them.
SINGLE_BYTE = (*(f"windows-{n}" for n in range(1250, 1259)), *(f"iso-8859-{n}" for n in (*range(2, 12), *range(13, 17))), "koi8-r", "koi8-u", "macintosh", "ibm437", "ibm850")
HIGH = "".join(map(chr, range(128, 256)))


def decoded(body: Column, content_type: Column) -> Column:
    """The text of a body in its declared charset; invalid bytes become replacement characters.

    UTF-8 is the default and stands in for charsets that aren't known. Single-byte charsets are read as Latin-1 and
    their upper half is translated by the charset's own table, so all of it stays in the JVM.
    """
    charset = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1))
    latin = F.decode(body, "ISO-8859-1")
    tables = F.create_map(*(F.lit(x) for c in SINGLE_BYTE for x in (c, bytes(range(128, 256)).decode(c, "replace"))))
    out = F.make_valid_utf8(body.cast("string"))
    out = F.when(charset.isin(*SINGLE_BYTE), F.call_function("translate", latin, F.lit(HIGH), F.element_at(tables, charset))).otherwise(out)
    out = F.when(charset.isin("utf-16", "utf-16le", "utf-16be"), F.decode(body, "UTF-16")).otherwise(out)
    return F.when(charset.isin("iso-8859-1", "latin-1", "latin1", "us-ascii"), latin).otherwise(out)


def script_text(html: Column) -> Column:
    """Text of markup that scripts hold escaped (`\\u003c` for `<`, or set as inner HTML): unescaped, without tags."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    marked = F.filter(bodies, lambda x: F.contains(F.lower(x), F.lit("\\u003c")) | F.contains(x, F.lit("dangerouslySetInnerHTML")))
    out = F.array_join(marked, "\n")
    for escaped, plain in ((r"(?i)\\u003c", "<"), (r"(?i)\\u003e", ">"), (r"(?i)\\u0026", "&"), (r"(?i)\\u0022|\\\"", '"'), (r"\\n|\\t|\\r", " "), (r"\\/", "/")):
        out = F.regexp_replace(out, escaped, plain)
    inner = F.array_join(F.transform(F.regexp_extract_all(out, F.lit(r"(?s)>([^<>]*\p{L}[^<>]*)<"), F.lit(1)), lambda x: T.collapse(T.unescape(x))), "\n")
    return F.coalesce(inner, F.lit(""))


def page_text(html: Column) -> Column:
    """Visible text, and below it that of escaped markup in scripts."""
    return F.concat_ws("\n", F.nullif(visible_text(html), F.lit("")), F.nullif(script_text(html), F.lit("")))


def without_scripts(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(out, rf"(?is)<({SKIPPED})\b[^>]*>.*?</\1\s*>", " ")


def visible_text(html: Column, *, tables: bool = True) -> Column:
    """Visible text with a line per block; table cells of a row are joined by ` | ` if asked."""
    out = without_scripts(html)
    if tables:
        out = F.regexp_replace(out, r"(?is)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return T.normalize_text(F.regexp_replace(out, r"(?s)<[^>]*>", ""))


def title(html: Column, fallback: Column, *, most: int = 180) -> Column:
    """og:title, else <title>, else <h1>, else the fallback; white space collapsed."""
    ways = (r'(?is)<meta[^>]+property=["\']og:title["\'][^>]+content=["\']([^"\']*)', r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>")
    found = [F.nullif(T.collapse(T.unescape(F.regexp_replace(F.regexp_extract(html, w, 1), r"<[^>]*>", ""))), F.lit("")) for w in ways]
    return F.substring(F.coalesce(*found, fallback), 1, most)


def links(html: Column, base: Column) -> Column:
    """The distinct normalised links of a page in order of their URL, also those in skipped regions."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: T.normalize_url(base, T.unescape(x))), lambda x: x.isNotNull())))
