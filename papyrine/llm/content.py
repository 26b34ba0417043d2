"""Main content of pages, by ratios over the paths at which their lines stand.

The texts are plain, so the root-to-leaf path of a line is its domain, its leading segment (of a path line) and its
skeleton: lower-case ASCII without white space, bullets and final colons, digits as 0. Skeletons keep no letter outside
ASCII, so a line garbled by a wrong encoding stays on its path.
Over all distinct texts of a domain each path gets the share of pages that hold it, its text length and punctuation per
node, and how often it heads a list; a text that is published again counts once. The share is smoothed by the pooled
share over the domains that have the path, so that what is furniture everywhere is also known where it is rare, and a
path that many domains repeat a little isn't furniture where it is by chance more frequent. The text of a path is its
length, weighted by punctuation: furniture repeats little text on many pages, content puts much text on few. The smoothed
share is divided by the text (the fused score), and a path whose score reaches LEAST_SHARE is furniture: a short one
needs little more than that share, a long punctuated one a multiple of it. Decisions are then smoothed along the page:
a path line whose leading segment is furniture, the lines above the article's own title, and the titles of other pages
that follow a furniture heading belong to the page. `html_nodes` does the same over the true tag paths of HTML.

Null, empty and blank texts have no lines. A null domain is a domain of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from papyrine.llm.lines import not_blank, per_domain, signed
from papyrine.runtime import cut, sized_join

DIGITS = re.compile(r"\d+")
SEPARATOR = re.compile(r"\s[>»|/·]\s|\s{2,}")
TRAIL = re.compile(r"\s[>»/]\s")
DROPPED = bytes(range(0x21)).replace(b"\n", b"") + b"\x7f"
BULLETS = "•»+*-> \t\xa0"
#: Least share of a domain's distinct pages, once divided by the text, and least number of them, of a furniture path.
LEAST_SHARE, LEAST_PAGES = 0.05, 3
#: Signs, weighted by punctuation, with which a path needs twice the least share.
LONG_TEXT = 1_000
#: Pages' worth of evidence that the pooled share of a path has in a domain, and domains from which it is pooled.
PRIOR_PAGES, LEAST_DOMAINS = 100, 3
#: Shares of a furniture path's occurrences with a final colon or arrow, or before a title or teaser, from which it heads a list.
HEAD_COLONS, HEAD_LEADS = 0.15, 0.5
#: Characters from which a line is no title of another page.
LONGEST_TEASER = 400
#: Characters from which a line above the title is body.
LONG_LINE = 250
#: Share of all titles from which their opening words or a run of three words mark a line as a title.
TITLE_SHARE, RUN_SHARE = 0.002, 0.008


def skeletons(text: str) -> list[bytes]:
    """One skeleton per line; a line without ASCII signs has its own letters instead, a blank one is empty."""
    folded = DIGITS.sub("0", text.lower())
    found = folded.encode("ascii", "ignore").translate(None, DROPPED).split(b"\n")
    out = []
    for i, s in enumerate(found):
        s = s.lstrip(b"+>*-").rstrip(b":")
        out.append(s or folded.split("\n")[i].strip().encode())
    return out


def leading(line: str) -> str:
    """The first segment of a line of segments, or ''."""
    parts = SEPARATOR.split(line.strip(), maxsplit=1)
    return parts[0] if len(parts) > 1 else ""


def trail(line: str) -> int | None:
    """The path of the leading segment of a line such as `Home > News > Title`; None for other lines."""
    parts = TRAIL.split(line.strip(), maxsplit=1)
    part = skeletons(parts[0].replace("\n", " "))[0] if len(parts) > 1 else b""
    return signed(xxh3_64_intdigest(b">" + part)) if part else None


def titled(line: str, opens: frozenset[str], runs: frozenset[str]) -> bool:
    """Whether a line opens like a title, or holds a run of words that titles share."""
    words = DIGITS.sub("0", line.lower().lstrip(BULLETS)).split()
    if len(words) < 2:
        return False
    if words[0] in opens or f"{words[0]} {words[1]}" in opens:
        return True
    return any(" ".join(words[i : i + 3]) in runs for i in range(len(words) - 2))


def teaser(line: str, opens: frozenset[str], runs: frozenset[str]) -> bool:
    """Whether a line may name another page: bulleted as teasers are or worded like a title, and no longer than one."""
    return len(line) < LONGEST_TEASER and (line.lstrip()[:1] in ("•", "»") or titled(line, opens, runs))


def path_rows(opens: frozenset[str], runs: frozenset[str]) -> Callable:
    """Makes the function that maps pages to (domain, path, weight, chars, signs, colons, leads) of each distinct path of a page."""

    def rows(batches):
        for batch in batches:
            out: dict[str, list] = {"domain": [], "path": [], "weight": [], "chars": [], "signs": [], "colons": [], "leads": []}
            for domain, text, copies in zip(*(batch.column(c).to_pylist() for c in ("domain", "text", "copies")), strict=True):
                seen: set[int] = set()
                lines, leads = text.split("\n"), False
                for line, skeleton in reversed(list(zip(lines, skeletons(text), strict=True))):
                    if not skeleton:
                        continue
                    signs = skeleton.count(b".") + skeleton.count(b",") + skeleton.count(b";") + skeleton.count(b"?")
                    for path, chars in ((signed(xxh3_64_intdigest(skeleton)), len(line)), (trail(line), 0)):
                        if path is not None and path not in seen:
                            seen.add(path)
                            out["domain"].append(domain)
                            out["path"].append(path)
                            out["weight"].append(1 / (copies or 1))
                            out["chars"].append(chars)
                            out["signs"].append(signs if chars else 0)
                            out["colons"].append(line.rstrip().endswith((":", "»")))
                            out["leads"].append(leads)
                    leads = teaser(line, opens, runs)
            kinds = {"domain": pa.string(), "path": pa.int64(), "weight": pa.float64(), "chars": pa.int32(), "signs": pa.int32(), "colons": pa.bool_(), "leads": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return rows


def path_ratios(docs: DataFrame, opens: frozenset[str] = frozenset(), runs: frozenset[str] = frozenset()) -> DataFrame:
    """(domain, path, pages, share, smoothed, fused, colons, leads) of every path that several pages of a domain or several domains have.

    Each of n equal texts of a domain counts 1 / n; only the hashes of texts that come again are joined.
    """
    pages = docs.filter(not_blank(F.col("text"))).select("domain", "text", F.xxhash64("domain", "text").alias("h"))
    counts = pages.groupBy("domain", "h").agg(F.count("*").alias("copies"))
    again = cut(counts.filter("copies > 1").select("h", "copies"))
    weighed = sized_join(pages, again, ["h"], "left", salt_by=F.col("h"))
    rows = weighed.select("domain", "text", "copies").mapInArrow(path_rows(opens, runs), "domain string, path long, weight double, chars int, signs int, colons boolean, leads boolean")
    totals = counts.groupBy(F.coalesce("domain", F.lit("")).alias("domain")).agg(F.count("*").alias("domain_pages"))
    means = [F.avg("chars").alias("chars"), F.avg("signs").alias("signs"), F.avg(F.col("colons").cast("int")).alias("colons"), F.avg(F.col("leads").cast("int")).alias("leads")]
    return smoothed_ratios(rows.withColumn("domain", F.coalesce("domain", F.lit(""))).groupBy("domain", "path").agg(F.round(F.sum("weight"), 6).alias("pages"), *means), totals)


def smoothed_ratios(sums: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds share, the share smoothed over domains, and the score fused with the text to (domain, path, pages, chars, signs, ..)."""
    sums = cut(sums.join(totals, "domain"))
    seen = sums.filter(F.col("pages") >= LEAST_PAGES)
    pooled = seen.groupBy("path").agg(F.count("*").alias("domains"), F.sum("pages").alias("p"), F.sum("domain_pages").alias("d"))
    pooled = cut(pooled.filter(F.col("domains") >= LEAST_DOMAINS).select("path", (F.col("p") / F.col("d")).alias("pooled")))
    joined = sized_join(sums, pooled, ["path"], "left", salt_by=F.xxhash64("domain")).filter((F.col("pages") >= LEAST_PAGES) | F.col("pooled").isNotNull())
    share = F.col("pages") / F.col("domain_pages")
    near = F.when(F.col("pooled").isNull(), share).otherwise(F.greatest("pooled", (F.col("pages") + PRIOR_PAGES * F.col("pooled")) / (F.col("domain_pages") + PRIOR_PAGES)))
    fused = near / (1 + F.col("chars") * (1 + F.col("signs")) / LONG_TEXT)
    rest = [c for c in ("colons", "leads") if c in sums.columns]
    return joined.select("domain", "path", "pages", share.alias("share"), near.alias("smoothed"), fused.alias("fused"), *rest)


def furniture_paths(docs: DataFrame, opens: frozenset[str] = frozenset(), runs: frozenset[str] = frozenset()) -> DataFrame:
    """(domain, paths array<long>, heads array<long>) with the paths of each domain that are page furniture.

    A domain can have at most its mean number of lines divided by the least share of them, and what is furniture by
    the pooled share.
    """
    kept = path_ratios(docs, opens, runs).filter(F.col("fused") >= LEAST_SHARE)
    heads = (F.col("colons") >= HEAD_COLONS) | (F.col("leads") >= HEAD_LEADS)
    return kept.groupBy("domain").agg(F.collect_list("path").alias("paths"), F.collect_list(F.when(heads, F.col("path"))).alias("heads"))


def title_marks(docs: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(opening words, runs of three words) that mark titles: at most 1 / TITLE_SHARE and 1 / RUN_SHARE per title word."""
    titles = docs.filter(not_blank(F.col("title"))).select(F.split(F.regexp_replace(F.lower(F.trim("title")), r"\p{Nd}+", "0"), r"\s+").alias("w"))
    titles = titles.filter(F.size("w") >= 2)
    first = F.when(F.element_at("w", 1).endswith(":"), F.element_at("w", 1)).otherwise(F.concat_ws(" ", F.slice("w", 1, 2)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))
    marks = F.array_append(F.when(F.size("w") >= 3, F.array_distinct(F.transform(runs, lambda r: F.concat(F.lit("r"), r)))).otherwise(F.array().cast("array<string>")), F.concat(F.lit("o"), first))
    counts = titles.select(F.explode(marks).alias("mark")).groupBy("mark").count()
    total = titles.count()
    opens, run = F.col("mark").startswith("o"), F.col("mark").startswith("r")
    least = F.greatest(F.lit(3), F.when(opens, F.lit(TITLE_SHARE * total)).otherwise(F.lit(RUN_SHARE * total)))
    found = [r.mark for r in counts.filter((opens | run) & (F.col("count") >= least)).collect()]
    return frozenset(m[1:] for m in found if m[0] == "o"), frozenset(m[1:] for m in found if m[0] == "r")


def page_parts(text: str, title: str | None, paths: frozenset[int], heads: frozenset[int], opens: frozenset[str], runs: frozenset[str]) -> list[bool]:
    """For each line whether it is page furniture; blank lines aren't."""
    lines, bones = text.split("\n"), skeletons(text)
    hashes = [signed(xxh3_64_intdigest(b)) if b else None for b in bones]
    drop = [h in paths for h in hashes]
    own = skeletons(title.split("\n")[0])[0] if title and title.strip() else None

    first = None
    for i, (line, b) in enumerate(zip(lines, bones, strict=True)):
        if not b or drop[i]:
            continue
        if first is None and own is not None and b == own:
            first = i
        head = leading(line)
        if head:
            part = skeletons(head)[0]
            drop[i] = trail(line) in paths or bool(part) and signed(xxh3_64_intdigest(part)) in paths
    if first is not None and all(len(x) < LONG_LINE for x in lines[:first]):
        for i in range(first):
            drop[i] = bool(bones[i])
    listing = body = False
    for i, b in enumerate(bones):
        if not b:
            listing = False
        elif drop[i]:
            listing = body and hashes[i] in heads
        elif listing and i != first and teaser(lines[i], opens, runs):
            drop[i] = True
        else:
            listing, body = False, True
    return drop


@dataclass(frozen=True)
class Furniture:
    """What a corpus says about its pages: the furniture paths per domain, materialised, and the marks of titles."""

    paths: DataFrame
    opens: frozenset[str]
    runs: frozenset[str]


def furniture_of(docs: DataFrame) -> Furniture:
    """The furniture of all web pages of docs; found once, it serves every pass over them or over a part of them."""
    opens, runs = title_marks(docs)
    return Furniture(cut(furniture_paths(docs.filter(F.col("source_type") == "web_source_text"), opens, runs)), opens, runs)


def with_furniture(docs: DataFrame, columns: list[str], of: Callable, schema: str, furniture: Furniture | None = None) -> DataFrame:
    """Runs of(batch of columns, drop lists) over documents with a text that isn't blank, joined with their domain's paths.

    `columns` must hold what `of` needs; text is always there. The furniture of texts that aren't web pages is empty.
    `furniture` is that of the corpus docs are part of; without it, that of docs.
    """
    furniture = furniture or furniture_of(docs)
    opens, runs = furniture.opens, furniture.runs
    names = list(dict.fromkeys([*columns, "text", "title", "domain", "source_type"]))
    rows = docs.filter(not_blank(F.col("text"))).select(*names)
    rows, sets_of = per_domain(rows, furniture.paths, ("paths", "heads"))

    def run(batches):
        for batch in batches:
            drops, of_domain = [], sets_of(batch)
            for i, (domain, kind, title, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("domain", "source_type", "title", "text")), strict=True)):
                if kind != "web_source_text":
                    drops.append([False] * (text.count("\n") + 1))
                else:
                    drops.append(page_parts(text, title, *of_domain(domain or "", i), opens, runs))
            yield of(batch, drops)

    return rows.mapInArrow(run, schema)


def furniture_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no) of the lines of web pages that aren't main body; blank lines are never reported."""

    def rows(batch, drops):
        keys, numbers = [], []
        for k, d in zip(batch.column(key).to_pylist(), drops, strict=True):
            hit = [i for i, x in enumerate(d) if x]
            keys += [k] * len(hit)
            numbers += hit
        return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(numbers, pa.int64())], names=[key, "line_no"])

    web = docs.filter(F.col("source_type") == "web_source_text")
    return with_furniture(web, [key], rows, f"{key} {dict(docs.dtypes)[key]}, line_no long")


def main_text(docs: DataFrame, key: str = "doc_id", *, furniture: Furniture | None = None) -> DataFrame:
    """(key, text, removed_lines): the main body of every document; a null or blank text comes back as it is."""

    def rows(batch, drops):
        texts = [
            "\n".join(x for x, d in zip(t.split("\n"), drop, strict=True) if not d) for t, drop in zip(batch.column("text").to_pylist(), drops, strict=True)
        ]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string()), pa.array([sum(d) for d in drops], pa.int32())], names=[key, "text", "removed_lines"])

    kept = with_furniture(docs, [key], rows, f"{key} {dict(docs.dtypes)[key]}, text string, removed_lines int", furniture)
    blank = docs.filter(~not_blank(F.col("text"))).select(key, "text", F.lit(0).alias("removed_lines"))
    return kept.unionByName(blank)


#: Elements whose text is never shown, and elements that have no end tag. Fixed values.
HIDDEN = frozenset("script style noscript template title head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


class Nodes(HTMLParser):
    """Collects the text nodes of a page with their root-to-leaf tag paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:  # ends what was left open inside it, too
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not HIDDEN.intersection(self.open):
            self.found.append(("/".join(self.open), text))


def tag_nodes(body: bytes | None, content_type: str | None) -> list[tuple[str, str]]:
    """(tag path, text) of a page's text nodes in order; bytes are read by the declared encoding, else as UTF-8."""
    declared = CHARSET.search(content_type or "")
    try:
        text = (body or b"").decode(declared[1] if declared else "utf-8", "replace")
    except LookupError:
        text = (body or b"").decode("utf-8", "replace")
    parser = Nodes()
    parser.feed(text)
    parser.close()
    return parser.found


def html_nodes(pages: DataFrame) -> DataFrame:
    """(url, node_no, path, text, score, content boolean) of the text nodes of rows with url, content_type and body.

    Per site (the host of the url) and tag path text length and punctuation per node give the path ratio; it is smoothed
    over neighbouring nodes of a page, divided by the site's mean over all nodes, and nodes of at least half of that
    mean (a quarter before smoothing) are content. A heading is content if what follows it is. Null bodies have no nodes; fetches of one url that
    differ are pages of their own, equal ones count once.
    """

    def rows(batches):
        for batch in batches:
            out: dict[str, list] = {"url": [], "page": [], "node_no": [], "path": [], "text": []}
            for url, page, kind, body in zip(*(batch.column(c).to_pylist() for c in ("url", "page", "content_type", "body")), strict=True):
                for i, (path, text) in enumerate(tag_nodes(body, kind)):
                    for name, value in (("url", url), ("page", page), ("node_no", i), ("path", path), ("text", text)):
                        out[name].append(value)
            kinds = {"url": pa.string(), "page": pa.int64(), "node_no": pa.int32(), "path": pa.string(), "text": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    own = pages.filter(F.col("body").isNotNull()).select("url", "content_type", "body", F.xxhash64("url", "content_type", "body").alias("page")).dropDuplicates(["page"])
    nodes = cut(own.mapInArrow(rows, "url string, page long, node_no int, path string, text string").withColumn("site", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit(""))))
    signs = F.length("text") - F.length(F.regexp_replace("text", r"[.,;:?!]", ""))
    sums = nodes.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(signs).alias("signs"))
    ratio = F.col("chars") / F.col("n") * (1 + F.col("signs") / F.col("n"))
    ratios = cut(sums.select("site", "path", ratio.alias("ratio"), "n"))
    means = ratios.groupBy("site").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("mean"))
    scored = sized_join(nodes, ratios.join(means, "site").select("site", "path", "ratio", "mean"), ["site", "path"], salt_by=F.col("page"))
    along = Window.partitionBy("page").orderBy("node_no")
    near = (2 * F.col("ratio") + F.coalesce(F.lag("ratio").over(along), "ratio") + F.coalesce(F.lead("ratio").over(along), "ratio")) / 4
    smooth = scored.withColumn("score", near / F.col("mean"))
    heading = F.element_at(F.split("path", "/"), -1).isin(*HEADINGS)
    body = (F.col("score") >= 0.5) & (F.col("ratio") >= 0.25 * F.col("mean"))
    content = F.when(heading, F.coalesce(F.lead("score").over(along), "score") >= 0.5).otherwise(body)
    return smooth.select("url", "node_no", "path", "text", F.round("score", 6).alias("score"), content.alias("content"))
