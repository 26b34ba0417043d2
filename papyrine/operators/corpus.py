"""Building a document table: fetch status, cleaning, enrichment, de-duplication, crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import classify, html
from papyrine.functions import text as T
from papyrine.runtime import cut


def load_status(fetched: DataFrame, *, fetch: bool = True, least_words: int = 40) -> DataFrame:
    """(url, fetch_status, text): what came of each fetch.

    skipped without fetching; the fetch's own error; decode_error for too many replacement signs; too_short; ok.
    """
    if not fetch:
        return fetched.select("url", F.lit("skipped").alias("fetch_status"), F.lit("").alias("text"))
    text = F.coalesce(html.visible_text(html.decoded(F.col("body"), F.col("content_type"))), F.lit(""))
    rows = fetched.select("url", "status", "body", text.alias("text"))
    lost = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("body").isNull(), "error")
        .when(lost > F.greatest(F.lit(20.0), F.length("text") * 0.02), "decode_error")
        .when(T.word_count(F.col("text")) < least_words, "too_short")
        .otherwise("ok")
    )
    return rows.select("url", status.alias("fetch_status"), "text")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is last by the given columns; ties go by all other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in by]
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in by), *(F.col(c).cast("string").desc_nulls_last() for c in rest))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order; never an arbitrary one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def clean_documents(docs: DataFrame, *, key: str = "doc_id", terms: tuple[str, ...] = ("copyright", "read more", "related posts", "cookie"), fact: str = "Fact ", marker: str = "Curated facts") -> DataFrame:
    """(key, text): lines that aren't boilerplate; short ones only once. Facts always stay; a long line may come again.

    From the first line that begins with `marker` on only facts are kept.

    Row-local. Each array is materialised once by a generator, since lambdas would compute it again per element. A
    line counts as seen by its key if it has fewer than 18 words. A null text stays null.
    """
    def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.withColumn(name, F.explode(F.array(value)))

    rows = docs.select(key, "title", F.coalesce("text", F.lit("")).alias("_text"), F.col("text").isNull().alias("_null"))
    rows = once(rows, "_lines", F.filter(F.transform(F.split("_text", "\n", -1), T.collapse), lambda x: x != ""))
    rows = once(rows, "_end", F.coalesce(F.nullif(F.array_position(F.transform("_lines", lambda x: x.startswith(marker)), F.lit(True)), F.lit(0)), F.size("_lines") + 1))
    rows = once(rows, "_lines", F.filter("_lines", lambda x, i: (i + 1 < F.col("_end")) | x.startswith(fact)))
    rows = once(rows, "_kept", F.filter("_lines", lambda x: x.startswith(fact) | ~classify.boilerplate_line(x, F.col("title"), terms=terms)))
    rows = once(rows, "_keys", F.transform("_kept", lambda x: F.when((T.word_count(x) < 18) & ~x.startswith(fact), T.line_key(x))))
    first = F.filter("_kept", lambda x, i: F.get("_keys", i).isNull() | (F.array_position("_keys", F.get("_keys", i)) == i + 1))
    return rows.select(key, F.when(~F.col("_null"), F.array_join(first, "\n")).alias("text"))


def enrich(docs: DataFrame) -> DataFrame:
    """Adds domain, content hash, sizes, category and language to rows with url and text."""
    return docs.withColumns(
        {
            "domain": T.host(F.col("url")),
            "content_sha256": F.sha2(F.coalesce("text", F.lit("")), 256),
            "char_count": F.length(F.coalesce("text", F.lit(""))),
            "word_count": T.word_count(F.coalesce("text", F.lit(""))),
            "category": classify.category(F.col("url"), F.col("text")),
            "source_language": classify.marker_language(F.col("text")),
        }
    )


def fact_lines(pairs: DataFrame) -> DataFrame:
    """(source_url, text): a header and one numbered fact line per pair of the source, in order of id."""
    answer = F.coalesce(F.nullif("answer", F.lit("")), F.array_join("answers", "; "))
    rows = pairs.filter(F.col("source_url").isNotNull() & F.col("question").isNotNull() & answer.isNotNull()).select("source_url", "id", "question", answer.alias("answer")).distinct()
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("source_url").orderBy("id", "question", "answer")))
    line = F.concat(F.lit("Fact "), F.col("n"), F.lit(". Question: "), F.col("question"), F.lit(" Answer: "), F.col("answer"), F.lit("."))
    lines = numbered.groupBy("source_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("l"))
    return lines.select("source_url", F.concat(F.lit("Curated facts\n"), F.array_join("l", "\n")).alias("text"))


def from_sources(pairs: DataFrame, loaded: DataFrame) -> DataFrame:
    """(id, url, fetch_status, text, manual_train_qa_count): a document per source URL of the pairs, numbered by URL.

    The text is the loaded one where it is ok, else the source's fact lines.
    """
    counts = pairs.filter(F.col("source_url").isNotNull()).groupBy(F.col("source_url").alias("url")).agg(F.count_distinct("id").alias("manual_train_qa_count"))
    facts = fact_lines(pairs).withColumnRenamed("source_url", "url").withColumnRenamed("text", "facts")
    rows = counts.join(loaded, "url", "left").join(facts, "url", "left")
    good = F.coalesce(F.col("fetch_status") == "ok", F.lit(False))
    text = F.when(good, F.col("text")).otherwise(F.coalesce("facts", F.lit("")))
    ranked = with_ordinal(rows.select("url", F.coalesce("fetch_status", F.lit("skipped")).alias("fetch_status"), text.alias("text"), "manual_train_qa_count"), "url")
    return ranked.select(F.format_string("doc_%04d", F.col("ordinal")).alias("id"), "url", "fetch_status", "text", "manual_train_qa_count")


def with_ordinal(rows: DataFrame, column: str, *, name: str = "ordinal") -> DataFrame:
    """Numbers rows from 1 in order of a unique column, with one range shuffle and the sizes of its partitions.

    Only the counts per partition reach one task; the rows are numbered where they lie.
    """
    ordered = cut(rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return ordered.withColumn("_l", local).join(F.broadcast(before), "_p").withColumn(name, (F.col("before") + F.col("_l")).cast("long")).drop("_p", "_l", "before")


def quality_gate(docs: DataFrame, terms: tuple[str, ...], *, least_words: int = 70, mandatory: Column | None = None) -> DataFrame:
    """Documents with words enough that are relevant by URL or text, or mandatory."""
    wanted = classify.relevant(F.col("url"), F.col("text"), terms)
    if mandatory is not None:
        wanted = wanted | F.coalesce(mandatory, F.lit(False))
    return docs.filter((T.word_count(F.coalesce("text", F.lit(""))) >= least_words) & wanted)


def crawl(seeds: DataFrame, pages: DataFrame, *, rounds: int = 3, most: int | None = None, relevant: Column | None = None) -> DataFrame:
    """(url, depth, place): the order in which a breadth-first crawl over (url, html) pages comes to URLs.

    Seeds stand in order of URL; then a URL's place is that of its first link, by the place of the linking page and the
    link's place on it. `relevant` is a condition on `url` for links to follow; seeds are always followed. `most` bounds
    all fetches together, in this order, as a crawler's limit does; None crawls to the end. Each level is an anti-join
    with what was visited and an explode of links; levels are materialised.
    """
    def numbered(rows: DataFrame, key: Column, depth: int, base: int) -> DataFrame:
        return cut(with_ordinal(rows.withColumn("_k", key), "_k", name="_o").select("url", F.lit(depth).alias("depth"), (F.col("_o") + base).alias("place")))

    frontier = numbered(seeds.select("url").filter(F.col("url").isNotNull()).distinct(), F.col("url"), 0, 0)
    visited = frontier
    for depth in range(1, rounds + 1):
        base = visited.count()
        if most is not None and base >= most:
            break
        found = frontier.join(pages, "url").select("place", F.posexplode(html.links(F.col("html"), F.col("url"))).alias("pos", "url"))
        if relevant is not None:
            found = found.filter(relevant)
        first = found.groupBy("url").agg(F.min(F.struct("place", "pos")).alias("at")).join(visited.select("url"), "url", "left_anti")
        frontier = numbered(first.select("url", "at"), F.format_string("%015d|%09d", "at.place", "at.pos"), depth, base)
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    return visited if most is None else visited.filter(F.col("place") <= most)


def crawled_documents(order: DataFrame, fetched: DataFrame, terms: tuple[str, ...], *, least_words: int = 70, mandatory: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents (id, url, place, content_sha256, text), failures (url, status)) of a crawl's order.

    fetched has (url, status, text), a row per URL. Failed fetches are reported; documents are gated, and of those with
    one text the first in the crawl's order stays. They are numbered from 0 in that order.
    """
    rows = order.join(fetched, "url")
    failures = rows.filter(F.coalesce(F.col("status") != "ok", F.lit(True))).select("url", "status")
    good = quality_gate(rows.filter(F.col("status") == "ok"), terms, least_words=least_words, mandatory=mandatory)
    hashed = good.withColumn("content_sha256", F.sha2("text", 256))
    kept = hashed.groupBy("content_sha256").agg(F.min_by(F.struct("url", "place", "text"), "place").alias("d")).select("d.*", "content_sha256")
    ids = F.format_string("doc_%04d", F.col("ordinal") - 1)
    return with_ordinal(kept, "place").select(ids.alias("id"), "url", "place", "content_sha256", "text"), failures


def missing_sources(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_url): the pairs' sources that no document has."""
    asked = pairs.filter(F.col("source_url").isNotNull()).select("source_url").distinct()
    return asked.join(documents.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_anti")


def with_documents(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs with the document_id of their source_url; raises a KeyError that names sources no document has.

    documents has (document_id, url), a row per URL. Pairs without a source have no document and are left out.
    """
    lost = [r.source_url for r in missing_sources(pairs, documents).orderBy("source_url").limit(5).collect()]
    if lost:
        raise KeyError(f"sources without a document: {', '.join(lost)}")
    return pairs.join(documents.select(F.col("url").alias("source_url"), "document_id"), "source_url")


def annotations(pairs: DataFrame, documents: DataFrame, chunks: DataFrame, *, split: str, seed: int = 42, status: str = "manual_curated", language: str = "en") -> DataFrame:
    """Annotation rows of one split in a seeded order: (id, split, question, answers, answer, source_id, source_url, chunk_id, qa_language, annotation_status).

    pairs has (question, answer, source_url). Rows of the train split get their document and the chunk that holds the
    answer; others have neither. Ids number the seeded order from 0. Repeated pairs stay repeated.
    """
    from papyrine.operators import chunking, generation

    keyed = pairs.select("question", "answer", "source_url")
    copies = keyed.groupBy("question", "answer", "source_url").agg(F.count("*").alias("n"))
    rows = copies.select("question", "answer", "source_url", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    rows = rows.withColumn("_key", F.sha2(F.to_json(F.struct("question", "answer", "source_url", "copy")), 256))
    placed = cut(generation.shuffled(rows, seed=seed, key="_key").withColumn("id", F.format_string(f"{split}_%04d", F.col("place") - 1)))
    if split == "train":
        sourced = with_documents(placed, documents).withColumnRenamed("document_id", "source_id")
        sourced = sourced.join(chunking.with_answer(sourced.select("id", "source_id", "question", "answer"), chunks), "id", "left")
    else:
        none = F.lit(None).cast("string")
        sourced = placed.withColumn("source_url", none).withColumns({"source_id": none, "chunk_id": none})
    return sourced.select("id", F.lit(split).alias("split"), "question", F.array("answer").alias("answers"), "answer", "source_id", "source_url", "chunk_id", F.lit(language).alias("qa_language"), F.lit(status).alias("annotation_status"))


def dataset_metadata(documents: DataFrame, chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of statistics: documents, chunks, pairs per split, sources, fetched and fallback documents, counts per fetch status."""
    one = F.lit(1).alias("_one")
    fetched = F.count_if(F.coalesce(F.col("fetch_status") == "ok", F.lit(False)))
    docs = documents.agg(F.count("*").alias("document_count"), F.count_distinct("url").alias("unique_source_url_count"), fetched.alias("fetched_source_count"), (F.count("*") - fetched).alias("fallback_source_count"), one)
    parts = (
        chunks.agg(F.count("*").alias("chunk_count"), one),
        pairs.agg(F.count_if(F.col("split") == "train").alias("train_count"), F.count_if(F.col("split") == "test").alias("test_count"), one),
        histogram(documents, "fetch_status").select(F.col("counts").alias("fetch_status_counts"), one),
    )
    for part in parts:
        docs = docs.join(F.broadcast(part), "_one")
    return docs.drop("_one")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """One row with a map from value to count."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).isNotNull())
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))


def refreshed(cached: DataFrame, pairs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Cached documents without their fact lines, cleaned and enriched anew; facts come back only where nothing is left."""
    bare = cached.withColumn("text", F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: ~x.startswith("Fact ")), "\n"))
    cleaned = clean_documents(bare, key=key).withColumnRenamed("text", "_clean")
    facts = fact_lines(pairs).select(F.col("source_url").alias("url"), F.col("text").alias("_facts"))
    rows = bare.select(key, "title", "url").join(cleaned, key).join(facts, "url", "left")
    return enrich(rows.select(key, "title", "url", F.coalesce(F.nullif("_clean", F.lit("")), F.col("_facts"), F.lit("")).alias("text")))


def repaired_titles(docs: DataFrame, *, bad: tuple[str, ...] = ("home", "index", "untitled", "trang chủ")) -> DataFrame:
    """Documents whose missing or empty-worded title is replaced by one made of the URL, classified anew."""
    title = F.when(F.col("title").isNull() | (F.length(F.trim("title")) < 4) | F.lower(F.trim("title")).isin(*bad), T.headline_from_url(F.col("url"))).otherwise(F.col("title"))
    return docs.withColumn("title", title).withColumn("category", classify.category_raw(F.col("url"), F.col("title"), F.col("text")))


def manifest(docs: DataFrame, *, most: int = 800) -> DataFrame:
    """(documents, domains, urls): counts, and the first `most` URLs in order."""
    first = docs.filter(F.col("url").isNotNull()).select("url").distinct().orderBy("url").limit(most).agg(F.array_sort(F.collect_list("url")).alias("urls"), F.lit(1).alias("k"))
    counts = docs.agg(F.count("*").alias("documents"), F.count_distinct(T.host(F.col("url"))).alias("domains"), F.lit(1).alias("k"))
    return counts.join(F.broadcast(first), "k").drop("k")
