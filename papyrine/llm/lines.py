"""Lines that come back across the documents of one site.

Documents with the same text on one domain are first collapsed to a cluster with its number of members and its
first day. A line is counted over clusters and days as well as over members, so a republished article raises the
member count of its lines but not their cluster count. Counting goes in three steps with partial aggregation
(line, cluster), (line, day), (line), so that one hot domain or line is never gathered in one task.

`occurrences` reports lines by their members, as the definition of its cases says. `boilerplate_lines` and
`without_repeated` decide by clusters and days: a line must stand in enough different documents, published on more than
one day, so that an article which is published again keeps its lines.

Null, empty and blank texts have no lines; a null domain is a domain of its own (none of its lines is ever frequent).
A line counts once per document; each of its occurrences is reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from papyrine.runtime import cut, sized_join

#: Unicode white space, as a class of a Java pattern.
SPACE = r"\t-\r \x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIGITS = re.compile(r"\d+")


def not_blank(text: Column) -> Column:
    """Whether a text has anything but white space; false for null."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def comparable(text: str) -> list[str]:
    """Lines trimmed, with single spaces, in lower case and with every run of digits read as 0."""
    return [" ".join(line.split()) for line in DIGITS.sub("0", text.lower()).split("\n")]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_lines(batches):
    """Adds to each text the 64-bit hashes of its comparable lines, null for a blank one.

    Python's string methods do this at a sixth of the CPU time of the JVM's case mapping and regular expressions.
    """
    for batch in batches:
        values, valid, ends = [], [], [0]
        for text in batch.column("text").to_pylist():
            for line in comparable(text):
                valid.append(bool(line))
                values.append(xxh3_64_intdigest(line) if line else 0)
            ends.append(len(values))
        flat = pa.array(np.array(values, np.uint64).view(np.int64), mask=~np.array(valid, bool))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), lists], names=[*keep, "lines"])


def hashed(docs: DataFrame, key: str) -> DataFrame:
    """(key, domain, cluster, day, lines array<long>) of every document with a text that isn't blank, materialised."""
    rows = docs.filter(not_blank(F.col("text"))).select(key, "domain", F.xxhash64("text").alias("cluster"), F.substring("collected_at", 1, 10).alias("day"), "text")
    kind = dict(rows.dtypes)[key]
    return cut(rows.mapInArrow(hash_lines, f"{key} {kind}, domain string, cluster long, day string, lines array<long>"))


def line_counts(rows: DataFrame) -> DataFrame:
    """(domain, line, n_docs, n_clusters, n_days) per line of a domain, of the rows that hashed() gives."""
    each = rows.select("domain", "cluster", "day", F.explode(F.array_compact(F.array_distinct("lines"))).alias("line"))
    clusters = each.groupBy("domain", "line", "cluster").agg(F.count("*").alias("n"), F.min("day").alias("day"))
    days = clusters.groupBy("domain", "line", "day").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    return days.groupBy("domain", "line").agg(F.sum("n").alias("n_docs"), F.sum("c").alias("n_clusters"), F.count("day").alias("n_days"))


def repeated_lines(rows: DataFrame, *, least_docs: int = 8, least_share: float = 0.10) -> DataFrame:
    """The counts of lines that stand in at least least_docs documents and in least_share of their domain's.

    A domain can have at most its mean number of lines divided by least_share of them.
    """
    totals = rows.groupBy("domain").agg(F.count("*").alias("domain_docs"))
    counts = line_counts(rows).filter(F.col("n_docs") >= least_docs)
    return counts.join(totals, "domain").filter(F.col("n_docs") >= F.col("domain_docs") * least_share)


def boilerplate_lines(rows: DataFrame, *, least_clusters: int = 8, least_share: float = 0.10, least_days: int = 2) -> DataFrame:
    """The counts of lines in at least least_clusters distinct documents and least_share of their domain's, on least_days days.

    Where none of a line's documents has a day, the days don't count.
    """
    totals = rows.select("domain", "cluster").distinct().groupBy("domain").agg(F.count("*").alias("domain_clusters"))
    counts = line_counts(rows).filter((F.col("n_clusters") >= least_clusters) & ((F.col("n_days") >= least_days) | (F.col("n_days") == 0)))
    return counts.join(totals, "domain").filter(F.col("n_clusters") >= F.col("domain_clusters") * least_share)


#: Longs that all domains' sets may have together to be broadcast: 16 MB as sent.
SET_LONGS = 2_000_000


def per_domain(rows: DataFrame, sets: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable]:
    """Brings arrays of longs per domain to the rows of each domain, whose column is `domain`.

    `sets` (domain, one array per name) should be materialised. If the arrays are small together they are broadcast as
    one dictionary, else they are joined to the rows. Returns the rows to map over and a function that gives, of a
    batch, the function (domain, row number) -> tuple of frozensets, empty for a domain without sets.
    """
    size = sets.agg(F.sum(sum((F.size(n) for n in names), F.lit(8)))).first()[0] or 0
    none = tuple(frozenset() for _ in names)
    if size <= SET_LONGS:
        shared = rows.sparkSession.sparkContext.broadcast({r.domain: tuple(frozenset(r[n]) for n in names) for r in sets.collect()})
        return rows, lambda batch: lambda domain, i: shared.value.get(domain, none)
    keyed = rows.withColumn("_domain", F.coalesce("domain", F.lit("")))
    named = sets.select(F.col("domain").alias("_domain"), *(F.col(n).alias(f"_{n}") for n in names))
    joined = sized_join(keyed, named, ["_domain"], "left", limit=0, salt_by=F.xxhash64("text")).drop("_domain")

    def of_batch(batch):
        columns, kept = [batch.column(f"_{n}") for n in names], {}

        def of(domain, i):
            if domain not in kept:
                kept[domain] = tuple(frozenset(c[i].as_py() or ()) for c in columns)
            return kept[domain]

        return of

    return joined, of_batch


def occurrences(docs: DataFrame, *, key: str = "doc_id", least_docs: int = 8, least_share: float = 0.10) -> DataFrame:
    """(key, line_no) of every occurrence of a repeated line; line_no counts from 0."""
    rows = hashed(docs, key)
    repeated = cut(repeated_lines(rows, least_docs=least_docs, least_share=least_share).select("domain", "line"))
    marks = rows.select(key, "domain", F.posexplode("lines").alias("line_no", "line")).filter(F.col("line").isNotNull())
    return sized_join(marks, repeated, ["domain", "line"], "left_semi", salt_by=F.xxhash64(key)).select(key, F.col("line_no").cast("long").alias("line_no"))


def without_repeated(docs: DataFrame, *, key: str = "doc_id", least_clusters: int = 8, least_share: float = 0.10, least_days: int = 2) -> DataFrame:
    """(key, text, removed_lines): every text without its domain's boilerplate lines; null and blank texts come back as they are."""
    found = boilerplate_lines(hashed(docs, key), least_clusters=least_clusters, least_share=least_share, least_days=least_days)
    sets = cut(found.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.collect_list("line").alias("lines")))
    rows, sets_of = per_domain(docs.filter(not_blank(F.col("text"))).select(key, "domain", "text"), sets, ("lines",))

    def run(batches):
        for batch in batches:
            texts, removed, of_domain = [], [], sets_of(batch)
            for i, (domain, text) in enumerate(zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                (hit,) = of_domain(domain, i)
                own = text.split("\n")
                kept = [x for x, c in zip(own, comparable(text), strict=True) if not (c and signed(xxh3_64_intdigest(c)) in hit)] if hit else own
                texts.append("\n".join(kept))
                removed.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=[key, "text", "removed_lines"])

    clean = rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, text string, removed_lines int")
    return clean.unionByName(docs.filter(~not_blank(F.col("text"))).select(key, "text", F.lit(0).alias("removed_lines")))
