"""Exact search that scans the passages twice and moves no postings.

The first scan counts in how many passages each term stands; the second weighs the terms of each passage, scores it for
all queries and keeps the k best. Queries and document frequencies are broadcast after both were measured; a term that
isn't among the latter stands in one passage only, which makes them few. Terms are those of `functions.text.terms`, made
by Python's string methods and hashed to 64 bits; scores are those of `retrieval.lexical_scores`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from papyrine.functions import text as T
from papyrine.runtime import saved

WORD = re.compile(r"[a-z0-9][a-z0-9_.-]*[a-z0-9_]")
#: Characters and passages that are worked on at once, and queries that are scored at once.
SLICE_CHARS, SLICE_ROWS, QUERY_BLOCK = 2_000_000, 2_048, 1_024
#: Runs of signs that a task remembers; queries and terms up to which they are broadcast (12 bytes a term).
RUNS, QUERIES, TERMS = 1_000_000, 50_000, 5_000_000
#: How many postings of a term cost as much as one cell of a matrix product.
SPARSE = 50


def fold_table() -> dict[int, str | None]:
    """What str.translate needs to do as text.ascii_fold(..., stroke=True)."""
    chars, bases = T.accent_map()
    return {**dict.fromkeys(range(0x300, 0x370)), **dict(zip(map(ord, chars), bases, strict=True)), ord("đ"): "d", ord("Đ"): "D"}


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes; the order counts."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Counter:
    """Counts the terms of texts; remembers within a task which terms a run of signs between white space has.

    No term contains white space and letters are folded one by one, so the terms of a text are those of its runs.
    """

    def __init__(self) -> None:
        self.fold = fold_table()
        self.forget()

    def forget(self) -> None:
        self.runs: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for run in text.split():
            ids = self.runs.get(run)
            if ids is None:
                folded = (run if run.isascii() else run.translate(self.fold)).lower()
                ids = self.runs[run] = tuple(self.words.setdefault(w, len(self.words)) for w in WORD.findall(folded))
            out += ids
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms, doc, at, tf): the distinct terms, and for each term of each text its place among them and its number."""
        if len(self.runs) > RUNS:
            self.forget()
        each = [self.ids(t) if t else [] for t in texts]
        ids, doc = np.fromiter(chain.from_iterable(each), np.int64), np.repeat(np.arange(len(each)), [len(x) for x in each])
        if len(self.words) > len(self.hashes):
            new = list(self.words)[len(self.hashes) :]
            made = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in new)
            self.hashes = np.concatenate([self.hashes, np.frombuffer(made, np.uint64)])
        h, same = self.hashes[ids], doc[1:] == doc[:-1]
        at, terms = pd.factorize(np.concatenate([h, mixed(h[:-1], h[1:])[same]]))
        code, tf = np.unique(np.concatenate([doc, doc[1:][same]]) * max(1, len(terms)) + at, return_counts=True)
        return terms, code // max(1, len(terms)), code % max(1, len(terms)), tf


def places(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, there): where each of `wanted` stands in sorted_, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def slices(batch: pa.RecordBatch, text: str = "text"):
    """The batch in parts of bounded characters and rows."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.array([len(t) if t else 0 for t in column.to_pylist()], np.int64)
    begin = 0
    ends = np.cumsum(size)
    while begin < len(size):
        before = ends[begin - 1] if begin else 0
        end = min(begin + SLICE_ROWS, max(begin + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def frequencies(passages: DataFrame, asked: np.ndarray) -> DataFrame:
    """(t, n): in how many passages the term with the hash t stands, of terms in two or more, or in `asked`."""

    def run(batches):
        counter, terms, numbers, held = Counter(), [], [], 0

        def merged():
            t, at = np.unique(np.concatenate(terms), return_inverse=True)
            return t, np.bincount(at, np.concatenate(numbers), len(t)).astype(np.int64)

        for batch in batches:
            for part in slices(batch):
                t, _, at, _ = counter.counts(part.column(0).to_pylist())
                terms.append(t)
                numbers.append(np.bincount(at, minlength=len(t)))
                held += len(t)
                if held > 4_000_000:
                    t, n = merged()
                    terms, numbers, held = ([t], [n], 0) if len(t) < 2_000_000 else ([], [], 0)
                    if not terms:
                        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["t", "n"])
        if terms:
            t, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["t", "n"])

    wanted = [int(x) for x in asked.view(np.int64)]
    spark = passages.sparkSession
    counted = passages.select("text").filter(F.col("text").isNotNull()).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    marked = counted.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"t": pd.Series(wanted, dtype="int64"), "asked": True}), "t long, asked boolean")), "t", "left")
    return marked.filter((F.col("n") > 1) | F.col("asked")).select("t", F.col("n").cast("int").alias("n"))


@dataclass
class Asked:
    """The queries: ids, vectors or None, and their terms' weights, ordered by term."""

    ids: np.ndarray
    vectors: np.ndarray | None
    terms: np.ndarray
    starts: np.ndarray  # first weight of each term
    query: np.ndarray
    weight: np.ndarray


def idf(n: np.ndarray, passages: int) -> np.ndarray:
    return np.log((1.0 + passages) / (1.0 + n)) + 1.0


def asked_of(ids: np.ndarray, vectors: np.ndarray | None, counts, known: np.ndarray, number: np.ndarray, passages: int) -> Asked:
    """Unit weights of the queries' terms that stand in some passage."""
    terms, query, at, tf = counts
    order = np.argsort(terms)
    terms, at = terms[order], np.argsort(order)[at]
    place, there = places(known, terms)
    keep = there[at]
    query, at, tf = query[keep], at[keep], tf[keep]
    raw = (1.0 + np.log(tf)) * idf(number[place] if len(number) else np.zeros(len(place)), passages)[at]
    length = np.sqrt(np.bincount(query, raw * raw, len(ids)))
    order = np.argsort(at, kind="stable")
    query, at, weight = query[order], at[order], (raw / length[query])[order]
    used, starts = np.unique(at, return_index=True)
    return Asked(ids, vectors, terms[used], np.append(starts, len(at)), query, weight)


class Best:
    """The k best passages of each query so far: by rounded score, ties to the greater key."""

    def __init__(self, queries: int, k: int, least: float) -> None:
        self.k, self.queries = k, queries
        self.bar = np.full(queries, least)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, first: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: of the queries from number `first`, by keys. Only those above the bar are taken."""
        bar = self.bar[first : first + len(scores)]
        taken = scores > bar[:, None]
        if scores.shape[1] > self.k and taken.sum() > 4 * self.k * len(scores):
            own = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            taken &= scores > (own - 2e-6)[:, None]
        q, at = np.nonzero(taken)
        if len(q):
            self.held.append((q + first, keys[at], np.round(scores[q, at], 6)))
            self.pending += len(q)
        if self.pending > 2 * self.k * self.queries:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        q, key, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-pd.factorize(key, sort=True)[0], -score, q))
        begins = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - begins < self.k]
        q, key, score = q[order], key[order], score[order]
        last = np.flatnonzero(np.bincount(q, minlength=self.queries) == self.k)
        # rounding moves a score by half a millionth at most, and an equal one may have a greater key
        self.bar[last] = np.maximum(self.bar[last], score[np.searchsorted(q, last, side="right") - 1] - 1e-6)
        self.held, self.pending = [(q, key, score)], 0
        return self.held[0]


def search(queries: DataFrame, passages: DataFrame, k: int, *, qid: str = "qid", key: str = "chunk_id", column: str | None = None, weight: float = 0.70) -> DataFrame | None:
    """(qid, key, score): at least the k best passages of each query, from every part of the table; retrieval.top_k merges them.

    Without `column` the score is the lexical one, and passages that share no term with the query are left out; with it
    weight x inner product of `column` + (1 - weight) x lexical score, over all passages. A passage without key counts,
    but has no lexical score. None if the queries or terms are too many to broadcast, or a key stands in several rows.
    Both tables should be materialised.
    """
    spark = passages.sparkSession
    if queries.count() > QUERIES:
        return None
    rows, keys, whole = passages.agg(F.count("*"), F.count_distinct(key) + F.count_if(F.col(key).isNull()), F.count("text")).first()
    if rows != keys:
        return None
    own = queries.select(qid, "text", *([column] if column else [])).toPandas()
    counts = Counter().counts([t if isinstance(t, str) else None for t in own.text])
    known = saved(frequencies(passages, counts[0]))
    if known.count() > TERMS:
        return None
    table = known.toPandas()
    term, number = table.t.to_numpy(np.int64).view(np.uint64), table.n.to_numpy(np.int32)
    order = np.argsort(term)
    term, number = term[order], number[order]
    vectors = np.stack(own[column]).astype(np.float64) if column and len(own) else None
    asked = asked_of(own[qid].to_numpy(), vectors, counts, term, number, whole)
    shared = spark.sparkContext.broadcast((asked, term, number))
    kinds = dict(queries.dtypes) | dict(passages.dtypes)
    schema = f"q {kinds[qid]}, p {kinds[key]}, score double"
    asks = to_arrow_type(queries.schema[qid].dataType)

    def run(batches):
        asked, term, number = shared.value
        counter, best = Counter(), Best(len(asked.ids), k, -np.inf if column else 0.0)
        used = np.diff(asked.starts)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch):
                ids = part.column(0).to_pandas().to_numpy()
                terms, doc, at, tf = counter.counts(part.column(1).to_pylist())
                place, there = places(term, terms)
                raw = (1.0 + np.log(tf)) * idf(np.where(there, number[place] if len(number) else 1, 1), whole)[at]
                w = raw / np.sqrt(np.bincount(doc, raw * raw, len(ids)))[doc]
                place, there = places(asked.terms, terms)
                keep = there[at] & ~pd.isna(ids)[doc]
                doc, w, at = doc[keep], w[keep], place[at[keep]]
                dense = np.stack(part.column(2).to_pandas().to_numpy()).astype(np.float64) if column else None
                present = np.bincount(at, minlength=len(asked.terms))
                common = present * used * SPARSE > len(asked.ids) * len(ids)
                column_of = np.cumsum(common) - 1
                much = common[at]
                wide = np.zeros((int(common.sum()), len(ids)))
                wide[column_of[at[much]], doc[much]] = w[much]
                doc, w, at = doc[~much], w[~much], at[~much]
                # every rare posting once for each query that has the term
                times = used[at]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                entry = np.repeat(asked.starts[at], times) + offset
                cell = asked.query[entry], np.repeat(doc, times), asked.weight[entry] * np.repeat(w, times)
                by = np.repeat(common, used)
                for first in range(0, len(asked.ids), QUERY_BLOCK):
                    size = min(QUERY_BLOCK, len(asked.ids) - first)
                    mine = (cell[0] >= first) & (cell[0] < first + size)
                    scores = np.bincount((cell[0][mine] - first) * len(ids) + cell[1][mine], cell[2][mine], size * len(ids)).reshape(size, len(ids)).astype(np.float64, copy=False)
                    own = by & (asked.query >= first) & (asked.query < first + size)
                    if own.any():
                        tall = np.zeros((size, len(wide)))
                        tall[asked.query[own] - first, column_of[np.repeat(np.arange(len(used)), used)[own]]] = asked.weight[own]
                        scores += tall @ wide
                    if column:
                        scores = weight * (asked.vectors[first : first + size] @ dense.T) + (1 - weight) * scores
                    best.add(first, scores, ids)
        q, p, score = best.settle()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q].tolist(), asks), pa.array(p.tolist(), kind), pa.array(score)], names=["q", "p", "score"])

    found = passages.select(key, "text", *([column] if column else [])).mapInArrow(run, schema)
    return found.select(F.col("q").alias(qid), F.col("p").alias(key), "score")
