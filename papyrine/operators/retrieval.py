"""Lexical, dense and hybrid retrieval for whole sets of queries at once.

An index is an ordinary table of postings; searching joins it with the queries' terms and keeps the best k per query,
which Catalyst limits before the shuffle. Dense search multiplies blocks of queries with blocks of passages, each pair
of blocks in one task, and merges the local best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as T
from papyrine.operators import scan
from papyrine.runtime import BROADCAST_ROWS, cut, saved, sized_join


def postings(passages: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf) of the passages' terms."""
    return passages.select(key, F.explode(T.terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(passages: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """(key, term, idf, weight): sublinear tf, smoothed idf, unit length per passage. Materialised, since it is used twice."""
    rows = cut(postings(passages, key=key))
    n = passages.filter(F.col("text").isNotNull()).select(key).distinct().count()
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = rows.join(df.select("term", idf.alias("idf")), "term").withColumn("raw", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", "idf", (F.col("raw") / F.col("norm")).alias("weight"))


def query_weights(queries: DataFrame, index: DataFrame, *, qid: str = "qid") -> DataFrame:
    """(qid, term, q): unit weights of the queries' terms; terms outside the index don't count."""
    asked = queries.select(qid, F.explode(T.terms(F.col("text"))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("tf"))
    known = asked.join(index.select("term", "idf").distinct(), "term").withColumn("raw", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(qid)))
    return known.select(qid, "term", (F.col("raw") / length).alias("q"))


def lexical_scores(queries: DataFrame, index: DataFrame, *, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(qid, key, score): cosine of all queries and passages that share a term, for later mixing."""
    weighted = query_weights(queries, index, qid=qid)
    return weighted.join(index.select(key, "term", "weight"), "term").groupBy(qid, key).agg(F.sum(F.col("q") * F.col("weight")).alias("score"))


def top_k(scores: DataFrame, k: int, *, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(qid, rank, key, score): the best k by rounded score, ties to the greater key."""
    rounded = scores.withColumn("score", F.round("score", 6))
    order = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(key).desc())
    return rounded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(qid, "rank", key, "score")


def lexical_best(queries: DataFrame, index: DataFrame, k: int, *, qid: str = "qid", key: str = "chunk_id", query_block: int = 512, passage_block: int = 8_192) -> DataFrame:
    """The k best of lexical_scores per query, in blocks of queries and passages.

    Common terms make the number of (query, passage, term) triples explode; here they exist only as numpy sums inside a
    block, and k rows per query and block are shuffled. Only postings of terms that some query has are moved, once: the
    queries' weights are broadcast while they are few, and only beyond that postings are copied for blocks of queries.
    Terms travel as 64-bit hashes.
    """
    weighted = cut(query_weights(queries, index, qid=qid))
    asked = cut(weighted.select("term").distinct())
    matching = sized_join(index.select(key, "term", "weight"), asked, ["term"], "left_semi", salt_by=F.xxhash64(key))
    np_ = max(1, -(-index.select(F.approx_count_distinct(key)).first()[0] // passage_block))
    left = weighted.select(F.col(qid).alias("q"), F.xxhash64("term").alias("t"), F.col("q").alias("w"))
    right = matching.select(F.col(key).alias("p"), F.xxhash64("term").alias("t"), F.col("weight").alias("w")).withColumn("pb", F.pmod(F.xxhash64("p"), F.lit(np_)).cast("int"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            terms = np.unique(a.t.to_numpy())
            at = np.minimum(np.searchsorted(terms, b.t.to_numpy()), len(terms) - 1)
            b = b[terms[at] == b.t.to_numpy()]
            names, place = np.unique(b.p.to_numpy(), return_inverse=True)
            # postings by term, so that a query touches those of its own terms only
            order = np.argsort(b.t.to_numpy(), kind="stable")
            tails, weight, place = b.t.to_numpy()[order], b.w.to_numpy()[order], place[order]
            for q, own in a.groupby("q") if len(names) else ():
                begins, ends = np.searchsorted(tails, own.t.to_numpy()), np.searchsorted(tails, own.t.to_numpy(), side="right")
                hit = np.concatenate([np.arange(x, y) for x, y in zip(begins, ends, strict=True)]) if len(own) else np.zeros(0, np.int64)
                raised = np.repeat(own.w.to_numpy(), ends - begins)
                score = np.round(np.bincount(place[hit], weight[hit] * raised, len(names)), 6)[::-1]  # greater keys first among equals
                shared = np.bincount(place[hit], minlength=len(names))[::-1] > 0
                top = np.argsort(np.where(shared, -score, np.inf), kind="stable")[:k]
                top = top[shared[top]]
                out.append(pd.DataFrame({"q": q, "p": names[::-1][top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"q": np.array([], object), "p": np.array([], object), "score": np.zeros(0)})

    types = dict(left.dtypes) | dict(right.dtypes)
    schema = f"q {types['q']}, p {types['p']}, score double"
    if weighted.count() <= BROADCAST_ROWS:
        shared_ = left.sparkSession.sparkContext.broadcast(left.toPandas())
        found = right.groupBy("pb").applyInPandas(lambda b: best(shared_.value, b), schema)
    else:
        nq = max(1, -(-queries.count() // query_block))
        left = left.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
        right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        found = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(best, schema)
    return top_k(found.select(F.col("q").alias(qid), F.col("p").alias(key), "score"), k, qid=qid, key=key)


def search(queries: DataFrame, index: DataFrame, k: int = 8, *, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """lexical_best; a query that shares no term with any passage gets the first k passages with score 0.

    queries and index should be materialised or cheap, since both are read twice.
    """
    index = cut(index)
    best = cut(lexical_best(queries, index, k, qid=qid, key=key))
    lost = queries.select(qid).join(best.select(qid).distinct(), qid, "left_anti")
    first = index.select(key).distinct().orderBy(key).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(key)))
    fallback = lost.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").select(qid, "rank", key, F.lit(0.0).alias("score"))
    return best.unionByName(fallback)


def stored(passages: DataFrame, *, key: str = "chunk_id") -> DataFrame:
    """The passages in a saved table, spread over its files by key, so that every scan of it uses all cores."""
    return saved(passages.repartition(key))


def search_passages(queries: DataFrame, passages: DataFrame, k: int = 8, *, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """search() over the passages (key, text) themselves, without an index, while queries and terms are few enough to broadcast.

    Both should be materialised; passages best by stored().
    """
    found = scan.search(queries, passages, k, qid=qid, key=key)
    if found is None:
        return search(queries, tfidf(passages, key=key), k, qid=qid, key=key)
    best = cut(top_k(found, k, qid=qid, key=key))
    lost = cut(queries.select(qid).join(F.broadcast(best.select(qid).distinct()), qid, "left_anti"))
    if lost.isEmpty():
        return best
    first = passages.filter(F.col(key).isNotNull() & (F.size(T.terms(F.col("text"))) > 0)).select(key).distinct().orderBy(key).limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(key))).withColumn("_one", F.lit(1))
    return best.unionByName(lost.withColumn("_one", F.lit(1)).join(F.broadcast(ranked), "_one").select(qid, "rank", key, F.lit(0.0).alias("score")))


def unit(column: str):
    """The array scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(column, lambda x: x.cast("double") / norm)).otherwise(F.transform(column, lambda x: x.cast("double")))


def mean_pool(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(by, embedding): the unit mean of the vectors of each group."""
    parts = vectors.select(by, F.posexplode(column).alias("d", "x")).groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias(column))
    return pooled.select(by, unit(column).alias(column))


#: Numbers of the queries' vectors up to which they are broadcast: 32 MB.
SHARED_NUMBERS = 4_000_000


def dense_best(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, p, score): the k best passages of b (p, v) for each query of a (q, v)."""
    if a.empty or b.empty:
        return pd.DataFrame({"q": np.array([], object), "p": np.array([], object), "score": np.zeros(0)})
    b = b.sort_values("p", ascending=False)
    scores = np.round(np.stack(a.v).astype(np.float64) @ np.stack(b.v).astype(np.float64).T, 6)
    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({"q": np.repeat(a.q.to_numpy(), at.shape[1]), "p": b.p.to_numpy()[at.ravel()], "score": np.take_along_axis(scores, at, 1).ravel()})


def dense_search(queries: DataFrame, passages: DataFrame, k: int = 8, *, qid: str = "qid", key: str = "vec_id", column: str = "embedding", query_block: int = 512, passage_block: int = 8_192) -> DataFrame:
    """(qid, rank, key, score): exact inner products of all queries with all passages, in blocks.

    While the queries' vectors are small together they are broadcast and the passages are scanned once, where they lie.
    Beyond that queries fall into blocks of about query_block, passages of about passage_block, and each pair of blocks
    is one group. Either way a matrix product keeps its k best, so no score but k per query and batch is shuffled.
    """
    asked = queries.count()
    size = queries.agg(F.max(F.size(column))).first()[0] or 0
    if asked * size <= SHARED_NUMBERS:
        shared = queries.sparkSession.sparkContext.broadcast(queries.select(F.col(qid).alias("q"), F.col(column).alias("v")).toPandas())

        def scan(parts):
            for b in parts:
                yield dense_best(shared.value, b, k)

        kinds = dict(queries.dtypes) | dict(passages.dtypes)
        found = passages.select(F.col(key).alias("p"), F.col(column).alias("v")).mapInPandas(scan, f"q {kinds[qid]}, p {kinds[key]}, score double")
        return top_k(found.select(F.col("q").alias(qid), F.col("p").alias(key), "score"), k, qid=qid, key=key)
    nq = max(1, -(-asked // query_block))
    np_ = max(1, -(-passages.count() // passage_block))
    left = queries.select(F.col(qid).alias("q"), F.col(column).alias("v")).withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    right = passages.select(F.col(key).alias("p"), F.col(column).alias("v")).withColumn("pb", F.pmod(F.xxhash64("p"), F.lit(np_)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    types = dict(left.dtypes) | dict(right.dtypes)
    found = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(lambda a, b: dense_best(a, b, k), f"q {types['q']}, p {types['p']}, score double")
    return top_k(found.select(F.col("q").alias(qid), F.col("p").alias(key), "score"), k, qid=qid, key=key)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = 12, *, weight: float = 0.70, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(qid, rank, key, score): weight x dense + (1 - weight) x lexical, a missing score is 0."""
    both = dense.select(qid, key, F.col("score").alias("d")).join(lexical.select(qid, key, F.col("score").alias("l")), [qid, key], "full")
    score = weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("l", F.lit(0.0))
    return top_k(both.select(qid, key, score.alias("score")), k, qid=qid, key=key)


def hybrid_search(queries: DataFrame, passages: DataFrame, index: DataFrame, k: int = 12, *, weight: float = 0.70, qid: str = "qid", key: str = "chunk_id", column: str = "embedding", query_block: int = 512, passage_block: int = 8_192) -> DataFrame:
    """(qid, rank, key, score): weight x inner product + (1 - weight) x lexical score, over all passages.

    queries have (qid, text, column), passages (key, column), index is the passages' tfidf(). Both scores of every query
    and passage are added inside a batch, which keeps the k best sums; neither side is cut before. Only postings of terms
    that some query has are gathered. While the queries are few they are broadcast and the passages are scanned once,
    beyond that both fall into blocks. A text without known terms has lexical score 0. All three should be
    materialised, since they are read more than once.
    """

    def listed(rows: DataFrame, by: str, value: str) -> DataFrame:
        pairs = F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col(value).alias("w")))
        return rows.groupBy(by).agg(pairs.alias("x")).select(by, F.col("x.t").alias("t"), F.col("x.w").alias("w"))

    weighted = cut(query_weights(queries, index, qid=qid))
    matching = sized_join(index.select(key, "term", "weight"), cut(weighted.select("term").distinct()), ["term"], "left_semi", salt_by=F.xxhash64(key))
    asked = cut(queries.select(qid, column).join(listed(weighted, qid, "q"), qid, "left"))
    stored = passages.select(key, column).join(listed(matching, key, "weight"), key, "left")
    numbers = asked.agg(F.sum(F.size(column) + 2 * F.greatest(F.coalesce(F.size("t"), F.lit(0)), F.lit(0)))).first()[0] or 0
    nq, np_ = (1, 1) if numbers <= SHARED_NUMBERS else (max(1, -(-queries.count() // query_block)), max(1, -(-passages.count() // passage_block)))
    left = asked.select(F.col(qid).alias("q"), F.col(column).alias("v"), "t", "w").withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))
    right = stored.select(F.col(key).alias("p"), F.col(column).alias("v"), "t", "w").withColumn("pb", F.pmod(F.xxhash64("p"), F.lit(np_)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": np.array([], object), "p": np.array([], object), "score": np.zeros(0)})
        b = b.sort_values("p", ascending=False, ignore_index=True)
        scores = weight * (np.stack(a.v).astype(np.float64) @ np.stack(b.v).astype(np.float64).T)
        known, held = a.t.notna().to_numpy(), b[b.t.notna()]
        if known.any() and len(held):
            terms = np.unique(np.concatenate(a.t[known].to_list()))
            place, t, w = np.repeat(held.index.to_numpy(), held.t.map(len)), np.concatenate(held.t.to_list()), np.concatenate(held.w.to_list())
            at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            hit = terms[at] == t
            place, at, w = place[hit], at[hit], w[hit]
            for i in np.flatnonzero(known):
                wanted = np.zeros(len(terms))
                wanted[np.searchsorted(terms, a.t.iloc[i])] = a.w.iloc[i]
                scores[i] += (1 - weight) * np.bincount(place, w * wanted[at], len(b))
        scores = np.round(scores, 6)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"q": np.repeat(a.q.to_numpy(), top.shape[1]), "p": b.p.to_numpy()[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()})

    types = dict(left.dtypes) | dict(right.dtypes)
    schema = f"q {types['q']}, p {types['p']}, score double"
    if numbers <= SHARED_NUMBERS:
        shared = left.sparkSession.sparkContext.broadcast(left.select("q", "v", "t", "w").toPandas())

        def scan(parts):
            for b in parts:
                yield best(shared.value, b)

        found = right.select("p", "v", "t", "w").mapInPandas(scan, schema)
    else:
        found = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(best, schema)
    return top_k(found.select(F.col("q").alias(qid), F.col("p").alias(key), "score"), k, qid=qid, key=key)


def hybrid_passages(queries: DataFrame, passages: DataFrame, k: int = 12, *, weight: float = 0.70, qid: str = "qid", key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """hybrid_search() over passages (key, text, column) without an index, while queries and terms are few enough to broadcast."""
    found = scan.search(queries, passages, k, qid=qid, key=key, column=column, weight=weight)
    if found is None:
        return hybrid_search(queries, passages, cut(tfidf(passages, key=key)), k, weight=weight, qid=qid, key=key, column=column)
    return top_k(found, k, qid=qid, key=key)


def corpus(chunks: DataFrame, pairs: DataFrame, *, facts: bool = True) -> DataFrame:
    """(chunk_id, source, title, url, text): the chunks and, if asked, one fact per training pair with an answer."""
    passages = chunks.select("chunk_id", F.lit("corpus_chunk").alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    if not facts:
        return passages
    answer = F.coalesce(F.nullif("answer", F.lit("")), F.array_join("answers", "; "))
    taught = pairs.filter((F.col("split") == "train") & answer.isNotNull() & F.col("question").isNotNull())
    latest = taught.groupBy("id").agg(F.max_by(F.struct("question", answer.alias("answer"), "source_title", "source_url"), "updated_at").alias("r"))
    fact = F.concat(F.lit("Question: "), F.col("r.question"), F.lit(" Answer: "), F.col("r.answer"), F.lit("."))
    return passages.unionByName(latest.select(F.col("id").alias("chunk_id"), F.lit("train_fact").alias("source"), F.coalesce("r.source_title", F.lit("")).alias("title"), F.coalesce("r.source_url", F.lit("")).alias("url"), fact.alias("text")))


def embedded(texts: DataFrame, encoder, *, key: str = "chunk_id", prefix: str = "", batch: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, embedding array<float>): unit vectors of an injected encoder (list of texts -> matrix), called per batch in tasks.

    The prefix goes before every text, as some models want it for queries and passages. Null texts count as empty.
    """
    kinds = dict(texts.dtypes)

    def run(batches):
        for part in batches:
            text, rows = [prefix + (t or "") for t in part.column("text").to_pylist()], []
            for at in range(0, len(text), batch):
                made = np.asarray(encoder(text[at : at + batch]), dtype=np.float32)
                length = np.linalg.norm(made, axis=1, keepdims=True)
                rows.append(made / np.where(length > 0, length, 1))
            if rows:
                vectors = np.concatenate(rows)
                ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(vectors.shape[1]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (key, *keep)), pa.ListArray.from_arrays(ends, pa.array(vectors.astype(np.float32).ravel()))], names=[key, *keep, "embedding"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *keep))
    return texts.select(*dict.fromkeys((key, *keep, "text"))).mapInArrow(run, f"{schema}, embedding array<float>")
