"""Cutting documents into passages, and finding the passage of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import text as T


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """How many windows of `size` words n words give: none for 0, one up to size, then one per step."""
    step = max(1, size - overlap)
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")


def sliding(docs: DataFrame, *, key: str = "doc_id", size: int = 110, overlap: int = 25) -> DataFrame:
    """(key, chunk_index, start_word, end_word, text): windows of size words, each overlap words into the last.

    Row-local: one pass, no shuffle. A text without words gives no chunk.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = max(1, size - overlap)
    rows = docs.select(key, words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    count = window_count(F.size("w"), size, overlap)
    at = rows.select(key, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.least(start + size, F.size("w"))
    return at.select(key, "chunk_index", start.alias("start_word"), end.alias("end_word"), F.array_join(F.slice("w", start + 1, F.lit(size)), " ").alias("text"))


def choose_window(docs: DataFrame, *, candidates=((110, 25), (90, 25), (75, 20), (60, 15), (50, 12)), target: int = 1_200) -> tuple[int, int]:
    """The first (size, overlap) that gives at least target chunks, else the last; counted in closed form in one pass."""
    n = F.size(words(F.col("text")))
    sums = docs.agg(*(F.sum(window_count(n, s, o)).alias(f"c{i}") for i, (s, o) in enumerate(candidates))).first()
    for i, pair in enumerate(candidates):
        if (sums[i] or 0) >= target:
            return pair
    return candidates[-1]


def paragraphs(docs: DataFrame, *, key: str = "doc_id", size: int = 140, overlap: int = 30, fact: str = "Fact ", useful: Column | None = None) -> DataFrame:
    """(key, chunk_index, start_word, end_word, text): lines packed up to size words.

    Lines are added while they fit; a line that begins with `fact` closes the pack and is a chunk of its own; a longer
    line closes the pack and is cut by sliding windows. A fold over the lines in the JVM, one pass, no shuffle. `useful`
    is a condition over `text` that chunks must meet, other than facts; rejected ones take no index. A text none of
    whose chunks is kept gives one chunk of its first size words.
    """
    step = max(1, size - overlap)
    kind = "struct<out:array<struct<s:int,e:int,t:string,f:boolean>>,buf:array<string>,s:int,n:int>"

    def flush(state: Column) -> Column:
        done = F.struct(state["s"].alias("s"), (state["s"] + F.size(state["buf"])).alias("e"), F.array_join(state["buf"], " ").alias("t"), F.lit(False).alias("f"))
        return F.when(F.size(state["buf"]) > 0, F.array_append(state["out"], done)).otherwise(state["out"])

    def fold(state: Column, line: Column) -> Column:
        w = words(line)
        n, seen, nothing = F.size(w), state["n"], F.array().cast("array<string>")
        is_fact, too_long, fits = line.startswith(fact), F.size(w) > size, F.size(state["buf"]) + F.size(w) <= size
        alone = F.array(F.struct(seen.alias("s"), (seen + n).alias("e"), F.array_join(w, " ").alias("t"), F.lit(True).alias("f")))
        cut = F.transform(
            F.sequence(F.lit(0), F.greatest(window_count(n, size, overlap) - 1, F.lit(0))),
            lambda k: F.struct((seen + k * step).alias("s"), (seen + F.least(k * step + size, n)).alias("e"), F.array_join(F.slice(w, k * step + 1, F.lit(size)), " ").alias("t"), F.lit(False).alias("f")),
        )
        closed = flush(state)
        out = F.when(is_fact, F.concat(closed, alone)).when(too_long, F.concat(closed, cut)).when(fits, state["out"]).otherwise(closed)
        buf = F.when(is_fact | too_long, nothing).when(fits, F.concat(state["buf"], w)).otherwise(w)
        start = F.when(is_fact | too_long, seen + n).when(fits & (F.size(state["buf"]) > 0), state["s"]).otherwise(seen)
        return F.when(n == 0, state).otherwise(F.struct(out.alias("out"), buf.alias("buf"), start.alias("s"), (seen + n).alias("n"))).cast(kind)

    zero = F.struct(F.array().cast("array<struct<s:int,e:int,t:string,f:boolean>>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("s"), F.lit(0).alias("n")).cast(kind)
    folded = docs.select(key, "text", F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n", -1), zero, fold, flush).alias("all"))
    if useful is not None:
        exploded = folded.select(key, F.posexplode("all").alias("p", "c")).select(key, "p", "c.s", "c.e", F.col("c.t").alias("text"), "c.f").filter(F.col("f") | useful)
        index = F.row_number().over(Window.partitionBy(key).orderBy("p")) - 1
        kept = exploded.select(key, index.alias("chunk_index"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), "text")
        first = F.array_join(F.slice(words(F.col("text")), 1, size), " ")
        rest = docs.join(kept.select(key).distinct(), key, "left_anti").filter(F.size(words(F.col("text"))) > 0)
        return kept.unionByName(rest.select(key, F.lit(0).alias("chunk_index"), F.lit(0).alias("start_word"), F.least(F.size(words(F.col("text"))), F.lit(size)).alias("end_word"), first.alias("text")))
    return folded.select(key, F.posexplode("all").alias("chunk_index", "c")).select(key, "chunk_index", F.col("c.s").alias("start_word"), F.col("c.e").alias("end_word"), F.col("c.t").alias("text"))


def useful_chunk(text: Column, *, least_words: int = 18, boilerplate: tuple[str, ...] = ("cookie", "log in"), wanted: tuple[str, ...] = ()) -> Column:
    """Whether a passage says something: words enough, no boilerplate term, a sentence or a table, a wanted term."""
    low = F.lower(text)
    bad, good = F.lit(False), F.lit(not wanted)
    for t in boilerplate:
        bad = bad | low.contains(t)
    for t in wanted:
        good = good | low.contains(t)
    table = (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) >= 4
    return (T.word_count(text) >= least_words) & ~bad & good & (table | text.rlike(r"[.!?](?:\s|$)"))


def with_answer(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id): the first chunk of the pair's document that has answer and question, else the answer, else any.

    One equi-join on the document and a minimum; the texts' containment is a residual of the join.
    """
    joined = pairs.select("id", F.col("source_id").alias("document_id"), "question", "answer").join(chunks.select("document_id", "chunk_id", "chunk_index", "text"), "document_id", "left")
    low = F.lower(F.coalesce("text", F.lit("")))
    has_answer = low.contains(F.lower(F.coalesce("answer", F.lit("\0"))))
    rank = F.when(has_answer & low.contains(F.lower(F.coalesce("question", F.lit("\0")))), 0).when(has_answer, 1).otherwise(2)
    return joined.groupBy("id").agg(F.min_by("chunk_id", F.struct(rank.alias("r"), "chunk_index", "chunk_id")).alias("chunk_id"))


def with_sentence(pairs: DataFrame, chunks: DataFrame, *, prefix: int = 80, words_used: int = 20) -> DataFrame:
    """(id, chunk_id): the first chunk with the sentence's first signs, else the one that shares most of its first words.

    Null where no word is shared.
    """
    joined = pairs.select("id", F.col("source_id").alias("document_id"), "sentence").join(chunks.select("document_id", "chunk_id", "chunk_index", "text"), "document_id", "left")
    hit = F.coalesce(F.col("text").contains(F.substring("sentence", 1, prefix)), F.lit(False))
    shared = F.size(F.array_intersect(F.slice(words(F.lower("sentence")), 1, words_used), words(F.lower("text"))))
    shared = F.coalesce(F.greatest(shared, F.lit(0)), F.lit(0))
    best = F.max_by(F.struct("chunk_id", hit.alias("hit"), shared.alias("shared")), F.struct(hit.cast("int").alias("h"), F.when(hit, 0).otherwise(shared).alias("s"), (-F.col("chunk_index")).alias("i"), "chunk_id"))
    return joined.groupBy("id").agg(best.alias("b")).select("id", F.when(F.col("b.hit") | (F.col("b.shared") > 0), F.col("b.chunk_id")).alias("chunk_id"))
