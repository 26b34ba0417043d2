"""Encoding of a whole corpus with a public byte-level tokenizer through a table of distinct words.

Every text is split into the tokenizer's words once. Consecutive texts of about BLOCK_CHARS characters form a block,
which keeps its distinct words and, per text, the places of its words among them. Each distinct word of the corpus is
encoded once; the ids return to the blocks by a join on the word, and inside a block they are joined to the texts by
position. Texts are never shuffled, and occurrences only as small integers; what the join moves are (block, word) pairs.

Null and empty texts have the empty list of ids. Special-token strings inside a text are ordinary text. Several rows
of one doc_id stay several rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import wordsplit
from papyrine.runtime import cut, saved, sized_join

#: The tokenizer's own rule for words, as Python's regex reads it. Fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabulary files, unless the environment or an argument names another.
FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000


def vocabulary_path(path: str | None = None) -> str:
    """The file of ranks: the argument, else the installed package of public tokenizers, else FOLDER."""
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else FOLDER
    return os.path.join(folder, RANKS)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ragged(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concatenated lists of the rows, their lengths) of the lists that end at `ends` in values."""
    begins = np.concatenate([[0], ends[:-1]])
    widths = (ends - begins)[rows]
    offsets = np.cumsum(widths) - widths
    index = np.arange(int(widths.sum()), dtype=np.int64) + np.repeat(begins[rows] - offsets, widths)
    return values[index], widths


def flat_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a column of lists without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    offsets = np.asarray(lists.offsets, np.int64)
    return np.asarray(lists.flatten()), offsets[1:] - offsets[0]


def split_blocks(batches):
    """Rows of a block: (_block, _key, places) of each text, and one with the block's distinct words."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, keys = batch.column("_text").to_pylist(), batch.column("_key")
        for a, b in wordsplit.chunks(texts, BLOCK_CHARS):
            joined, starts, ends, owner = wordsplit.split(texts[a:b])
            words, back = wordsplit.dictionary(joined, starts, ends)
            counts = np.bincount(owner, minlength=b - a)
            tails = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(tails), pa.array(back.astype(np.int32)))
            block = pa.array(np.full(b - a + 1, (task << 32) + made), pa.int64())
            keys_ = pa.concat_arrays([keys.slice(a, b - a), pa.nulls(1, keys.type)])
            places_ = pa.concat_arrays([places, pa.nulls(1, places.type)])
            words_ = pa.array([None] * (b - a) + [words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([block, keys_, places_, words_], names=["_block", "_key", "places", "words"])
            made += 1


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, sizes: bool = False) -> DataFrame:
    """(key, ids array<int>) for every row of docs; with `sizes` (key, size int), the number of ids, instead."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(ranks(vocabulary_path(vocabulary)))  # as large as the vocabulary
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict(rows.dtypes)["_key"]
    split = saved(rows.mapInArrow(split_blocks, f"_block long, _key {kind}, places array<int>, words array<string>"))
    pairs = split.filter(F.col("words").isNotNull()).select(F.col("_block").alias("_of"), F.posexplode("words").alias("place", "word"))

    def encode_words(batches):
        import tiktoken

        # words are split already: the pattern takes each one whole
        one = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=table.value, special_tokens={}).encode_ordinary
        for batch in batches:
            ids = [one(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    coded = cut(pairs.select("word").distinct().mapInArrow(encode_words, "word string, ids array<int>"))
    local = sized_join(pairs, coded, ["word"], salt_by=F.col("_of")).select("_of", "place", "ids")

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, tails = flat_of(right.column("ids").take(np.argsort(right.column("place").to_numpy())))
        places, ends = flat_of(left.column("places"))
        if sizes:
            widths = np.diff(tails, prepend=0)[places]
        else:
            values, widths = ragged(flat, tails, places)
        sums = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], ends])]
        if sizes:
            return pa.table({"_key": left.column("_key"), "size": pa.array(np.diff(sums), pa.int32())})
        return pa.table({"_key": left.column("_key"), "ids": pa.ListArray.from_arrays(pa.array(sums, pa.int32()), pa.array(values, pa.int32()))})

    texts = split.filter(F.col("words").isNull()).select("_block", "_key", "places")
    made = "size" if sizes else "ids"
    joined = texts.groupBy("_block").cogroup(local.groupBy("_of")).applyInArrow(join_back, f"_key {kind}, {made} {'int' if sizes else 'array<int>'}")
    return joined.select(F.col("_key").alias(key), made)


def pieces(spark, vocabulary: str | None = None) -> DataFrame:
    """(id int, piece binary): the vocabulary as a table; its size is that of the tokenizer."""
    table = ranks(vocabulary_path(vocabulary))
    return spark.createDataFrame([(i, p) for p, i in table.items()], "id int, piece binary")


def decode(encoded: DataFrame, key: str = "doc_id", *, vocabulary: str | None = None) -> DataFrame:
    """(key, text): ids joined by position with the table of pieces; the empty list gives ''.

    The table is as large as the vocabulary whatever the corpus, so it is broadcast and every batch of ids is joined
    with it at once; no occurrence is shuffled. Bytes that aren't UTF-8 come out as replacement characters, null ids
    as ''; an id outside the table has no piece.
    """
    spark = encoded.sparkSession
    known = sorted((r.id, bytes(r.piece)) for r in pieces(spark, vocabulary).collect())
    parts = [b""] * (known[-1][0] + 2 if known else 1)
    for i, piece in known:
        parts[i] = piece
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])))

    def gather(batches):
        letters, tails = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                ids, ends = flat_of(some.column("ids").fill_null([]))
                inside = (ids >= 0) & (ids < len(tails))
                values, widths = ragged(letters, tails, np.where(inside, ids, len(tails) - 1))
                sums = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], ends])]
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(values)])
                try:
                    texts = raw.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(key), texts], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(gather, f"{key} {kind}, text string")
