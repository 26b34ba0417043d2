"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Every record is brought to a canonical form: accents folded, misspelt rare words set right against the frequent
vocabulary, institution names replaced by one token, the question reduced to its language, matter, year, institution
and the words of the programme, the answer to its value. Records of one canonical form and side are one class, so
copies are never compared. A shingle is one word of the programme anchored at language, matter, year, institution and
value (TESTDATA counts other wordings as the same, which runs of five words would miss). Minwise hashes of the shingles in
bands give candidates of one class from either side; candidates are verified by exact Jaccard similarity of at least
0.8, equal values, and programme words that differ in misspellings only.

Null questions and records without an answer that has a value overlap with nothing. Rows delivered again under the
same id count once.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from papyrine.llm.values import YEAR, fold, matter_of, value_of
from papyrine.runtime import saved

LEAST_JACCARD = 0.8
#: A pair at the least Jaccard similarity shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 1 in 9,800.
BANDS, ROWS = 9, 2
#: Share of records from which a word belongs to the frequent vocabulary: at most words per record / share entries.
WORD_SHARE = 2e-4
TOKEN = re.compile(r"[a-z0-9]+")
#: Where a programme's name begins and ends, accents folded. Fixed values of the two languages.
NAMED = re.compile(r"(?:\bthe |\b)((?:\w+ )(?:programme|program|course) in .*?)\bat (inst\w+)|((?:chuong trinh|khoa) .*?)\btai (inst\w+)")
LINKS = frozenset("the a an of in on at to for programme program course campus track tai huong co so chuong trinh khoa nganh".split())
PRIMES = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def institution_names(sites: DataFrame) -> dict[str, str]:
    """Folded names and acronyms -> one token each; the table has a row per site."""
    rows = sites.select("institution", "institution_vi", "acronym").collect()
    return {fold(name): f"inst{fold(r.acronym)}" for r in rows for name in (r.institution, r.institution_vi, r.acronym) if name and r.acronym}


def word_counts(batches):
    for batch in batches:
        counts: Counter = Counter()
        for q in batch.column("question").to_pylist():
            counts.update(TOKEN.findall(fold(q)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def vocabulary(rows: DataFrame, *, share: float = WORD_SHARE) -> frozenset[str]:
    """The words in at least this share of all questions (and in at least three)."""
    asked = rows.filter(F.col("question").isNotNull()).select("question")
    total = asked.count()
    counts = asked.mapInArrow(word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in counts.filter(F.col("n") >= max(3.0, share * total)).select("word").collect())


class Speller:
    """Sets rare words right: to the only frequent word one or two edits away."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        self.by_cut: dict[str, set[str]] = {}
        for w in words:
            if len(w) > 3 and not w.isdigit():
                for v in shortened(w):
                    self.by_cut.setdefault(v, set()).add(w)
        self.known: dict[str, str] = {}

    def right(self, word: str) -> str:
        if word in self.words or len(word) < 4 or any(c.isdigit() for c in word):
            return word
        if word not in self.known:
            near = {w for v in shortened(word) for w in self.by_cut.get(v, ()) if edits(word, w) <= (2 if len(word) > 6 else 1)}
            least = min((edits(word, w) for w in near), default=0)
            best = [w for w in near if edits(word, w) == least]
            self.known[word] = best[0] if len(best) == 1 else word
        return self.known[word]


def shortened(word: str) -> set[str]:
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    two = {w[:i] + w[i + 1 :] for w in one for i in range(len(w))} if len(word) > 6 else set()
    return one | two | {word}


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


class Reader:
    """Brings questions to their canonical form."""

    def __init__(self, names: dict[str, str], words: frozenset[str]):
        self.speller = Speller(words)
        spelt = {" ".join(self.speller.right(t) for t in TOKEN.findall(n)): v for n, v in names.items()}
        self.names = {" ".join(TOKEN.findall(n)): v for n, v in names.items()} | spelt
        self.pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, self.names), key=len, reverse=True)) + r")\b") if self.names else None

    def question(self, text: str) -> tuple[str, tuple[str, ...], str | None, str | None]:
        """(anchor, programme words, matter, year)."""
        flat = " ".join([self.speller.right(t) for t in TOKEN.findall(fold(text).replace("'", ""))])
        if self.pattern:
            flat = self.pattern.sub(lambda m: self.names[m[0]], flat)
        years = sorted(set(YEAR.findall(flat)))
        named = NAMED.search(flat)
        outside = flat[: named.start()] + " " + flat[named.end() :] if named else flat
        matter = matter_of(outside)
        if named and matter:
            name, inst = (named[1] or named[3]), (named[2] or named[4])
            words = [t for t in name.split() if t not in LINKS and not YEAR.fullmatch(t)]
        else:
            inst = next((t for t in flat.split() if t.startswith("inst") and t in self.names.values()), "")
            words = [t for t in flat.split() if t not in LINKS]
        return f"{matter}|{','.join(years)}|{inst}", tuple(sorted(words)), matter, years[0] if len(years) == 1 else None


def canonical(reader_of):
    """Makes the function that maps batches to (id, side, anchor with the value, words, class)."""

    def run(batches):
        reader = reader_of()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "side", "anchor", "words", "class")}
            columns = (batch.column(c).to_pylist() for c in ("id", "split", "question", "answers", "qa_language"))
            for id_, split, question, answers, language in zip(*columns, strict=True):
                anchor, words, matter, year = reader.question(question)
                if matter in ("combination", None):
                    value = value_of("; ".join(a for a in answers or () if a), matter, year)
                else:
                    value = next((v for v in (value_of(a, matter, year) for a in answers or ()) if v), None)
                if not value:
                    continue
                out["id"].append(id_)
                out["side"].append("train" if split == "train" else "eval")
                out["anchor"].append(f"{language}|{anchor}|{value}")
                out["words"].append(" ".join(words))
                digest = xxh3_64_intdigest("\x1f".join((language or "", anchor, value, *words)))
                out["class"].append(digest - (1 << 64) if digest >> 63 else digest)
            kinds = {"id": pa.string(), "side": pa.string(), "anchor": pa.string(), "words": pa.string(), "class": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run


def banded(batches):
    """(class, side, bands) of classes; the hash of band k is mixed with k."""
    for batch in batches:
        bands = []
        for anchor, words in zip(batch.column("anchor").to_pylist(), batch.column("words").to_pylist(), strict=True):
            base = np.array([xxh3_64_intdigest(f"{anchor}|{w}") for w in set(words.split())] or [xxh3_64_intdigest(anchor)], np.uint64)
            with np.errstate(over="ignore"):
                mixed = base[:, None] * PRIMES[None, :]
                mixed ^= mixed >> np.uint64(29)
                least = (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0).reshape(BANDS, ROWS)
                keys = (least * np.arange(3, 3 + 2 * ROWS, 2, dtype=np.uint64)).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bands.append(keys.view(np.int64))
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("side"), lists], names=["class", "side", "bands"])


def same(a: set[str], b: set[str], known: frozenset[str]) -> bool:
    """Whether two programmes' words agree up to misspellings, with Jaccard similarity of at least LEAST_JACCARD."""
    left, right = a - b, b - a
    if len(a & b) < LEAST_JACCARD * len(a | b):
        return False
    if len(left) != len(right):
        return False
    return all(any((x not in known or y not in known) and edits(x, y) <= 2 for y in right) for x in left)


def confirmed_classes(rows: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, side, anchor, words, class), pairs (eval_class, train_class)): classes that overlap; copies aren't expanded."""
    names, words = institution_names(sites), vocabulary(rows)
    made: list[Reader] = []

    def reader() -> Reader:
        if not made:
            made.append(Reader(names, words))
        return made[0]

    asked = rows.filter(F.col("question").isNotNull() & F.col("id").isNotNull()).select("id", "split", "question", "answers", "qa_language")
    members = saved(asked.mapInArrow(canonical(reader), "id string, side string, anchor string, words string, class long"))
    sides = {}
    for side in ("eval", "train"):
        own = members.filter(F.col("side") == side)
        sides[side] = own.groupBy("class").agg(F.first("anchor").alias("anchor"), F.first("words").alias("words")).withColumn("side", F.lit(side))
    bands = {s: c.mapInArrow(banded, "class long, side string, bands array<long>").select(F.explode("bands").alias("band"), F.col("class").alias(f"{s}_class")) for s, c in sides.items()}
    candidates = bands["eval"].join(bands["train"], "band").select("eval_class", "train_class").distinct()

    def verify(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("eval_words", "train_words")]
            ok = pa.array([same(set(a.split()), set(b.split()), words) for a, b in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("eval_class").filter(ok), batch.column("train_class").filter(ok)], names=["eval_class", "train_class"])

    full = candidates
    for s, c in sides.items():
        full = full.join(c.select(*(F.col(x).alias(f"{s}_{x}") for x in ("class", "anchor", "words"))), f"{s}_class")
    alike = full.filter(F.col("eval_anchor") == F.col("train_anchor"))
    confirmed = alike.select("eval_class", "train_class", "eval_words", "train_words").mapInArrow(verify, "eval_class long, train_class long")
    return members, confirmed


def ids_of(members: DataFrame, side: str) -> DataFrame:
    return members.filter(F.col("side") == side).select(F.col("class").alias(f"{side}_class"), F.col("id").alias(f"{side}_id")).distinct()


def overlaps(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(eval_id, train_id) of all overlapping records of the dev and test splits with the train split."""
    members, confirmed = confirmed_classes(rows, sites)
    return confirmed.join(ids_of(members, "eval"), "eval_class").join(ids_of(members, "train"), "train_class").select("eval_id", "train_id").distinct()


def overlap_pairs(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b."""
    return overlaps(rows, sites).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def overlap_counts(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(split, source_url, eval_records, pairs): confirmed overlaps by split and source of the evaluation record.

    Pairs are counted from the sizes of the classes; none is made.
    """
    members, confirmed = confirmed_classes(rows, sites)
    sizes = ids_of(members, "train").groupBy("train_class").agg(F.count("*").alias("size"))
    found = confirmed.join(sizes, "train_class").groupBy("eval_class").agg(F.sum("size").alias("pairs"))
    own = rows.groupBy(F.col("id").alias("eval_id")).agg(F.first("split").alias("split"), F.first("source_url").alias("source_url"))
    each = ids_of(members, "eval").join(found, "eval_class").groupBy("eval_id").agg(F.sum("pairs").alias("pairs"))
    return each.join(own, "eval_id").groupBy("split", "source_url").agg(F.count("*").alias("eval_records"), F.sum("pairs").alias("pairs"))
