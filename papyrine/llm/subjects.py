"""Subject areas of documents by class-association rules.

Sentences of a bounded sample of hand-labelled documents are transactions: their telling words (accents folded) with
the labels of the document as classes. Equal transactions are collapsed to one with its counts. Rules are mined by
parallel frequent-pattern growth: words are ranked by frequency, every transaction is cut into the prefixes that the
groups of words need, and each group grows its patterns from conditional pattern bases. Growth stops at LONGEST words
inside the mining, so that repeated long sentences cost no more than their pairs of words. A rule is dropped as
redundant if a shorter one for the same class is as sure, and its confidence is calibrated against held-out documents.
Every document is scored: a sentence of its main body counts, by its length, for the class of its surest matching
rule, and the shares of classes among the sentences that say something are held against a threshold that is calibrated
on the labelled documents. Fitting and scoring see the same bodies: page furniture is found once, over all documents.

Null and blank texts, and texts in which no rule matches, have no area. Labels whose document isn't there are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import content
from papyrine.llm.values import fold_word
from papyrine.runtime import cut, sample_of

#: Bound of the labelled documents that rules are mined from.
SAMPLE_DOCS = 4_000
#: Least occurrences of a telling word or rule, documents with the word, least lift of a word, least confidence of a rule, words in a rule.
LEAST_COUNT, LEAST_DOCS, LEAST_LIFT, LEAST_CONFIDENCE, LONGEST = 3, 2, 2.0, 0.55, 2
#: Spellings that a worker keeps.
CACHE = 500_000
#: Groups of words whose patterns grow apart.
GROUPS = 24
WORD = re.compile(r"[^\W\d_]{2,}")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
BINS = ((0.0, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.01))
THRESHOLDS = (0.12, 0.14, 0.16, 0.18, 0.2, 0.22, 0.25, 0.28)


def words_of(sentence: str) -> set[str]:
    return {fold_word(w) for w in WORD.findall(sentence)}


def sentences_of(lines: list[str]) -> list[str]:
    return [s for line in lines for s in SENTENCE.split(line) if s]


@dataclass(frozen=True)
class Rules:
    """Rules by their words, and the threshold for shares: {word: (class, confidence)}, {(word, word): (class, confidence)}."""

    single: dict[str, tuple[str, float]]
    double: dict[tuple[str, str], tuple[str, float]]
    partners: frozenset[str]
    threshold: float = 0.2
    seen: dict[str, str] = field(default_factory=dict, compare=False, repr=False)

    def telling(self, sentence: str) -> list[str]:
        """The words of a sentence that a rule has, in order; each spelling is folded and looked up once per worker."""
        seen, out = self.seen, set()
        for w in WORD.findall(sentence):
            known = seen.get(w)
            if known is None:
                folded = fold_word(w)
                known = folded if folded in self.single or folded in self.partners else ""
                if len(seen) >= CACHE:
                    seen.clear()
                seen[w] = known
            if known:
                out.add(known)
        return sorted(out)

    def match(self, sentence: str) -> tuple[str, float] | None:
        """The class and confidence of the surest rule that matches; the more evidence decides between equals."""
        words = self.telling(sentence)
        votes: dict[str, float] = {}
        top: dict[str, float] = {}
        for w in words:
            hit = self.single.get(w)
            if hit:
                votes[hit[0]] = votes.get(hit[0], 0.0) + hit[1]
                top[hit[0]] = max(top.get(hit[0], 0.0), hit[1])
        some = [w for w in words if w in self.partners]
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                hit = self.double.get((a, b))
                if hit:
                    votes[hit[0]] = votes.get(hit[0], 0.0) + hit[1]
                    top[hit[0]] = max(top.get(hit[0], 0.0), hit[1])
        if not votes:
            return None
        best = max(votes, key=lambda c: (votes[c], top[c], c))
        return best, top[best]

    def shares(self, lines: list[str]) -> dict[str, float]:
        """Share of each class in the characters of the sentences that a rule matches."""
        sizes: dict[str, float] = {}
        for s in sentences_of(lines):
            hit = self.match(s)
            if hit:
                sizes[hit[0]] = sizes.get(hit[0], 0.0) + len(s)
        total = sum(sizes.values())
        return {c: n / total for c, n in sizes.items()} if total else {}


def word_table(rows: DataFrame, classes: list[str]) -> list:
    """(word, n, n0.., d0..): transactions with a word, in all and per class, and documents per class; bounded by the sample."""
    each = rows.select("doc", "subjects", F.explode("words").alias("word"))
    per = each.groupBy("word", "doc", "subjects").agg(F.count("*").alias("n"))
    has = [F.array_contains("subjects", c) for c in classes]
    sums = per.groupBy("word").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.when(h, F.col("n")).otherwise(0)).alias(f"n{i}") for i, h in enumerate(has)),
        *(F.sum(F.when(h, 1).otherwise(0)).alias(f"d{i}") for i, h in enumerate(has)),
    )
    return sums.filter(F.col("n") >= LEAST_COUNT).collect()


def telling(table: list, sizes: np.ndarray) -> list:
    """The rows of words whose share in sentences of one class is at least LEAST_LIFT times their share in all."""
    out, classes = [], range(len(sizes))
    for r in table:
        own = np.array([r[f"n{i}"] for i in classes])
        best, n = int(own.argmax()), int(own.sum())
        if n >= LEAST_COUNT and own[best] * sizes.sum() >= LEAST_LIFT * n * sizes[best] and r[f"d{best}"] >= LEAST_DOCS:
            out.append(r)
    return out


def prefixes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of flat[begin:end] of all ranges, one after another."""
    widths = ends - begins
    offsets = np.cumsum(widths) - widths
    return flat[np.arange(int(widths.sum()), dtype=np.int64) + np.repeat(begins - offsets, widths)]


def grow(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray, least: int, depth: int, wanted=None):
    """Patterns of up to `depth` items of the transactions flat[begin:end], each with its counts: (items, counts).

    Items of a transaction ascend. Of each item with at least `least` transactions of some class, the transactions that
    hold it are cut before it: its conditional pattern base, in which longer patterns grow. `counts` has a row per
    transaction: its number in all and per class. Only items for which wanted(items) holds start a pattern.
    """
    items = prefixes(flat, begins, ends)
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    place = prefixes(np.arange(len(flat)), begins, ends)
    if wanted is not None:
        keep = wanted(items)
        items, owner, place = items[keep], owner[keep], place[keep]
    order = np.argsort(items, kind="stable")
    items, owner, place = items[order], owner[order], place[order]
    heads = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
    if not len(heads):
        return
    sums = np.add.reduceat(counts[owner], heads, axis=0)
    tails = np.append(heads[1:], len(items))
    for k in np.flatnonzero(sums[:, 1:].max(axis=1) >= least):
        item = int(items[heads[k]])
        yield (item,), sums[k]
        if depth > 1:
            at = slice(heads[k], tails[k])
            for longer, n in grow(flat, begins[owner[at]], place[at], counts[owner[at]], least, depth - 1):
                yield (*longer, item), n


def redundant(words: tuple, name: str, confidence: float, shorter: dict) -> bool:
    """Whether a rule of one word less, for the same class, is as sure."""
    parts = (words[:i] + words[i + 1 :] for i in range(len(words))) if len(words) > 1 else ()
    return any(p in shorter and shorter[p][0] == name and shorter[p][1] >= confidence - 0.02 for p in parts)


def best_rule(counts, classes: list[str], least: int) -> tuple[str, float, int] | None:
    """(class, confidence, support) of a pattern that is frequent and sure enough, else None."""
    total, own = int(counts[0]), counts[1:]
    top = int(own.argmax())
    sure = int(own[top]) / (total + 0.5)
    return (classes[top], sure, int(own[top])) if own[top] >= least and sure >= LEAST_CONFIDENCE else None


def mine(rows: DataFrame) -> list[tuple[tuple[str, ...], str, float, int]]:
    """[(words, class, confidence, support)] of rows with doc, subjects and words, without redundant rules.

    What comes to the driver are the telling words and the rules, which the sample bounds.
    """
    sizes = {r.subject: r.n for r in rows.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).collect()}
    classes, total = sorted(sizes), rows.count()
    kept = telling(word_table(rows, classes), np.array([sizes[c] for c in classes]))
    if not kept:
        return []
    least = max(LEAST_COUNT, round(total * 2e-5))
    ranking = [r.word for r in sorted(kept, key=lambda r: (-r.n, r.word))]
    rank = {w: i for i, w in enumerate(ranking)}
    rules: dict[tuple[str, ...], tuple[str, float, int]] = {}
    for r in kept:
        made = best_rule(np.array([r.n, *(r[f"n{i}"] for i in range(len(classes)))]), classes, least)
        if made:
            rules[(r.word,)] = made
    if LONGEST < 2:
        return [(w, *made) for w, made in rules.items()]
    number = {c: i for i, c in enumerate(classes)}

    def ranked(batches):
        for batch in batches:
            lists = [sorted(rank[w] for w in words if w in rank) for words in batch.column("words").to_pylist()]
            labels = [sorted(number[c] for c in own) for own in batch.column("subjects").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int32()))], names=["items", "labels"])

    # equal sentences become one transaction
    sets = rows.select("words", "subjects").mapInArrow(ranked, "items array<int>, labels array<int>").filter(F.size("items") > 1)
    sets = sets.groupBy("items", "labels").agg(F.count("*").alias("n"))

    def by_group(batches):
        """The prefix of each transaction up to the last item of a group, for every group it has items of."""
        for batch in batches:
            out: dict[str, list] = {"group": [], "items": [], "labels": [], "n": []}
            for items, labels, n in zip(*(batch.column(c).to_pylist() for c in ("items", "labels", "n")), strict=True):
                seen = set()
                for i in range(len(items) - 1, 0, -1):
                    group = items[i] % GROUPS
                    if group not in seen:
                        seen.add(group)
                        for name, value in (("group", group), ("items", items[: i + 1]), ("labels", labels), ("n", n)):
                            out[name].append(value)
            kinds = {"group": pa.int32(), "items": pa.list_(pa.int32()), "labels": pa.list_(pa.int32()), "n": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    shared = {(rank[w[0]],): made for w, made in rules.items()}

    def grown(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        lists = table.column("items").combine_chunks()
        offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        n = table.column("n").to_numpy()
        counts = np.zeros((len(n), 1 + len(classes)), np.int64)
        counts[:, 0] = n
        for i, own in enumerate(table.column("labels").to_pylist()):
            counts[i, [1 + k for k in own]] = n[i]
        known, words, names, sure, support = dict(shared), [], [], [], []
        found = grow(np.asarray(lists.flatten(), np.int64), offsets[:-1], offsets[1:], counts, least, LONGEST, lambda x: x % GROUPS == group)
        for pattern, c in sorted(found, key=lambda x: (len(x[0]), x[0])):
            made = best_rule(c, classes, least) if len(pattern) > 1 else None
            if made and not redundant(pattern, made[0], made[1], known):
                known[pattern] = made
                words.append([ranking[i] for i in pattern])
                names.append(made[0])
                sure.append(made[1])
                support.append(made[2])
        return pa.table({"words": pa.array(words, pa.list_(pa.string())), "subject": pa.array(names, pa.string()), "confidence": pa.array(sure, pa.float64()), "support": pa.array(support, pa.int64())})

    spread = sets.mapInArrow(by_group, "`group` int, items array<int>, labels array<int>, n long")
    for r in spread.groupBy("group").applyInArrow(grown, "words array<string>, subject string, confidence double, support long").collect():
        rules[tuple(sorted(r.words))] = (r.subject, r.confidence, r.support)
    return [(w, *made) for w, made in rules.items()]


def rules_of(mined: list[tuple[tuple[str, ...], str, float, int]], threshold: float = 0.2) -> Rules:
    single = {w[0]: (c, p) for w, c, p, _ in mined if len(w) == 1}
    double = {(w[0], w[1]): (c, p) for w, c, p, _ in mined if len(w) == 2}
    return Rules(single, double, frozenset(x for pair in double for x in pair), threshold)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, subjects, columns of docs) of about SAMPLE_DOCS labelled documents."""
    known = labels.filter(F.col("subject").isNotNull()).groupBy(key).agg(F.collect_set("subject").alias("subjects"))
    return docs.join(F.broadcast(sample_of(cut(known), SAMPLE_DOCS, F.col(key))), key)


def transactions(texts: DataFrame) -> DataFrame:
    """(fold, subjects, words) per sentence of rows with key, text and subjects."""

    def run(batches):
        for batch in batches:
            folds, subjects, words, docs = [], [], [], []
            for text, own, at, doc in zip(*(batch.column(c).to_pylist() for c in ("text", "subjects", "fold", "doc")), strict=True):
                for s in sentences_of((text or "").split("\n")):
                    w = words_of(s)
                    if w:
                        folds.append(at)
                        docs.append(doc)
                        subjects.append(own)
                        words.append(list(w))
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(subjects, pa.list_(pa.string())), pa.array(words, pa.list_(pa.string())), pa.array(docs, pa.int64())], names=["fold", "subjects", "words", "doc"])

    return texts.select("text", "subjects", "fold", "doc").mapInArrow(run, "fold int, subjects array<string>, words array<string>, doc long")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", *, furniture: content.Furniture | None = None) -> Rules:
    """Mines the rules and calibrates confidences and the threshold on documents held out from mining."""
    own = cut(labelled(docs, labels, key).dropDuplicates([key]))
    bodies = content.main_text(own, key, furniture=furniture or content.furniture_of(docs)).select(key, "text")
    fold = F.pmod(F.xxhash64(key), F.lit(3)).cast("int")
    texts = cut(bodies.join(own.select(key, "subjects"), key).withColumn("fold", fold).withColumn("doc", F.xxhash64(key)))
    rows = cut(transactions(texts))
    part, whole = rules_of(mine(rows.filter(F.col("fold") != 0))), mine(rows)

    def tried(batches):
        """Counts over held-out documents: (kind, at, hits, said, true) of thresholds and of bins of confidence."""
        for batch in batches:
            at_share, at_bin, n = np.zeros((len(THRESHOLDS), 3), np.int64), np.zeros((len(BINS), 3), np.int64), 0
            for text, said in zip(batch.column("text").to_pylist(), batch.column("subjects").to_pylist(), strict=True):
                n, lines, truth = n + 1, (text or "").split("\n"), set(said)
                shares = part.shares(lines)
                for i, t in enumerate(THRESHOLDS):
                    got = {c for c, v in shares.items() if v >= t}
                    at_share[i] += (len(got & truth), len(got), len(truth))
                for match in map(part.match, sentences_of(lines)):
                    if match:
                        i = next(i for i, (low, high) in enumerate(BINS) if low <= match[1] < high)
                        at_bin[i] += (match[0] in truth, 1, 0)
            counts = np.concatenate([at_share, at_bin, [[0, n, 0]]])
            kinds = ["share"] * len(THRESHOLDS) + ["bin"] * len(BINS) + ["docs"]
            places = [*range(len(THRESHOLDS)), *range(len(BINS)), 0]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(places, pa.int32()), *(pa.array(counts[:, j]) for j in range(3))], names=["kind", "at", "hits", "said", "true"])

    held = texts.filter(F.col("fold") == 0).select("text", "subjects")
    counts = held.mapInArrow(tried, "kind string, at int, hits long, said long, true long")
    sums = {(r["kind"], r["at"]): r for r in counts.groupBy("kind", "at").agg(F.sum("hits").alias("hits"), F.sum("said").alias("said"), F.sum("true").alias("true")).collect()}
    docs_held = sums[("docs", 0)].said if sums else 0
    f1 = {t: 2 * r.hits / max(1, r.said + r.true) for i, t in enumerate(THRESHOLDS) if (r := sums.get(("share", i)))}
    seen = {low: (r.hits, r.said) for i, (low, _) in enumerate(BINS) if (r := sums.get(("bin", i)))}
    sure = calibration(seen)
    return rules_of([(w, c, sure(p), n) for w, c, p, n in whole], best_threshold(f1, docs_held))


def best_threshold(f1: dict[float, float], docs: int) -> float:
    """The share from which areas agree best (F1) with the labels; 0.2 where there are too few documents."""
    if docs < 30:
        return 0.2
    top = max(f1.values())
    return min((t for t in f1 if f1[t] >= top - 0.003), key=lambda t: abs(t - 0.2))


def calibration(seen: dict[float, tuple[int, int]]) -> Callable[[float], float]:
    """Maps a mined confidence to the share of held-out sentences of that confidence whose document has the class."""
    found = {low: (right + 1) / (n + 2) for low, (right, n) in seen.items() if n}

    def sure(p: float) -> float:
        low = next(b for b, _ in reversed(BINS) if p >= b)
        return 0.5 * p + 0.5 * found[low] if low in found else p

    return sure


def areas(docs: DataFrame, labels: DataFrame, key: str = "doc_id", *, rules: Rules | None = None) -> DataFrame:
    """(key, subject, share, chars): every area of every document, those above the threshold."""
    furniture = content.furniture_of(docs)
    rules = rules or fit(docs, labels, key, furniture=furniture)

    def of(batch, drops):
        out: dict[str, list] = {key: [], "subject": [], "share": [], "chars": []}
        for k, text, drop in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), drops, strict=True):
            lines = [x for x, d in zip(text.split("\n"), drop, strict=True) if not d]
            chars = sum(map(len, lines))
            for c, v in rules.shares(lines).items():
                if v >= rules.threshold:
                    for name, x in ((key, k), ("subject", c), ("share", v), ("chars", int(chars * v))):
                        out[name].append(x)
        kinds = {key: batch.schema.field(key).type, "subject": pa.string(), "share": pa.float64(), "chars": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds.items()], names=list(kinds))

    return content.with_furniture(docs, [key], of, f"{key} {dict(docs.dtypes)[key]}, subject string, share double, chars long", furniture)


def composition(found: DataFrame) -> DataFrame:
    """(subject, documents, chars): the make-up of the corpus by area."""
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
