"""Question-answer pairs whose answer is no answer.

Every answer is cut into clauses, and a linear-chain conditional random field tags them as answer, refusal, echo,
foreign or unfinished. Its features compare a clause with the question and the evidence, look at how the clause ends
(against how often its last word ends answers in the whole table) and at its language. The field is trained in numpy
on a bounded sample: answers that state a value, and defects made from them (cut short, the question given back,
phrases that decline, answers of the other language). The clauses' coverage of the text decides for an answer, the
answers decide for the pair: one usable answer is enough, else the type that covers most is reported.

No answers, null, blank and placeholder answers are `empty`. Rows delivered again under an id count once. A null
question gives nothing back and has no language.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import language
from papyrine.llm.overlap import LINKS
from papyrine.llm.values import fold, matter_of
from papyrine.runtime import cut, sample_of

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
TYPES = {"refusal": "refusal", "echo": "copy", "foreign": "other_language", "unfinished": "truncated"}
#: Bound of the training sample, and the share of words from which an ending is counted.
SAMPLE_PAIRS, WORD_SHARE = 6_000, 5e-5
#: Share of an answer's characters in answer clauses from which it is usable.
USABLE = 0.3
TOKEN = re.compile(r"[a-z0-9]+")
CLAUSES = re.compile(r"(?<=[.!?…])(?<!\b[Nn]o\.)(?<!\bNr\.)\s+(?=\S)|\n+")
ZERO_WIDTH = re.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad]")
CUT_SIGNS = ("…", "...", "-", "–")

#: What stands in place of an answer (folded). Fixed values.
PLACEHOLDERS = frozenset(
    ("na", "n a", "tbd", "tba", "null", "none", "nil", "nan", "unknown", "blank", "empty", "answer", "a", "pending", "missing", "todo", "xxx")
    + ("none given", "not given", "not available", "not applicable", "to be announced", "to be confirmed", "to be determined", "no answer", "no data")
    + ("chua co", "khong co", "tra loi", "dang cap nhat")
)
#: Words of declining (folded). Fixed values.
UNABLE = re.compile(
    r"\b(?:cannot|can not|can ?t|could not|couldn ?t|unable to (?:help|answer|verify|say|tell|determine|find|provide)|not able|impossible for me|don ?t (?:have|know)|do not (?:have|know)|no (?:answer|information|details?|data|mention)|nothing here|silent on|lies outside|outside what|decline|rather not|not (?:mentioned|stated|given|provided|specified|clear)|khong the (?:tra loi|xac dinh|xac minh|giup|cung cap|tim)|khong (?:co|du|tim thay|neu|de cap|duoc nhac|biet|ro|noi|cho biet|tra loi)|chua (?:co|du|ro)|tu choi|ngoai pham vi|nam ngoai)\b"
)
SOURCE = re.compile(
    r"\b(?:information|context|passage|text|source|excerpt|document|question|that detail|website|help|verify|determined|what i was given|training office|thong tin|ngu canh|van ban|tai lieu|doan trich|doan van|nguon|cau hoi|chi tiet|trang web|phong dao tao)\b"
)
PERSON = re.compile(r"\b(?:i|me|i ?m|my|sorry|apologies|apologise|unfortunately|regret|please|could you|try asking|toi|minh|xin loi|rat tiec|tiec|vui long|ban co the|hay hoi|thu hoi)\b")
#: Parts of made refusals, for training. Fixed values.
REFUSAL_STARTS = ("", "Sorry, ", "Unfortunately, ", "Apologies: ", "I’m sorry, but ", "I regret that ", "Based on the passage alone, ")
REFUSAL_BODIES = ("I cannot answer this question", "I don't have enough information to say", "this can't be determined from the given text", "no answer could be found in the document", "the source is silent on {}", "the excerpt gives no details on {}", "it is impossible for me to verify {}", "that lies outside what I was given", "I am not able to help with that", "there is nothing here that tells {}")
REFUSAL_ENDS = ("", ".", ". Please consult the university website.", ". Could you provide more context?", "; try asking the training office.", ", so I must decline.")
REFUSAL_STARTS_VI = ("", "Xin lỗi, ", "Rất tiếc, ")
REFUSAL_BODIES_VI = ("tôi không thể trả lời câu hỏi này", "tôi không có đủ thông tin", "văn bản không nêu {}", "tài liệu không đề cập đến {}", "không tìm thấy câu trả lời trong tài liệu", "tôi không thể xác định điều này từ đoạn trích")
REFUSAL_ENDS_VI = ("", ".", ". Vui lòng xem trang web của trường.", ". Bạn có thể cho thêm ngữ cảnh không?")

#: Words of question forms and of matters, which neither side must give back.
FORMS = frozenset(
    "what which who when where how is are was were does do did can could may much many long by whom under according notice question please tell me hi q in let s year years the list show called vietnamese title name cho hoi la bao nhieu nao gi khi may theo nam voi".split()
)


def clauses_of(answer: str | None) -> list[str]:
    """The clauses of one answer; none if it has no content."""
    if answer is None:
        return []
    text = ZERO_WIDTH.sub("", answer).replace("\xa0", " ").strip()
    words = TOKEN.findall(fold(text))
    if " ".join(words) in PLACEHOLDERS or not any(c.isalnum() for c in text):
        return []
    return [c for c in (x.strip() for x in CLAUSES.split(text)) if any(map(str.isalnum, c))]


def shape(token: str) -> str:
    return re.sub(r"\d", "0", token)


def endings(batches):
    """(word, ends, n): how often a word stands in answers and how often it ends one."""
    for batch in batches:
        every: Counter = Counter()
        last: Counter = Counter()
        for answers in batch.column("answers").to_pylist():
            for a in answers or ():
                words = [shape(w) for w in TOKEN.findall(fold(a or ""))]
                every.update(words)
                if words and not a.rstrip().endswith(CUT_SIGNS):
                    last[words[-1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([last[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "ends", "n"])


def ending_rates(rows: DataFrame) -> dict[str, float]:
    """Smoothed share of a word's occurrences that end an answer, for at most 1 / WORD_SHARE words."""
    counts = rows.select("answers").mapInArrow(endings, "word string, ends long, n long").groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.word: (r.ends + 0.02) / (r.n + 1) for r in counts.filter(F.col("n") >= max(4.0, WORD_SHARE * total)).collect()}


class Question:
    """What of a question its answers are compared with."""

    def __init__(self, question: str | None, evidence: str | None, lang: str | None):
        self.folded = fold(question or "")
        words = TOKEN.findall(self.folded)
        self.words = set(words)
        self.content = {w for w in words if w not in LINKS and w not in FORMS}
        self.lang = lang
        self.named = "vi" if matter_of(self.folded) == "vname" else None
        self.evidence = fold(evidence) if evidence else ""
        self.parts = 1 + ("track" in self.words) + ("campus" in self.words)


FEATURES = 31


def features(q: Question, clause: str, rates: dict[str, float], soft: np.ndarray) -> list[float]:
    """The features of one clause; `soft` are its language confidences."""
    text = fold(clause)
    words = TOKEN.findall(text)
    own = {w for w in words if w not in LINKS and w not in FORMS}
    new = own - q.words
    covered = len(q.content & own) / len(q.content) if q.content else 0.0
    digits = any(any(map(str.isdigit, w)) for w in new)
    last = words[-1] if words else ""
    rate = rates.get(shape(last))
    stripped = clause.rstrip()
    cut_sign = stripped.endswith(("…", "...")) or (stripped.endswith(("-", "–")) and len(words) > 0)
    final = stripped.endswith((".", "!", "?")) and not stripped.endswith("...")
    midword = closed = spaced = False
    if q.evidence and len(text) > 2:
        bare = text.rstrip(" .…-–")
        at = q.evidence.find(bare)
        if at >= 0:
            after = q.evidence[at + len(bare) : at + len(bare) + 1]
            midword = after.isalnum() and bare[-1:].isalnum()
            closed, spaced = after in ("", ".", ",", ";", ":"), after == " "
    unable, source, person = bool(UNABLE.search(text)), bool(SOURCE.search(text)), bool(PERSON.search(text))
    best = int(soft.argmax())
    lang, sure = language.LANGUAGES[best], float(soft[best])
    other = q.lang is not None and lang != q.lang and lang != q.named and sure >= 0.8 and len([w for w in words if w.isalpha() and len(w) > 1]) >= 2
    open_ = text.count("(") > text.count(")")
    asks = stripped.endswith("?")
    parts = 1 + (" huong " in text) + (" so " in text.partition("(co")[2])  # a name asked for has a part for each of the question's
    return [
        1.0,
        covered,
        float(covered >= 0.95),
        min(len(new), 6) / 6,
        float(digits),
        float(not new),
        float(len(words) <= 3),
        float(rate is None),
        float(rate is not None and rate < 0.02),
        float(rate is not None and 0.02 <= rate < 0.15),
        float(rate is not None and rate >= 0.15),
        float(cut_sign),
        float(open_),
        float(final),
        float(midword),
        float(unable),
        float(source),
        float(person),
        float(unable and (source or person)),
        float(other),
        float(other and sure >= 0.97),
        float(asks),
        float(covered >= 0.95 and not digits),
        float(unable and digits),
        float(person and source and not digits),
        float(rate is not None and rate < 0.004),
        float(digits and rate is not None and rate < 0.02),
        float(closed),
        float(spaced),
        float(q.named is not None and parts < q.parts),
        float(q.named is not None and parts >= q.parts and rate is not None),
    ]


class Field:
    """A linear-chain conditional random field over clauses."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def tag(self, x: np.ndarray, lengths: list[int]) -> np.ndarray:
        """The best tags of sequences that lie one after another in x."""
        emit = x @ self.weights
        out = emit.argmax(axis=1)
        at = 0
        for n in lengths:
            if n > 1:
                out[at : at + n] = self.best(emit[at : at + n])
            at += n
        return out

    def best(self, emit: np.ndarray) -> list[int]:
        score, back = emit[0], []
        for e in emit[1:]:
            all_ = score[:, None] + self.moves
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0) + e
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def fit_field(sequences: list[tuple[np.ndarray, list[int]]], *, rounds: int = 250, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximises the regularised conditional likelihood by gradient ascent with momentum, all lengths in one batch."""
    tags = len(TAGS)
    weights, moves = np.zeros((FEATURES, tags)), np.zeros((tags, tags))
    if not sequences:
        return Field(weights, moves)
    longest = max(len(y) for _, y in sequences)
    x = np.zeros((len(sequences), longest, FEATURES))
    y = np.full((len(sequences), longest), -1)
    for i, (f, t) in enumerate(sequences):
        x[i, : len(t)], y[i, : len(t)] = f, t
    there = y >= 0
    truth = np.eye(tags)[np.maximum(y, 0)] * there[..., None]
    pairs = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:]) if longest > 1 else np.zeros((tags, tags))
    speed_w, speed_m = np.zeros_like(weights), np.zeros_like(moves)
    n = there.sum()
    for _ in range(rounds):
        emit = x @ weights
        fwd = np.zeros((len(sequences), longest, tags))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = _logsum(fwd[:, t - 1][:, :, None] + moves[None], 1) + emit[:, t]
            fwd[:, t] = np.where(there[:, t][:, None], step, fwd[:, t - 1])
        bwd = np.zeros_like(fwd)
        for t in range(longest - 2, -1, -1):
            step = _logsum(moves[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(there[:, t + 1][:, None], step, 0.0)
        z = _logsum(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
        grad_w = np.einsum("ntf,nta->fa", x, truth - node) / n - decay * weights
        grad_m = pairs / n - decay * moves
        for t in range(1, longest):
            both = fwd[:, t - 1][:, :, None] + moves[None] + (emit[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
            grad_m -= (np.exp(both) * there[:, t][:, None, None]).sum(axis=0) / n
        speed_w, speed_m = 0.9 * speed_w + grad_w, 0.9 * speed_m + grad_m
        weights, moves = weights + rate * speed_w, moves + rate * speed_m
    return Field(weights, moves)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def made_examples(rows: list, seed: int = 5) -> list[tuple[object, list[tuple[str, str]]]]:
    """(row, [(clause, tag)]) of answers that state a value, and of defects made from them."""
    rng = random.Random(seed)
    clean = []
    for r in rows:
        said = [a for a in r.answers or () if a and clauses_of(a)]
        if not said or not r.question:
            continue
        a, q = said[0].strip(), fold(r.question)
        words = TOKEN.findall(fold(a))
        new = {w for w in words if w not in q}
        valued = any(any(map(str.isdigit, w)) for w in new) or matter_of(q) == "vname"
        if valued and not a.endswith(CUT_SIGNS) and a.count("(") == a.count(")") and (r.evidence is None or fold(a).rstrip(". ") in fold(r.evidence)) and len(a) > 3:
            clean.append((r, a))
    by_lang: dict[str, list[str]] = {}
    for r, a in clean:
        if len(a.split()) >= 5 and matter_of(fold(r.question)) != "vname":
            by_lang.setdefault(r.qa_language, []).append(a)
    out = []
    for r, a in clean:
        vi = r.qa_language == "vi"
        out.append((r, [(c, "answer") for c in clauses_of(a)]))
        kind = rng.random()
        if kind < 0.25 and len(a) > 6:
            at = rng.randint(2, max(2, int(len(a) * 0.85)))
            if (m := re.search(r" is (?=\S*\d)", a)) and rng.random() < 0.4:
                out.append((r, [(a[: m.start()] + rng.choice(("", ".", ":")), "echo")]))
            else:
                part = a[:at] + rng.choice(("", "", " ", "...", "…", "-"))
                if clauses_of(part):
                    pieces = clauses_of(part)
                    out.append((r, [(c, "answer") for c in pieces[:-1]] + [(pieces[-1], "unfinished")]))
        elif kind < 0.5:
            q = r.question.strip()
            form = rng.choice((q, q, q.rstrip("?"), q.lower(), f"{q} {q}", f"Answer: {q}", f"A: {q}", f"The question is: {q}"))
            out.append((r, [(c, "echo") for c in clauses_of(form)]))
        elif kind < 0.75:
            starts, bodies, ends = (REFUSAL_STARTS_VI, REFUSAL_BODIES_VI, REFUSAL_ENDS_VI) if vi and rng.random() < 0.8 else (REFUSAL_STARTS, REFUSAL_BODIES, REFUSAL_ENDS)
            about = re.sub(r"^(?:what|which|how \w+)\s+(?:is|was|are|\w+)?\s*", "", r.question.rstrip("?"), flags=re.I) if rng.random() < 0.7 else rng.choice(("that detail", "this"))
            text = rng.choice(starts) + rng.choice(bodies).format(about) + rng.choice(ends)
            out.append((r, [(c, "refusal") for c in clauses_of(text[:1].upper() + text[1:])]))
        else:
            others = [x for k, v in by_lang.items() if k != r.qa_language for x in v]
            if others and matter_of(fold(r.question)) != "vname":
                out.append((r, [(c, "foreign") for c in clauses_of(rng.choice(others))]))
    return out


def fit(rows: DataFrame, tongue: language.Model, rates: dict[str, float], *, sample_pairs: int = SAMPLE_PAIRS) -> Field:
    """Trains the field on about sample_pairs pairs chosen by hash, half of them of the rarer question languages."""
    asked = rows.filter(F.col("question").isNotNull()).select("id", "question", "answers", "evidence", "qa_language")
    english = F.coalesce(F.col("qa_language") == "en", F.lit(False))
    common, rest = (sample_of(asked.filter(which), sample_pairs // 2, F.col("id")).collect() for which in (english, ~english))
    examples = made_examples(common + rest)
    flat = [c for _, clauses in examples for c, _ in clauses]
    soft = tongue.confidences(flat)
    sequences, at = [], 0
    for r, clauses in examples:
        q = Question(r.question, r.evidence, r.qa_language)
        x = np.array([features(q, c, rates, soft[at + i]) for i, (c, _) in enumerate(clauses)])
        sequences.append((x, [TAGS.index(t) for _, t in clauses]))
        at += len(clauses)
    return fit_field(sequences)


def defects(rows: DataFrame, documents: DataFrame, *, details: bool = False) -> DataFrame:
    """(id, defect_type) of the defective pairs; with details also the coverage per tag."""
    rates = ending_rates(rows)
    tongue = language.fit(documents)
    field = fit(rows, tongue, rates)

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "question", "answers", "evidence", "qa_language")]
            ids, kinds, covers = [], [], []
            for begin in range(0, batch.num_rows, 2_000):
                part = list(zip(*(c[begin : begin + 2_000] for c in columns), strict=True))
                cut_ = [[clauses_of(a) for a in answers or ()] for _, _, answers, _, _ in part]
                flat = [c for answers in cut_ for a in answers for c in a]
                soft = tongue.confidences(flat)
                x, lengths = [], []
                for (_, question, _, evidence, lang), answers in zip(part, cut_, strict=True):
                    q = Question(question, evidence, lang)
                    for a in answers:
                        if a:
                            lengths.append(len(a))
                            x += [features(q, c, rates, soft[len(x) + i]) for i, c in enumerate(a)]
                tags = field.tag(np.array(x), lengths) if x else np.zeros(0, int)
                at = 0
                for (id_, *_), answers in zip(part, cut_, strict=True):
                    usable, total = False, np.zeros(len(TAGS))
                    for a in answers:
                        cover = np.zeros(len(TAGS))
                        for c in a:
                            cover[tags[at]] += len(c)
                            at += 1
                        if a:
                            total += cover / cover.sum()
                            usable = usable or cover[0] >= USABLE * cover.sum()
                    if usable:
                        continue
                    ids.append(id_)
                    kinds.append(TYPES[TAGS[1 + int(total[1:].argmax())]] if total.any() else "empty")
                    covers.append({t: float(v) for t, v in zip(TAGS, total / max(1.0, total.sum()), strict=True)})
            names, arrays = ["id", "defect_type"], [pa.array(ids, pa.string()), pa.array(kinds, pa.string())]
            if details:
                names.append("coverage")
                arrays.append(pa.array(covers, pa.struct([(t, pa.float64()) for t in TAGS])))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "id string, defect_type string" + (f", coverage struct<{', '.join(f'{t}: double' for t in TAGS)}>" if details else "")
    found = rows.filter(F.col("id").isNotNull()).select("id", "question", "answers", "evidence", "qa_language").mapInArrow(run, schema)
    return found.dropDuplicates(["id"])
