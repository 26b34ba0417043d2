"""Languages of documents and of their paragraphs.

The model averages hashed subword embeddings (character bigrams and trigrams) and passes the average to a linear
softmax; it is trained by stochastic gradient descent in numpy on lines of a bounded sample of documents whose two
delivered labels agree and are confirmed by a first model. A held-out part calibrates the temperature and the confidence under which a line is rejected
as undetermined. For prediction embeddings and softmax weights are multiplied out to one small table, and whole
batches of lines are scored by segmented sums.

Page furniture is left out first. A document holds a language if a whole paragraph of its body is accepted as that
language; single words, names and sentences inside a paragraph don't count. Null and blank texts have no language and
no row; a text without letters has an empty list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm import content
from papyrine.llm.lines import not_blank
from papyrine.runtime import sample_of

LANGUAGES = ("en", "vi", "fr", "de")
#: Usual spellings of labels, lower case, without region. Fixed values.
SPELLINGS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "tiếng anh"),
    "vi": ("vi", "vie", "vn", "vietnamese", "tiếng việt", "vietnamesisch", "vietnamien"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "tiếng pháp"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "tiếng đức"),
    "mixed": ("mixed", "mul", "multi", "multiple", "multilingual"),
}
BUCKETS, DIMENSIONS = 1 << 15, 12
#: Bound of the sample the model is fitted on; documents with the smallest hashes are taken.
SAMPLE_DOCS = 1_500
#: Bound of the lines that one sampled document gives to training, so that long ones don't outweigh the rest.
SAMPLE_LINES = 12
#: Characters from which a line is a paragraph; length and confidence from which one alone tells a further language.
PARAGRAPH, SURE_LENGTH, SURE = 60, 80, 0.9


def label_of(label: Column) -> Column:
    """A delivered label as one of LANGUAGES or 'mixed'; null where it says nothing."""
    said = F.regexp_replace(F.lower(F.trim(label)), r"^(\w{2,3})[-_].*$", "$1")
    out = F.lit(None).cast("string")
    for name, ways in SPELLINGS.items():
        out = F.when(said.isin(*ways), F.lit(name)).otherwise(out)
    return out


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, line starts within them) of the bigrams and trigrams of lines; each line has at least two."""
    code = np.frombuffer(("".join([f" {x} \n" for x in lines]).lower() + "\n\n").encode("utf-32-le"), np.uint32)
    digit = (code >= 48) & (code <= 57)
    code = np.where(digit, np.uint32(48), code)
    with np.errstate(over="ignore"):
        a, b, c = code[:-2] * np.uint32(2654435761), code[1:-1] * np.uint32(2246822519), code[2:] * np.uint32(3266489917)
        two, three = (a ^ (b << np.uint32(7))) * np.uint32(668265263), (a ^ (b << np.uint32(7)) ^ (c << np.uint32(13))) * np.uint32(374761393)
    out = np.empty((len(a), 2), np.int32)
    out[:, 0], out[:, 1] = two >> np.uint32(17), three >> np.uint32(17)
    ends = np.flatnonzero(code[:-2] == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    return out.reshape(-1), starts * 2


@dataclass(frozen=True)
class Model:
    """Multiplied-out weights per bucket and language, the bias, the temperature and the least confidence."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def confidences(self, lines: list[str]) -> np.ndarray:
        if not lines:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        buckets, starts = grams(lines)
        sums = np.stack([np.add.reduceat(self.table[:, k][buckets], starts) for k in range(len(LANGUAGES))], 1)
        widths = np.diff(np.append(starts, len(buckets)))[:, None]
        return softmax((sums / widths + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(lines: list[str], labels: list[int], *, epochs: int = 6, batch: int = 256, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits embeddings and softmax by minibatch gradient descent; every fifth line is held out for calibration."""
    rng = np.random.default_rng(seed)
    classes = len(LANGUAGES)
    if not lines:
        return Model(np.zeros((BUCKETS, classes), np.float32), np.zeros(classes, np.float32), 1.0, 0.5)
    y = np.array(labels)
    held = np.arange(len(lines)) % 5 == 4
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, classes)).astype(np.float32), np.zeros(classes, np.float32)
    scale_e, scale_w = np.full(BUCKETS, 1e-6, np.float32), np.full(weights.shape, 1e-6, np.float32)
    own = np.flatnonzero(~held) if (~held).any() else np.arange(len(lines))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            buckets, starts = grams([lines[i] for i in part])
            widths = np.diff(np.append(starts, len(buckets)))
            mean = np.add.reduceat(embed[buckets], starts, axis=0) / widths[:, None]
            error = softmax(mean @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            step_w, back = mean.T @ error / len(part), (error @ weights.T) / widths[:, None]
            spread = np.repeat(back, widths, axis=0)
            step_e = np.stack([np.bincount(buckets, spread[:, k], BUCKETS) for k in range(DIMENSIONS)], 1).astype(np.float32)
            scale_e += (step_e**2).mean(axis=1)
            scale_w += step_w**2
            embed -= rate * 0.2 * step_e / np.sqrt(scale_e)[:, None]
            weights -= rate * 0.2 * step_w / np.sqrt(scale_w)
            bias -= rate * 0.1 * error.mean(axis=0)
    table = (embed @ weights).astype(np.float32)
    if not held.any():
        return Model(table, bias, 1.0, 0.5)
    raw = Model(table, bias, 1.0, 0.0)
    test, truth = [lines[i] for i in np.flatnonzero(held)], y[held]
    logits = np.log(raw.confidences(test) + 1e-12)
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in np.geomspace(0.05, 2, 16)}
    best = min(losses, key=losses.get)
    sure = softmax(logits / best)
    top, right = sure.max(axis=1), sure.argmax(axis=1) == truth
    least = next((c for c in np.linspace(0.5, 0.95, 10) if (top >= c).any() and right[top >= c].mean() >= 0.985), 0.95)
    return Model(table, bias, float(best), float(least))


def clean(lines: list[str], labels: list[int], groups: list[int]) -> tuple[list[str], list[int]]:
    """The lines of those documents whose label a first model confirms over all their lines."""
    first = train(lines, labels, epochs=3)
    votes = np.zeros((max(groups, default=-1) + 1, len(LANGUAGES)))
    np.add.at(votes, np.array(groups, np.int64), first.confidences(lines))
    kept = [i for i, (y, g) in enumerate(zip(labels, groups, strict=True)) if votes[g].argmax() == y]
    soft = first.confidences([lines[i] for i in kept])
    kept = [i for i, p in zip(kept, soft, strict=True) if p.argmax() == labels[i]]
    return [lines[i] for i in kept], [labels[i] for i in kept]


def fit(docs: DataFrame, key: str = "doc_id", *, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """Trains on up to sample_lines lines, spread over the text, of each of about sample_docs documents whose labels agree, chosen by hash."""
    said, also = label_of(F.col("source_language")), label_of(F.col("lang"))
    agreed = docs.filter(not_blank(F.col("text")) & (said == also) & (said != "mixed"))
    long = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: F.length(x) >= 40)
    step = F.greatest(F.lit(1), F.ceil(F.size("long") / sample_lines)).cast("int")
    spread = F.filter("long", lambda x, i: i % F.col("step") == 0)
    taken = sample_of(agreed, sample_docs, F.col(key)).select(said.alias("said"), long.alias("long")).withColumn("step", step)
    rows = taken.select("said", spread.alias("own")).collect()  # sample_docs x sample_lines lines at most
    lines, labels, groups = [], [], []
    for i, (said_, own) in enumerate(rows):
        lines += own
        labels += [LANGUAGES.index(said_)] * len(own)
        groups += [i] * len(own)
    return train(*clean(lines, labels, groups)) if lines else train([], [])


def identify(docs: DataFrame, key: str = "doc_id", *, model: Model | None = None) -> DataFrame:
    """(key, label, languages array<string>, confidence, segments array<struct<line_no, last_line, lang, confidence>>).

    One row per document with a text that isn't blank. `label` is source_language as label_of reads it. Segments are
    the runs of body lines in one language, with their first and last line and the mean confidence by length; a line that
    is rejected as undetermined ends a run.
    """
    model = model or fit(docs, key)
    schema = f"{key} {dict(docs.dtypes)[key]}, source_language string, languages array<string>, confidence double, segments array<struct<line_no:int,last_line:int,lang:string,confidence:double>>"

    def of(batch, drops):
        texts = batch.column("text").to_pylist()
        names, sure, segments = [], [], []
        for begin in range(0, len(texts), 256):
            lines, owner, place = [], [], []
            for i in range(begin, min(begin + 256, len(texts))):
                drop = drops[i]
                own = [(j, x) for j, x in enumerate(texts[i].split("\n")) if not drop[j] and x and not x.isspace()]
                if not own:
                    own = [(j, x) for j, x in enumerate(texts[i].split("\n")) if x and not x.isspace()]
                lines += [x for _, x in own]
                owner += [i] * len(own)
                place += [j for j, _ in own]
            soft = model.confidences(lines)
            width = np.fromiter(map(len, lines), np.int64, len(lines))
            top, best = soft.max(axis=1), soft.argmax(axis=1)
            lettered = np.fromiter((any(map(str.isalpha, x)) for x in lines), bool, len(lines))
            ok = (top >= model.least) & lettered
            at = np.array(owner) - begin
            count = min(256, len(texts) - begin)
            for k in range(count):
                mine = np.flatnonzero(at == k)
                n, c, s = _document(mine, width, best, top, ok, place)
                names.append(n)
                sure.append(c)
                segments.append(s)
        return pa.RecordBatch.from_arrays(
            [batch.column(key), batch.column("source_language"), pa.array(names, pa.list_(pa.string())), pa.array(sure, pa.float64()), pa.array(segments, pa.list_(pa.struct([("line_no", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])))],
            names=[key, "source_language", "languages", "confidence", "segments"],
        )

    return content.with_furniture(docs, [key, "source_language"], of, schema).withColumn("label", label_of(F.col("source_language"))).drop("source_language")


def _document(mine, width, best, top, ok, place) -> tuple[list[str], float | None, list[dict]]:
    accepted = mine[ok[mine]]
    if not len(accepted):
        return [], None, []
    whole = accepted[width[accepted] >= PARAGRAPH]
    counted = whole if len(whole) else accepted
    size = np.bincount(best[counted], width[counted], len(LANGUAGES))
    sure = np.bincount(best[whole], (width[whole] >= SURE_LENGTH) & (top[whole] >= SURE), len(LANGUAGES)) if len(whole) else np.zeros(len(LANGUAGES))
    order = [int(k) for k in np.argsort(-size) if size[k]]
    held = order[:1] + [k for k in order[1:] if sure[k]]
    runs: list[dict] = []
    last = None
    for i in mine:
        if not ok[i]:
            last = None
            continue
        lang = LANGUAGES[best[i]]
        if last != lang:
            runs.append({"line_no": place[i], "lang": lang, "sum": 0.0, "chars": 0})
            last = lang
        runs[-1]["last_line"] = place[i]
        runs[-1]["sum"] += float(top[i]) * int(width[i])
        runs[-1]["chars"] += int(width[i])
    segments = [{"line_no": r["line_no"], "last_line": r["last_line"], "lang": r["lang"], "confidence": r["sum"] / r["chars"]} for r in runs]
    return [LANGUAGES[k] for k in held], float((top[counted] * width[counted]).sum() / width[counted].sum()), segments


def mislabelled(docs: DataFrame, key: str = "doc_id", *, model: Model | None = None) -> DataFrame:
    """(key, lang): the languages of every document whose source_language doesn't tell them."""
    found = identify(docs, key, model=model).filter(F.size("languages") > 0)
    true = F.when(F.size("languages") > 1, F.lit("mixed")).otherwise(F.element_at("languages", 1))
    return found.filter(F.col("label").isNull() | (F.col("label") != true)).select(key, F.explode("languages").alias("lang"))
