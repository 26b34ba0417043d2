"""Text that was decoded with a wrong character encoding: finding it, and restoring it where that is possible.

Only words with a letter outside ASCII can be garbled. For each distinct one every chain of up to three steps
(encode with one of CODECS, decode as UTF-8; or read as the Vietnamese byte scheme of VNI fonts) gives candidates.
A smoothed character trigram model, trained on the clean words of all texts, scores the word and its
candidates; the likeliest is accepted if it beats the word itself by a margin that is validated on clean and on
deliberately garbled words. The font scheme gives letters that only Vietnamese has in Vietnamese syllables alone. A replacement character marks a loss that nothing restores.

Null, empty and blank texts are never affected. Decomposed accents, other scripts and rare signs are unusual but
correct and stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.runtime import cut

#: Encodings that UTF-8 text is taken for by mistake. Fixed values, names as Python spells them.
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1258", "koi8-r", "gbk", "shift_jis", "big5")
#: Bytes that windows-1252 leaves undefined; decoders pass them through.
UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
STEPS = 3
#: Words are counted over all texts; their frequencies are taken for so many texts, so that bounds hold at every size.
PER_TEXTS = 1_500
#: Distinct words that a task counts before it passes the counts on.
HELD_WORDS = 300_000
#: By how much all words of a text together must gain to be read in the font scheme.
FONT_MARGIN = 12.0
#: Occurrences in PER_TEXTS texts from which a word is surely clean.
SURE = 8
LOST = "�"
WORDS = re.compile(r"([ \n\t\r]+)")
SPACES = re.compile(r"[ \n\t\r]+")
RUNS = re.compile(r"[^\x00-\x7f]+")
CACHE = 300_000

# VNI fonts write a base letter and then one sign for shape and tone. Sign -> combining marks.
VNI_TONES = {"ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣"}
VNI_ROUND = {"â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂"}
VNI_SHORT = {"ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆"}
VNI_ALONE = {"ñ": "đ", "ö": "ư", "ô": "ơ", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}


def vni_table() -> dict[str, str]:
    pairs = {}
    for bases, signs in (("aeouyôö", VNI_TONES), ("aeo", VNI_ROUND), ("a", VNI_SHORT)):
        for base in bases:
            for sign, marks in signs.items():
                letter = VNI_ALONE.get(base, base)
                made = unicodedata.normalize("NFC", letter + marks)
                pairs[base + sign] = made
                pairs[base.upper() + sign.upper()] = pairs[base.upper() + sign] = made.upper()
    for alone, made in VNI_ALONE.items():
        pairs[alone], pairs[alone.upper()] = made, made.upper()
    return pairs


VNI = vni_table()
VNI_PATTERN = re.compile("|".join(sorted(map(re.escape, VNI), key=len, reverse=True)))

# A Vietnamese syllable without its tone: initial, vowels, final. Fixed values of the orthography.
INITIALS = "ngh ng nh gh gi g kh k qu ph p th tr t ch c b d đ h l m n r s v x"
VOWELS = (
    "a ă â e ê i o ô ơ u ư y ai ao au ay âu ây eo êu ia iê iêu iu oa oă oe oi oai oay oeo oo ôi ơi ua uâ uê ui uô uôi uơ uy uya uyê uyu"
    " uây ưa ươ ươi ươu ưi ưu yê yêu"
)
TONES = "\u0301\u0300\u0309\u0303\u0323"
SYLLABLE = re.compile(f"(?:{'|'.join(INITIALS.split())})?(?:{'|'.join(VOWELS.split())})(?:(?P<stop>ch|c|p|t)|ng|nh|m|n)?")
#: Initials of Vietnamese words, as in ĐH; they have no vowel.
INITIALISM = re.compile("[BCDĐGHKLMNPQRSTVX]+")
LETTERS = re.compile(r"[^\W\d_]+")


def syllable(run: str) -> bool:
    """Whether letters are one Vietnamese syllable or Vietnamese initials.

    A syllable has one tone at most; one that ends in c, ch, p or t has the acute or the dot.
    """
    if INITIALISM.fullmatch(run):
        return True
    apart = unicodedata.normalize("NFD", run.lower())
    tones = [c for c in apart if c in TONES]
    match = SYLLABLE.fullmatch(unicodedata.normalize("NFC", "".join(c for c in apart if c not in TONES)))
    return match is not None and len(tones) <= 1 and (not match["stop"] or tones in (["\u0301"], ["\u0323"]))


def from_font(word: str) -> str:
    """The word read in the font scheme: whole where that gives Vietnamese syllables, else only letters that aren't just Vietnamese.

    Words of other languages have the signs of the scheme as letters (ö in höchstens isn't ư), but texts in French stand in it too.
    """

    def run(match: re.Match) -> str:
        made = VNI_PATTERN.sub(lambda m: VNI[m[0]], match[0])
        return made if syllable(made) else VNI_PATTERN.sub(lambda m: VNI[m[0]] if VNI[m[0]] <= "\xff" else m[0], match[0])

    return LETTERS.sub(run, word)


def to_bytes(word: str, codec: str) -> bytes | None:
    if codec == "cp1252":
        out = bytearray()
        for c in word:
            try:
                out += c.encode("cp1252")
            except UnicodeEncodeError:
                if ord(c) not in UNDEFINED:
                    return None
                out.append(ord(c))
        return bytes(out)
    try:
        return word.encode(codec)
    except UnicodeEncodeError:
        return None


def one_step(word: str) -> dict[str, str]:
    """Candidates after one step: {restored: codec}."""
    found: dict[str, str] = {}
    for codec in CODECS:
        raw = to_bytes(word, codec)
        try:
            made = raw.decode("utf-8") if raw is not None else None
        except UnicodeDecodeError:
            made = None
        if made is None:  # a word in which only some runs are garbled

            def run(match: re.Match, codec=codec) -> str:
                part = to_bytes(match[0], codec)
                try:
                    return part.decode("utf-8") if part else match[0]
                except UnicodeDecodeError:
                    return match[0]

            made = RUNS.sub(run, word)
        if made != word:
            found.setdefault(made, codec)
    return found


@dataclass
class Model:
    """Character trigrams of clean words, interpolated with bigrams and single characters, and the margin."""

    three: dict[str, int]
    two: dict[str, int]
    one: dict[str, int]
    total: int
    margin: float = 1.0
    known: frozenset[str] = frozenset()
    cache: dict[str, str | None] = field(default_factory=dict, compare=False)

    def score(self, word: str) -> float:
        """Log-probability of the whole word; bytes spread over more characters cost more."""
        text = f"^^{word.lower()}$"
        sum_ = 0.0
        for i in range(2, len(text)):
            c, b, a = text[i], text[i - 1 : i], text[i - 2 : i]
            p = (self.one.get(c, 0) + 0.05) / (self.total + 50)
            p = (self.two.get(b + c, 0) + 2 * p) / (self.one.get(b, 0) + 2)
            p = (self.three.get(a + c, 0) + 2 * p) / (self.two.get(a, 0) + 2)
            sum_ += math.log(p)
        return sum_

    def best(self, word: str) -> tuple[str, float]:
        """The likeliest candidate and by how much it beats the word."""
        own, top, gain = self.score(word), word, 0.0
        layer = {word}
        for _ in range(STEPS):
            layer = {made for w in layer for made in one_step(w)}
            if not layer:
                break
            for made in layer:
                if not all(c <= "\x7f" or c in self.one for c in made.lower()):
                    continue  # it has a letter that no clean word has
                by = self.score(made) - own
                if by > gain:
                    top, gain = made, by
        if all(c <= "\xff" for c in word):  # the fonts put all of Vietnamese on these places
            scheme = from_font(word)
            if scheme != word and (by := self.score(scheme) - own) > gain:
                top, gain = scheme, by
        return top, gain

    def restored(self, word: str) -> str | None:
        """What a garbled word was, LOST if that can't be had; None for a word in order."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > CACHE:
            self.cache.clear()
        if word.lower() in self.known:
            out = None
        else:
            made, gain = self.best(word)
            out = made if gain > self.margin else LOST if LOST in word else None
        self.cache[word] = out
        return out


def suspicious(word: str) -> bool:
    return LOST in word or any("\x80" <= c <= "\x9f" for c in word) or bool(one_step(word))


def train(texts: list[str]) -> Model:
    """Trains on a list of texts."""
    return learned(Counter(w for t in texts for w in WORDS.split(t) if w and not w.isspace()), len(texts))


def counted(counts: dict[str, float]) -> Model:
    """The trigrams, bigrams and characters of words with their counts."""
    three: Counter = Counter()
    two: Counter = Counter()
    one: Counter = Counter()
    for w in counts:
        text, n = f"^^{w}$", 1 + int(math.log2(counts[w]))
        for i in range(2, len(text)):
            three[text[i - 2 : i + 1]] += n
            two[text[i - 1 : i + 1]] += n
            one[text[i]] += n
        two["^^"] += n
        one["^"] += 2 * n
    return Model(dict(three), dict(two), dict(one), sum(one.values()))


def learned(raw: dict[str, int], texts: int) -> Model:
    """The model of the words' counts in `texts` texts; every fifth frequent word is held out to validate the margin.

    The model itself has the held-out words again, so that what is found doesn't hang on which these were.

    A clean word counts from one occurrence in PER_TEXTS texts: however large the table, garbled words are many but
    each is rare.
    """
    scale = max(1.0, texts / PER_TEXTS)
    sums: Counter = Counter()
    for w, n in raw.items():
        if w.isascii() or not suspicious(w):
            sums[w.lower()] += n
    counts = {w: n / scale for w, n in sorted(sums.items()) if n >= scale}
    words = list(counts)
    held = [w for i, w in enumerate(sorted(words)) if i % 5 == 0 and not w.isascii() and counts[w] >= SURE]
    apart = set(held)
    model = counted({w: n for w, n in counts.items() if w not in apart})
    clean = [model.best(w)[1] for w in held]
    garbled = []
    for i, w in enumerate(held):
        try:
            garbled.append(model.best(w.encode("utf-8").decode(CODECS[i % 4]))[1])
        except UnicodeDecodeError:
            continue
    worst, weak = max(clean, default=0.0), sorted(garbled)[len(garbled) // 50] if garbled else 6.0
    whole = counted(counts)
    whole.margin = max(1.5, worst + 1.0) if worst + 1.0 < weak else max(1.5, weak)
    whole.known = frozenset(w for w in words if not w.isascii() and counts[w] >= 3 * SURE)
    return whole


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all rows of a column `text`; the word null has the number of texts."""

    def run(batches):
        held: Counter = Counter()
        number = 0

        def passed(words: Counter, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([number, *words.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                number += 1
                held.update(w for w in SPACES.split(text) if w and not w.isspace())
            if len(held) > HELD_WORDS:
                yield passed(held, number)
                held, number = Counter(), 0
        yield passed(held, number)

    return texts.select("text").filter(F.col("text").isNotNull()).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame) -> Model:
    """Trains on the words of all rows of a column `text`. The driver gets those that stand once in PER_TEXTS texts.

    These are at most PER_TEXTS words for each word of an average text, whatever the number of texts.
    """
    counts = cut(word_counts(texts))
    number = counts.filter(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    # words of other case count together
    forms = counts.filter(F.col("word").isNotNull()).withColumn("low", F.lower("word"))
    frequent = forms.groupBy("low").agg(F.sum("n").alias("all"), F.collect_list(F.struct("word", "n")).alias("forms")).filter(F.col("all") >= max(1.0, number / PER_TEXTS))
    return learned({r.word: r.n for r in frequent.select(F.explode("forms").alias("f")).select("f.word", "f.n").toLocalIterator()}, number)


def garbled_words(text: str, model: Model) -> dict[str, str]:
    """{garbled word: original or LOST} of one text."""
    out: dict[str, str] = {}
    if text.isascii():
        return out
    for w in set(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")):
        if not w.isascii() and (made := model.restored(w)) is not None:
            out[w] = made
    # a word of few letters may by chance read well in the font scheme, so its words must together be sure
    fonts = [w for w, made in out.items() if made != LOST and made not in one_step(w) and all(c <= "\xff" for c in w)]
    if fonts and sum(model.best(w)[1] for w in fonts) < FONT_MARGIN:
        for w in fonts:
            del out[w]
    return out


def repair(texts: DataFrame, *, model: Model | None = None) -> DataFrame:
    """Of rows with record_table, record_key and text those that are affected.

    Returns (record_table, record_key, garbled_words int, restored string, complete boolean): the text with every
    restorable word put back, and whether nothing is lost.
    """
    model = model or fit(texts)

    def run(batches):
        for batch in batches:
            keep, number, restored, complete = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                bad = garbled_words(text, model) if text else {}
                if not bad:
                    continue
                parts = [bad[w] if w in bad and bad[w] != LOST else w for w in WORDS.split(text)]
                keep.append(i)
                number.append(len(bad))
                restored.append("".join(parts))
                complete.append(LOST not in bad.values())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_table").take(at), batch.column("record_key").take(at), pa.array(number, pa.int32()), pa.array(restored, pa.string()), pa.array(complete, pa.bool_())],
                names=["record_table", "record_key", "garbled_words", "restored", "complete"],
            )

    schema = "record_table string, record_key string, garbled_words int, restored string, complete boolean"
    return texts.select("record_table", "record_key", "text").filter(F.col("text").isNotNull()).mapInArrow(run, schema)


def records(documents: DataFrame, train_qa: DataFrame) -> DataFrame:
    """The texts of documents and the evidence of train_qa as (record_table, record_key, text)."""
    docs = documents.select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("string").alias("record_key"), "text")
    pairs = train_qa.select(F.lit("train_qa").alias("record_table"), F.col("id").alias("record_key"), F.col("evidence").alias("text"))
    return docs.unionByName(pairs)
