"""Splitting texts into a tokenizer's words for whole batches at once, in numpy.

The rule of the public byte-level tokenizer (contractions; an optional space before a run of letters, of numbers or
of other signs; white space) depends only on the class of each character and of its neighbours, so word starts come
from comparing shifted arrays, and every word gets a 64-bit hash by a segmented sum, which finds the distinct words.
No Python object is made per word; strings are made only for the distinct words of a batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4
#: White_Space of the Unicode standard. Fixed values.
SPACES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters handled at once; a longer text is handled alone.
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(SPACES)] = SPACE
    return table


@lru_cache(maxsize=1)
def char_hashes() -> np.ndarray:
    """A fixed pseudo-random 64-bit value per code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x100000001B3, np.uint64))


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def split(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, starts, ends, owner): word k is joined[starts[k]:ends[k]] and belongs to text owner[k]."""
    clean = [t or "" for t in texts]
    joined = "\0".join(clean) + "\0"
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    breaks = np.cumsum(lengths + 1) - 1
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    kind[breaks] = BREAK

    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[breaks] = True
    start[breaks[:-1] + 1] = True

    space = kind == SPACE
    solid = (kind < SPACE) | (kind == OTHER)
    last = np.flatnonzero(space[:-1] & solid[1:])  # white space right before a word
    start[last] = True
    attached = last[code[last] == 0x20]
    start[attached + 1] = False

    quote = np.flatnonzero(code == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        padded = np.concatenate([code, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, width in ((quote[single], 2), (quote[double], 3)):
            start[at + 1] = False
            start[at + width] = True  # at most the break after the text

    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] != BREAK
    starts, ends = starts[real], ends[real]
    return joined, starts, ends, np.searchsorted(breaks, starts)


def hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the indexes of all words' characters with their place in their word."""
    widths = ends - starts
    offsets = np.cumsum(widths) - widths
    place = np.arange(int(widths.sum()), dtype=np.int64) - np.repeat(offsets, widths)
    inside = np.repeat(starts, widths) + place
    most = int(widths.max())
    with np.errstate(over="ignore"):
        terms = char_hashes()[code[inside]] * powers(1 << max(6, (most - 1).bit_length()))[place]
        sums = np.add.reduceat(terms, offsets)
        return mix(sums ^ widths.astype(np.uint64)), inside, place


def dictionary(joined: str, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(distinct words, place of each word among them). Exact: words of one hash are compared sign by sign."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    keys, inside, place = hashes(code, starts, ends)
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    widths, like = ends - starts, first[back]
    if not (np.array_equal(widths, widths[like]) and np.array_equal(code[inside], code[np.repeat(starts[like], widths) + place])):
        known: dict[str, int] = {}
        at = [known.setdefault(joined[s:e], len(known)) for s, e in zip(starts, ends, strict=True)]
        return list(known), np.array(at)
    return [joined[starts[i] : ends[i]] for i in first], back
