"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Entries are word beginnings (`` scum`` or `` lowei``, with the space that opens a word) or whole words (with
a closing space too).  Their weights are log-odds learned from labelled documents; exception phrases are an
entry with the word before or behind it which labelled clean documents hold, and there the entry doesn't count.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm.shared import labelled_sample

SAMPLE_PER_CLASS = 3000     # labelled rows of each class that a fit reads
SUPPORT = 4                 # different words that an entry must follow in toxic texts, so edited copies don't count
CHANCE = 1.0                # entries taken by chance at most, on average, if all were as common in clean texts
COPY_WORDS = 50             # texts of so many words or more are copies of one another even with a few edits
TELLING = 50                # toxic documents with an entry for one clean document with it
THRESHOLD = 0.7

# Letters of other scripts, digits and signs that are used for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i",
    "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}


class _Fold(dict):
    """Translation of one character: a letter of a-z, others by their look, all else to nothing or a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char.lower())
        kept = "".join(LOOKALIKES.get(c, c) for c in plain if not unicodedata.combining(c))
        if unicodedata.category(char) == "Cf" or (unicodedata.combining(char) and not kept):
            out = ""                            # invisible characters don't part a word
        else:
            out = "".join(c if c.isalnum() else " " for c in kept) or " "
        self[code] = out
        return out


_FOLD = _Fold()
_SIGNS = str.maketrans("", "", "!|")


def folded(text: str | None) -> str:
    """Words of a text, folded, with one space before, between and behind them.

    Digits and signs stand for letters only inside a word that has letters; elsewhere they are left out.
    """
    words = []
    for word in (text or "").split():
        word = word.rstrip("!|.,;:?").lstrip("!|")
        if any(c.isalpha() for c in word):
            words.extend(word.translate(_FOLD).split())
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, str] = field(default_factory=dict)        # phrase -> the entry in it that doesn't count
    slope: float = 1.0
    offset: float = -3.0

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (1 - len(entry), weight))
        for phrase, entry in self.exceptions.items():
            place = 0 if phrase.startswith(entry) else phrase.rindex(" ", 0, -1)
            found.add_word(phrase, (1 - len(phrase) + place, 0.0))      # where the entry starts, and no weight
        found.make_automaton()
        return found


def density(text: str | None, matcher: ahocorasick.Automaton | None) -> float:
    """Weight of all matches outside of exception phrases, for the root of the number of words."""
    return _density(folded(text), matcher)


def _density(plain: str, matcher: ahocorasick.Automaton | None) -> float:
    if matcher is None or plain == " ":
        return 0.0
    found = [(end + back, weight) for end, (back, weight) in matcher.iter(plain)]
    excused = {start for start, weight in found if not weight}
    return sum(weight for start, weight in found if start not in excused) / math.sqrt(plain.count(" "))


def _beginnings(word: str) -> list[str]:
    """A word as an entry, and its beginnings of 4 to 9 letters."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(4, min(9, len(word)) + 1))]


def _entries(plain: str) -> set[str]:
    return {e for word in set(plain.split()) for e in _beginnings(word)}


def _origin(plain: str) -> int | str:
    """The same for copies of a text, and for most copies of a longer one with a few edits: the least hash of its
    runs of five words."""
    words = plain.split()
    if len(words) < COPY_WORDS:
        return plain
    return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))


def _by_chance(toxic: int, clean: int, share: float) -> float:
    """A bound (Chernoff) on the chance that so many of the texts with an entry are toxic, if ``share`` of all are."""
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= share:
        return 1.0
    gain = p * math.log(p / share) + (0.0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - share)))
    return math.exp(-n * gain)


def fit(texts: list[str], toxic: list[int]) -> Lexicon:
    """The lexicon that labelled texts show; without texts of both classes every score is low.

    Copies of toxic texts count once.  An entry is taken if it follows a few different words and enough texts hold
    it for chance to be ruled out; neither asks more of it as texts grow in number, and none is left out for the
    number of entries."""
    rows: list[tuple[bool, str]] = []
    known: set[int | str] = set()
    for text, mark in zip(texts, toxic):
        plain = folded(text)
        if mark:
            origin = _origin(plain)
            if origin in known:
                continue
            known.add(origin)
        rows.append((bool(mark), plain))
    plains, marks = [plain for _, plain in rows], np.array([mark for mark, _ in rows], bool)
    n_toxic, n_clean = int(marks.sum()), int((~marks).sum())
    if not n_toxic or not n_clean:
        return Lexicon()
    held: Counter[str] = Counter()
    places: set[tuple[str, str]] = set()
    for plain, mark in zip(plains, marks):
        if mark:
            held.update(_entries(plain))
            words = plain.split()
            places.update(zip(["", *words], words))
    after: Counter[str] = Counter()
    for _, word in places:
        after.update(_beginnings(word))
    held = Counter({e: n for e, n in held.items() if after[e] >= SUPPORT})
    clean: Counter[str] = Counter()
    for plain, mark in zip(plains, marks):
        if not mark:
            clean.update(e for e in _entries(plain) if e in held)
    # entries that clean documents hold now and then may be telling outside the phrases these have
    doubtful = {e for e, n in held.items() if n < clean[e] * TELLING and clean[e] * 4 <= n}
    excused, outside = _exceptions(doubtful, plains, marks)
    clean.update({e: outside[e] - clean[e] for e in doubtful})
    odds = {e: math.log((n + 0.1) / (n_toxic + 0.2)) - math.log((clean[e] + 0.1) / (n_clean + 0.2)) for e, n in held.items()}
    share, chance = n_toxic / (n_toxic + n_clean), CHANCE / max(1, len(held))
    strong = {
        e: w for e, w in odds.items()
        if w > 2.5 and clean[e] * TELLING <= held[e] and _by_chance(held[e], clean[e], share) <= chance
    }
    chosen: dict[str, float] = {}
    # the shortest beginning that is as telling stands for all words behind it
    for entry in sorted(strong, key=lambda e: (len(e), e)):
        if not any(entry[:n] in chosen for n in range(5, len(entry))):
            chosen[entry] = strong[entry]
    lexicon = Lexicon(chosen, {p: e for p, e in excused.items() if e in chosen})
    matcher = lexicon.automaton()
    lexicon.slope, lexicon.offset = _logistic(np.array([_density(p, matcher) for p in plains]), marks)
    return lexicon


def _phrases(plain: str, entries: set[str]) -> Iterator[tuple[str, list[str]]]:
    """Each occurrence of an entry, with the phrases of two words around it."""
    words = plain.split()
    for k, word in enumerate(words):
        for entry in _beginnings(word):
            if entry in entries:
                around = [f" {words[k - 1]} {word} "] if k else []
                yield entry, around + ([f" {word} {words[k + 1]} "] if k + 1 < len(words) else [])


def _exceptions(entries: set[str], plains: list[str], marks: np.ndarray) -> tuple[dict[str, str], Counter]:
    """Phrases around entries which clean documents hold, and toxic ones hardly do, with their entry; and the
    clean documents that hold an entry outside of them."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for plain, mark in zip(plains, marks):
        seen[int(mark)].update({(p, entry) for entry, around in _phrases(plain, entries) for p in around})
    kept = [(n, p, e) for (p, e), n in seen[0].items() if n >= 2 and n > 4 * seen[1][(p, e)]]
    excused = {p: e for _, p, e in sorted(kept, key=lambda x: (-x[0], x[1], -len(x[2])))}
    outside: Counter[str] = Counter()
    for plain, mark in zip(plains, marks):
        if not mark:
            outside.update({e for e, around in _phrases(plain, entries) if not any(p in excused for p in around)})
    return excused, outside


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighted alike, by Newton steps with a small ridge."""
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    rows, beta = np.stack([np.log1p(8 * x), np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        grad = rows.T @ (weight * (p - y)) + 1e-4 * beta
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def probability(value: float, lexicon: Lexicon) -> float:
    z = lexicon.slope * math.log1p(8 * value) + lexicon.offset
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_PER_CLASS) -> Lexicon:
    rows = labelled_sample(docs, labels, "toxic", per_class, usable)
    return fit(rows["text"].tolist(), (rows["label"] == "1").astype(int).tolist())


def scored(docs: DataFrame, lexicon: Lexicon, column: str = "toxic_score") -> DataFrame:
    """``docs`` with a score, 0 to 1, in ``column``; one of that name is replaced, all others stay.  Null and empty
    texts get the score of a text without any match; long texts are read whole, repeated rows scored alike."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = lexicon.automaton()
        for texts in batches:
            yield pd.Series([probability(density(t, matcher), lexicon) for t in texts], dtype="float64")

    return docs.withColumn(column, score(F.col("text")))
