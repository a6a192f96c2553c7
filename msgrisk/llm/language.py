"""Language by word: scripts narrow the candidates, a Viterbi pass with a switching penalty labels spans."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm import ngrams
from msgrisk.llm.shared import labelled_sample

SAMPLE_PER_LANGUAGE = 1200  # labelled rows of each language that a fit reads
GRAMS = (1, 2, 3, 4)
WEIGHTS = (0.25, 0.25, 1.0, 1.0)    # of the lengths
BUCKETS = 1 << 18           # rows of the table of n-grams
KNOWN_WORDS = 200_000       # scored words that a tagger remembers, a few dozen bytes a language each
SMOOTHING = 0.5
TOGETHER = 1 << 18          # characters of texts whose new words are scored at once
PENALTY = 12.0              # log-odds that a change of language must win
FLOOR = -50.0               # log-odds that one word can weigh
SCRIPT_SHARE = 0.001        # share of a language's letters that makes a script its own
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
# Numbers that aren't decimal digits, such as fractions and Roman numerals: \w has them, but they are no letters.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
# First code points of the blocks that tell a script; a letter belongs to the last one before it.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7FF, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPT_RANGES]


def script_of(letter: str) -> str:
    code = ord(letter)
    if code < 0x370:
        return "latin"
    return SCRIPT_RANGES[int(np.searchsorted(_STARTS, code, "right")) - 1][1]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased and composed."""
    if not text:
        return []
    if text.isascii():
        return _LETTERS.findall(text.lower())
    plain = unicodedata.normalize("NFC", text)
    for number in _NUMBERS.intersection(plain):
        plain = plain.replace(number, " ")
    return _LETTERS.findall(plain.lower())


@dataclass
class LanguageModel:
    """Log probabilities of hashed n-grams by language, weighted by length, and the languages of each script."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))     # bucket x language
    scripts: dict[str, list[bool]] = field(default_factory=dict)


def _buckets(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of each length, in a part of the table of its own, and the words' numbers."""
    part = BUCKETS // len(GRAMS)
    for i, n in enumerate(GRAMS):
        hashes, words = ngrams.gram_hashes(codes, n)
        yield hashes.astype(np.int64) % part + i * part, words


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Count the n-grams in the distinct words of each text, every language on its own."""
    model = LanguageModel(sorted(set(languages)))
    counts = np.zeros((len(model.languages), BUCKETS))
    letters: list[Counter] = [Counter() for _ in model.languages]
    for text, lang in zip(texts, languages):
        words, at = sorted(set(words_of(text))), model.languages.index(lang)
        for some in ngrams.chunks(words):
            for ids, _ in _buckets(ngrams.codes_of(some)):
                counts[at] += np.bincount(ids, minlength=BUCKETS)
        letters[at].update(Counter(map(script_of, "".join(words))))
    for i, n in enumerate(GRAMS):
        own = slice(i * BUCKETS // len(GRAMS), (i + 1) * BUCKETS // len(GRAMS))
        used = max(1, int((counts[:, own].sum(0) > 0).sum()))
        share = (counts[:, own] + SMOOTHING) / (counts[:, own].sum(1, keepdims=True) + SMOOTHING * used)
        counts[:, own] = np.log(share) * WEIGHTS[i]
    model.table = np.ascontiguousarray(counts.T, np.float32)
    for script in {s for c in letters for s in c}:
        model.scripts[script] = [c[script] >= SCRIPT_SHARE * max(1, c.total()) for c in letters]
    return model


class Tagger:
    def __init__(self, model: LanguageModel, penalty: float = PENALTY):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}        # of a scored word in the table
        self._scored = np.empty((1024, len(self.model.languages)))

    def _remember(self, words: Iterable[str]) -> None:
        """The score of a word is its own, whatever stands beside it, so each word is scored once and remembered;
        words that are too many start anew."""
        new = list(wanted.difference(self._place)) if (wanted := set(words)) else []
        if new and len(self._place) + len(new) > KNOWN_WORDS:
            self._forget()
            new = list(wanted)
        known = len(self._place)
        if known + len(new) > len(self._scored):
            grown = np.empty((max(2 * len(self._scored), known + len(new)), self._scored.shape[1]))
            grown[:known] = self._scored[:known]
            self._scored = grown
        if new:
            self._scored[known : known + len(new)] = self._fresh_scores(new)
            self._place.update(zip(new, range(known, known + len(new))))

    def scores(self, words: list[str]) -> np.ndarray:
        """Word x language, as ``_fresh_scores`` gives them."""
        self._remember(words)
        return self._scored[np.array([self._place[w] for w in words], np.intp)]

    def _fresh_scores(self, words: list[str]) -> np.ndarray:
        """Word x language: log probability, the best language at zero.  Languages that aren't written in a
        word's script are ruled out; a word in a script of no language is no sign of any."""
        parts = []
        for some in ngrams.chunks(words):
            codes = ngrams.codes_of(some)
            score = np.zeros((len(some), len(self.model.languages)))
            for ids, number in _buckets(codes):
                if len(ids):
                    starts = np.flatnonzero(np.diff(number, prepend=-1))
                    score[number[starts]] += np.add.reduceat(self.model.table[ids], starts, axis=0)
            for script, at in self._scripts(some, codes):
                own = np.array(self.model.scripts.get(script, [False]))
                score[at] = np.where(own, score[at], -np.inf) if own.any() else 0.0
            parts.append(np.maximum(score - score.max(1, keepdims=True), FLOOR))
        return np.concatenate(parts)

    def _scripts(self, words: list[str], codes: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Scripts with the words most of whose letters are in them."""
        if codes.max() < 0x370:
            yield "latin", np.arange(len(words))
            return
        names = sorted({name for _, name in SCRIPT_RANGES})
        block = np.array([names.index(name) for _, name in SCRIPT_RANGES])[np.searchsorted(_STARTS, codes, "right") - 1]
        letter = codes != 32
        number = (np.cumsum(~letter) - 1)[letter]
        held = np.bincount(number * len(names) + block[letter], minlength=len(words) * len(names))
        most = held.reshape(len(words), -1).argmax(1)
        for at in np.unique(most):
            yield names[at], np.flatnonzero(most == at)

    def path(self, words: list[str]) -> np.ndarray:
        """The language of each word on the best path: scores of the words, less the penalty at each change.

        A path in one language is best, and no other need be looked at, if no stretch of words gains more
        than one penalty by another language; the largest gain of a stretch follows from running sums.
        """
        scores = self.scores(words)
        main = int(scores.sum(0).argmax())
        gain = scores.max(1) - scores[:, main]
        rival = np.where(gain > 0, gain, np.delete(scores, main, 1).max(1, initial=FLOOR) - scores[:, main])
        sums = np.concatenate(([0.0], np.cumsum(rival)))
        if (sums - np.minimum.accumulate(sums)).max() <= self.penalty:
            return np.full(len(words), main)
        # Where one language is best at every word of a run, a change within the run is never better than at its ends.
        starts = np.flatnonzero(np.diff(scores.argmax(1), prepend=-1))
        runs = self._viterbi(np.add.reduceat(scores, starts, axis=0))
        return np.repeat(runs, np.diff(starts, append=len(words)))

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        n, k = scores.shape
        came = np.empty((n, k), np.int16)
        stay, best = np.arange(k), scores[0].copy()
        for t in range(1, n):
            top = int(best.argmax())
            switch = best[top] - self.penalty
            moved = switch > best
            came[t] = np.where(moved, top, stay)
            best = np.where(moved, switch, best) + scores[t]
        out = np.empty(n, np.int64)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Stretches of one language: language, first word, word behind the last."""
        words = words_of(text)
        if not words or not self.model.languages:
            return []
        path = self.path(words)
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(self.model.languages[path[a]], a, b) for a, b in zip(cuts, cuts[1:])]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of most letters, and its share of them; ``und`` and 0 without letters or languages."""
        return self._predicted(words_of(text))

    def predictions(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """``predict`` for each of the texts; the new words of texts of some ``TOGETHER`` characters are scored at once."""
        group, size = [], 0
        for text in texts:
            group.append(words_of(text))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._grouped(group)
                group, size = [], 0
        yield from self._grouped(group)

    def _grouped(self, group: list[list[str]]) -> Iterator[tuple[str, float]]:
        if self.model.languages:
            self._remember(chain.from_iterable(group))
        return map(self._predicted, group)

    def _predicted(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        path = self.path(words)
        sizes = np.bincount(path, weights=np.array(list(map(len, words))), minlength=len(self.model.languages))
        main = int(sizes.argmax())
        return self.model.languages[main], float(sizes[main] / sizes.sum())


def learn(docs: DataFrame, usable: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model from the documents' own lang column, of a bounded sample of the usable rows of each language."""
    rows = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", per_language, usable)
    return fit(rows["text"].tolist(), rows["label"].tolist())


def identified(docs: DataFrame, model: LanguageModel, column: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score) in ``column``; one of that name is replaced, all others stay.  Null
    texts and texts without letters are ``und``; long texts are read whole, repeated rows labelled alike."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for texts in batches:
            found = list(tagger.predictions(texts))
            yield pd.DataFrame(found, columns=["lang_pred", "score"], index=texts.index).astype({"score": "float64"})

    return docs.withColumn(column, predict(F.col("text")))
