"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from msgrisk.llm.shared import keep

SEQUENCE = 2048
ROWS_PER_BUCKET = 256
_CACHED_WORDS = 500_000     # about 80 MB
# Signs between a letter (ASCII, or of U+00C0 to U+00FF) and white space.  The pattern begins with a sign and looks
# back from there, so that the search runs from sign to sign.
_SIGN = rb"[^\sa-z0-9\x80-\xff]"
_SIGNS = re.compile(_SIGN + rb"(?:(?<=[a-z0-9]" + _SIGN + rb")|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]" + _SIGN + rb"))" + _SIGN + rb"*(?=\s)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Token ids, as packed 32-bit integers, of words between ASCII white space; a word's ids don't depend
    on its neighbours for tokenizers that split at white space first.

    The words met first are kept, which are the frequent ones in the main; when far more words than those
    have been unknown, the texts have changed and it starts anew.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.unknown = Tokenizer.from_file(tokenizer_path), 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        self.unknown += 1
        if self.unknown > 8 * _CACHED_WORDS:
            self.clear()
            self.unknown = 0
        if len(self) < _CACHED_WORDS:
            self[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, then id 0.  Where no special token can be meant and no mark of U+0300 to U+037F (first
        byte CC or CD) can be composed with a capital, which comes before lower-casing, A-Z are lower-cased and the
        signs behind a word's last letter, which the tokenizer parts from it anyway, become a word of their own."""
        line = (text or "").encode("utf-8", "replace")
        if b"<|" not in line and b"\xcc" not in line and b"\xcd" not in line:
            line = _SIGNS.sub(rb" \g<0>", line.lower())
        return b"".join(map(self.__getitem__, line.split())) + b"\0\0\0\0"

    @classmethod
    def of_worker(cls, tokenizer_path: str) -> WordIds:
        """The words of this Python worker, which Spark uses for many tasks one after another."""
        held = sys.modules.setdefault("_words_of_worker", types.ModuleType("_words_of_worker")).__dict__
        if tokenizer_path not in held:
            held[tokenizer_path] = cls(tokenizer_path)
        return held[tokenizer_path]


def _cut(batches: Iterator[pd.DataFrame], tokenizer_path: str, size: int) -> Iterator[pd.DataFrame]:
    ids = WordIds.of_worker(tokenizer_path)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            packed = ids.encode(text)
            for piece, at in enumerate(range(0, len(packed), 4 * size)):
                part = packed[at : at + 4 * size]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        yield frame.astype({"doc_id": "Int64"})


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of each document: its ids, then id 0, cut only if longer than ``size``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        partial(_cut, tokenizer_path=tokenizer_path, size=size), PIECES
    )


def plan_bins(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, copies) for so many documents of each length.

    A bin is filled greedily with the longest document that fits; if a gap is left, its smallest document
    makes way for the two unpacked ones that fit the wider gap most tightly, if they fill more of it.  The
    same bin is then made as often as the counts allow, so the work depends on the number of lengths (at
    most ``size``), not on the number of documents.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while True:
        free = np.flatnonzero(left)
        if not len(free):
            return bins
        used: Counter[int] = Counter()
        gap, order = size, []
        while gap:
            fits = free[: np.searchsorted(free, gap, "right")]
            best = next((int(x) for x in fits[::-1] if left[x] > used[int(x)]), 0)
            if not best:
                break
            run = 1 if not order else max(1, min(gap // best, int(left[best]) - used[best]))
            order += [best] * run
            used[best] += run
            gap -= best * run
        if gap and len(order) > 1:
            small = order[-1]
            pair = _tightest_pair(left, used, small, gap + small)
            if pair:
                order = sorted([*order[:-1], *pair], reverse=True)
                used = Counter(order)
        copies = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * copies
        bins.append((tuple(order), copies))


def _tightest_pair(left: np.ndarray, used: Counter, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum above ``small`` that fits ``room``, else None."""
    spare = left[: room + 1].copy()
    for x, n in used.items():
        if x <= room:
            spare[x] -= n
    free = np.flatnonzero(spare > 0)
    if not len(free):
        return None
    at = np.searchsorted(free, room - free, "right") - 1
    single = (at >= 0) & (free[at] == free) & (spare[free] < 2)     # it can't be its own partner
    at = np.where(single, at - 1, at)
    sums = np.where(at >= 0, free + free[at], 0)
    best = int(sums.argmax())
    return (int(free[best]), int(free[at[best]])) if sums[best] > small else None


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows length, first rank, per bin, offset, first sequence: which documents of a length go where.

    At most a few rows for each length and bin, and there are no more bins than lengths can be used up."""
    ranks: Counter[int] = Counter()
    rows, sequence = [], 0
    for order, copies in bins:
        offset = 0
        for length, n in sorted(Counter(order).items(), reverse=True):
            rows.append((length, ranks[length], n, offset, sequence))
            ranks[length] += n * copies
            offset += n * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches: Iterator[pd.DataFrame], slots: np.ndarray) -> Iterator[pd.DataFrame]:
    first = slots[:, 0] * (1 << 48) + slots[:, 1]
    for batch in batches:
        if len(batch):
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            row = slots[np.searchsorted(first, length * (1 << 48) + rank, "right") - 1]
            copy, which = np.divmod(rank - row[:, 1], row[:, 2])
            batch = batch.assign(sequence_id=row[:, 4] + copy, offset=row[:, 3] + which * length)
            yield batch.drop(columns="rank").astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    Null and empty texts hold the closing id only.  Rows without doc_id and repeated rows are packed like
    others, each in a place of its own.  Only the counts of each length reach the driver; documents of a
    length are numbered in buckets whose number follows that count, so a common length is no hot key.
    """
    rows = keep(pieces(docs, tokenizer_path, size))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_bins(counts, size))
    buckets = [1] * (size + 1)
    for length, n in counts.items():
        buckets[length] = -(-n // ROWS_PER_BUCKET)
    spread = F.element_at(F.lit(buckets), F.col("length").cast("int") + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), spread).cast("long"))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("at", F.row_number().over(within) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("at")).cast("long").alias("rank"))
    return ranked.mapInPandas(partial(_place, slots=slots), PIECES + ", sequence_id long, offset long")
