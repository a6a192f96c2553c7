"""Token counts; huge documents are encoded in overlapping chunks that are spliced where their tokens agree.

A byte-level tokenizer first cuts a text into words by a pattern that never looks back.  If two encodings of
overlapping chunks both end a word at one place, they cut the text behind it alike, so there they can be spliced.
What the end of a chunk can still change is left out: the pattern looks a few characters ahead, and a
special token may be cut off.  Where no such place lies in the overlap, it is widened over the whole next chunk.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from msgrisk.llm.shared import keep

CHUNK = 32_768              # code points; longer documents are cut
OVERLAP = 256
LIMIT = 1024
_AHEAD = 4                  # characters that the pattern may look at behind a word
_KEPT = 400_000             # counts of words that a worker remembers, about 60 MB
_BREAK = re.compile(r"(?<=\S) ")
PIECES = "row long, doc_id long, n_bytes long, n_tokens long, first int, last int, final boolean, text string"
MARKS = "row long, doc_id long, n_bytes long, first int, last int, total long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"
SPLICED = "row long, doc_id long, n_bytes long, n_tokens long, first int, into int"


class Counter(dict):
    """Counts tokens of a byte-level tokenizer (its own pattern, no normalizer); remembers those of words.

    A space behind a character that is none begins a new word, whatever follows, so what lies between two such
    spaces has the same tokens in every text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts.get("pre_tokenizer") or {}
        added = parts.get("added_tokens") or []
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        # what the argument above, and the one for splicing, are proven for
        self.known = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") \
            and not parts.get("normalizer") and not parts.get("post_processor") and plain
        self.special = [t["content"] for t in added]
        self.parted = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.ahead = _AHEAD + max(map(len, self.special), default=0)

    def __missing__(self, part: str) -> int:
        n = len(self.tokenizer.encode(part, add_special_tokens=False).ids)
        if len(part) < 64:
            if len(self) >= _KEPT:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str) -> int:
        if not self.known:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        found = 0
        for run in (self.parted.split(text) if self.parted and any(s in text for s in self.special) else [text]):
            first, *rest = _BREAK.split(run)
            found += self[first] + sum(map(self.__getitem__, [" " + x for x in rest])) if run else 0
        return found + (len(self.parted.findall(text)) if self.parted else 0)

    def word_ends(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places where words end, the tokens up to each, and the number of all tokens."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        last = np.flatnonzero(np.append(words[1:] != words[:-1], True)) if len(words) else np.empty(0, np.int64)
        ends = np.array([b for _, b in found.offsets], np.int64)
        return ends[last], last + 1, len(words)

    @classmethod
    def of_worker(cls, path: str) -> Counter:
        """The counter of this Python worker, which Spark uses for many tasks one after another."""
        held = sys.modules.setdefault("_token_counter_of_worker", types.ModuleType("_token_counter_of_worker")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]


def _cut(batches: Iterator[pd.DataFrame], path: str, chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Counts of documents up to a chunk long; chunks with the beginning of the next one of all others."""
    counter, row = Counter.of_worker(path), TaskContext.get().partitionId() << 40
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            text, row = text or "", row + 1
            n_bytes = len(text.encode("utf-8", "replace"))
            if len(text) <= chunk or not counter.known:
                out.append((row, doc_id, n_bytes, counter.count(text), None, None, None, None))
                continue
            n = -(-len(text) // chunk)
            out += [(row, doc_id, n_bytes, None, i, i, i == n - 1, text[i * chunk : (i + 1) * chunk + overlap]) for i in range(n)]
        frame = pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "n_tokens", "first", "last", "final", "text"])
        yield frame.astype({"doc_id": "Int64", "n_tokens": "Int64", "first": "Int32", "last": "Int32"})


def marks(text: str, start: int, following: int, overlap: int, counter: Counter) -> tuple:
    """Of a chunk at ``start``: all tokens, and word ends with the tokens up to them in the overlaps with the
    chunks before and behind it (the latter begins at ``following``)."""
    ends, upto, total = counter.word_ends(text)
    at = ends + start
    head = at <= start + overlap
    tail = (at >= following) & (ends <= len(text) - counter.ahead)
    return total, at[head], upto[head], at[tail], upto[tail]


def _encode(batches: Iterator[pd.DataFrame], path: str, chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    counter = Counter.of_worker(path)
    for batch in batches:
        out = [marks(text, first * chunk, (last + 1) * chunk, overlap, counter) for text, first, last in zip(batch["text"], batch["first"], batch["last"])]
        found = pd.DataFrame(out, columns=["total", "head_at", "head_n", "tail_at", "tail_n"], index=batch.index)
        yield batch[["row", "doc_id", "n_bytes", "first", "last"]].astype({"doc_id": "Int64"}).join(found)


def _splice(frame: pd.DataFrame) -> pd.DataFrame:
    """The tokens of a document if all its chunks agree somewhere with the next one; else which chunks to join.

    Takes numbers only, at most as many for each chunk as an overlap has words."""
    frame = frame.sort_values("first").reset_index(drop=True)
    tokens, into, parts = int(frame["total"].sum()), int(frame["first"][0]), []
    for left, right in zip(frame.itertuples(), frame.iloc[1:].itertuples()):
        parts.append((left.first, into))
        places, a, b = np.intersect1d(left.tail_at, right.head_at, return_indices=True)
        if len(places):
            tokens += int(left.tail_n[a[-1]]) - left.total - int(right.head_n[b[-1]])
            into = right.first
    parts.append((int(frame["first"].iloc[-1]), into))
    row, doc_id, n_bytes = frame.loc[0, ["row", "doc_id", "n_bytes"]]
    if all(a == b for a, b in parts):
        parts = [(None, None)]
    else:
        tokens = None
    out = pd.DataFrame([(row, doc_id, n_bytes, tokens, a, b) for a, b in parts], columns=["row", "doc_id", "n_bytes", "n_tokens", "first", "into"])
    return out.astype({"doc_id": "Int64", "n_tokens": "Int64", "first": "Int32", "into": "Int32"})


def _joined(frame: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """Chunks that follow one another as one."""
    frame = frame.sort_values("first").reset_index(drop=True)
    own = [text[: (last - first + 1) * chunk] for text, first, last in zip(frame["text"][:-1], frame["first"], frame["last"])]
    end = frame.iloc[-1]
    out = frame.iloc[:1].drop(columns="into").assign(last=end["last"], final=end["final"], text="".join([*own, end["text"]]))
    return out.astype({"doc_id": "Int64", "n_tokens": "Int64"})


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs`` (doc_id, text).

    Counts are those of the tokenizers package without added special tokens; special strings in a text count as it
    has them by default.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and ids and rows without
    doc_id are counted like others; an empty table gives an empty one; other columns are ignored.  Documents longer
    than ``chunk`` are encoded in chunks by any task and only numbers are brought together, so no task gets a whole
    one, unless no two of its chunks agree (a run of a million letters is a single word, which can't be parted).
    A tokenizer that isn't byte-level, for which splicing isn't proven, encodes every text whole.
    """
    overlap = min(overlap, chunk)
    cut = partial(_cut, path=tokenizer_path, chunk=chunk, overlap=overlap)
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES))
    counted, open_ = rows.where("n_tokens is not null"), rows.where("n_tokens is null")
    columns = ["doc_id", "n_bytes", "n_tokens"]
    out = counted.select(*columns)
    while True:
        encode = partial(_encode, path=tokenizer_path, chunk=chunk, overlap=overlap)
        found = open_.repartition("row", "first").mapInPandas(encode, MARKS)
        spliced = keep(found.groupBy("row").applyInPandas(_splice, SPLICED))
        out = out.union(spliced.where("n_tokens is not null").select(*columns))
        wide = spliced.where("n_tokens is null").select("row", "first", "into")
        if wide.isEmpty():
            break
        parts = open_.join(wide, ["row", "first"]).select(*open_.columns, "into")
        open_ = keep(parts.groupBy("row", "into").applyInPandas(lambda frame: _joined(frame, chunk), PIECES))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
