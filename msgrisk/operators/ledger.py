"""Cooldown and cache expiry over a batch: which checks are accepted, which skipped.

A check is accepted when the last *accepted* check of its key is old enough and, if a payload hash is given,
had another hash; so the answer for one row depends on all earlier rows of the key.  A fold per key would put
a busy key into one task.  Instead time is cut into chunks, and what a chunk does is a function from the state
before it (open from when on, last accepted hash) to the state behind it:

1. repeats within a millisecond (the clock of the checks) are merged before any grouping, so a chunk holds a
   bounded number of instants however busy its key;
2. every (key, chunk) is summarised in parallel: for each instant at which it may become open again, the
   state that follows if the hash before was another one, and if it was the same; neighbours alike are merged;
3. such functions compose, and a composed one is no longer than that of its first chunk.  Up to ``FAN``
   chunks are composed to a block, blocks to larger ones, until a block spans all time; then, downwards, each
   block learns the state before it and passes it on to its parts.  The rounds grow with the logarithm of the
   time spanned, and no task sees more than ``FAN`` parts of a key at a time;
4. every (key, chunk) marks its accepted instants, again in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgrisk.session import store

MAX_CHUNK_MS = 16_000_000      # aim for at most this many instants per chunk
FAN = 256                      # parts of a block
NEVER = -(2**62)
STEPS = ["until", "code", "last", "last_code", "alike", "alike_code"]
SUMMARY = "key string, chunk long, " + ", ".join(f"{c} long" for c in STEPS)
STATE = "key string, chunk long, opens long, before long"


def chunk_width(wait: int) -> int:
    """Milliseconds per chunk: 64 windows, fewer (but at least 4) for long windows."""
    return wait * int(np.clip(MAX_CHUNK_MS // wait, 4, 64))


def next_accepted(times: np.ndarray, codes: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """For each instant the next one that is accepted after it, and the next one with another code; past the end if none."""
    n = len(times)
    change = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, n)
    other = np.append(change[np.searchsorted(change, np.arange(n), "right")], n) if n else np.zeros(1, np.int64)
    open_ = np.searchsorted(times, times + wait)
    same = np.append(codes, 0)[np.minimum(open_, n)] == codes
    return np.where((open_ < n) & same, other[open_], open_), other


def _last_accepted(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the last accepted instant when the first accepted one is ``starts``."""
    current = starts.copy()
    while True:
        step = following[current]
        moving = step < len(following)
        if not moving.any():
            return current
        current[moving] = step[moving]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Sorted batches as arrays with the bounds of their complete (key, chunk) runs.

    A run may span batches: the unfinished last run is carried into the next one.
    """
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys, chunks = rows["key"].to_numpy(), rows["chunk"].to_numpy()
        starts = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        bounds = np.concatenate([[0], starts])
        rest = rows.iloc[bounds[-1] :]
        if len(bounds) > 1:
            yield {c: rows[c].to_numpy() for c in rows.columns}, bounds[:-1], bounds[1:]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}, np.array([0]), np.array([len(rest)])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, int, list[np.ndarray]]]:
    """The steps of each (key, chunk), with the rows they are cut from and their place."""
    for rows, starts, ends in _runs(batches):
        columns = [rows[c] for c in STEPS]
        for start, end in zip(starts.tolist(), ends.tolist()):
            yield rows, start, [c[start:end] for c in columns]


def _summarise(wait: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _runs(batches):
            lone = starts[ends - starts == 1]       # nothing to follow in a run of one instant
            t, code = rows["t"][lone], rows["code"][lone]
            pick, found = [lone], [[t, code, t, code, np.full(len(lone), NEVER), code]]
            for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                times, codes = rows["t"][start:end], rows["code"][start:end]
                following, other = next_accepted(times, codes, wait)
                opened = rows["chunk"][start] * width + wait     # surely open from here on
                first = np.arange(min(np.searchsorted(times, opened) + 1, len(times)))
                first = first[np.append(True, np.diff(times[first]) > 0)]       # a key opens before the first row of a millisecond
                exits = _last_accepted(following, first)
                alike, left = other[first], np.full(len(first), NEVER)
                inside = alike < len(times)
                alike[inside] = _last_accepted(following, alike[inside])
                left[inside] = times[alike[inside]]
                left_code = np.where(inside, codes[np.minimum(alike, len(times) - 1)], codes[first])
                steps = [times[first], codes[first], times[exits], codes[exits], left, left_code]
                # Without a hash an instant's code is its time and no state before has it: only what follows counts.
                plain = (codes == times).all()
                differ = np.any([np.diff(c) != 0 for c in (steps[2:3] if plain else steps[1:])], axis=0)
                merged = np.append(np.flatnonzero(differ), len(first) - 1)
                pick.append(np.full(len(merged), start))
                found.append([c[merged] for c in steps])
            at = np.concatenate(pick)
            columns = {c: np.concatenate([f[i] for f in found]) for i, c in enumerate(STEPS)}
            yield pd.DataFrame({"key": rows["key"][at], "chunk": rows["chunk"][at], **columns})

    return run


def _apply(steps: list[np.ndarray], opens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a chunk accepts anything from the given states: last accepted instants and their codes."""
    until, code, last, last_code, alike, alike_code = steps
    at = np.searchsorted(until, opens)
    inside, at = at < len(until), np.minimum(at, len(until) - 1)
    same = code[at] == before
    out, out_code = np.where(same, alike[at], last[at]), np.where(same, alike_code[at], last_code[at])
    return inside & (out != NEVER), out, out_code


def _compose(wait: int, width: int):
    """Summaries of blocks from those of their parts, in order; ``part`` numbers the parts by time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, key, steps, bound = None, None, [], 0

        def whole() -> pd.DataFrame:
            n = len(steps[0])
            return pd.DataFrame({"key": [key] * n, "chunk": np.full(n, block), **dict(zip(STEPS, steps))})

        for rows, start, part in _parts(batches):
            if rows["key"][start] != key or rows["block"][start] != block:
                if steps:
                    yield whole()
                key, block, steps = rows["key"][start], rows["block"][start], [c.copy() for c in part]
                bound = rows["begins"][start] + wait
                continue
            for place in (2, 4):
                # the state behind the parts so far; where they accepted nothing it is that before, with the same code
                idle = steps[place] == NEVER
                opens = np.where(idle, NEVER, steps[place] + wait)
                moved, last, code = _apply(part, opens, np.where(idle, steps[1], steps[place + 1]))
                steps[place], steps[place + 1] = np.where(moved, last, steps[place]), np.where(moved, code, steps[place + 1])
            if steps[0][-1] < bound:        # opens behind the last instant of the first part: as from this one's first
                steps = [np.append(c, p[0]) for c, p in zip(steps, part)]
        if steps:
            yield whole()

    return run


def _follow(wait: int):
    """The state before each part, given that before its block (``opens``, ``before``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = block = None
        opens = before = NEVER
        found: list[tuple] = []
        for rows, start, part in _parts(batches):
            if rows["key"][start] != key or rows["block"][start] != block:
                key, block = rows["key"][start], rows["block"][start]
                opens, before = int(rows["opens"][start]), int(rows["before"][start])
            found.append((key, rows["chunk"][start], opens, before))
            moved, last, code = _apply(part, np.array([opens]), np.array([before]))
            if moved[0]:
                opens, before = int(last[0]) + wait, int(code[0])
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=["key", "chunk", "opens", "before"])
                found = []
        yield pd.DataFrame(found, columns=["key", "chunk", "opens", "before"])

    return run


def _mark(wait: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _runs(batches):
            lone = starts[ends - starts == 1]
            keep = [lone[(rows["t"][lone] >= rows["opens"][lone]) & (rows["code"][lone] != rows["before"][lone])]]
            for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                times, codes, taken = rows["t"][start:end], rows["code"][start:end], []
                following, other = next_accepted(times, codes, wait)
                at = int(np.searchsorted(times, rows["opens"][start]))
                if at < len(times) and codes[at] == rows["before"][start]:
                    at = int(other[at])
                while at < len(times):
                    taken.append(start + at)
                    at = int(following[at])
                keep.append(np.array(taken, dtype=np.int64))
            yield pd.DataFrame({"row_id": rows["row_id"][np.concatenate(keep)]})

    return run


def payload_code(time: Column, row_id: str, payload: str | None) -> Column:
    """A number for the payload hash; one that no other row of the key has where there is none."""
    if payload is None:
        return time
    own = F.xxhash64(F.lit("no payload"), F.col(row_id))
    return F.when(F.col(payload).isNull(), own).otherwise(F.xxhash64(F.col(payload).cast("string")))


def _instants(df: DataFrame, key: Column, time: Column, row_id: str, payload: str | None) -> DataFrame:
    """Columns key, t, row_id, code: what can be accepted at each millisecond of a key.

    Without a payload that is the first row, and its code is the time, which no other instant has.  With
    payloads it is the first row, or the first with another payload if the state has that of the first."""
    if payload is None:
        first = df.groupBy(key.alias("key"), time.alias("t")).agg(F.min(row_id).cast("long").alias("row_id"))
        return first.withColumn("code", F.col("t"))
    code = payload_code(time, row_id, payload)
    first = df.groupBy(key.alias("key"), time.alias("t"), code.alias("code")).agg(F.min(row_id).cast("long").alias("row_id"))
    order = Window.partitionBy("key", "t").orderBy("row_id", "code")
    return first.withColumn("place", F.row_number().over(order)).where("place <= 2").drop("place")


def accepted_rows(
    df: DataFrame, key: str, time: str, row_id: str, window_seconds: int, hit_at_limit: bool, payload: str | None = None, fan: int = FAN
) -> DataFrame:
    """Ids (column ``row_id``) of the accepted rows.

    ``hit_at_limit``: a row exactly ``window_seconds`` after the accepted one is
    still skipped (cache expiry) or already accepted (cooldown).
    """
    wait = window_seconds * 1000 + (1 if hit_at_limit else 0)
    width = chunk_width(wait)
    millis = F.unix_millis(F.col(time).cast("timestamp"))
    chunk_of = F.expr(f"(t - pmod(t, {width}L)) div {width}L")
    ends = df.select(millis.alias("t")).agg(F.min(chunk_of).alias("first"), F.max(chunk_of).alias("last")).first()
    first, span = ends["first"] or 0, (ends["last"] or 0) - (ends["first"] or 0) + 1
    instants = _instants(df, F.col(key).cast("string"), millis, row_id, payload).withColumn("chunk", chunk_of)
    placed = instants.repartition("key", "chunk")
    ordered = placed.sortWithinPartitions("key", "chunk", "t", "row_id")
    summaries = ordered.select("key", "chunk", "t", "code").mapInPandas(_summarise(wait, width), SUMMARY)
    level = summaries.withColumn("chunk", F.col("chunk") - first)       # blocks are counted from the first chunk
    levels, size = [], 1
    while span > fan:
        levels.append(level := store(level))
        parts = level.withColumns({"block": F.expr(f"chunk div {fan}"), "begins": (F.col("chunk") * size + first) * width})
        parts = parts.repartition("key", "block").sortWithinPartitions("key", "block", "chunk", "until")
        level = parts.mapInPandas(_compose(wait, width), SUMMARY)
        size, span = size * fan, -(-span // fan)
    start = {"block": F.lit(0).cast("long"), "opens": F.lit(NEVER), "before": F.lit(NEVER)}
    state = _followed(level.withColumns(start), wait)
    for level in reversed(levels):
        above = state.withColumnRenamed("chunk", "block")
        state = _followed(level.withColumn("block", F.expr(f"chunk div {fan}")).join(above, ["key", "block"]), wait)
    state = state.withColumn("chunk", F.col("chunk") + first)
    return (
        placed.join(state, ["key", "chunk"])
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "t", "row_id")
        .mapInPandas(_mark(wait), "row_id long")
    )


def _followed(parts: DataFrame, wait: int) -> DataFrame:
    ordered = parts.repartition("key", "block").sortWithinPartitions("key", "block", "chunk", "until")
    return ordered.mapInPandas(_follow(wait), STATE)


def _flagged(df: DataFrame, row_id: str, accepted: DataFrame, name: str, when_accepted: bool) -> DataFrame:
    marks = accepted.select(F.col("row_id").alias(row_id), F.lit(when_accepted).alias(name))
    joined = df.join(marks, row_id, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(not when_accepted)))


def cooldown(df: DataFrame, key: str, time: str, row_id: str, seconds: int = 30, payload: str | None = None) -> DataFrame:
    """Add ``accepted``: false for a check less than ``seconds`` after the last accepted one of its key, and, if
    ``payload`` names a column with payload hashes, for one with the hash of the last accepted one, however old
    that is.  A row without hash repeats none."""
    return _flagged(df, row_id, accepted_rows(df, key, time, row_id, seconds, False, payload), "accepted", True)


def ttl_cache(df: DataFrame, key: str, time: str, row_id: str, seconds: int = 3600) -> DataFrame:
    """Add ``is_hit``: true while a stored result is at most ``seconds`` old; a hit
    does not extend its life."""
    return _flagged(df, row_id, accepted_rows(df, key, time, row_id, seconds, True), "is_hit", False)


def fresh_entries(entries: DataFrame, now: str, ttl_seconds: int, time: str = "created_at") -> DataFrame:
    """Stored results still valid at ``now``."""
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(time).cast("timestamp"))
    return entries.filter(age <= ttl_seconds * 1000)
