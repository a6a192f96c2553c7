"""Benchmark decontamination by SimHash windows of item size, by DataFrame functions only.

A window of a document is as long as an item.  Every window that shares enough shingles of five words with an
item of its size to be as similar as asked gets a SimHash of its shingles, each counted as often as it occurs;
all others are ruled out by that count, without loss.  Multi-index Hamming blocks give all pairs of a window and
an item of its size whose fingerprints lie within the radius; these windows are compared first, by the exact
similarity of weighted shingles (weight: times it occurs).  At similarity 0.8 fingerprints differ in about 10 bits with
a deviation of 3, but the bits of few or evenly balanced shingles may all turn over.  So of the other windows those
are compared as well that may be better than the best one found so, and all of documents without such a one;
documents with none within the radius have a null distance in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgrisk.llm.shared import broadcast_if_few, keep, set_apart, unless_many

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 18
BLOCK_BITS = 16             # four blocks; within the radius one of them differs in at most RADIUS // 4 bits
BROADCAST_SHINGLES = 500_000        # rows of five numbers, 20 MB; more shingles are met by a shuffled join
BROADCAST_TEXTS = 2_000_000         # texts that share enough with an item, 16 bytes each; more are met by a shuffled join
_BLOCKS = 64 // BLOCK_BITS


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    places = F.sequence(F.lit(1), F.size(words) - size + 1)
    each = F.transform(places, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(size))))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<bigint>"))


def _item_shingles(words: Column) -> Column:
    """Shingles of an item; one of fewer words than a shingle is a shingle itself."""
    short = F.size(words) < SHINGLE_WORDS
    whole = F.aggregate(words, F.lit(42).cast("long"), lambda h, w: F.xxhash64(h, w))
    cases = F.when(short & (F.size(words) > 0), F.array(whole))
    return cases.otherwise(_shingles(words, SHINGLE_WORDS))


def _simhash(rows: DataFrame, keys: list[str], grams: str) -> DataFrame:
    """Keys and fp for rows of distinct keys and shingle hashes: a bit is set if over half the hashes have it.

    Each of 32 sums counts two bits, 32 positions apart."""
    lanes = F.lit((1 << 32) + 1)
    each = rows.select(*keys, F.explode(grams).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lanes)).alias(f"s{i}") for i in range(32)]
    counted = each.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    fp = F.lit(0).cast("long")
    low = F.lit((1 << 32) - 1)
    for i in range(32):
        few, many = F.col(f"s{i}").bitwiseAND(low), F.shiftrightunsigned(f"s{i}", 32)
        fp = fp.bitwiseOR(F.shiftleft((few * 2 > F.col("n")).cast("long"), i))
        fp = fp.bitwiseOR(F.shiftleft((many * 2 > F.col("n")).cast("long"), i + 32))
    return counted.select(*keys, fp.alias("fp"))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _close_pairs(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Columns win, item, distance: all pairs of a window and an item of its size whose fingerprints differ in at
    most RADIUS bits.

    Items go to every block value within RADIUS // 4 bits of theirs, windows to their own values."""
    flips = F.expr(f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), x -> bit_count(x) <= {RADIUS // _BLOCKS})")
    own = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(_BLOCKS)))
    probes = items.select("item", "size", F.col("fp").alias("item_fp"), F.explode(own).alias("b"), flips.alias("flips"))
    probes = probes.select("item", "size", "item_fp", "b.block", "b.value", F.explode("flips").alias("flip"))
    probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    spread = windows.withColumn("b", F.explode(own)).select("win", "size", "fp", "b.block", "b.value")
    met = spread.join(probes.hint("merge"), ["size", "block", "value"])     # probes are many for a few items: no broadcast
    met = met.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= RADIUS)
    return met.groupBy("win", "item").agg(F.min("distance").alias("distance"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Columns item (a number for each word sequence), name, words, grams, size of the distinct items that have words."""
    words = benchmark.select(words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    rows = words.select(F.monotonically_increasing_id().alias("item"), _name(F.col("words")).alias("name"), "words", F.size("words").alias("size"))
    return rows.withColumn("grams", _item_shingles(F.col("words")))


def _name(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Columns doc_id, item_id, start, words, similarity, distance: for each document and benchmark item (item_id,
    text) the best of all windows with at least this similarity, the first of equal ones; ``start`` counts words
    from 0; ``distance`` is that of the nearest fingerprint, null if none lies within the radius.

    Repeated documents and items give repeated pairs once each; documents without id are searched and come
    out with a null id.  Null or wordless texts and items match nothing; items of fewer than five words match
    where all their words stand together.  A document shorter than an item is a window as a whole.  Very long
    texts are searched whole.  Empty tables give an empty one; other columns are ignored.
    """
    items = keep(benchmark_items(benchmark))
    best = _best_windows(docs, items, similarity)
    best = best.groupBy("doc_id", "item").agg(F.max("b").alias("b"))
    names = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    names = names.select("item_id", _name(F.col("w")).alias("name")).distinct().join(items.select("name", "item"), "name")
    return best.join(names, "item").select(
        "doc_id", "item_id", (-F.col("b.back")).cast("int").alias("start"), F.col("b.words").cast("int").alias("words"),
        F.round("b.similarity", 6).alias("similarity"), (-F.col("b.closeness")).cast("int").alias("distance"),
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _short_runs(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, as items of so few words have them."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.aggregate(F.slice(words, i, k), F.lit(42).cast("long"), lambda h, w: F.xxhash64(h, w)))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _shared(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Columns doc, item, size, n_grams, n_win, n_words, need, hits: the places of each document that hold a shingle
    of an item, in order, where they are enough for a window of this similarity.

    A place counts once, however often the item has its shingle, so there are no more than the text has."""
    grams = items.select("item", "size", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    grams = keep(grams.groupBy("item", "size", "n_grams", "gram").agg(F.count("*").alias("times")))
    n_grams = grams.count()
    side = grams.hint("merge") if n_grams > BROADCAST_SHINGLES else F.broadcast(grams)
    short = [r["size"] for r in items.where(F.col("size") < SHINGLE_WORDS).select("size").distinct().collect()]     # 1 to 4
    keyed = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    hits = None
    for kind in [_shingles(F.col("words"), SHINGLE_WORDS), *(_short_runs(F.col("words"), k) for k in short)]:
        places = keyed.select(F.struct("doc_id", "text_key").alias("doc"), F.size("words").alias("n_words"), F.posexplode(kind).alias("at", "gram"))
        found = places.join(side, "gram")
        hits = found if hits is None else hits.union(found)
    n_win = F.greatest(F.least("size", "n_words") - SHINGLE_WORDS + 1, F.lit(1))    # an item shorter than a shingle is one
    hits = hits.withColumn("n_win", n_win)
    # both / (n_win + n_grams - both) reaches s only if s / (1 + s) of all shingles are shared ones
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_win") + F.col("n_grams")) - 1e-9).cast("int")
    hits = keep(hits.withColumn("need", need).select("doc", "item", "size", "n_grams", "n_win", "n_words", "need", "at", "gram", "times"))
    enough = hits.groupBy("doc", "item").agg(F.count("*").alias("n"), F.min("need").alias("least")).where("n >= least").select("doc", "item")
    hits = hits.join(unless_many(enough, hits.count()), ["doc", "item"], "left_semi")
    own = F.array_sort(F.collect_set(F.struct("at", "gram", "times"))).alias("hits")       # a set: rows may be repeated
    return keep(hits.groupBy("doc", "item", "size", "n_grams", "n_win", "n_words", "need").agg(own))


def _starts(shared: DataFrame) -> DataFrame:
    """``shared`` with ``start``: every window with ``need`` or more places.

    Windows that begin behind one place and not behind the next have ``need`` places if the last one of these lies inside."""
    last = F.greatest(F.col("n_words") - F.col("size"), F.lit(0))
    place = F.sequence(F.lit(0), F.size("hits") - F.col("need"))

    def run(j: Column) -> Column:
        before = F.when(j > 0, F.get("hits", j - 1)["at"] + 1).otherwise(0)
        low = F.greatest(before, F.get("hits", j + F.col("need") - 1)["at"] - F.col("n_win") + 1)
        return F.struct(low.alias("low"), F.least(F.get("hits", j)["at"], last).alias("high"))

    runs = F.filter(F.transform(place, run), lambda r: r["low"] <= r["high"])
    rows = shared.select("*", F.explode(runs).alias("r"))
    return rows.select("*", F.explode(F.sequence("r.low", "r.high")).alias("start")).drop("r")


def _near(docs: DataFrame, windows: DataFrame, items: DataFrame) -> DataFrame:
    """Columns doc, item, start, distance: the windows near to an item, by fingerprints."""
    wanted = windows.select("doc", "size", "n_win", "start").distinct()
    keys = keep(windows.groupBy(F.col("doc.text_key").alias("text_key")).agg(F.count("*").alias("n")))
    n_keys, n_windows = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    keys = keys.select("text_key")
    few = F.broadcast(keys) if n_keys <= BROADCAST_TEXTS else keys.hint("merge")        # else whole texts are shuffled
    texts = docs.withColumn("text_key", _text_key(F.col("text"))).join(few, "text_key", "left_semi")
    texts = texts.select(F.struct("doc_id", "text_key").alias("doc"), "text").dropDuplicates(["doc"])
    texts = texts.select("doc", words_of(F.col("text")).alias("words"))     # a column: the shingles refer to it often
    prints = None
    for size in (SHINGLE_WORDS, *range(1, SHINGLE_WORDS)):
        few = wanted.where(F.col("size") >= size) if size == SHINGLE_WORDS else wanted.where(F.col("size") == size)
        whole = texts.select("doc", (_shingles(F.col("words"), size) if size == SHINGLE_WORDS else _short_runs(F.col("words"), size)).alias("grams"))
        cut = whole.join(broadcast_if_few(few, n_windows), "doc").select(F.struct("doc", "start").alias("win"), "size", F.slice("grams", F.col("start") + 1, F.col("n_win")).alias("grams"))
        part = _simhash(cut, ["win", "size"], "grams")
        prints = part if prints is None else prints.union(part)
        if size == SHINGLE_WORDS and items.where(F.col("size") < SHINGLE_WORDS).isEmpty():
            break
    pairs = _close_pairs(prints, _simhash(items, ["item", "size"], "grams"))
    return pairs.select("win.doc", "item", "win.start", "distance")


def _similar(held: DataFrame, similarity: float) -> DataFrame:
    """Columns doc, item, b (similarity, back, words): the windows (with ``hits``, the places inside them) at least so similar."""
    # Where no shingle occurs twice, all places inside count; else each shingle as often as both have it.
    single = F.size(F.array_distinct(F.transform("hits", lambda h: h["gram"]))) == F.size("hits")
    window = ["doc", "item", "size", "n_grams", "n_win", "start"]
    plain = held.where(single).select(*window, F.size("hits").cast("long").alias("both"))
    each = held.where(~single).select(*window, F.explode("hits").alias("h"))
    each = each.groupBy(*window, "h.gram", "h.times").agg(F.count("*").alias("n"))
    counted = each.groupBy(*window).agg(F.sum(F.least("n", "times")).alias("both"))
    scored = plain.union(counted).withColumn("similarity", _ratio(F.col("both"))).where(F.col("similarity") >= similarity)
    return scored.select("doc", "item", F.struct("similarity", (-F.col("start")).alias("back"), F.col("size").alias("words")).alias("b"))


def _ratio(both: Column) -> Column:
    return both / (F.col("n_win") + F.col("n_grams") - both)


def _unsettled(held: DataFrame, settled: DataFrame) -> DataFrame:
    """The windows that may be better than the one that ``settled`` has for their document and item, if it has one:
    no window is more similar than if all its places counted."""
    known = unless_many(settled.select("doc", "item", F.col("b").alias("least")), settled.count())
    open_ = held.join(known, ["doc", "item"], "left")
    reach = F.struct(_ratio(F.size("hits").cast("long")).alias("similarity"), (-F.col("start")).alias("back"), F.col("size").alias("words"))
    return open_.where(F.col("least").isNull() | (reach > F.col("least"))).drop("least")


def _best_windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """Columns doc_id, text_key, item, b (similarity, back, words, closeness): the best window of each text of an id.

    The windows near by fingerprint are compared first.  Then only those that may be better than the best of them are;
    of documents without such a one that is as similar as asked, all."""
    shared = _shared(docs, items, similarity)
    windows = _starts(shared)
    near = keep(_near(docs, windows.select("doc", "item", "size", "n_win", "start"), items))
    held = windows.withColumn("hits", F.filter("hits", lambda h: (h["at"] >= F.col("start")) & (h["at"] < F.col("start") + F.col("n_win"))))
    held = held.select("doc", "item", "size", "n_grams", "n_win", "start", "hits")
    n_near = near.count()
    by_print = _similar(held.join(unless_many(near.drop("distance"), n_near), ["doc", "item", "start"], "left_semi"), similarity)
    settled = keep(by_print.groupBy("doc", "item").agg(F.max("b").alias("b")))
    least = near.groupBy("doc", "item").agg(F.min("distance").alias("distance"))
    rest = _similar(_unsettled(held, settled), similarity)
    found = settled.union(rest).join(unless_many(least, n_near), ["doc", "item"], "left")
    best = F.struct("b.*", (-F.col("distance")).alias("closeness"))
    return found.groupBy(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text_key").alias("text_key"), "item").agg(F.max(best).alias("b"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the ids that hold a benchmark item; rows without id stay only if no such row holds one.

    ``clean_rows`` judges each row by its own text and is what the pipeline uses."""
    inner, restored = set_apart(docs, "doc_id", "text")
    found = contaminated(inner, benchmark).select(F.col("doc_id").alias("found")).distinct()
    return restored(inner.join(found, F.col("doc_id").eqNullSafe(F.col("found")), "left_anti"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item; other rows of the same id, or without id, stay.

    Columns of any name stay as they are; null and empty texts and repeated rows stay; ``contaminated`` says what is found."""
    inner, restored = set_apart(docs, "doc_id", "text")
    found = _best_windows(inner, keep(benchmark_items(benchmark)), SIMILARITY)
    found = found.select(F.col("doc_id").alias("found"), F.col("text_key").alias("found_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("found")) & (_text_key(F.col("text")) == F.col("found_key"))
    return restored(inner.join(found, same, "left_anti"))
