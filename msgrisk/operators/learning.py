"""Training-set statistics, exact splits and model evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from msgrisk import fixed_values as fv

SCORE_BUCKETS = 1000


# -------------------------------------------------------------------- vocabulary
def words(text: Column) -> Column:
    """Lower-case words of two or more letters or digits.

    Texts without other characters take the plain classes, several times faster than those of Unicode."""
    wide = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(plain)


def words_and_pairs(tokens: Column) -> Column:
    """The words, then every pair of neighbours."""
    n = F.size(tokens)
    pairs = F.when(
        n >= 2,
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1)),
        ),
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(tokens, pairs)


def term_counts(docs: DataFrame, terms: str) -> DataFrame:
    """Corpus count and document count of every term, with a single shuffle.

    Sorting the terms inside their document marks the first of each run, so the
    document count is a plain sum that combines before the shuffle, like the total.
    """
    rows = docs.select(F.sort_array(F.col(terms)).alias("_sorted"))
    marked = F.transform(
        F.col("_sorted"),
        lambda t, i: F.struct(
            t.alias("term"),
            F.when(F.get(F.col("_sorted"), i - 1) == t, 0).otherwise(1).alias("first"),
        ),
    )
    return (
        rows.select(F.explode(marked).alias("m"))
        .groupBy("m.term")
        .agg(F.count("*").alias("n_total"), F.sum("m.first").alias("n_docs"))
    )


def vocabulary(docs: DataFrame, terms: str, size: int = fv.VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms (ties by term); a bounded top-k."""
    return term_counts(docs, terms).orderBy(F.desc("n_total"), "term").limit(size)


def smooth_idf(n_docs: Column, total_docs) -> Column:
    return F.log((F.lit(1.0) + total_docs) / (F.lit(1.0) + n_docs)) + F.lit(1.0)


# ------------------------------------------------------------------ class balance
def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows, share and balanced weight n / (k * n_c) of each class."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    everything = Window.partitionBy(F.lit(0))       # one row per class
    total, classes = F.sum("n_rows").over(everything), F.count("*").over(everything)
    return counts.select(
        "label", "n_rows", F.round(total / (classes * F.col("n_rows")), 6).alias("weight")
    )


# ----------------------------------------------------------------- stratified split
def split_order(row_id: str, seed: int = 42) -> Column:
    """Repeatable pseudo-random order of a row."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    rows: DataFrame, label: str, row_id: str, share: float = 0.25, seed: int = 42, stratify: bool = True
) -> DataFrame:
    """Add ``is_test``: exactly floor(share * n_c + 0.5) rows of each class.

    Ranking a whole class would put it into one task.  The order key is a hash,
    so its leading digits cut each class into even buckets; bucket counts tell
    where the cut falls, and only the rows of that one bucket are ranked.
    """
    group = F.col(label) if stratify else F.lit(0)
    keyed = rows.withColumns({"_group": group, "_order": split_order(row_id, seed)})
    keyed = keyed.withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    per_bucket = keyed.groupBy("_group", "_bucket").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("_group")         # at most 4096 rows per class
    running = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        per_bucket.withColumns(
            {
                "_wanted": F.floor(F.sum("n").over(by_group) * share + 0.5),
                "_before": F.sum("n").over(running) - F.col("n"),
            }
        )
        .select("_group", "_bucket", (F.col("_wanted") - F.col("_before")).alias("_quota"), "n")
    )
    placed = keyed.join(F.broadcast(cuts), ["_group", "_bucket"])
    whole = F.col("_quota") >= F.col("n")
    partial = (F.col("_quota") > 0) & ~whole
    edge = Window.partitionBy("_group", "_bucket").orderBy("_order", row_id)
    ranked = placed.filter(partial).withColumn("is_test", F.row_number().over(edge) <= F.col("_quota"))
    settled = placed.filter(~partial).withColumn("is_test", whole)
    extra = ["_group", "_order", "_bucket", "_quota", "n"]
    return ranked.unionByName(settled).drop(*extra)


# --------------------------------------------------------------------- evaluation
def confusion(predictions: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    return predictions.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def evaluation_report(predictions: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, their averages, and accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    accuracy = _ratio(tp + tn, total)

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("long").alias("support"),
        )

    def measures(hit, wrong, missed):
        precision, recall = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return precision, recall, _ratio(2 * precision * recall, precision + recall), hit + missed

    zero, one = measures(tn, fn, fp), measures(tp, fp, fn)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    rows = F.array(
        row("0", *zero),
        row("1", *one),
        row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    )
    report = confusion(predictions, label, predicted).select(F.explode(rows).alias("r")).select("r.*")
    return report.select("name", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def roc_auc(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores averaged; null with one class only.

    For each distinct score: positives at this score beat all negatives below it
    and half of those equal to it.  Rows are first counted per score; the running
    count of negatives is then taken within score ranges, and the (few) range
    totals are added, so no task orders the whole table.  Scores lie in 0..1.
    """
    positive = F.col(label).cast("int") == 1
    per_score = predictions.groupBy(F.col(score).alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    per_score = per_score.withColumn("bucket", F.floor(F.col("s") * SCORE_BUCKETS).cast("int"))
    totals = per_score.groupBy("bucket").agg(F.sum("neg").alias("neg_in_bucket"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = totals.select("bucket", F.coalesce(F.sum("neg_in_bucket").over(ranges), F.lit(0)).alias("neg_below"))
    inside = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_score.withColumn("neg_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(
        F.broadcast(below), "bucket"            # at most SCORE_BUCKETS + 1 rows
    )
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg_inside") + F.col("neg") / 2)
    sums = placed.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("wins")
    )
    pairs = F.col("n_pos") * F.col("n_neg")
    return sums.select("n_pos", "n_neg", F.when(pairs > 0, F.round(F.col("wins") / pairs, 6)).alias("auc"))


def operating_point(predictions: DataFrame, max_fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: threshold, recall, fpr, precision, tp, fp, fn, tn of the threshold with the highest recall among those
    with a false-positive rate of at most ``max_fpr``; of equal recall the one with fewest false positives.

    Rows at or above a threshold count as positive.  Exact: every distinct score is a candidate.  Rows are first
    counted per score; running counts are taken within score ranges and added to the (few) range totals, so no
    task orders the whole table.  Scores lie in 0..1.  Where even the highest score breaks the bound, or there is
    no score, the threshold is null and nothing counts as positive.
    """
    positive = F.col(label).cast("int") == 1
    per_score = predictions.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    per_score = per_score.withColumn("bucket", F.floor(F.col("s") * SCORE_BUCKETS).cast("int"))
    totals = per_score.groupBy("bucket").agg(F.sum("pos").alias("pos_in"), F.sum("neg").alias("neg_in"))
    everything = Window.partitionBy(F.lit(0))           # at most SCORE_BUCKETS + 1 rows
    above = everything.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.select(
        "bucket", F.coalesce(F.sum("pos_in").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("neg_in").over(above), F.lit(0)).alias("neg_above"),
        F.sum("pos_in").over(everything).alias("n_pos"), F.sum("neg_in").over(everything).alias("n_neg"),
    )
    upto = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    points = per_score.join(F.broadcast(ranges), "bucket").select(
        "s", "n_pos", "n_neg", (F.col("pos_above") + F.sum("pos").over(upto)).alias("tp"), (F.col("neg_above") + F.sum("neg").over(upto)).alias("fp"),
    )
    allowed = F.col("fp") <= F.lit(max_fpr) * F.col("n_neg")
    best = points.agg(
        F.max(F.when(allowed, F.struct("tp", (-F.col("fp")).alias("less"), "s"))).alias("b"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
    )
    n_pos, n_neg = (F.coalesce(c, F.lit(0)) for c in ("n_pos", "n_neg"))
    tp, fp = F.coalesce(F.col("b.tp"), F.lit(0)), -F.coalesce(F.col("b.less"), F.lit(0))
    return best.select(
        F.col("b.s").alias("threshold"), F.round(_ratio(tp, n_pos), 6).alias("recall"), F.round(_ratio(fp, n_neg), 6).alias("fpr"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"), tp.alias("tp"), fp.alias("fp"), (n_pos - tp).alias("fn"), (n_neg - fp).alias("tn"),
    )


def scale_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Population standard deviation of each column, one row."""
    return rows.agg(*[F.round(F.stddev_pop(c), 6).alias(c) for c in columns])
