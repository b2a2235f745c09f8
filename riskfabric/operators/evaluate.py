"""Classification metrics as grouped aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = counts.withColumn("accuracy", (tp + tn) / F.greatest(F.lit(1), tp + fp + tn + fn)).withColumn("precision", _safe(tp, tp + fp)).withColumn("recall", _safe(tp, tp + fn))
    return df.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_counts(df: DataFrame, expected="expected", predicted="predicted", by=()) -> DataFrame:
    e, p = F.col(expected) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn"))


def binary_metrics(df: DataFrame, expected="expected", predicted="predicted", by=()) -> DataFrame:
    return with_scores(binary_counts(df, expected, predicted, by))


def multilabel_summary(df: DataFrame, labels) -> DataFrame:
    """Micro metrics over all decisions, macro F1 and exact-match share; one row."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"{n}_label").alias("expected"), F.col(f"{n}_prediction").alias("predicted")) for n in labels])).alias("d")).select("d.*")
    per_label = binary_counts(stacked, by=("label",))
    micro = with_scores(per_label.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))
    macro = with_scores(per_label).agg(F.avg("f1").alias("macro_f1"))
    same = F.lit(True)
    for n in labels:
        same = same & (F.col(f"{n}_label") == F.col(f"{n}_prediction"))
    exact = df.agg((F.count_if(same) / F.count("*")).alias("exact_match"))
    return micro.crossJoin(macro).crossJoin(exact)  # three one-row aggregates


def threshold_sweep(df: DataFrame, thresholds, score="score", expected="expected", gate=None) -> DataFrame:
    """Metrics at every threshold.

    A row passes a prefix of the ascending thresholds, so rows are first counted by the number of thresholds they
    pass; only that small table meets the thresholds.
    """
    steps = F.lit(sorted(float(t) for t in thresholds))
    passed = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    if gate is not None:
        passed = F.when(gate, passed).otherwise(0)
    counted = df.groupBy(passed.alias("passed"), (F.col(expected) == 1).alias("e")).agg(F.count("*").alias("n"))
    levels = df.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(sorted(thresholds))], "at int, threshold double")
    hit = F.col("passed") > F.col("at")
    pick = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return with_scores(counted.crossJoin(F.broadcast(levels)).groupBy("threshold").agg(
        pick(hit & F.col("e")).alias("tp"), pick(hit & ~F.col("e")).alias("fp"), pick(~hit & ~F.col("e")).alias("tn"), pick(~hit & F.col("e")).alias("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the best (F1, accuracy, precision, threshold)."""
    row = F.max_by(F.struct(*sweep.columns), F.struct("f1", "accuracy", "precision", "threshold"))
    return sweep.agg(row.alias("b")).select("b.*")


def multiclass_report(df: DataFrame, expected="expected", predicted="predicted", labels=None) -> DataFrame:
    """Precision, recall, F1 and support per class plus overall accuracy and macro F1.

    ``df`` is reduced to the confusion matrix first.
    """
    matrix = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    classes = (df.sparkSession.createDataFrame([(x,) for x in labels], "label string") if labels
               else matrix.select(F.explode(F.array("e", "p")).alias("label")).distinct())
    tally = matrix.crossJoin(F.broadcast(classes)).groupBy("label").agg(
        F.sum(F.when((F.col("e") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("e") == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum("n").alias("total"))
    scored = tally.withColumn("precision", _safe(F.col("tp"), F.col("called"))).withColumn("recall", _safe(F.col("tp"), F.col("support")))
    scored = scored.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    overall = scored.agg((F.sum("tp") / F.max("total")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return scored.crossJoin(overall).select("label", "precision", "recall", "f1", "support", "accuracy", "macro_f1")
