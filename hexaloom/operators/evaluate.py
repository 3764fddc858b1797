"""Evaluation of predicted labels: counts and rates per label, threshold search, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import above, divide

# all take (label, truth 0/1, p): one row per sample and label


def confusion(scored: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """One row a label: TN, FN, TP, FP."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    guess = above(F.col("p"), t)
    hit = lambda y, g: F.count_if((F.col("truth") == y) & (guess == g))
    return scored.groupBy("label").agg(hit(0, 0).alias("TN"), hit(1, 0).alias("FN"), hit(1, 1).alias("TP"), hit(0, 1).alias("FP"))


def rates(counts: DataFrame) -> DataFrame:
    """Counts with total_positives, sensitivity, specificity, recall, fpr, fnr, accuracy and precision in percent, 2 places; 0 where undefined."""
    tn, fn, tp, fp = (F.col(c) for c in ("TN", "FN", "TP", "FP"))
    pct = lambda a, b: F.round(100 * divide(a, b), 2)
    return counts.select(
        "*", (tp + fn).alias("total_positives"), pct(tp, tp + fn).alias("sensitivity"), pct(tn, tn + fp).alias("specificity"), pct(tp, tp + fn).alias("recall"),
        pct(fp, fp + tn).alias("fpr"), pct(fn, fn + tp).alias("fnr"), pct(tp + tn, tp + tn + fp + fn).alias("accuracy"), pct(tp, tp + fp).alias("precision"),
    )


def threshold_sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """(label, threshold, fnr, fpr, accuracy) at 0 to 1 in equal steps. Samples are first counted by the step they reach, so each is read once."""
    # the number of thresholds i / steps that p is strictly above
    reached = F.greatest(F.lit(0), F.least(F.lit(steps + 1), F.ceil(F.round(F.col("p") * steps, 9)))).cast("int")
    by = scored.groupBy("label", "truth", reached.alias("reached")).agg(F.count("*").alias("n"))
    totals = by.groupBy("label").agg(F.sum(F.when(F.col("truth") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("truth") == 0, F.col("n")).otherwise(0)).alias("neg"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    j = grid.join(by.withColumnRenamed("label", "l"), (F.col("label") == F.col("l")) & (F.col("reached") > F.col("i")), "left")
    above_it = j.groupBy("label", "i", "pos", "neg").agg(F.sum(F.when(F.col("truth") == 1, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("truth") == 0, F.col("n")).otherwise(0)).alias("fp"))
    return above_it.select("label", (F.col("i") / steps).alias("threshold"), divide(F.col("pos") - F.col("tp"), F.col("pos")).alias("fnr"), divide(F.col("fp"), F.col("neg")).alias("fpr"), divide(F.col("tp") + F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(label, threshold): where |fnr - fpr| is least, both in percent of two places, the lowest such; 0 becomes 0.01."""
    percent = lambda c: F.round(100 * F.col(c), 2)
    best = sweep.groupBy("label").agg(F.min(F.struct(F.round(F.abs(percent("fnr") - percent("fpr")), 2).alias("gap"), "threshold")).alias("b"))
    return best.select("label", F.when(F.col("b.threshold") == 0, 0.01).otherwise(F.col("b.threshold")).alias("threshold"))


def roc(scored: DataFrame) -> DataFrame:
    """(label, score, tpr, fpr): one point a distinct score, from the highest down. Sums run over distinct scores, not samples."""
    by = scored.groupBy("label", F.col("p").alias("score")).agg(F.sum(F.col("truth")).alias("p1"), F.sum(1 - F.col("truth")).alias("p0"))
    down = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("label")
    return by.select("label", "score", divide(F.sum("p1").over(down), F.sum("p1").over(whole)).alias("tpr"), divide(F.sum("p0").over(down), F.sum("p0").over(whole)).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    down = Window.partitionBy("label").orderBy(F.desc("score"))
    x, y = F.coalesce(F.lag("fpr").over(down), F.lit(0.0)), F.coalesce(F.lag("tpr").over(down), F.lit(0.0))
    return curve.withColumn("area", (F.col("fpr") - x) * (F.col("tpr") + y) / 2).groupBy("label").agg(F.sum("area").alias("auc"))


def unpivot(predicted: DataFrame, truth: DataFrame, sample_id: str, labels: list[str], prefix: str = "B_") -> DataFrame:
    """(label, truth, p) from a table of predictions and one of truths, joined by sample."""
    long = lambda df, cols, name: df.select(sample_id, F.explode(F.array(*[F.struct(F.lit(f).alias("label"), F.col(f"`{c}`").cast("double").alias(name)) for f, c in zip(labels, cols, strict=True)])).alias("v")).select(sample_id, "v.*")
    both = long(predicted, [prefix + f for f in labels], "p").join(long(truth, labels, "truth"), [sample_id, "label"])
    return both.select("label", F.col("truth").cast("int").alias("truth"), "p")
