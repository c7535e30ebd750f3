"""Confusion counts, classification reports, decision logs, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold, pred, n)."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def evaluation_rows(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows with a hyphen in gold and prediction, of the labels that end a line: gold 1 to 4, prediction 1 to 9."""
    return rows.where(F.col(gold).isin("1", "2", "3", "4") & F.col(pred).rlike("^[1-9]$"))


def report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of confusion counts, with accuracy, macro and weighted rows.

    A ratio without a denominator is 0.
    """
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sides = counts.select(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).alias("p"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(counts.select(F.col("pred").alias("label"), F.lit(0).alias("g"), F.col("n").alias("p"), F.lit(0).alias("hit")))
    per = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("p"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    labels = per.select("label", "precision", "recall", "f1", "support")
    accuracy = ratio(F.sum("hit"), F.sum("support"))
    total = per.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), "*")
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "*")
    by = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    weighted = per.agg(by("precision"), by("recall"), by("f1"), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "*")
    return labels.unionByName(total).unionByName(macro).unionByName(weighted)


def choice_confusion(rows: DataFrame, answer: str = "answer", correct: str = "correct") -> DataFrame:
    """(cell, n) of choice strings compared letter by letter: each pair of a, b and c; other letters count as c, a pair of
    unequal c's as cd. Rows of unequal length are left out."""
    even = rows.where(F.length(answer) == F.length(correct))
    zipped = F.arrays_zip(F.split(answer, "").alias("x"), F.split(correct, "").alias("y"))
    pairs = even.select(F.explode(zipped).alias("z")).select(F.col("z.x").alias("x"), F.col("z.y").alias("y")).where("x <> '' AND x <> '_'")
    fold = lambda c: F.when(F.col(c).isin("a", "b"), F.col(c)).otherwise("c")
    cell = F.when((fold("x") == "c") & (fold("y") == "c") & (F.col("x") != F.col("y")), "cd").otherwise(F.concat(fold("x"), fold("y")))
    return pairs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def extract_best(log: DataFrame, marker: str = "Best:") -> DataFrame:
    """(line_no, line): the lines after each marker up to the next blank one, with a tab before.

    Gaps and islands: a line belongs if the last marker or blank line above it is a marker.
    """
    kind = F.when(F.col("line").startswith(marker), 1).when(F.trim("line") == "", 0)
    above = F.last(kind, ignorenulls=True).over(W.partitionBy("log_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    return log.withColumn("_in", above).where((F.col("_in") == 1) & (F.trim("line") != "") & ~F.col("line").startswith(marker)).select("log_id", "line_no", F.concat(F.lit("\t"), "line").alias("line"))


def train_summary(iterations: DataFrame) -> DataFrame:
    """(run, iterations, total_secs, chars_per_sec, words_per_sec) of (run, train_secs, proc_chars, proc_words), rates rounded down."""
    total = F.sum("train_secs")
    rate = lambda c: F.floor(F.sum(c) / F.nullif(total, F.lit(0))).cast("long")
    return iterations.groupBy("run").agg(F.count(F.lit(1)).alias("iterations"), total.cast("long").alias("total_secs"), rate("proc_chars").alias("chars_per_sec"), rate("proc_words").alias("words_per_sec"))
