"""Several annotators of the same items: what the items are, how far each annotator is to be trusted, and how far they agree.

Annotations are (item, annotator, label); labels are few. Null items, annotators or labels do not count. Of an annotator's several labels of an item
each counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialised


def _usable(df: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    return df.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.col(label).cast("string").alias("label")).na.drop()


def majority(df: DataFrame, item: str = "item", annotator: str = "annotator", label: str = "label") -> DataFrame:
    """(item, label, share): each label's share of the item's annotations."""
    counts = _usable(df, item, annotator, label).groupBy("item", "label").agg(F.count("*").alias("n"))
    return counts.select("item", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("item"))).alias("share"))  # a row for each label


def dawid_skene(df: DataFrame, item: str = "item", annotator: str = "annotator", label: str = "label", rounds: int = 20, smooth: float = 0.01, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """((item, label, p), (annotator, truth, label, p)): probabilities of each item's true label, and of each annotator's label given the true one.

    Expectation maximisation from the items' shares of labels. `smooth` is added to every count of a confusion matrix, so
    that no label is impossible. It ends when no probability changes by more than the tolerance, or after `rounds`.
    A single annotator is believed as far as the start goes; an item keeps all labels as possible.
    """
    given = materialised(_usable(df, item, annotator, label), "given")
    labels = sorted(r.label for r in given.select("label").distinct().collect())  # few, by contract
    k = len(labels)
    each = F.explode(F.array(*map(F.lit, labels)))
    counts = given.groupBy("item", "label").agg(F.count("*").alias("n"))
    total = Window.partitionBy("item")  # a row for each label
    shares = counts.select("item", F.col("label").alias("truth"), (F.col("n") / F.sum("n").over(total)).alias("p"))
    items = given.select("item").distinct().select("item", each.alias("truth")) if k else shares.select("item", "truth")
    now = materialised(items.join(shares, ["item", "truth"], "left").select("item", "truth", F.coalesce("p", F.lit(0.0)).alias("p")), "posterior")
    annotators = given.select("annotator").distinct().select("annotator", each.alias("truth")).select("annotator", "truth", each.alias("label")) if k else None
    if annotators is None:
        none = given.select("annotator", F.col("label").alias("truth"), "label", F.lit(0.0).alias("p"))
        return now.withColumnRenamed("truth", "label"), none
    annotators = materialised(annotators, "annotators")
    for _ in range(rounds):
        seen = given.join(now, "item").groupBy("annotator", "truth", "label").agg(F.sum("p").alias("n"))
        full = annotators.join(seen, ["annotator", "truth", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + smooth)
        matrix = materialised(full.select("annotator", "truth", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("annotator", "truth"))).alias("p")), "matrix")
        prior = now.groupBy("truth").agg(F.sum("p").alias("prior"))  # a row for each label
        weight = given.join(matrix.withColumnRenamed("p", "q"), ["annotator", "label"]).groupBy("item", "truth").agg(F.sum(F.log("q")).alias("w"))
        logs = weight.join(prior, "truth").where("prior > 0").select("item", "truth", (F.col("w") + F.log("prior")).alias("w"))
        scaled = logs.withColumn("e", F.exp(F.col("w") - F.max("w").over(total)))
        likely = scaled.select("item", "truth", (F.col("e") / F.sum("e").over(total)).alias("p"))
        new = materialised(items.join(likely, ["item", "truth"], "left").select("item", "truth", F.coalesce("p", F.lit(0.0)).alias("p")), "posterior")
        moved = new.join(now.withColumnRenamed("p", "old"), ["item", "truth"]).agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0]
        now = new
        if moved is None or moved <= tolerance:
            break
    return now.withColumnRenamed("truth", "label"), matrix


def alpha(df: DataFrame, item: str = "item", annotator: str = "annotator", label: str = "label") -> DataFrame:
    """(n, alpha), one row: annotations that can be paired, and Krippendorff's alpha of nominal labels; null if nothing can disagree.

    Coincidences come from each item's counts of labels; no pair of annotations is made.
    """
    counts = _usable(df, item, annotator, label).groupBy("item", "label").agg(F.count("*").alias("n"))
    paired = counts.withColumn("m", F.sum("n").over(Window.partitionBy("item"))).where("m > 1")  # a row for each label
    by_label = paired.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("apart"))
    out = by_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("apart").alias("apart"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    expected = F.col("n").cast("double") * F.col("n") - F.col("squares")
    return out.select("n", F.when(expected > 0, 1 - (F.col("n") - 1) * F.col("apart") / expected).alias("alpha"))
