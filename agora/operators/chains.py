"""Chains of equivalence: elements that stand together in many formulas."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialised


def chains(df: DataFrame, key: str, element: str, share: float = 0.01, closed: bool = True) -> DataFrame:
    """(elements, n): sets of two and more elements that at least `share` of the keys have together, sorted, and the number of those keys.

    Frequent sets are grown in parallel, each task from the elements of its own group, so that a frequent element alone is no task.
    With `closed`, a set goes if one more element does not make it rarer: what is left tells of all others. Null keys and elements do not count.
    """
    baskets = df.select(F.col(key).alias("k"), F.col(element).cast("string").alias("e")).na.drop().groupBy("k").agg(F.collect_set("e").alias("items"))  # a key's distinct elements
    sets = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets
    sets = materialised(sets.select(F.array_sort("items").alias("elements"), F.col("freq").alias("n")), "sets")
    if closed:
        one_less = F.transform("elements", lambda x: F.filter("elements", lambda y: y != x))
        covered = sets.where(F.size("elements") > 1).select(F.explode(one_less).alias("elements"), "n").distinct()
        sets = sets.join(covered, ["elements", "n"], "left_anti")
    return sets.where(F.size("elements") > 1)
