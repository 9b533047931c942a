"""Analytics over extracted tables. These go beyond what collection and enrichment need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialised

def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def group_compare(df: DataFrame, *dims: str) -> DataFrame:
    """Counts for every combination of the dimensions; `level` tells which are rolled up."""
    return df.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def log_odds(df: DataFrame, group: str, signifier: str, strength: float = 1.0) -> DataFrame:
    """(group, signifier, n, others, delta, z): how much more a group uses a signifier than all others do.

    Log-odds ratios with an informative Dirichlet prior: what all groups together use, scaled to `strength` times the mean
    group's size, is added to both sides; z is the ratio over its standard deviation. Every group gets every signifier that
    it uses itself; null groups and signifiers do not count. Null where all signifiers are one (nothing is left to compare with).
    """
    counts = df.select(F.col(group).alias("group"), F.col(signifier).alias("signifier")).na.drop().groupBy("group", "signifier").agg(F.count("*").cast("double").alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("size"))  # a row for each group
    words = counts.groupBy("signifier").agg(F.sum("n").alias("all"))
    whole = totals.agg(F.sum("size").alias("whole"), F.count("*").alias("groups")).first()
    if not whole.groups:
        return counts.select("group", "signifier", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("others"), F.lit(0.0).alias("delta"), F.lit(0.0).alias("z"))
    prior = strength * whole.whole / whole.groups
    rows = counts.join(words, "signifier").join(totals, "group")
    rows = rows.withColumns({"a": F.col("all") * (prior / whole.whole), "rest": F.col("all") - F.col("n"), "left": F.lit(whole.whole) - F.col("size")})
    odds = lambda n, size: F.log((n + F.col("a")) / F.nullif(size + prior - n - F.col("a"), F.lit(0.0)))
    delta = odds(F.col("n"), F.col("size")) - odds(F.col("rest"), F.col("left"))
    spread = F.sqrt(1 / (F.col("n") + F.col("a")) + 1 / (F.col("rest") + F.col("a")))
    return rows.select("group", "signifier", F.col("n").cast("long").alias("n"), F.col("rest").cast("long").alias("others"), delta.alias("delta"), (delta / spread).alias("z"))


def daily(df: DataFrame, ts: str, *by: str) -> DataFrame:
    day = F.to_date(F.window(F.col(ts).cast("timestamp"), "1 day")["start"])
    return df.groupBy(day.alias("day"), *by).agg(F.count("*").alias("n"))


def peaks(days: DataFrame, over: int = 7, factor: float = 1.05) -> DataFrame:
    """Days with more than `factor` times the mean of the `over` days before; days is (day, n), one row a day."""
    w = Window.orderBy("day").rowsBetween(-over, -1)  # one row a day: the window has no partition to spread over
    return days.withColumn("mean", F.avg("n").over(w)).where(F.col("n") > F.col("mean") * factor)


def cooccurrence(df: DataFrame, key: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, n) for items a < b that share `least` keys or more, from the distinct items of each key; a join, which is split where a key is hot.

    A pair has no more keys than its rarer item, so items of fewer than `least` keys go before the join; `meetings` says how
    large keys are kept from it. With `least` 1 it makes a row for every pair of items of a key, as the result does.
    Null keys and items count nowhere.
    """
    seen = df.select(F.col(key).alias("k"), F.col(item).alias("a")).na.drop().distinct()
    if least > 1:
        n = F.count("*") + F.max("besides")
        return meetings(materialised(seen, "seen"), least).groupBy("a", "b").agg(n.alias("n")).where(F.col("n") >= least)
    pairs = seen.join(seen.withColumnRenamed("a", "b"), "k").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def meetings(seen: DataFrame, least: int, large: int = 100) -> DataFrame:
    """(a, b, besides): rows for items a < b of the distinct (k, a); a pair of `least` keys or more has a row for each but the `besides` of its keys.

    An item is led by its `least` - 1 largest keys among those of over `large` items, all keys in one order. Of the keys that a pair
    shares, the last in that order leads neither item, so items that are led by a key need not meet there: such keys are compared
    as two short lists once the pair meets elsewhere, and a row is made only where the key leads one of both at most. A key that
    leads all its items, like the one largest of all, makes no row at all. `large` changes the work, not the pairs.
    """
    sizes = seen.groupBy("k").agg(F.count("*").alias("size")).where(F.col("size") > large)
    largest = Window.partitionBy("a").orderBy(F.desc("size"), "k")  # large keys alone
    led = seen.join(sizes, "k").withColumn("nth", F.row_number().over(largest)).where(F.col("nth") < least).groupBy("a").agg(F.collect_list("k").alias("led"))
    often = seen.groupBy("a").agg(F.count("*").alias("keys")).where(F.col("keys") >= least)
    items = often.join(led, "a", "left").select("a", F.coalesce("led", F.array()).alias("led"))
    each = materialised(seen.join(items, "a").select("k", "a", "led", F.array_contains("led", F.col("k")).alias("leads")), "seen")
    free = each.where("not leads").select("k", F.col("a").alias("x"), F.col("led").alias("x_led"))
    met = free.join(each.select("k", F.col("a").alias("y"), F.col("led").alias("y_led"), "leads"), "k").where("x < y or leads")
    both = F.when((F.size("x_led") > 0) & (F.size("y_led") > 0), F.size(F.array_intersect("x_led", "y_led"))).otherwise(0)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), both.alias("besides"))


def canonical(name: Column) -> Column:
    """Lower case, punctuation and runs of space gone: names that differ in these alone are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def merge_names(df: DataFrame, name: str) -> DataFrame:
    """(canonical, label, n): the most frequent spelling stands for its group."""
    spelled = df.select(F.col(name).alias("name"), canonical(F.col(name)).alias("canonical")).groupBy("canonical", "name").agg(F.count("*").alias("k"))
    return spelled.groupBy("canonical").agg(F.max_by("name", F.struct("k", "name")).alias("label"), F.sum("k").alias("n"))


def override(model: DataFrame, human: DataFrame, key: str, column: str) -> DataFrame:
    """A human's value where there is one, else the model's."""
    h = human.select(key, F.col(column).alias("__h"))
    return model.join(h, key, "left").withColumn("source", F.when(F.col("__h").isNotNull(), F.lit("human")).otherwise(F.lit("model"))).withColumn(column, F.coalesce("__h", column)).drop("__h")


def topics(df: DataFrame, tokens: str, k: int = 10, vocabulary: int = 20_000, seed: int = 7) -> DataFrame:
    """Topic weights of every row by latent Dirichlet allocation."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    counted = CountVectorizer(inputCol=tokens, outputCol="__counts", vocabSize=vocabulary).fit(df).transform(df)
    return LDA(k=k, seed=seed, featuresCol="__counts", optimizer="online").fit(counted).transform(counted).drop("__counts")
