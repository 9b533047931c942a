"""Names that are nearly equal become one: a similarity join by prefix filter, edit distance, components, and the medoid as label.

Two names are linked if their edit distance is at most a `ratio`-th of the longer one's length. Such names share a q-gram
among the rarest of each: one edit touches Q q-grams, so of Q * k + 1 of them one is left untouched. Only names that share such a
rare q-gram and whose lengths fit are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import canonical
from .graph import components
from .shared import materialised

Q, RATIO = 2, 6


def allowed(length: Column, ratio: int = RATIO) -> Column:
    """The edits that two names may differ by, the longer one being so long."""
    return F.floor(length / ratio)


def grams(name: Column) -> Column:
    """The numbered Q-grams of the name with one mark at each end: (gram, which of its repetitions); length + 1 of them."""
    marked = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    each = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(marked, i, F.lit(Q)))
    return F.transform(each, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(each, 1, i), lambda x: x == g)).alias("nth")))


def similar(names: DataFrame, name: str = "name", ratio: int = RATIO) -> DataFrame:
    """(a, b, distance) of all different names within the allowed distance, a < b. names: distinct, not null."""
    rows = names.select(F.col(name).alias("name")).where("name <> ''")
    each = materialised(rows.select("name", F.length("name").alias("size"), F.explode(grams(F.col("name"))).alias("g")).select("name", "size", "g.gram", "g.nth"), "grams")
    often = each.groupBy("gram", "nth").agg(F.count("*").alias("often"))
    order = Window.partitionBy("name").orderBy("often", "gram", "nth")  # a name's own q-grams
    rare = each.join(often, ["gram", "nth"]).withColumn("place", F.row_number().over(order))
    # the longer of two names may be longer than this one, by what is allowed for it
    most = F.floor(F.col("size") / (ratio - 1))
    rare = materialised(rare.where(F.col("place") <= Q * most + 1).select("name", "size", "gram", "nth"), "grams")
    longer = rare.select(F.col("name").alias("a_"), "gram", "nth", F.col("size").alias("sa"), F.explode(F.sequence("size", (F.col("size") + most).cast("int"))).alias("size"))
    met = longer.join(rare.withColumnRenamed("name", "b_"), ["gram", "nth", "size"]).where(F.col("a_") != F.col("b_")).where((F.col("size") - F.col("sa")) <= allowed(F.col("size"), ratio))
    pairs = met.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), allowed(F.col("size"), ratio).alias("most")).distinct()
    near = pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= F.col("most"))
    return near.select("a", "b", "distance")


def merged(df: DataFrame, name: str, ratio: int = RATIO) -> DataFrame:
    """(canonical, label, n): for each normal form the label of its component, and n its own rows.

    The label is the medoid: the member from which the distances to all rows of the component, cut off at one more than the
    longest link, sum to the least. Only links count against that cut-off, so no pair of members without a link is looked at.
    """
    forms = materialised(df.select(canonical(F.col(name)).alias("canonical")).where("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n")), "names")
    links = materialised(similar(forms.withColumnRenamed("canonical", "name"), ratio=ratio), "links")
    of = forms.join(components(links).withColumnRenamed("node", "canonical"), "canonical", "left").withColumn("component", F.coalesce("component", "canonical"))
    of = materialised(of, "names")
    both = links.select("a", "b", "distance").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    known = both.join(of.select(F.col("canonical").alias("b"), F.col("n").alias("nb"), "component"), "b")
    far = known.groupBy("component").agg((F.max("distance") + 1).alias("far"))
    gain = known.join(far, "component").groupBy(F.col("a").alias("canonical")).agg(F.sum(F.col("nb") * (F.col("far") - F.col("distance"))).alias("gain"))
    scored = of.join(far, "component", "left").join(gain, "canonical", "left").withColumn("saved", F.col("n") * F.coalesce("far", F.lit(1)) + F.coalesce("gain", F.lit(0)))
    label = scored.groupBy("component").agg(F.min_by("canonical", F.struct(-F.col("saved"), "canonical")).alias("label"))
    return of.join(label, "component").select("canonical", "label", "n")
