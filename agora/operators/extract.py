"""From structured replies to tables of topics, entities, sentiments and the Us / Frontier formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict import parse_formula, parse_sentiment
from ..functions.text import label_flags, list_text, pairs_text
from ..schemas import SENTIMENT


def split_results(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows); rejected ones belong in an errors table and are tried again."""
    return df.where(F.col(f"{column}.ok")), df.where(~F.col(f"{column}.ok"))


def sentiments(df: DataFrame, reply: str, *keys: str) -> DataFrame:
    parsed = df.select(*keys, parse_sentiment(F.col(reply)).alias("r"))
    return parsed.select(*keys, "r.ok", *(F.col(f"r.value.{n}").alias(n) for n in SENTIMENT), "r.error")


def formulas(df: DataFrame, reply: str, *keys: str) -> DataFrame:
    parsed = df.select(*keys, parse_formula(F.col(reply)).alias("r"))
    return parsed.select(*keys, "r.ok", "r.value.populism_analysis", "r.value.populism_us", "r.value.populism_frontier", "r.error")


def export(df: DataFrame) -> DataFrame:
    """Lists and pairs as text. For CSV only: names with commas or ^ cannot be read back."""
    kinds = dict(df.dtypes)
    pairs = [c for c, k in kinds.items() if k.startswith("array<struct<populism_element")]
    lists = [c for c, k in kinds.items() if k == "array<string>"]
    return df.withColumns({c: pairs_text(F.col(c)) for c in pairs} | {c: list_text(F.col(c)) for c in lists})


def distinct_lists(df: DataFrame) -> DataFrame:
    """Lists of names without repetitions; the order of first mention stays."""
    return df.withColumns({c: F.array_distinct(c) for c, k in df.dtypes if k == "array<string>"})


def elements(df: DataFrame, *keys: str) -> DataFrame:
    """One row per element: (keys..., side, element, affect, single_word)."""
    out = None
    for side in ("us", "frontier"):
        part = df.select(*keys, F.lit(side).alias("side"), F.explode(f"populism_{side}").alias("e"))
        out = part if out is None else out.unionAll(part)
    flags = label_flags(F.col("e.populism_element"), F.col("e.populism_affect"))
    return out.select(*keys, "side", flags["element"].alias("element"), F.lower(F.trim("e.populism_affect")).alias("affect"), flags["single_word"].alias("single_word"))
