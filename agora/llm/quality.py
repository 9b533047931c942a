"""Operator 8: quality rules learned as a decision list.

Statistics of each whole text are built-in expressions over arrays; nothing is
exploded or shuffled, so a very common word or line costs nothing extra. From
labelled statistics, sequential covering learns an ordered list of conjunctions
of thresholds: each rule is grown by information gain on two thirds of the
sample that is left until it covers bad rows alone or nothing separates them, pruned on the other third, kept while it is precise there,
and then its rows are taken out. The list comes out as one ordered conditional
expression.

Null and empty texts have no words and fail the base rule. Ties go to the first
feature and smallest threshold, so the list depends on the sample alone. A
labelled id that occurs twice counts once, as its lowest label and, of several texts, the one of the smallest statistics; without labels
the list is empty and keeps what passes the base rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, smallest, table

#: Labelled rows that the rules are learned from, at most: those of the smallest hash of their id.
SAMPLE = 20_000
#: Of the rows that a rule rejects in the pruning set, the share that must be labelled bad.
PRECISION = 0.95
#: Rows that a rule must reject, at least; learning ends when fewer bad rows are left.
MIN_COVER = 8
WHITE = r"[\x20\x09-\x0D]"
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def _left(text: Column, kept: str) -> Column:
    """How many characters of the text are of the kind."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeated(h: Column) -> Column:
    """Positions covered by three-word windows whose hash occurs twice or more in h, the windows' hashes in order."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), x - F.get(p, i - 1)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def again(z: Column) -> Column:
        same = F.filter(z, lambda e, k: F.coalesce(e["h"] == F.get(z, k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(z, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    bound = F.transform(F.transform(F.array(pairs), again), covered)  # arrays of one: each step is computed once
    return F.get(bound, F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.col(id_col),
        F.array_remove(F.split(text, f"{WHITE}+"), "").alias("w"),
        F.struct(F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))[0].alias("l")).alias("of"),
        F.length(F.regexp_replace(text, f"{WHITE}+", "")).cast("long").alias("word_chars"),
        _left(text, "#*$%&|<>").alias("n_symbols"),
        _left(text, "A-Z").alias("n_upper"),
        _left(text, "!?").alias("n_marks"),
        _left(text, "0-9").alias("n_digits"),
    )
    hashes = F.transform(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    second = first.withColumn("h", hashes)
    distinct = F.size(F.array_distinct("h")) == F.size("h")
    return second.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("of.l.dup").alias("n_dup_lines"),
        F.when(distinct, F.lit(0).cast("long")).otherwise(_repeated(F.col("h"))).alias("n_repeat_words"),
        F.col("of.l.n").alias("n_lines"),
        "n_upper",
        "n_marks",
        "n_digits",
    )


def _cover(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] >= t) if above else (x[:, f] <= t)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[int, bool, float]] | None:
    """The condition of largest FOIL gain over the rows, all of which the rule so far covers."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), None
    for f in range(x.shape[1]):
        for above in (True, False):
            order = np.argsort(-x[:, f] if above else x[:, f], kind="stable")
            v, b = x[order, f], bad[order]
            p = np.cumsum(b)
            n = np.arange(1, len(b) + 1) - p
            ends = np.append(v[1:] != v[:-1], True) & (p > 0)
            gain = np.where(ends, p * (np.log2(np.maximum(p, 1) / (p + n)) - base), -np.inf)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-9):
                best = (float(gain[at]), (f, above, float(v[at])))
    return best


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for rejection, each a list of (feature, at least?, threshold). Rows come in a fixed random order."""
    rules: list = []
    while bad.sum() >= MIN_COVER:
        third = np.arange(len(x)) % 3 == 2
        gx, gb, px, pb = x[~third], bad[~third], x[third], bad[third]
        rule: list = []
        while (best := _best(gx[(c := _cover(gx, rule))], gb[c])):
            rule.append(best[1])
        if not rule:
            break

        def worth(r: list) -> float:
            c = _cover(px, r)
            return (2 * pb[c].sum() - c.sum() + 1) / (c.sum() + 2)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c, all_c = _cover(px, rule), _cover(x, rule)
        if c.sum() == 0 or pb[c].mean() < precision or bad[all_c].mean() < precision or all_c.sum() < MIN_COVER:
            break
        rules.append(rule)
        x, bad = x[~all_c], bad[~all_c]
    return rules


def verdict(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """Whether a row of statistics is kept: the rules in order, then yes."""
    out = None
    names = list(FEATURES.values())
    for rule in rules:
        hit = F.expr(" AND ".join(f"({names[f]}) {'>=' if above else '<='} {t!r}D" for f, above, t in rule))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sample(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    labelled = stats.join(marked, id_col).select(F.xxhash64(F.lit("quality"), F.col(id_col)).alias("at"), F.col(id_col).cast("string").alias("tie"), (F.col("label") == 0).alias("bad"), *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    once = labelled.groupBy("at", "tie").agg(F.min(F.struct("bad", *FEATURES)).alias("row")).select("at", "tie", "row.*")  # one row per id
    got = smallest(checkpointed(once), "at", "tie", rows).collect()  # at most `rows`
    return np.array([r[3:] for r in got], float).reshape(-1, len(FEATURES)), np.array([r.bad for r in got], bool)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """The statistics of every text, base_failed, and kept."""
    stats = checkpointed(statistics(docs, id_col, text_col))
    rules = learn(*sample(stats, labels, id_col, label_col, rows))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
