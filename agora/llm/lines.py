"""Operator 2: line deduplication by winnowing.

The unit is a run of non-blank lines with at least `min_chars` characters in
all. A line goes if it lies in such a run that equals a run beginning earlier
in the corpus (smaller id, or further up in the same text); the first
occurrence stays.

A window is the shortest run that reaches `min_chars` from a line on, downwards
or upwards. The least line hash of each window is its fingerprint, so equal
windows have the same fingerprint at the same place in them. Fingerprints that
occur at one position only are dropped; at the others, the windows around them
are joined by content with their first occurrence. Downward windows extend a
match to its end and upward ones to its begin: together the repeated windows cover every
line of every repeated run, and no other line.

Everything is built-in functions. Positions are compared with the first
occurrence alone, never with each other, so frequent lines make no pairs; both
sides of that join are direct shuffles, which adaptive execution splits when a
key is hot. Two hashes of every line (96 bits) stand for it. Null and empty texts stay as they are. Blank lines stay. Rows with
the same id and text are one document and keep the same lines. Null ids come after all others, so of equal texts the one with an id
stays whole. An empty table gives an empty result. Columns of any name pass; where an input column has the name of a count, the
count's name gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

MIN_CHARS = 100


def _reach(c: Column, least: int) -> Column:
    """For each place of an array of lengths, how many from there on sum to `least`; null where the end comes first."""

    def steps(x: Column, i: Column) -> Column:
        two = x + F.get(c, i + 1)
        three = two + F.get(c, i + 2)
        far = F.aggregate(
            F.slice(c, i + 1, least),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda a, y: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + y).alias("sum"), (a["n"] + 1).alias("n"))),
            lambda a: F.when(a["sum"] >= least, a["n"]),
        )
        return F.when(x >= least, F.lit(1)).when(two >= least, F.lit(2)).when(three >= least, F.lit(3)).when(three.isNotNull(), far)

    return F.transform(c, steps)


def _ordered(id_col: str) -> Column:
    """The id as something that is never null and sorts null ids last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as it takes to differ from all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def windows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, mark (of the text), hashes of the non-blank lines, and their windows."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)).alias("h"), F.crc32(x).alias("g"), F.length(x).alias("c")))
    df = docs.where(F.length(text_col) >= min_chars).select(_ordered(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.filter(lines, lambda e: e["h"].isNotNull()).alias("l"))
    df = df.select("id", "mark", F.col("l.i").alias("at"), F.col("l.h").alias("h"), F.col("l.g").alias("g"), F.col("l.c").alias("c"), F.reverse("l.c").alias("r"))
    df = df.select("id", "mark", "at", "h", "g", _reach(F.col("c"), min_chars).alias("down"), F.reverse(_reach(F.col("r"), min_chars)).alias("up"))

    def window(s: Column, n: Column) -> Column:
        run = F.slice(F.col("h"), s + 1, n)
        least = F.array_min(run)
        return F.when(n.isNotNull(), F.struct(s.alias("s"), n.alias("n"), F.xxhash64(run).alias("key"), F.xxhash64(F.slice(F.col("g"), s + 1, n)).alias("key2"), least.alias("least"), (s + F.array_position(run, least) - 1).alias("place")))

    down = F.transform("down", lambda n, i: window(i, n))
    up = F.transform("up", lambda n, i: F.when(~F.get("down", i - n + 1).eqNullSafe(n), window(i - n + 1, n)))
    return df.select("id", "mark", "at", F.filter(F.concat(down, up), lambda w: w.isNotNull()).alias("w"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """id, mark, gone: the places (among all lines of the text, from 0) of the lines to delete."""
    wins = windows(docs, id_col, text_col, min_chars)
    prints = _prints(wins)
    shared = checkpointed(prints.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least"))
    rows = wins.select("id", "mark", F.explode_outer("w").alias("w"), "at").where("w is not null").select("id", "mark", "w.s", "w.n", "w.key", "w.key2", "w.least", F.slice("at", F.col("w.s") + 1, F.col("w.n")).alias("at"))
    near = checkpointed(rows.join(shared, "least", "left_semi").drop("least", "n"))
    first = checkpointed(near.groupBy("key", "key2").agg(F.min(F.struct("id", "mark", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = near.join(first, ["key", "key2"]).where(F.struct("id", "mark", "s") > F.col("first"))
    return later.select("id", "mark", F.explode("at").alias("at")).groupBy("id", "mark").agg(F.collect_set("at").alias("gone"))


def _prints(wins: DataFrame) -> DataFrame:
    """One row per selected position: places are distinct integers, so each fingerprint counts once where it stands."""
    chosen = F.array_sort(F.transform("w", lambda x: F.struct(x["place"].alias("place"), x["least"].alias("least"))))
    df = wins.select(chosen.alias("p"))
    return df.select(F.explode_outer(F.filter(F.transform("p", lambda x, i: F.when(~F.get("p", i - 1)["place"].eqNullSafe(x["place"]), x["least"])), lambda x: x.isNotNull())).alias("least")).where("least is not null")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs, with repeated lines deleted from the text, and n_lines and n_removed added."""
    key, mark, gone, parts, n_lines, n_removed = (free(c, docs.columns) for c in ("__id", "__mark", "__gone", "__lines", "n_lines", "n_removed"))
    found = repeated_lines(docs, id_col, text_col, min_chars).select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("gone").alias(gone))
    rows = docs.join(found, (_ordered(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left")
    rows = rows.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n"))
    count = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    return rows.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), count.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB SQL for documents with lines removed: ids, counts, and the text that is left.
KEPT_SQL = """
WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
b AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
        sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, upto - length(line) AS before FROM b),
spans AS (
  SELECT x.doc_id, x.k AS s, min(y.k) AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.before >= 100 GROUP BY ALL
  UNION
  SELECT y.doc_id, max(x.k) AS s, y.k AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k >= x.k AND y.upto - x.before >= 100 GROUP BY y.doc_id, y.k),
lists AS (SELECT doc_id, list(line ORDER BY k) AS ls, list(i ORDER BY k) AS pos FROM c GROUP BY doc_id),
w AS (SELECT doc_id, s, array_to_string(list_slice(ls, s, e), chr(10)) AS run, list_slice(pos, s, e) AS pos FROM spans JOIN lists USING (doc_id)),
f AS (SELECT *, min(struct_pack(a := doc_id, b := s)) OVER (PARTITION BY run) AS first FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(pos) AS i FROM f WHERE struct_pack(a := doc_id, b := s) > first),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
         FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
"""
OP2_SQL = KEPT_SQL + "SELECT doc_id, n_lines, n_removed, sha256(text) AS kept_sha256 FROM kept"
