"""Operator 11: how the sources of a language differ in their terms.

Terms are counted per language and source; a language keeps those of at least MIN_DOCS of its documents. A group (language,
source) gives term t the probability p = 1 + floor(SCALE (count + 1) / (N + V)) in units of 1 / SCALE, a language likewise.
The divergence of p from q is f = floor((p - q)^2 / q), all in whole numbers.

* term: for each group the TOP terms of largest f against the language, of those more likely in the group. f rises with p
  and falls with q, so a bucket of similar counts is bounded by its largest count and the language's least one in it.
  Buckets are evaluated best first, some at a time, until every bucket not yet seen is bounded strictly below the TOP-th value.
* pair: for each two sources the sum of f over all kept terms. Only terms that both have are met, in blocks of postings;
  what one of them lacks has one probability, so its part is a sum over the other's counts, and what both lack is a product.

Nothing of the size of a vocabulary is in one task: postings are dealt by term, pairs by block of terms and tiles of
sources. Null texts, languages and sources count as ''. Repeated rows count each. Ties are ordered by the item's bytes.
Other columns are not read. A group without terms is still a group; a language of one source has no pairs. An empty table
gives an empty result. Long texts are read in pieces, so memory is that of one text's distinct terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Counts up to this have a bucket each, larger ones eighths of octaves.
SINGLE = 32
#: Terms of a block on average; sources of a tile; pairs that a step works on at a time.
BLOCK_TERMS, TILE, PAIRS = 4096, 256, 1 << 19
#: Terms that a task counts before it hands them on; bytes of a piece of text.
COUNTED, PIECE = 1 << 20, 1 << 20
#: Bits of a term's count in a run of rows; the rest holds its documents.
DOCS_FROM = 44
TERM = re.compile(rb"[a-z\x80-\xff]+")
NOT_TERM = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def terms(text: bytes) -> Counter:
    """The terms of a text and their counts; only A-Z are lower-cased."""
    if len(text) <= PIECE:
        return Counter(TERM.findall(text.lower()))
    out, at = Counter(), 0
    while at < len(text):
        end = NOT_TERM.search(text, at + PIECE)
        end = end.start() if end else len(text)
        out.update(TERM.findall(text[at:end].lower()))
        at = end
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, c, docs) of runs of rows, and a row without a term for each group."""
    names = ["lang", "source", "term", "c", "docs"]
    count: dict[tuple[str, str], dict[bytes, int]] = {}
    held = rows = 0
    one = 1 << DOCS_FROM  # a number holds a term's count, and above it its documents

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in count.items():
            n = np.fromiter(of.values(), np.int64, len(of))
            values = [pa.array([None, *of], pa.binary()), *(pa.array(np.concatenate(([0], x))) for x in (n & (one - 1), n >> DOCS_FROM))]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(of) + 1), pa.repeat(source, len(of) + 1), *values], names=names)
        count.clear()

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, b.column(2).cast(pa.large_binary()), strict=True):
            of = count.setdefault((lang, source), {})
            had, get = len(of), of.get
            for t, n in terms(text.as_py()).items():
                of[t] = get(t, 0) + n + one
            held += len(of) - had
            rows += 1
            if held >= COUNTED or rows >= 1 << 62 - DOCS_FROM:
                yield from told()
                held = rows = 0
    yield from told()


def scaled(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (c + 1) / (n + v)), exact beyond what 64 bits hold of the product: three decimal digits a step. null if there is nothing to divide by."""
    total, step = n + v, F.lit(1000)
    over, left = F.lit(0), c + 1
    for _ in range(3):
        whole = left * step
        over, left = over * step + F.call_function("div", whole, total), whole % total
    return (over + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, term, source, c, l, head) of kept terms, l the term's count in the language and head true for one of its rows; and (lang, source) of all groups."""
    read = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = read.mapInArrow(_counted, "lang string, source string, term binary, c long, docs long")
    by_group = checkpointed(counts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    kept = by_group.where("term is not null").withColumns({"l": F.sum("c").over(of_term), "d": F.sum("docs").over(of_term), "head": F.col("source") == F.min("source").over(of_term)})
    kept = kept.where(F.col("d") >= MIN_DOCS).select("lang", F.col("term").cast("string").alias("term"), "source", "c", "l", "head")
    return checkpointed(kept), by_group.where("term is null").select("lang", "source")


def totals(post: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each group: n (its occurrences of kept terms), ln and v (the language's, and its number of kept terms)."""
    of_group = post.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    own = post.where("head").groupBy("lang").agg(F.sum("l").alias("ln"), F.count("*").alias("v"))
    none = {"n": F.coalesce("n", F.lit(0)), "ln": F.coalesce("ln", F.lit(0)), "v": F.coalesce("v", F.lit(0))}
    return checkpointed(groups.join(of_group, ["lang", "source"], "left").join(own, "lang", "left").withColumns(none))


def first(rows: DataFrame, k: int) -> DataFrame:
    """Rows with their rank in their group, by value and then item, up to k."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bucket_of(c: Column) -> Column:
    return F.when(c <= SINGLE, c).otherwise(SINGLE + F.floor(8 * F.log2(c.cast("double")))).cast("int")


def top_terms(post: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the k terms of largest divergence in each group, of those more likely there."""
    rows = post.drop("head").withColumn("bucket", bucket_of(F.col("c")))
    held = rows.groupBy("lang", "source", "bucket").agg(F.max("c").alias("c"), F.min("l").alias("l"), F.count("*").alias("size"))
    p, q = scaled(F.col("c"), F.col("n"), F.col("v")), scaled(F.col("l"), F.col("ln"), F.col("v"))
    bounds = held.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    todo = checkpointed(bounds.select("lang", "source", "bucket", "size", "n", "ln", "v", divergence(F.col("p"), F.col("q")).alias("bound")))
    best, step = None, k
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")  # a row for each bucket of a group
    before = best_first.rowsBetween(Window.unboundedPreceding, -1)
    while not todo.isEmpty():
        ordered = checkpointed(todo.withColumn("turn", F.coalesce(F.sum("size").over(before), F.lit(0)) < step))
        now = rows.join(ordered.where("turn").drop("bound", "size", "turn"), ["lang", "source", "bucket"]).withColumns({"p": p, "q": q}).where("p > q")
        now = now.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        best = checkpointed(first(now if best is None else best.drop("rank").unionByName(now), k))
        least = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("least"))
        todo = ordered.where("not turn").drop("turn").join(least, ["lang", "source"], "left").where("least is null or bound >= least").drop("least")
        todo, step = checkpointed(todo), step * 4
    return best if best is not None else post.select("lang", "source", F.col("term").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank")).limit(0)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _exact_sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of values (under 2**61) at each place, exact: in halves, whose sums floats hold."""
    high, low = values >> 31, values & 0x7FFFFFFF
    return (np.bincount(at, high, size).astype(np.int64) << 31) + np.bincount(at, low, size).astype(np.int64)


def _paired(t: pa.Table) -> pa.Table:
    """Sums over a block of terms for each source i of one tile and j of another: what differs from a term that both lack.

    Rows without a term are the sources themselves, with p their probability of a term that they lack.
    """
    side, place, p = (t[x].to_numpy() for x in ("side", "place", "p"))
    term = t["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    source = term < 0
    on = [(side == x) | (side == 2) for x in (0, 1)]  # 2: a tile met with itself
    own = [source & x for x in on]
    none = [p[x][np.argsort(place[x])] for x in own]
    names = [np.sort(place[x]) for x in own]
    out = np.zeros((len(names[0]), len(names[1])), np.int64)
    base = _f(none[0][:, None], none[1][None, :])
    rows = []
    for x in (0, 1):  # what one of them has, as if the other lacked it
        at = np.flatnonzero(~source & on[x])
        at = at[np.argsort(term[at], kind="stable")]
        where = np.searchsorted(names[x], place[at])
        rows.append((term[at], where, p[at]))
        pairs, n = np.unique(np.stack([where, p[at]]), axis=1, return_counts=True)
        for i, value, k in zip(*pairs.tolist(), n.tolist(), strict=True):
            if x == 0:
                out[i] += k * (_f(np.int64(value), none[1]) - base[i])
            else:
                out[:, i] += k * (_f(none[0], np.int64(value)) - base[:, i])
    (ta, ia, pa_), (tb, jb, qb) = rows
    lo, hi = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    ends, begin = np.cumsum(hi - lo), 0
    while begin < len(ta):  # what both have
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        many = (hi - lo)[begin:end]
        a = np.repeat(np.arange(begin, end), many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[begin:end], many)
        i, j, p_, q_ = ia[a], jb[b], pa_[a], qb[b]
        at, size = i * len(names[1]) + j, out.size
        for sign, values in ((1, _f(p_, q_)), (-1, _f(p_, none[1][j])), (-1, _f(none[0][i], q_)), (1, base[i, j])):
            out += sign * _exact_sums(at, values, size).reshape(out.shape)
        begin = end
    i, j = (x.ravel() for x in np.meshgrid(names[0], names[1], indexing="ij"))
    apart = i != j
    lang = pa.array([t["lang"][0].as_py()] * int(apart.sum()), pa.string())
    return pa.Table.from_arrays([lang, *(pa.array(x[apart]) for x in (i, j, out.ravel()))], names=["lang", "i", "j", "value"])


def pairs(post: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of all pairs of different sources of a language."""
    numbered = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)  # a row for each source
    none = F.when(F.col("v") > 0, scaled(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(1).cast("long")
    known = checkpointed(numbered.withColumns({"none": none, "place": F.col("place").cast("long"), "tiles": F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE), "blocks": (1 + F.col("v") / BLOCK_TERMS).cast("long")}))
    here = known.select("lang", "source", "place", "tiles", "blocks", "n", "v")
    given = post.join(here, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "place", "tiles", scaled(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    themselves = known.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "place", "tiles", F.col("none").alias("p"))
    both = given.unionAll(themselves)
    tile, others = F.expr(f"place div {TILE}"), F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: x != F.expr(f"place div {TILE}"))
    side = lambda n, a, b: F.struct(F.lit(n).alias("side"), a.alias("a"), b.alias("b"))
    sides = F.concat(F.array(side(2, tile, tile)), F.transform(others, lambda x: side(0, tile, x)), F.transform(others, lambda x: side(1, x, tile)))
    dealt = both.select("lang", "block", "term", "place", "p", F.explode(sides).alias("s")).select("lang", "block", "term", "place", "p", "s.*")
    parts = dealt.groupBy("lang", "block", "a", "b").applyInArrow(_paired, "lang string, i long, j long, value long")
    summed = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    one = known.select("lang", F.col("place").alias("i"), "source", F.col("none").alias("p"), "v")
    two = known.select("lang", F.col("place").alias("j"), F.col("source").alias("item"), F.col("none").alias("q"))
    # v can be 0: nothing is summed then
    named = summed.join(one, ["lang", "i"]).join(two, ["lang", "j"]).select("lang", "source", "item", (F.col("value") + F.col("v") * divergence(F.col("p"), F.col("q"))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    post, found = postings(docs, lang, source, text)
    groups = totals(post, found)
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, x in (("pair", pairs(post, groups)), ("term", top_terms(post, groups, top)))]
    return parts[0].unionAll(parts[1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, term, count(*) AS c FROM (SELECT id, lang, source, unnest(terms) AS term FROM d) u GROUP BY id, lang, source, term),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS l FROM w GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT g.lang, coalesce(sum(k.l), 0)::HUGEINT AS ln, count(k.term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept k ON g.lang = k.lang GROUP BY g.lang),
post AS (SELECT w.lang, w.source, w.term, sum(w.c)::HUGEINT AS c FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
grp AS (SELECT g.lang, g.source, coalesce(sum(p.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN post p ON g.lang = p.lang AND g.source = p.source GROUP BY g.lang, g.source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(p.c, 0) AS c, 1 + (1000000000 * (coalesce(p.c, 0) + 1)) // (g.n + s.v) AS p, 1 + (1000000000 * (k.l + 1)) // (s.ln + s.v) AS q
    FROM grp g JOIN langs s ON g.lang = s.lang JOIN kept k ON g.lang = k.lang LEFT JOIN post p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""
