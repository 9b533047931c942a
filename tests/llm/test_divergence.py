"""The divergence audit, against a dense version in whole numbers and against its SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from agora.llm import divergence

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, top=200):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        c = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        counts[lang, source].update(c)
        docs[lang].update(c.keys())
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        v = len(kept)

        def prob(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q = prob(sum((counts[lang, s] for s in names), Counter()))
        p = {s: prob(counts[lang, s]) for s in names}
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            terms = sorted(((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]))[:top]
            pairs = sorted((-sum(f(p[s][t], p[x][t]) for t in kept), x.encode()) for x in names if x != s)
            out |= {(lang, s, part, t.decode(), -v, k + 1) for part, found in (("term", terms), ("pair", pairs)) for k, (v, t) in enumerate(found)}
    return out


def got(df, **kw):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(150)]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + (i * 7 + k % 5 * 31) % 150) for i in range(150)], k=rng.randint(0, 60))), rng.choice("ab"), f"s{rng.randint(0, 6)}") for k in range(250)]
    rows += [(900, None, None, None), (901, "A a Ä ä", None, "x"), (901, "A a Ä ä", None, "x"), (902, "a", None, ""), (903, "", "c", "only"), (904, "tie tie", "d", "1"), (904, "tie", "d", "2"), (905, "tie", "d", "3"), (906, "one two", "e", "x"), (907, "three", "e", "y")]
    return rows


def test_given_documents(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(read) == plain([(r.text, r.lang, r.source) for r in read.collect()])


@pytest.mark.parametrize(("tile", "block", "top"), [(256, 4096, 200), (2, 5, 3), (1, 10**6, 1)])
def test_odd_rows(spark, odd, monkeypatch, tile, block, top):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    df = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "1 AS term", "'x' AS place", "2 AS value")
    assert got(df, top=top) == plain([r[1:] for r in odd], top)


def test_long_text_and_large_counts(spark):
    long = "aa " * 700_000 + "bb cc " * 300 + "x" * 1_200_000
    rows = [(1, long, "a", "p"), (2, "aa bb cc", "a", "q"), (3, "aa bb bb dd cc", "a", "q"), (4, "dd dd", "a", "r"), (5, "dd", "a", "p")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain([r[1:] for r in rows])


def test_scaled_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (10**15 + 7, 3 * 10**15 + 1, 12345), (7, 10**12, 1), (10**9, 10**9, 999)]
    rows = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.scaled(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in rows)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(SF, 'documents.parquet')}'")
    want = db.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.OP11_SQL})").fetchall()
    assert {tuple(r) for r in want} == {tuple(r) for r in divergence.op11_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()}
