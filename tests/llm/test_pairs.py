"""Near-duplicates, decontamination and the pipeline."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from agora.llm import decontam, neardup
from agora.llm.common import mix

from ..conftest import SF


def weights(t):
    w = (t or "").split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (collections.Counter([tuple(w)]) if w else collections.Counter())


def jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def plain_classes(rows):
    s = {i: weights(t) for i, t in rows}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(s, 2):
        if s[a] == s[b] or len(s[a].keys() & s[b].keys()) > 0.5 * len(s[a]) and jaccard(s[a], s[b]) >= 0.8:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: top(i) for i in s}


def test_signature_estimates_probability_jaccard():
    x, y = collections.Counter(a=1, b=2, c=3, d=1), collections.Counter(a=2, b=2, c=1, e=1)
    doc = np.repeat([0, 1], 4)
    g = mix(np.array([ord(k) for w in (x, y) for k in w], np.uint64))
    sig = neardup.signatures(doc, g, np.array([v for w in (x, y) for v in w.values()]), 2, 20_000)
    pack = [(np.sort(g[doc == d]), np.array(list(w.values()))[np.argsort(g[doc == d])]) for d, w in enumerate((x, y))]
    assert abs(neardup.similarity(*pack) - jaccard(x, y)) < 1e-12
    assert abs((sig[0] == sig[1]).mean() - jaccard(x, y)) < 0.02


def test_classes(docs, rows, empty):
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == plain_classes(rows)
    assert neardup.classes(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 3])
def test_groups_of_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):
        base = [f"w{rng.integers(10**6)}" for _ in range(150)]
        for k in range(25):
            w = list(base)
            for p in rng.choice(150, rng.integers(0, 5), replace=False):
                w[p] = f"x{rng.integers(10**6)}"
            rows.append((100 * g + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_texts_that_share_an_id_are_compared_each(spark):
    a, b = ([f"{x}{k}" for k in range(100)] for x in "ab")
    rows = [(1, a), (1, b), (2, [*a[:-1], "end"]), (3, [*b[:-1], "end"]), (1, a)]
    got = {(r.doc_id, r.class_id, r.rep_id) for r in neardup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 3)}


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 100), (7, 3)]
    got = {r.v: r.c for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def plain_tiles(a, b, k):
    """Longest unmarked common run first, smallest begins first, by looking at every pair of positions."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return out
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiling_is_greedy():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = rng.integers(0, 3, rng.integers(3, 40)), rng.integers(0, 3, rng.integers(3, 25))
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i : i + 3] == b[j : j + 3]).all()]
        assert decontam.tiles(seeds, a, b, 3) == plain_tiles(a.tolist(), b.tolist(), 3)


def test_matches_of_repeated_tokens(monkeypatch):
    """Matches equal those of all pairs of seeds; one token repeated 20,000 and 1,000 times makes no list of pairs."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(decontam, "PAIRS", 50)
    for _ in range(60):
        a, b = rng.integers(0, 2, rng.integers(3, 40)), rng.integers(0, 2, rng.integers(3, 25))
        lists = [np.array([j for j in range(len(b) - 2) if (a[i : i + 3] == b[j : j + 3]).all()], np.int64) for i in range(len(a) - 2)]
        at = np.flatnonzero([len(x) for x in lists])
        if not len(at):
            continue
        seeds = [(i, j) for i, x in enumerate(lists) for j in x.tolist()]
        got = decontam.matches(a, b, at, [lists[i] for i in at.tolist()], 3)
        assert sorted(got) == sorted(decontam.runs_of(seeds, 3))
        assert decontam.tiled(got, len(a), len(b), 3) == plain_tiles(a.tolist(), b.tolist(), 3)
    monkeypatch.setattr(decontam, "PAIRS", 1 << 20)
    h, item = np.full(20_000, 7, np.uint64), np.full(1_000, 7, np.uint64)
    assert [x[:4] for x in decontam.Index.built(pa.array([5]), [item], 5).match(h, 0.6)] == [(5, 1, 1000, 1000)]


def test_leaks(spark, docs, empty):
    item = " ".join(f"tok{i}" for i in range(30))
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, "One two"), (3, None), (4, ""), (5, item.upper())], "item_id long, text string")
    moved = " ".join(w[15:] + ["between", "these"] + w[:15])
    data = [(1, f"before. {item}, after"), (2, moved), (3, " ".join(w[:10]) + " else"), (4, "so one, TWO done"), (5, None), (6, ""), (7, " ".join(x for p in zip(w, w, strict=True) for x in p)), (1, f"before. {item}, after")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    for block in (1, 10**6):
        got = sorted((r.doc_id, r.item_id, r.n_tiles, round(r.coverage, 2)) for r in decontam.leaks(d, bench, block_tokens=block).collect())
        assert got == [(1, 1, 1, 1.0), (1, 1, 1, 1.0), (2, 1, 2, 1.0), (4, 2, 1, 1.0)]
        assert sorted(r.doc_id for r in decontam.without_leaks(d, bench, block_tokens=block).collect()) == [3, 5, 6, 7]
    assert decontam.leaks(empty, bench).count() == decontam.leaks(docs, bench.limit(0)).count() == 0


def plain_leaks(docs, items, k=5, coverage=0.6):
    """(id, item, tiles, tokens covered) by tiling every text against every item, on tokens themselves."""
    tokens = lambda text: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own, out = {}, []
    for i, text in items:
        if t := tuple(tokens(text)):
            own[t] = i if t not in own else min(own[t], i)
    for d, text in docs:
        a = tokens(text)
        for b, i in own.items():
            n = min(k, len(b))
            if not {tuple(a[x : x + n]) for x in range(len(a) - n + 1)} & {b[x : x + n] for x in range(len(b) - n + 1)}:
                continue
            got = plain_tiles(a, list(b), n)
            if (covered := sum(x[2] for x in got)) >= coverage * len(b):
                out.append((d, i, len(got), covered))
    return sorted(out)


def test_leaks_of_a_table_equal_plain_tiling(spark):
    """Blocks of one item, of some and of all; ids that are texts; many texts that share passages with many items."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 6, n)]
    passages = [word(9) for _ in range(12)]
    pick = lambda: [w for x in rng.integers(0, 12, 3) for w in passages[x]]
    items = [(f"item-{n}", " ".join(pick())) for n in range(25)] + [("again", "W1 w2"), ("short", "w1, w2"), ("none", None)]
    docs = [(f"doc-{n}", " ".join(pick() + word(8) + pick())) for n in range(20)] + [("empty", ""), ("null", None), ("tiny", "w1 w2")]
    want = plain_leaks(docs, items)
    assert len(want) > 50
    d, bench = spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame(items, "key string, passage string")
    for block in (1, 200, 10**6):
        names = {"text_col": "body", "item_col": "key", "item_text_col": "passage", "block_tokens": block}
        got = decontam.leaks(d, bench, id_col="name", **names)
        assert got.columns == ["name", "key", "n_tiles", "n_covered", "n_item_tokens", "coverage"]
        assert sorted(tuple(r)[:4] for r in got.collect()) == want
        assert sorted(r.name for r in decontam.without_leaks(d, bench, **names).collect()) == sorted(n for n, _ in docs if n not in {w[0] for w in want})


def test_leaks_of_the_documents_equal_plain_tiling(spark):
    rows = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in decontam.op10_decontam(spark, SF).collect())
    assert got == plain_leaks(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"))
    assert got


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
    out = p.run(spark, SF)
    assert out.count() == docs.count() and {"doc_id", "ids_sha256"} <= set(out.columns)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    none = docs.limit(0)
    for _, stage in p.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_pipeline_with_odd_rows(spark, docs, tmp_path):
    """Nulls in every column, repeated rows, an empty and a long text, columns that clash; decisions against each operator's own."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    full = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", None, 0), (-3, "word " * 60_000, "fr", "s", 300_000), (-3, "word " * 60_000, "fr", "s", 300_000)]
    d = full.unionByName(spark.createDataFrame(odd, full.schema)).withColumns({"n_removed": F.lit(7), "__id": F.lit("c"), "score": F.lit(None).cast("double"), "class_id": F.lit(1), "key": F.lit(2)})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path)).cache()
        assert out.schema.names == d.schema.names and out.where("n_removed = 7").count() == out.count(), name
        if name == "MinHash near-dedup":
            kept = {r.doc_id for r in neardup.classes(now).collect() if r.doc_id == r.class_id}
            assert {r.doc_id for r in out.collect()} == kept | {None}
        elif name == "benchmark decontamination":
            bad = {r.doc_id for r in decontam.leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()} - bad
        now = out
    last = p.run(spark, str(tmp_path))
    assert sorted((r.doc_id for r in last.collect()), key=str) == sorted((r.doc_id for r in now.collect()), key=str)
