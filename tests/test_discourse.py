"""Names, networks, bursts, annotators and signifiers, each against a plain version."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import analytics, annotators, bursts, graph, names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    base = ["".join(rng.choices("abcde ", k=rng.randint(1, 30))).strip() or "x" for _ in range(60)]
    out = set(base)
    for _ in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choices("abcdeé", k=rng.randint(0, 1))
        out.add("".join(w))
    return sorted(out - {""}) + ["aaaaaaaaaaaa", "aaaaaaaaaaaaaa", "abababababab", "babababababa"]


@pytest.mark.parametrize("ratio", [3, 6])
def test_similar_names_equal_brute_force(spark, spelled, ratio):
    got = {(r.a, r.b, r.distance) for r in names.similar(spark.createDataFrame([(x,) for x in spelled], "name string"), ratio=ratio).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(sorted(set(spelled)), 2) if (d := distance(a, b)) <= max(len(a), len(b)) // ratio}
    assert got == want and len(want) > 30


def test_no_stage_compares_all_pairs(spark):
    """Of names with nothing but common letters, few share a rare q-gram."""
    rng = random.Random(2)
    rows = [("".join(rng.choices("abcdefghijklmnop", k=18)),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "name string")
    assert names.similar(df).count() == 0
    each = df.select("name", F.explode(names.grams(F.col("name"))).alias("g"))
    assert each.count() == 1500 * 19


def test_merged_names(spark):
    rows = ["Juan Pérez Castillo", "juan perez castillo", "Juan Perez Castilo!", "Juan Pérez Castillo", "juan  pérez castillo", "Nato", None, "...", "Nato", "Otan"]
    got = {r.canonical: (r.label, r.n) for r in names.merged(spark.createDataFrame([(x,) for x in rows], "n string"), "n").collect()}
    assert got == {"juan pérez castillo": ("juan pérez castillo", 3), "juan perez castillo": ("juan pérez castillo", 1), "juan perez castilo": ("juan pérez castillo", 1), "nato": ("nato", 2), "otan": ("otan", 1), "": ("", 1)}
    assert names.merged(spark.createDataFrame([], "n string"), "n").count() == 0


def plain_components(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(5)
    some = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    return some + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)] + [(300, 300), (301, 302), (302, 301), (301, 302)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_components(spark, edges):
    real = [e for e in edges if e[0] != e[1]]
    assert {r.node: r.component for r in graph.components(frame(spark, [*edges, (None, 3)])).collect()} == plain_components(real)
    assert graph.components(frame(spark, [])).count() == 0


def neighbours(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_cores(spark, edges):
    dense = edges + list(itertools.combinations(range(400, 407), 2)) + [(400, 1), (406, 120)]
    near, want = neighbours(dense), {}
    left, k = {x: set(y) for x, y in near.items()}, 0
    while left:
        x = min(left, key=lambda n: len(left[n]))
        k = max(k, len(left[x]))
        want[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r.node: r.core for r in graph.cores(frame(spark, dense)).collect()} == want


def test_communities(spark):
    groups = [list(itertools.combinations(range(b, b + 6), 2)) for b in (0, 10, 20)]
    found = graph.communities(frame(spark, [*sum(groups, []), (5, 10), (15, 20)]))
    by = collections.defaultdict(set)
    for r in found.collect():
        by[r.community].add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(b, b + 6)) for b in (0, 10, 20)]


def plain_betweenness(edges):
    near, out = neighbours(edges), collections.Counter()
    for s in near:
        depth, paths, order = {s: 0}, collections.Counter({s: 1}), [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        share = collections.Counter()
        for x in reversed(order):
            for y in near[x]:
                if depth[y] == depth[x] + 1:
                    share[x] += paths[x] / paths[y] * (1 + share[y])
            if x != s:
                out[x] += share[x] / 2
    return {x: out[x] for x in near}


def test_betweenness(spark, edges):
    some = [e for e in edges if e[0] < 100 or e[0] >= 200] + [(500, 501), (501, 502), (502, 503)]
    got = {r.node: r.betweenness for r in graph.betweenness(frame(spark, some)).collect()}
    want = plain_betweenness(some)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    star = {r.node: r.betweenness for r in graph.betweenness(frame(spark, [(0, i) for i in range(1, 30)]), pivots=5).collect()}
    assert star[0] > 0 and all(v == 0 for x, v in star.items() if x)


def test_bursts_take_the_cheapest_way():
    rng = np.random.default_rng(1)
    for _ in range(20):
        hits, rows = rng.integers(0, 9, 6).astype(float), np.full(6, 10.0)
        if not hits.sum():
            continue
        cost, up = bursts.costs(hits, rows, 3, 1.7), 0.8
        ways = itertools.product(range(3), repeat=6)
        total = lambda w: sum(cost[d, s] for d, s in enumerate(w)) + up * sum(max(0, b - a) for a, b in zip((0, *w), w, strict=False))
        best = min(map(total, ways))
        assert abs(total(tuple(bursts.cheapest(cost, up))) - best) < 1e-9


def test_bursts(spark):
    rows = [(f"2024-01-{d:02}", k) for d in range(1, 21) for k in ["flat"] * 10 + ["peak"] * (20 if 8 <= d <= 11 else 1) + ["other"] * 60] + [(None, "peak"), ("2024-01-02", None)]
    got = {(r.term, r.level, str(r.begin), str(r.end), r.n) for r in bursts.bursts(spark.createDataFrame(rows, "ts string, tag string").withColumn("ts", F.to_timestamp("ts")), "ts", "tag").collect()}
    assert got >= {("peak", 1, "2024-01-08", "2024-01-11", 80)} and {x[0] for x in got} == {"peak"}
    assert bursts.bursts(spark.createDataFrame([], "ts timestamp, tag string"), "ts", "tag").count() == 0


def plain_dawid_skene(rows, rounds, smooth):
    labels, items, who = (sorted({r[k] for r in rows}) for k in (2, 0, 1))
    p = {i: {j: sum(r[2] == j for r in rows if r[0] == i) / sum(r[0] == i for r in rows) for j in labels} for i in items}
    for _ in range(rounds):
        pi = {a: {j: {y: smooth + sum(p[r[0]][j] for r in rows if r[1] == a and r[2] == y) for y in labels} for j in labels} for a in who}
        for a in who:
            for j in labels:
                s = sum(pi[a][j].values())
                pi[a][j] = {y: v / s for y, v in pi[a][j].items()}
        prior = {j: sum(p[i][j] for i in items) for j in labels}
        for i in items:
            e = {j: prior[j] * math.prod(pi[r[1]][j][r[2]] for r in rows if r[0] == i) for j in labels}
            s = sum(e.values())
            p[i] = {j: v / s for j, v in e.items()}
    return p, pi


def test_annotators(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        truth = rng.choice("abc")
        rows += [(i, w, truth if rng.random() < good else rng.choice("abc")) for w, good in (("x", 0.95), ("y", 0.8), ("z", 0.3)) if rng.random() < 0.9]
    rows += [(99, "x", "a")]
    df = spark.createDataFrame([*rows, (None, "x", "a"), (1, None, "a"), (1, "x", None)], "item long, annotator string, label string")
    truth, matrix = annotators.dawid_skene(df, rounds=4, tolerance=0)
    p, pi = plain_dawid_skene(rows, 4, 0.01)
    assert all(abs(r.p - p[r.item][r.label]) < 1e-9 for r in truth.collect()) and truth.count() == 3 * len(p)
    assert all(abs(r.p - pi[r.annotator][r.truth][r.label]) < 1e-9 for r in matrix.collect()) and matrix.count() == 27
    assert {(r.item, r.label): r.share for r in annotators.majority(df).collect()}[99, "a"] == 1
    one, _ = annotators.dawid_skene(df.where("annotator = 'x'"))
    assert all(abs(r.p - 1) < 0.1 for r in one.groupBy("item").agg(F.max("p").alias("p")).collect())
    assert annotators.dawid_skene(df.limit(0))[0].count() == 0


def test_alpha(spark):
    rows = [("u1", "a", 1), ("u1", "b", 1), ("u2", "a", 2), ("u2", "b", 2), ("u2", "c", 1), ("u3", "a", 3), ("u4", "b", 3), ("u4", "c", 3), ("u5", None, 1)]
    units = collections.defaultdict(list)
    for u, w, v in rows:
        if w:
            units[u].append(v)
    o = collections.Counter()
    for vs in units.values():
        for x, y in itertools.permutations(range(len(vs)), 2):
            o[vs[x], vs[y]] += 1 / (len(vs) - 1)
    n_c = collections.Counter()
    for (c, _), v in o.items():
        n_c[c] += v
    n = sum(n_c.values())
    want = 1 - (n - 1) * sum(v for (c, k), v in o.items() if c != k) / sum(n_c[c] * n_c[k] for c in n_c for k in n_c if c != k)
    got = annotators.alpha(spark.createDataFrame(rows, "item string, annotator string, label int")).first()
    assert got.n == 7 and abs(got.alpha - want) < 1e-12
    assert annotators.alpha(spark.createDataFrame(rows[:2], "item string, annotator string, label int")).first().alpha is None


def test_log_odds(spark):
    rows = [("l", "tax")] * 8 + [("l", "people")] * 3 + [("r", "people")] * 9 + [("r", "border")] * 4 + [("c", "tax")] + [(None, "tax"), ("l", None)]
    counts, n = collections.Counter(r for r in rows if None not in r), 25
    prior = n / 3
    for r in analytics.log_odds(spark.createDataFrame(rows, "g string, s string"), "g", "s").collect():
        y, size = counts[r.group, r.signifier], sum(v for (g, _), v in counts.items() if g == r.group)
        al = sum(v for (_, s), v in counts.items() if s == r.signifier)
        a, rest, left = al * prior / n, al - y, n - size
        delta = math.log((y + a) / (size + prior - y - a)) - math.log((rest + a) / (left + prior - rest - a))
        assert (r.n, r.others) == (y, rest) and abs(r.delta - delta) < 1e-12 and abs(r.z - delta / math.sqrt(1 / (y + a) + 1 / (rest + a))) < 1e-12
    assert analytics.log_odds(spark.createDataFrame([], "g string, s string"), "g", "s").count() == 0
    assert analytics.log_odds(spark.createDataFrame([("a", "x"), ("b", "x")], "g string, s string"), "g", "s").first().delta is None


@pytest.mark.parametrize("closed", [True, False])
def test_chains_equal_enumeration(spark, closed):
    from agora.operators.chains import chains

    rng = random.Random(9)
    baskets = {k: {e for e in "abcdef" if rng.random() < (0.9 if e == "a" else 0.45)} | ({"x", "y"} if k % 3 == 0 else set()) for k in range(90)}
    rows = [(k, e) for k, es in baskets.items() for e in es for _ in range(1 + k % 2)] + [(None, "a"), (1, None)]
    n = {s: sum(set(s) <= b for b in baskets.values()) for r in range(1, 9) for s in itertools.combinations("abcdefxy", r)}
    often = {s: v for s, v in n.items() if v >= 9}
    want = {s: v for s, v in often.items() if len(s) > 1 and not (closed and any(set(s) < set(u) and w == v for u, w in often.items()))}
    got = {tuple(r.elements): r.n for r in chains(spark.createDataFrame(rows, "k int, e string"), "k", "e", 9 / sum(map(bool, baskets.values())) - 1e-9, closed).collect()}
    assert got == want and len(want) > 10


def test_keys_of_very_many_items_meet_elsewhere(spark):
    """Rows that are made for pairs grow with the items of the two largest keys, not with their square; all counts stay."""
    from agora.operators.analytics import cooccurrence, meetings

    rng = random.Random(5)
    many = {(f"large{k}", i) for k in range(2) for i in range(3000) if (i + k) % 7}
    few = {(f"s{k}", i) for k in range(4000) for i in rng.sample(range(3000), 3)} | {(f"again{k}", i) for k in range(2) for i in (3, 5, 2999)}
    rows = sorted(many | few)
    by, want = {}, {}
    for k, i in rows:
        by.setdefault(i, set()).add(k)
    seen = spark.createDataFrame(rows, "k string, a int")
    assert meetings(seen, 3).count() < 5 * len(rows)
    for a in by:
        for b in by:
            if a < b and (n := len(by[a] & by[b])) >= 3:
                want[a, b] = n
    assert {(r.a, r.b): r.n for r in cooccurrence(seen, "k", "a", 3).collect()} == want
    assert want[3, 5] >= 3


@pytest.mark.parametrize("least", [2, 3, 5])
@pytest.mark.parametrize("large", [0, 4, 20, 1000])
def test_pairs_do_not_depend_on_what_is_large(spark, least, large):
    from agora.operators.analytics import meetings

    rng = random.Random(least)
    keys = {k: set(rng.sample(range(40), rng.choice((2, 3, 5, 25, 30)))) for k in range(40)}
    keys[40] = keys[41] = keys[42] = keys[43] = set(range(40))
    want = {(a, b): n for a in range(40) for b in range(a + 1, 40) if (n := sum({a, b} <= s for s in keys.values())) >= least}
    seen = spark.createDataFrame([(k, a) for k, s in keys.items() for a in s], "k int, a int")
    got = meetings(seen, least, large).groupBy("a", "b").agg({"*": "count", "besides": "max"}).collect()
    assert {(r.a, r.b): n for r in got if (n := r["count(1)"] + r["max(besides)"]) >= least} == want
