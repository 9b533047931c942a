"""Operators that give one row per text, against plain versions of their contracts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from agora.llm import hmm, lines, pieces, quality, sharding, suffixes, toxicity, urls

from ..conftest import SF


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_quality_statistics(docs, rows, empty):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(tri)
        covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered)

    got = by_id(quality.statistics(docs))
    for i, t in rows:
        assert all(tuple(r)[1:6] == plain(t) for r in got[i]), i
    labels = docs.sparkSession.createDataFrame([(-3, 0), (-3, None), (None, 1)], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == len(rows)
    assert quality.judge(empty, labels.limit(0)).count() == 0


def test_quality_verdicts_follow_the_rules(spark, docs):
    """kept, against the learned rules applied in plain Python to the statistics."""
    rng = np.random.default_rng(13)
    words = [f"word{k}" for k in range(300)]
    data = [(i, " ".join([*rng.choice(words, 80), *(["#x|", "<9>"] * 15 if i % 4 == 0 else [])])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    d = spark.createDataFrame([*data, (None, data[0][1]), (500, None), (501, "")], "doc_id long, text string")
    stats = quality.statistics(d)
    rules = quality.learn(*quality.sample(stats, labels, "doc_id", "quality", 20_000))
    assert rules
    names = list(quality.FEATURES)
    rows = stats.selectExpr("doc_id", "n_words", "n_repeat_words", *(f"cast({e} AS double) AS f{k}" for k, e in enumerate(quality.FEATURES.values()))).collect()

    def plain(r):
        x = r[3 : 3 + len(names)]
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        return not failed and not any(all(x[f] >= t if above else x[f] <= t for f, above, t in rule) for rule in rules)

    got = {r.doc_id: r.kept for r in quality.judge(d, labels).collect()}
    assert got == {r.doc_id: plain(r) for r in rows}
    assert all(not got[i] for i in range(0, 400, 4)) and sum(got[i] for i in range(400) if i % 4) > 280 and not got[None]


def test_quality_sample_counts_an_id_once(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1)) for i in range(30) for _ in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    x, bad = quality.sample(quality.statistics(docs), labels, "doc_id", "quality", 10)
    assert len(x) == len(bad) == len(set(x[:, 0])) == 10


def test_decision_list():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    hit = np.zeros(len(x), bool)
    for rule in quality.learn(x, bad):
        hit |= quality._cover(x, rule)
    assert (hit == bad).mean() > 0.98 and bad[hit].mean() > 0.97
    assert quality.learn(x[:0], bad[:0]) == []


def test_lines_of_null_ids_and_clashing_names(spark):
    t = "one line that is long enough to be a run all by itself, because it has more than one hundred characters in it\nsecond"
    rows = [(None, t, 1, "x", 9), (5, t, 2, "y", 8), (None, t, 3, "z", 7), (4, t, 4, "w", 6)]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines long, __id string, __gone long"))
    got = sorted((r["__id"], r.text, r.n_lines, r["n_lines_"], r.n_removed, r["__gone"]) for r in out.collect())
    assert got == [("w", t, 4, 2, 0, 6), ("x", "", 1, 2, 2, 9), ("y", "", 2, 2, 2, 8), ("z", "", 3, 2, 2, 7)]


def test_very_long_texts(spark):
    """Texts of several hashing blocks: pieces, suffixes and language model see them whole."""
    rng = np.random.default_rng(15)
    body = " ".join(f"tok{x}" for x in rng.integers(0, 5000, 180_000).tolist())
    docs = spark.createDataFrame([(1, body), (2, "start " + body[700_000:] + " end"), (3, "short")], "doc_id long, text string")
    enc = pieces.encoder(pieces.model_path())
    n = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in pieces.encode(docs, pieces.model_path()).collect()}
    assert n[1] == (len(ids := enc.sp.encode(body)), hashlib.sha256(enc.sp.decode(ids).encode()).hexdigest())
    kept = {r.doc_id: r.kept.decode() for r in suffixes.repeats(docs, with_text=True).collect()}
    assert kept[1] == body and len(kept[2]) < 60 and kept[2].startswith("start ")
    assert {r.doc_id: r.n_tokens for r in hmm.score(docs).collect()} == {1: 180_001, 2: len(body[700_000:].split()) + 3, 3: 2}


@pytest.mark.parametrize("small", [1, 1000])
def test_repeated_strings(docs, rows, empty, small):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    got = by_id(suffixes.repeats(docs, small=small))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        want = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
        assert all(tuple(r)[1:] == want for r in got[i]), i
    assert suffixes.repeats(empty).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 20_000).astype(np.uint8)
    offsets = np.array([0, 300, 310, 20_000])

    def windows():
        doc, begin, many, key, _ = suffixes.contexts(data, offsets, 50, 20)
        return sorted((d, s + k, x) for d, s, n, x in zip(doc.tolist(), begin.tolist(), many.tolist(), key.tolist(), strict=True) for k in range(n))

    whole = windows()
    assert len(whole) == 300 - 49 + 19_690 - 49
    monkeypatch.setattr(suffixes, "PIECE", 700)
    assert whole == windows()


def test_a_passage_of_many_texts(spark):
    """A q-gram of thousands of texts with different surroundings: the same path, whatever the limit for dealing windows singly."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(70)
    rows = [(i, word(60) + passage + word(60)) for i in range(5000)]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), with_text=True)
    same = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True, small=10**9)
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for r in (out := got.collect()):
        t = rows[r.doc_id][1]
        gone = {k + x for k in range(len(t) - 49) if first[t[k : k + 50]] < r.doc_id for x in range(50)}
        assert r.kept.decode() == "".join(c for k, c in enumerate(t) if k not in gone) and (r.n_removed >= 70 or r.doc_id == 0)
    assert sorted(map(tuple, out)) == sorted(map(tuple, same.collect()))


def test_large_ids_and_null_ids(spark):
    t = "x" * 10 + "the same passage of more than fifty bytes, in every text" + "y" * 10
    rows = [(2**63 - 1, t), (None, t), (None, t), (7, t), (-(2**63), t)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2**63 - 1, len(t)), (None, len(t)), (None, len(t)), (7, len(t)), (-(2**63), 0)], key=str)


def test_refined_buckets():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, 400).astype(np.uint8)
    data = np.concatenate((base, base[50:300], rng.integers(97, 99, 200).astype(np.uint8), base[:120], np.zeros(120, np.uint8)))
    at = np.arange(len(data) - 170)
    at = at[rng.random(len(at)) < 0.2]
    got = suffixes.refined(data, at, 50)
    strings = [data[i : i + 50].tobytes() for i in at]
    assert len(set(zip(got.tolist(), strings, strict=True))) == len(set(strings)) == len(set(got.tolist()))


def test_pieces(docs, rows, empty):
    enc = pieces.encoder(pieces.model_path())
    got = by_id(pieces.encode(docs, pieces.model_path()))
    for i, t in rows:
        ids = enc.sp.encode(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.sp.decode(ids).encode()).hexdigest())
        assert all(tuple(r)[1:4] == want for r in got[i]), i
    assert pieces.encode(empty, pieces.model_path()).count() == 0


@pytest.mark.parametrize("text", ["a  b", " ", "▁", "▁ ▁x", "  lead", "trail  ", "\t\n", "日本 é\0x", "x" * 500, "a▁b c"])
def test_piece_spans(spark, text):
    enc = pieces.encoder(pieces.model_path())
    r = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces.model_path(), spans=True).first()
    raw = text.encode()
    assert r.ids == enc.sp.encode(text) and r.decoded == enc.sp.decode(r.ids)
    assert r.ends[-1] == len(raw) and r.begins[0] == 0 and r.begins[1:] == r.ends[:-1]
    for n, (i, s, e) in enumerate(zip(r.ids, r.begins, r.ends, strict=True)):
        piece = raw[s:e].decode("utf-8", "ignore").replace("▁", " ")
        want = enc.text[i].decode("utf-8", "ignore")
        assert piece == (want[1:] if n == 0 and want[:1] == " " else want)


def test_compiled_map_takes_the_longest_key():
    units = [0] * 1024  # a double array with the keys "a" -> "x" and "ab" -> "yz"
    unit = lambda offset, label, leaf: offset << 10 | label | leaf << 8
    units[0] = 256 << 10
    node = 256 ^ ord("a")
    units[node] = unit(512, ord("a"), 1)
    below = node ^ 512
    units[below] = 1 << 31 | 0
    nxt = below ^ ord("b")
    units[nxt] = unit(768, ord("b"), 1)
    units[nxt ^ 768] = 1 << 31 | 2
    trie = b"".join(u.to_bytes(4, "little") for u in units)
    m = pieces.CharMap(len(trie).to_bytes(4, "little") + trie + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    enc = object.__new__(pieces.Encoder)
    enc.map, enc.dummy, enc.squeeze = m, True, True
    text, align = enc.normalise("  ab  a ")
    assert text == "▁yz▁x" and align.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 6, 7]


def test_language_model(docs, rows, empty):
    tokens = {n: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for n, (_, t) in enumerate(rows)}
    c = collections.Counter(w for n, (i, _) in enumerate(rows) if zlib.crc32(str(i).encode()) % 10 for w in tokens[n])
    total, v = sum(c.values()), len(c)
    got = by_id(hmm.score(docs))
    base = score = 0
    for n, (i, _) in enumerate(rows):
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in tokens[n])
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(tokens[n]), sum(c[w] > 0 for w in tokens[n]), total)
            assert abs(r.base_score - want) < 1e-6
            if r.held_out:
                base, score = base + r.base_score, score + r.score
    assert score > base
    assert hmm.score(empty).count() == 0


def test_forward_is_exact_and_training_climbs():
    rng = np.random.default_rng(0)
    m = hmm.Model(np.arange(10, dtype=np.uint64), rng.integers(1, 9, 10), 100, 30, 3)
    m.step, m.emit, m.start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(11), 3), rng.dirichlet(np.ones(3))
    sizes = np.array([1, 5, 64, 65, 200])
    sym = rng.integers(0, 11, sizes.sum())
    for n, begin, got in zip(sizes, np.cumsum(sizes) - sizes, hmm.forward(m, sym, sizes), strict=True):
        a = m.start * m.emit[:, sym[begin]]
        for t in range(1, n):
            a = (a @ m.step) * m.emit[:, sym[begin + t]]
        assert abs(got - math.log10(a.sum())) < 1e-9
    sizes = np.full(40, 60)
    sym = np.repeat(rng.integers(0, 11, 240), 10)
    seen = []
    for _ in range(5):
        seen.append(hmm.forward(m, sym, sizes).sum())
        m.update(hmm.expected(m, sym, sizes))
    assert seen == sorted(seen)
    p = sum(10 ** hmm.forward(m, np.array([a, b]), np.array([2]))[0] for a in range(11) for b in range(11))
    assert abs(p - 1) < 1e-9


def test_expectations_are_those_of_whole_texts():
    """Against forward-backward over each text in one go, long texts of several stretches included."""
    rng = np.random.default_rng(3)
    m = hmm.Model(np.arange(6, dtype=np.uint64), rng.integers(1, 9, 6), 100, 30, 3)
    m.step, m.emit, m.start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3), rng.dirichlet(np.ones(3))
    sizes = np.array([1, 300, 64, 2, 65, 128, 129])
    sym = rng.integers(0, 7, sizes.sum())
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 7))
    for n, begin in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True):
        x = sym[begin : begin + n]
        alpha, beta = np.empty((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.step) * m.emit[:, x[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = m.step @ (m.emit[:, x[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta / (alpha * beta).sum(1, keepdims=True)
        starts += gamma[0]
        for t in range(n):
            emits[:, x[t]] += gamma[t]
            if t:
                xi = alpha[t - 1][:, None] * m.step * (m.emit[:, x[t]] * beta[t])[None]
                steps += xi / xi.sum()
    assert np.allclose(hmm.expected(m, sym, sizes), np.concatenate((starts, steps.ravel(), emits.ravel())))


def test_ranges_of_hashes():
    rng = np.random.default_rng(2)
    hashes = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 500, 3)]
    got = [np.concatenate([h[s:e] for h, (s, e) in zip(hashes, cut, strict=True)]) for cut in hmm._ranges(hashes, 100)]
    assert len(got) > 4 and sum(map(len, got)) == 503
    assert all(a.max() < b.min() for a, b in zip(got, got[1:], strict=False) if len(a) and len(b))


def test_sharding_in_levels(docs, monkeypatch):
    """Many blocks, combined on several levels: the laws hold, and the order of the rows does not matter."""
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    got = sharding.shard(docs, 4).collect()
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values())
    again = sharding.shard(docs.repartition(5, "text"), 4).collect()
    assert sorted((r.doc_id, r.text_crc32, r.shard) for r in got) == sorted((r.doc_id, r.text_crc32, r.shard) for r in again)


def test_differencing_equals_a_plain_version():
    """The same places as a plain run of the method that keeps lists of members."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        weights = sorted(rng.integers(1, 60, rng.integers(1, 25)).tolist(), reverse=True)
        parts = [[(w, [n]), (0, []), (0, [])] for n, w in enumerate(weights)]
        turn = [(-w, n) for n, w in enumerate(weights)]
        alive = dict(enumerate(parts))
        while len(turn) > 1:
            turn.sort()
            (_, x), (_, y) = turn[:2]
            a, b = alive.pop(x), alive.pop(y)
            joined = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
            turn = [*turn[2:], (joined[-1][0] - joined[0][0], len(parts))]
            alive[len(parts)] = joined
            parts.append(joined)
        plain = sorted(p[0] for p in alive.popitem()[1])
        places, loads = sharding.differencing([[w, 0, 0] for w in weights])
        assert sorted(loads) == plain
        assert [sum(w for w, p in zip(weights, places[:, 0].tolist(), strict=True) if p == s) for s in range(3)] == list(loads)


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    slots, place, load = collections.defaultdict(list), {}, collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0], x[1] or "")), sorted(got, key=lambda r: (r.doc_id, r.text_crc32)), strict=True):
        assert (r.doc_id, r.size, r.text_crc32) == (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert place.setdefault(t or "", r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 16
    assert sharding.shard(empty).count() == 0


def test_differencing_blocks(monkeypatch, docs):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 7)
    places, loads = sharding.differencing([[w, 0, 0] for w in (8, 7, 6, 5, 4)])
    assert sorted(loads) == [8, 11, 11] or max(loads) - min(loads) <= 3
    back = [0, 0, 0]
    for w, p in zip((8, 7, 6, 5, 4), places, strict=True):
        back[p[0]] += w
    assert back == list(loads)
    assert sharding.differencing([[3, 1]])[1] == [3, 1]


def test_toxicity(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns_held_out_forms(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{rng.integers(10**6)}" for _ in range(500)]
    data, marks = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 40))
        toxic = i % 6 == 0
        if toxic:
            w[5], w[20] = f"nastyy{rng.integers(10**6)}", "vileword"
        data.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    out = toxicity.scores(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in out.collect())


def test_toxicity_compares_every_text(spark):
    """Few labels and no word that reaches the evidence: a copy of a labelled text is still found, at cosine 1."""
    data = [(i, " ".join(f"w{i}x{k} common{k}" for k in range(20))) for i in range(30)]
    copy = next(i for i, _ in data if zlib.crc32(str(i).encode()) % 5)
    out = toxicity.scores(spark.createDataFrame([*data, (100, data[copy][1])], "doc_id long, text string"), spark.createDataFrame([(i, int(i == copy)) for i, _ in data], "doc_id long, toxic int"))
    found = {r.doc_id: r.evidence for r in out.collect()}
    assert found[100][0].id == copy and found[100][0].label == 1 and abs(found[100][0].cosine - 1) < 1e-9
    assert all(found.values())


def test_toxicity_score_equals_a_dense_one(spark):
    """Features, weights, cosines, votes and calibration of all texts, once more with dictionaries and all pairs."""
    rng = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(120)]
    data = [(i, " ".join([*rng.choice(vocabulary, rng.integers(3, 30)), *(["bad"] if i % 5 == 0 and i % 3 else []), *(["Worse"] if i % 10 == 0 else [])])) for i in range(300)]
    data += [(300, None), (301, ""), (302, "unknown words only"), (303, data[7][1]), (None, data[10][1])]
    marks = {i: int(i % 5 == 0) for i in range(0, 300) if i % 4}
    train = {i: y for i, y in marks.items() if zlib.crc32(str(i).encode()) % 5}
    tokens = lambda t: collections.Counter(re.findall(r"[0-9a-z]+", (t or "").lower()))
    text = {i: tokens(t) for i, t in data}
    df = collections.Counter(w for _, t in data for w in tokens(t))
    p, n_docs = sum(train.values()) / len(train), len(data)

    def weight(w):
        n = sum(w in text[i] for i in train)
        bad = sum(w in text[i] for i, y in train.items() if y)
        share = bad / n
        ratio = 2 * ((bad * math.log(share / p) if bad else 0) + ((n - bad) * math.log((1 - share) / (1 - p)) if n > bad else 0))
        x = max(ratio, 0) * (share - p) / (1 - p) if share > p else 0
        return math.log(1 + n_docs / (1 + df[w])) * (1 + x * x / (x + 25))

    weights = {w: weight(w) for w in {w for i in train for w in text[i]}}

    def unit(t):
        v = {w: (1 + math.log(c)) * weights[w] for w, c in t.items() if w in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: unit(text[i]) for i in train}

    def vote(t, without=None):
        v = unit(t)
        sims = sorted(((-round(sum(x * e.get(w, 0) for w, x in v.items()), 12), i) for i, e in examples.items() if i != without))
        best = [(-c, i) for c, i in sims if c < 0][:15]
        w = [1 / (0.05 + max(0, 1 - c)) for c, _ in best]
        return sum(x * train[i] for x, (_, i) in zip(w, best, strict=True)) / sum(w) if best else None

    calibrated = toxicity.Calibration([(vote(text[i], i), y) for i, y in train.items()])
    got = toxicity.scores(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")).collect()
    assert len(got) == len(data)
    plain = {i: calibrated(vote(t)) for i, t in ((i, tokens(t)) for i, t in data)}
    assert all(abs(r.score - plain[r.doc_id]) < 1e-6 for r in got)
    assert len({r.evidence[0].label for r in got if r.evidence}) == 2 and next(r.held_out for r in got if r.doc_id is None)


def test_nearest_with_many_blocks(monkeypatch):
    """Blocks that the bounds rule out hold none of the nearest."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 16)
    rows = []
    for i in range(900):
        f = np.unique((i % 9) * 40 + rng.integers(0, 40, rng.integers(1, 25)))
        rows.append((i, 0, np.append(f, 360 + rng.integers(20)), rng.integers(1, 4, len(f) + 1)))
    index = toxicity.Index(rng.random(380) + 0.5, rows, 15)
    dense = np.zeros((900, 380))
    for x, i in enumerate(index.ids.tolist()):
        dense[x, rows[i][2]] = index.unit(*rows[i][2:])
    scored = []
    real = index._scored
    index._scored = lambda near, left, chosen, *a: (scored.append(chosen.sum()), real(near, left, chosen, *a))
    for (best, sims), (i, _, f, t) in zip(index.nearest_of([(f, index.unit(f, t), -1) for _, _, f, t in rows]), rows, strict=True):
        exact = dense @ dense[index.ids == i][0]
        order = np.lexsort((index.ids, -np.round(exact, 12)))[:15]
        assert best.tolist() == [x for x in order.tolist() if exact[x] > 0] and np.allclose(sims, exact[best])
    assert sum(scored) < 0.6 * 900 * index.blocks


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        f = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        rows.append((i, int(rng.integers(2)), f, rng.integers(1, 4, len(f))))
    index = toxicity.Index(rng.random(60) + 0.5, rows, 15)
    dense = np.zeros((len(rows), 60))
    place = {int(i): n for n, i in enumerate(index.ids)}
    for i, _, f, t in rows:
        dense[place[i], f] = index.unit(f, t)
    for i, _, f, t in rows[:60]:
        best, sims = index.nearest(f, index.unit(f, t))
        exact = dense @ dense[place[i]]
        order = np.lexsort((index.ids, -np.round(exact, 12)))[:15]  # ties by id
        assert best.tolist() == [x for x in order.tolist() if exact[x] > 0] and np.allclose(sims, exact[best])


def test_url_verdicts_equal_a_plain_propagation(spark):
    """A graph with cycles, hubs and hosts without links out: trust, distrust and verdicts, against sums over dictionaries."""
    rng = np.random.default_rng(14)
    hosts = [f"h{k}.info" for k in range(30)] + ["a.com", "b.com", "c.net", "d.org"]
    pages = []
    for n in range(200):
        h = hosts[int(rng.integers(len(hosts)))] if n % 3 else "h0.info"
        path = {"com": "/en/", "net": "/de/", "org": "/es/"}.get(h.split(".")[-1], "/x/") if rng.random() < 0.8 else "/other"
        out = [hosts[int(rng.integers(len(hosts)))] for _ in range(rng.integers(0, 4))] if h not in ("h5.info", "a.com") else []
        pages.append((n, f"http://{h}{path}", " ".join(f'<a href="http://{t}/y">' for t in out)))
    n_pages, good, bad, edges = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for _, u, html in pages:
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        n_pages[host] += 1
        good[host] += host.endswith(".net") and path.startswith("/de/")
        bad[host] += host.endswith(".com") and path.startswith("/en/") or host.endswith(".org") and path.startswith("/es/")
        edges.update((host, t) for t in re.findall("http://([^/]*)/y", html) if t != host)

    def rank(seeds, links):
        flow = {h: 0.15 * s / n_pages[h] for h, s in seeds.items() if s}
        out, total = collections.Counter(flow), collections.Counter()
        for (a, _), n in links.items():
            total[a] += n
        for _ in range(200):
            new = collections.Counter()
            for (a, b), n in links.items():
                new[b] += 0.85 * flow.get(a, 0) * n / total[a]
            flow = new
            out.update(new)
        return out

    trust, distrust = rank(good, edges), rank(bad, collections.Counter({(b, a): n for (a, b), n in edges.items()}))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert abs(r.trust - trust[r.host]) < 1e-3 and abs(r.distrust - distrust[r.host]) < 1e-3
        if r.rule is None and abs(distrust[r.host] - trust[r.host]) > 2e-3 and abs(distrust[r.host] - 0.075) > 2e-3:
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] and distrust[r.host] >= 0.075 else "allow")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_urls(spark):
    pages = [
        (1, "http://A.Example.com/en/7?x", '<a href="http://good.net/de/1">'), (2, "https://b.com/en/1", None), (3, "https://linker.info/x", '<a href="//b.com/en/1"><a href=\'http://b.com/\'>'),
        (4, None, None), (5, "no scheme", ""), (6, "x://example.net/de/8#f", ""), (7, "x://y.org/es/", ""), (8, "http://good.net/de/3", ""), (9, "http://plain.info", ""), (10, "http://notexample.com/EN/", ""), (9, "http://plain.info", ""),
    ]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("b.com", "/en/1", "com/en/", "block"), 3: ("linker.info", "/x", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("example.net", "/de/8", "example.net/de/8", "block"), 7: ("y.org", "/es/", "org/es/", "block"), 8: ("good.net", "/de/3", "net/de/", "allow"), 9: ("plain.info", "", None, "allow"), 10: ("notexample.com", "/EN/", None, "allow")}
    assert {i: tuple(r)[1:5] for i, r in out.items()} == want
    assert out[3].distrust > 0.5 * 0.15
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 3)], "src string, dst string, n long")
    got = {r.host: r.score for r in urls.pagerank(edges, spark.createDataFrame([("a", 1.0)], "host string, weight double"), steps=60, tolerance=1e-12).collect()}
    p, d = np.array([[0, 1, 0], [0.25, 0, 0.75], [0, 0, 0]]), 0.85
    want = np.linalg.solve(np.eye(3) - d * p.T, (1 - d) * np.array([1, 0, 0]))
    assert np.allclose([got[h] for h in "abc"], want)


def test_pagerank_goes_on_to_the_tolerance(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = urls.pagerank(edges, spark.createDataFrame([("a", 1.0)], "host string, weight double")).collect()
    assert 0 <= 1 - sum(r.score for r in got) <= 1.2e-4


def test_lines(docs, rows, empty):
    import duckdb

    c = duckdb.connect()
    import pandas as pd

    once = sorted({(i, t) for i, t in rows if t is not None})
    documents = pd.DataFrame(once, columns=["doc_id", "text"])  # noqa: F841
    c.register("documents", documents)
    want = {tuple(r) for r in c.sql(lines.OP2_SQL).fetchall()}
    got = {(r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines.dedup(docs).collect() if r.text is not None}
    assert got == want
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.where("text is null").count() == 1
    assert lines.dedup(empty).count() == 0


def test_lines_runs(spark):
    x, y = "x" * 60, "y" * 60
    data = [(1, f"{x}\n{y}\nq"), (2, f"p\n{x}\n\n{y}\nr"), (3, f"{x}\n{x}\n{x}"), (4, x), (5, "s\n" + "z" * 120 + "\nt"), (6, "s\n" + "z" * 120 + "\nt")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: f"{x}\n{y}\nq", 2: "p\n\nr", 3: x, 4: x, 5: data[4][1], 6: ""}
