"""Texts of more than one hashing block (512 KiB): results are those of the whole text, also where a block ends inside what counts."""

import collections
import re

import numpy as np

from agora.llm import decontam, lines, neardup, quality, toxicity
from agora.llm.common import BLOCK

SCHEMA = "doc_id long, text string"


def words(n, seed, of=20_000):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, of, n).tolist()]


def test_toxicity_counts_the_whole_text(spark):
    """The same words in another order, so cut elsewhere, have the same neighbours and score."""
    rng = np.random.default_rng(1)
    some = words(200_000, 2, 3000)
    other = [some[k] for k in rng.permutation(len(some)).tolist()]
    assert len(" ".join(some)) > 2 * BLOCK
    small = [(i, " ".join([*words(40, i, 3000), *["bad"] * (i % 2)])) for i in range(10, 90)]
    docs = spark.createDataFrame([(1, " ".join(some)), (2, " ".join(other)), *small], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 90)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert got[1].score == got[2].score and [(e.id, round(e.cosine, 9)) for e in got[1].evidence] == [(e.id, round(e.cosine, 9)) for e in got[2].evidence]
    assert len(got[1].evidence) == toxicity.NEIGHBOURS


def test_lines_of_a_long_text(spark):
    body = "\n".join(" ".join(words(9, k)) for k in range(25_000))
    assert len(body) > 2 * BLOCK
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame([(1, body), (2, f"x\n{body}\ny"), (3, body[-2000:] + "\nz")], SCHEMA)).collect()}
    assert got[1] == body and got[2] == "x\ny" and got[3].endswith("\nz") and len(got[3]) < 200


def test_long_near_copies(spark):
    one = words(250_000, 3)
    two, three = list(one), words(250_000, 4)
    for k in range(0, len(two), 500):
        two[k] = f"new{k}"
    assert len(" ".join(one)) > 2 * BLOCK
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame([(i + 1, " ".join(w)) for i, w in enumerate((one, two, three))], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_quality_of_a_long_text(spark):
    text = "\n".join(" ".join(words(12, k, 300)) + " #|" * (k % 3) for k in range(20_000)) + "\nw1 w2 w3"
    assert len(text) > 2 * BLOCK
    w, ls = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len({i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}))
    assert tuple(quality.statistics(spark.createDataFrame([(1, text)], SCHEMA)).first())[1:6] == want


def test_a_leak_over_the_end_of_a_block(spark):
    item = [f"tok{i}" for i in range(40)]
    before = words(150_000, 5)
    head = " ".join(before)[: BLOCK - 100].rsplit(" ", 1)[0]
    text = f"{head} {' '.join(item)} {' '.join(before)}"
    assert head.encode().__len__() < BLOCK < len(head) + len(" ".join(item)) and len(text) > 2 * BLOCK
    docs = spark.createDataFrame([(1, text), (2, " ".join(before))], SCHEMA)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontam.leaks(docs, bench).collect()] == [(1, 7, 1.0)]
    assert [r.doc_id for r in decontam.without_leaks(docs, bench).collect()] == [2]
