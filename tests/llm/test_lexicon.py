"""BPE through the transducer, against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from agora.llm import lexicon

from ..conftest import SF

PATH = lexicon.model_path("word_bpe_49k.json")
ODD = "'''sStdmrevl aABbÀéé́̇İΣσς1２½³ \n\t\x1c\x85中文🙂_-ǅꯍ\U00010d50\U0001e6c0"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_is_minimal_and_finds_places():
    words = sorted({bytes(random.Random(5 * k).choices(b"abc", k=random.Random(k).randint(1, 6))) for k in range(400)})
    final, arcs = lexicon.automaton(words)

    def below(s):
        return frozenset([""] if final[s] else []) | {chr(b) + w for b, t in arcs[s] for w in below(t)}

    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += [t for _, t in arcs[s]]
    rights = [below(s) for s in reached]
    assert len(set(rights)) == len(rights) == len(final)  # no two states with the same right language, none unreachable
    made = lexicon.Lexicon(lexicon.compiled({w: [k, k] for k, w in enumerate(words)}, np.zeros(4, np.uint8)))
    tried = [*words, b"", b"d", b"ab" * 9, words[3] + b"z"]
    data = np.frombuffer(b"".join(tried), np.uint8)
    ends = np.cumsum([len(x) for x in tried])
    keep = np.array([len(x) > 0 for x in tried])
    found = made.find(np.append(data, np.uint8(0)), (ends - [len(x) for x in tried])[keep], ends[keep])
    assert found.tolist() == [words.index(x) if x in words else -1 for x in tried if x]
    assert made.ids[made.begin[7] : made.begin[8]].tolist() == [7, 7]


def test_long_and_short_merges_agree(monkeypatch):
    m = lexicon.model(PATH)
    words = [bytes(random.Random(k).choices(b"etaoinshrdlu", k=random.Random(-k).randint(1, 60))) for k in range(300)]
    monkeypatch.setattr(lexicon, "HEAP_FROM", 1)
    by_heap = [m.merged(w) for w in words]
    monkeypatch.setattr(lexicon, "HEAP_FROM", 10**9)
    assert by_heap == [m.merged(w) for w in words]


@pytest.mark.parametrize("piece", [1 << 19, 16])
def test_random_texts_equal_the_library(library, monkeypatch, piece):
    monkeypatch.setattr(lexicon, "PIECE", piece)
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "x" * 3000, "don't 'street ''s 's's'd", "ΑΣ ΑΣΑ", "they'll we've I'm 'l"]
    enc = lexicon.Encoder(lexicon.model(PATH), lexicon.Lexicon(lexicon.compiled({w: lexicon.model(PATH).merged(w) for w in (b"don", b"a", b"ab", b"'s")}, lexicon.classes(PATH))))
    got = [[] for _ in texts]
    for n, ids, _ in enc.documents(iter(texts)):
        got[n] += ids.tolist()
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("words", [0, 500, lexicon.WORDS])
def test_op13_equals_the_library(spark, docs, rows, library, words):
    odd = spark.createDataFrame([(-20, "ab " * 400_000), (-21, "<|endoftext|> x"), (-22, "é" * 70_000)], "doc_id long, text string")
    rows = [*rows, *((r.doc_id, r.text) for r in odd.collect())]
    got = lexicon.encode(docs.select("doc_id", "text", "id", "key").unionByName(odd, allowMissingColumns=True), PATH, words=words)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted((i, *plain(library, t)) for i, t in rows)


def test_query_real_outputs_and_empty(spark, empty, library):
    got = {r.doc_id: r for r in lexicon.op13_bpe(spark, SF).collect()}
    read = spark.read.parquet(f"{SF}/documents.parquet")
    assert all((got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == plain(library, r.text) for r in read.collect())
    some = lexicon.decode(lexicon.encode(read.where("doc_id < 20"), PATH, whole=True), PATH, to="again").collect()
    assert some and all(r.decoded == r.again == library.decode(r.ids, skip_special_tokens=False) for r in some)
    assert lexicon.encode(empty, PATH).count() == 0
