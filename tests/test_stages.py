"""Stage tables: what is asked, how often, and what a run that is killed leaves behind."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agora.operators import cache, models
from agora.plans import enrichment
from agora.plans.queries import _Stub, as_videos

SCHEMA = "id string, ok boolean, value string, error string"


class Counting:
    """Writes down every input that it is asked; replies of another client."""

    def __init__(self, folder, task, inner):
        self.folder, self.task, self.inner = folder, task, inner

    def run(self, task, inputs):
        with open(f"{self.folder}/{self.task}-{os.getpid()}-{os.urandom(4).hex()}", "w") as f:
            f.writelines(json.dumps(x.decode() if isinstance(x, bytes) else x) + "\n" for x in inputs)
        return self.inner.run(task, inputs)


def asked(folder):
    """What has been asked of each task since the last call."""
    out = {}
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            out.setdefault(name.split("-")[0], Counter()).update(json.loads(x) for x in f)
        os.remove(f"{folder}/{name}")
    return out


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def stage(log, fail):
    return lambda rows: models.run_stage(rows, "t", lambda: Counting(log, "t", models.FakeClient(fail)), F.col("s"), ("id",))


def test_each_row_is_asked_once_a_run(spark, tmp_path, log):
    path = str(tmp_path / "stage")
    df = spark.createDataFrame([(str(i), "bad" if i % 10 == 0 else f"good{i}") for i in range(40)], "id string, s string").repartition(3)
    assert cache.with_stage_cache(df, path, ("id",), stage(log, "bad"), SCHEMA).count() == 36
    assert asked(log)["t"] == Counter({f"good{i}": 1 for i in range(40) if i % 10} | {"bad": 4})
    assert cache.with_stage_cache(df, path, ("id",), stage(log, "bad"), SCHEMA).count() == 36
    assert asked(log)["t"] == Counter({"bad": 4})
    assert cache.with_stage_cache(df, path, ("id",), stage(log, None), SCHEMA).count() == 40
    assert asked(log)["t"] == Counter({"bad": 4})
    assert cache.with_stage_cache(df, path, ("id",), stage(log, None), SCHEMA).count() == 40
    assert asked(log) == {} and len(cache.committed(spark, path)) == 3
    assert cache.errors(spark, path, SCHEMA).count() == 8


def test_a_killed_run_leaves_nothing(spark, tmp_path, log, monkeypatch):
    path = str(tmp_path / "stage")
    df = spark.createDataFrame([("1", "a"), ("2", "bad")], "id string, s string")
    monkeypatch.setattr(cache, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        cache.with_stage_cache(df, path, ("id",), stage(log, "bad"), SCHEMA)
    monkeypatch.undo()
    assert cache.stage_table(spark, path, SCHEMA).count() == cache.errors(spark, path, SCHEMA).count() == 0
    asked(log)
    assert [r.id for r in cache.with_stage_cache(df, path, ("id",), stage(log, "bad"), SCHEMA).collect()] == ["1"]
    assert asked(log)["t"] == Counter(["a", "bad"])
    assert [r.id for r in cache.errors(spark, path, SCHEMA).collect()] == ["2"]


@pytest.mark.parametrize("largest", [23, 6])
def test_compaction_and_filters(spark, tmp_path, log, monkeypatch, largest):
    """Rows of any run are known, filtered or joined, before and after the runs become one; null keys are asked each time."""
    monkeypatch.setattr(cache, "MAX_LOG_BITS", largest)
    path = str(tmp_path / "stage")
    part = lambda a, b: spark.createDataFrame([(str(i), f"v{i}") for i in range(a, b)], "id string, s string")
    for a, b in ((0, 30), (10, 50), (50, 52)):
        cache.with_stage_cache(part(a, b), path, ("id",), stage(log, None), SCHEMA)
    assert asked(log)["t"] == Counter(f"v{i}" for i in range(52))
    assert [r.bloom is None for r in cache.committed(spark, path)] == ([False] * 3 if largest == 23 else [False, True, True]) or largest == 6
    before = sorted(map(str, cache.stage_table(spark, path, SCHEMA).collect()))
    cache.compact(spark, path, ("id",), SCHEMA)
    assert len(cache.committed(spark, path)) == 1
    assert sorted(map(str, cache.stage_table(spark, path, SCHEMA).collect())) == before
    odd = part(0, 60).unionAll(spark.createDataFrame([(None, "none")], "id string, s string"))
    for _ in range(2):
        cache.with_stage_cache(odd, path, ("id",), stage(log, None), SCHEMA)
    assert asked(log)["t"] == Counter([f"v{i}" for i in range(52, 60)] + ["none"] * 2)


def test_filter_knows_all_keys_and_few_others(spark):
    runs = []
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    log_bits, bits = cache.bloom(rows.where("id % 3 = 0"), ("id",), 1000)
    runs.append(cache.Row(log_bits=log_bits, bloom=bits))
    hit = {int(r.id) for r in rows.where(cache._maybe(spark, ("id",), runs)).collect()}
    assert hit >= set(range(0, 3000, 3)) and len(hit) < 1000 + 120


@pytest.mark.parametrize("rooted", [True, False])
def test_enrichment_asks_each_row_once(spark, tmp_path, log, rooted):
    docs = spark.createDataFrame([(i, "x" * (60 * i), "en", "s", 1300) for i in range(1, 21)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)

    def decode(path, offsets):
        Counting(log, "decode", models.FakeClient()).run("decode", [f"{path}@{s}" for s in offsets])
        return [f"{path}@{s}".encode() for s in offsets]

    def run():
        root = str(tmp_path / "root") if rooted else None
        out = enrichment.enrich(as_videos(docs), root, lambda task: Counting(log, task, _Stub(task)), decode=decode, media=F.col("videoId"))
        return sorted(map(str, out.collect())), asked(log)

    first, calls = run()
    heard = [i for i in range(1, 21) if i % 5]
    assert {task: sum(n.values()) for task, n in calls.items()} == {"decode": 60, "ocr": 60, "frame": 60, "transcribe": 20, "language": len(heard), "translate": len(heard), "summary": 20, "sentiment": 20, "formula": 20}
    assert all(n == 1 for task, n in calls.items() if task not in ("sentiment", "formula", "summary") for n in n.values())
    unparsable = sum(1 for x in calls["sentiment"].elements() if not len(x) % 2)
    assert 0 < unparsable < 20
    for _ in range(2 if rooted else 0):
        again, calls = run()
        assert again == first
        # failing frames (at 60 seconds), speech, translations and unparsable replies only; nothing is decoded
        assert {task: sum(n.values()) for task, n in calls.items()} == {"frame": 20, "transcribe": 4, "translate": sum(1 for i in heard if i % 7 == 0), "sentiment": unparsable}
    if rooted:
        path = f"{tmp_path}/root/sentiment/{models.SPECS['sentiment'].version}"
        lost = cache.errors(spark, path, "videoId string, ok boolean, value string, error string").collect()
        assert len(lost) == 3 * unparsable and {(r.value, r.error) for r in lost} == {("no JSON", "reply does not fit its schema")}


class _Speaker(_Stub):
    """Speech of 1,000 words."""

    def run(self, task, inputs):
        if task == "transcribe":
            return [" ".join(f"mot{x}.{k}" for k in range(1000)) for x in inputs]
        if task == "translate":
            return [ValueError("no translate") if "mot2.500 " in x or len(x) > 3000 else x.replace("mot", "word").strip() for x in inputs]
        return super().run(task, inputs)


def test_long_videos_are_enriched_whole(spark, tmp_path):
    """Keyframes past the third minute and speech past the 3,000th character."""
    docs = spark.createDataFrame([(i, "x", "en", "s", 20 * n) for i, n in ((1, 1000), (2, 181), (3, 180))], "doc_id long, text string, lang string, source string, n_chars long")
    decode = lambda path, offsets: [f"{path}@{s}".encode() for s in offsets]
    for _ in range(2):
        rows = {r.videoId: r for r in enrichment.enrich(as_videos(docs), str(tmp_path), _Speaker, decode=decode, media=F.col("videoId")).collect()}
        assert {k: [f.offset_s for f in r.frames] for k, r in rows.items()} == {"1": list(range(0, 1000, 30)), "2": list(range(0, 181, 30)), "3": list(range(0, 180, 30))}
        assert all([f.frame_number for f in r.frames] == list(range(1, len(r.frames) + 1)) and all(f.ocr == f"o {k}@{f.offset_s}" for f in r.frames) for k, r in rows.items())
        words = {k: r.whisperResult.split(" ") for k, r in rows.items()}
        assert all(words[k] == [f"word{k}.{n}" for n in range(1000)] for k in ("1", "3"))
        kept = [n for n, w in enumerate(words["2"]) if w == f"mot2.{n}"]
        assert 500 in kept and 0 < len(kept) < 1000 and all(w == f"word2.{n}" for n, w in enumerate(words["2"]) if n not in kept) and len(words["2"]) == 1000


class _Sizes:
    """What was asked at once, in characters."""

    def run(self, task, inputs):
        return [str(sum(map(len, inputs)))] * len(inputs)


def test_long_rows_come_to_clients_in_small_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from agora.operators import cache, models

    key = ("videoId",)
    rows = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("videoId"), F.repeat(F.lit("x"), 100_000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    done = cache.with_stage_cache(rows, str(tmp_path), key, lambda df: models.run_stage(df, "summary", _Sizes, F.col("text"), key), "videoId string, ok boolean, value string, error string").collect()
    assert len(done) == 300 and all(0 < int(r.value) <= 5_000_000 for r in done)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
