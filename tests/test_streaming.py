"""Keyed state: what a stream adds is what insert-or-ignore adds, over many batches and restarts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from agora.operators import ingest
from agora.sources import landing
from agora.streaming import ingest as streaming

from .conftest import SF


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:04}.json").write_text("".join(json.dumps({"endpoint": "comment", "body": json.dumps({k: v for k, v in (("cid", c), ("nickname", n)) if v}), "received_at": f"2024-01-01T00:{number:02}:{at:02}Z"}) + "\n" for c, n, at in rows))


def run(spark, tmp_path, files=1, **kw):
    made = streaming.start(str(tmp_path / "out"), str(tmp_path / "check"), records=landing.stream(spark, str(tmp_path / "src"), landing.RECORDS, files), names=("comment",), **kw)
    for q in made:
        q.awaitTermination()
    return made


def table(spark, tmp_path):
    return sorted((r.cid or "", r.nickname) for r in spark.read.parquet(f"{tmp_path}/out/comment").collect())


def test_fifty_batches_with_a_restart(spark, tmp_path, one_partition):
    rng, want, seen, k = random.Random(4), [], set(), 0
    progress = []
    for begin, end in ((0, 20), (20, 50)):
        for number in range(begin, end):
            rows = []
            for _ in range(6):
                k += 1
                rows.append((rng.choice([None, *(f"c{x}" for x in range(60))]), f"n{k}", rng.randint(0, 59)))
            land(tmp_path / "src", number, rows)
            for c, n, _ in sorted((r for r in rows if r[0]), key=lambda r: r[2]):
                if c not in seen and not any(c == r[0] and r[2] == at for r in rows for cc, nn, at in [(c, n, _)] if r[1] != n):
                    seen.add(c)
                    want.append((c, n))
                elif c not in seen:  # a tie of arrival: the row that is first as text
                    seen.add(c)
                    want.append((c, None))
            want += [("", n) for c, n, _ in rows if c is None]
        progress += run(spark, tmp_path)[0].recentProgress
    got = table(spark, tmp_path)
    assert len(got) == len(want) and {c for c, _ in got} == {c for c, _ in want}
    assert {x for x in want if x[1]} <= set(got)
    fed = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert len(fed) == 50 and set(fed) == {12}  # a batch reads its own file only (once for rows with a key and once for those without)


def test_known_keys_and_replay(spark, tmp_path, one_partition):
    land(tmp_path / "src", 0, [("old", "x", 0), ("new", "y", 1), ("new", "z", 0), (None, "n", 0)])
    known = {"comment": spark.createDataFrame([("old",), (None,)], "cid string")}
    run(spark, tmp_path, known=known)
    run(spark, tmp_path, known=known)
    assert table(spark, tmp_path) == [("", "n"), ("new", "z")]


def test_keys_are_forgotten_in_time(spark, tmp_path, one_partition):
    """State with a time to live needs a running query: with it, Spark plans batches for ever."""
    land(tmp_path / "src", 0, [("a", "x", 0)])
    rows = ingest.arrivals(records=landing.stream(spark, str(tmp_path / "src"), landing.RECORDS))[0]["comment"]
    writer = streaming.first_records(rows, "cid", ttl_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out/comment"))
    q = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        for number, want in ((0, 1), (1, 2)):
            if number:
                land(tmp_path / "src", number, [("a", "y", 0)])
            for _ in range(60):
                if q.lastProgress and len(list((tmp_path / "out/comment").glob("*.parquet"))) and len(table(spark, tmp_path)) == want:
                    break
                time.sleep(0.5)
    finally:
        q.stop()
    assert table(spark, tmp_path) == [("a", "x"), ("a", "y")]


def test_responses_and_records_meet(spark):
    api = "https://www.tiktok.com/api/user/detail"
    responses = spark.createDataFrame([(api, json.dumps({"userInfo": {"user": {"id": "1", "nickname": "seen"}}})), (api, "")], "request_url string, body string").withColumn("received_at", F.timestamp_seconds(F.lit(1)))
    records = spark.createDataFrame([("author", '{"usedId": "1", "nickname": "posted"}'), ("author", " ")], "endpoint string, body string").withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    tables, dead = ingest.arrivals(responses, records)
    assert sorted((r.id, r.nickname) for r in tables["author"].collect()) == [("1", "posted"), ("1", "seen")]
    assert [r.nickname for r in ingest.first_wins(tables["author"], "id", "received_at").collect()] == ["posted"]
    assert {(r["at"], r.reason) for r in dead.collect()} == {("author", "empty body")}


def test_visits_follow_changes(spark, tmp_path, one_partition):
    """A busy source is visited often, a quiet one less and less; the same stream gives the same plan; late events are left out."""
    from datetime import datetime, timedelta

    from agora.streaming.visits import visits

    begin, src = datetime(2024, 1, 1), tmp_path / "src"
    src.mkdir()
    days = [[("busy", begin + timedelta(days=d, hours=h)) for h in range(24)] + ([("quiet", begin)] if d == 0 else []) + ([("late", begin)] if d == 5 else []) for d in range(6)]
    for d, rows in enumerate(days):
        (src / f"{d}.json").write_text("".join(json.dumps({"source": s, "ts": t.isoformat() + "Z"}) + "\n" for s, t in rows))
    plans = []
    for k in range(2):
        stream = spark.readStream.schema("source string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
        out = visits(stream, "source", "ts", least_s=1800, most_s=2 * 86400).writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / f"check{k}"))
        out.trigger(availableNow=True).start().awaitTermination()
        plans.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out{k}")).collect())))
    assert plans[0] == plans[1]
    by = {s: [p for p in plans[0] if p[0] == s] for s in ("busy", "quiet", "late")}
    assert len(by["busy"]) > len(by["quiet"]) >= 1 and not by["late"]
    assert all(p[3] == 0 for p in by["quiet"][1:]) and by["busy"][-1][2] < 2 * 3600


def plain_visits(times, mark, least, most, learn):
    """Visits before mark, one millisecond of interest after the other."""
    gap, out, last, due, prev, found = most, [], None, None, None, 0
    times = sorted(t for t in times if t < mark)
    while True:
        if due is not None and due < mark and (not times or due < times[0]):
            out.append((due, due - prev, found))
            prev, due, found = due, due + (gap if found else min(2 * (due - prev), most)), 0
        elif times:
            t = times.pop(0)
            if last is not None and t > last:
                gap = int(min(max(gap + learn * (t - last - gap), least), most))
            last, found = t, found + 1
            if due is None:
                prev, due = t, t + gap
            due = min(due, t + gap)
        else:
            return out


def test_visit_plan_equals_a_plain_one(spark):
    """A source's events of a whole table, in one batch: visits fall between them as well."""
    from agora.plans.queries import QUERIES

    by = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").where("ts is not null and user_id is not null").selectExpr("cast(user_id as string) u", "unix_millis(cast(ts as timestamp)) ms").collect():
        by.setdefault(r.u, []).append(r.ms)
    mark = max(map(max, by.values())) - 3600 * 1000
    want = sorted((u, at, wait // 1000, n) for u, times in by.items() for at, wait, n in plain_visits(times, mark, 600_000, 7 * 86_400_000, 0.3))
    got = QUERIES["visit_plan"](spark, SF).selectExpr("source", "unix_millis(visit_at) at", "wait_s", "changes").collect()
    assert sorted(map(tuple, got)) == want
    assert len(want) > len(by)


def test_visits_do_not_depend_on_batches(spark, tmp_path, one_partition):
    """Shuffled within the delay, in one batch or in many."""
    from datetime import datetime, timedelta

    from agora.streaming.visits import visits

    rng, begin = random.Random(3), datetime(2024, 1, 1)
    times = [begin + timedelta(minutes=rng.randrange(10, 4000)) for _ in range(60)] + [begin + timedelta(days=4)]
    near = sorted(times, key=lambda t: t + timedelta(minutes=rng.randrange(300)))
    plans = []
    for k, cut in enumerate((1000, 13)):
        src = tmp_path / f"src{k}"
        src.mkdir()
        for n, at in enumerate(range(0, len(near), cut)):
            (src / f"{n:03}.json").write_text("".join(json.dumps({"source": "x", "ts": t.isoformat() + "Z"}) + "\n" for t in near[at : at + cut]))
            os.utime(src / f"{n:03}.json", (1e9 + n, 1e9 + n))
        stream = spark.readStream.schema("source string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
        out = visits(stream, "source", "ts", "12 hours", 1800, 86400).writeStream.format("parquet").option("path", str(tmp_path / f"to{k}")).option("checkpointLocation", str(tmp_path / f"at{k}"))
        out.trigger(availableNow=True).start().awaitTermination()
        plans.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"to{k}")).selectExpr("unix_millis(visit_at) at", "wait_s", "changes").collect())))
    utc = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = plain_visits([utc(t) for t in times], utc(max(times)) - 12 * 3_600_000, 1_800_000, 86_400_000, 0.3)
    assert plans[0] == plans[1] == sorted((at, wait // 1000, n) for at, wait, n in want)


def test_visit_plan_of_a_table_in_many_files(spark, tmp_path):
    """No file is late, whatever the times in it; a source of more times than one value of its state holds is whole."""
    from pyspark.sql import functions as F

    from agora.plans.queries import QUERIES

    events = spark.read.parquet(f"{SF}/events.parquet")
    busy = spark.range(70_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 37 % 2_500_000).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    whole = events.unionByName(busy, allowMissingColumns=True)
    by = {}
    for r in whole.where("ts is not null and user_id is not null").selectExpr("cast(user_id as string) u", "unix_millis(cast(ts as timestamp)) ms").collect():
        by.setdefault(r.u, []).append(r.ms)
    mark = max(map(max, by.values())) - 3600 * 1000
    want = sorted((u, at, wait // 1000, n) for u, times in by.items() for at, wait, n in plain_visits(times, mark, 600_000, 7 * 86_400_000, 0.3))
    for k in range(4):
        whole.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["visit_plan"](spark, str(tmp_path)).selectExpr("source", "unix_millis(visit_at) at", "wait_s", "changes").collect()
    assert sorted(map(tuple, got)) == want
