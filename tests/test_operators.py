import json

from pyspark.sql import functions as F

from agora.operators import analytics, cache, extract, ingest, models
from agora.plans import enrichment
from agora.sources import corpus, landing, media
from agora.streaming import ingest as streaming
from agora.streaming import windows

API = "https://www.tiktok.com/api/"


def responses(spark):
    item = {"id": "1", "desc": "d", "textExtra": [{"hashtagId": "9", "hashtagName": "n"}, {"hashtagId": "", "hashtagName": "n"}]}
    rows = [
        (API + "post/item_list", json.dumps({"itemList": [item, {"id": "2", "textExtra": None}]})),
        (API + "search/general/full", json.dumps({"data": [{"type": 1, "item": {"id": "3"}}, {"type": "1", "item": {"id": "4"}}, {"type": 2, "item": {"id": "5"}}]})),
        (API + "user/playlist", json.dumps({"itemList": [{"item": {"id": "6"}}]})),
        (API + "comment/list?x=user/detail", json.dumps({"comments": [{"cid": "c", "text": "t", "user": {"avatar_thumb": {"url_list": []}}}]})),
        (API + "comment/list", json.dumps({"comments": []})),
        (API + "user/detail", json.dumps({"userInfo": {"user": {"id": "u", "bioLink": {"link": "l"}}}})),
        (API + "challenge/detail", json.dumps({"challengeInfo": {"challenge": {"id": "h"}, "statsV2": {"viewCount": "5", "videoCount": "x"}}})),
        (API + "post/item_list", "{broken"),
        ("https://elsewhere/post/item_list", json.dumps({"itemList": [{"id": "7"}]})),
        (API + "post/item_list", json.dumps({"itemList": [item | {"desc": "again"}]})),
    ]
    return spark.createDataFrame([(u, b, n) for n, (u, b) in enumerate(rows)], "request_url string, body string, n int").withColumn("received_at", F.timestamp_seconds("n"))


def test_ingest(spark):
    good, bad = ingest.split_bodies(ingest.routed(responses(spark)))
    t = ingest.tables(good)
    assert bad.count() == 1
    assert sorted(r.videoId for r in t["video"].collect()) == ["1", "1", "2", "3", "6"]
    assert {r.videoId: r.authorHeart for r in t["video"].collect()} == {"1": 0, "2": 0, "3": 0, "6": 0}
    assert [(r.videoId, r.hashtagId) for r in t["hashtag"].collect()] == [("1", "9")] * 2
    assert [(r.cid, r.avatar_thumb) for r in t["comment"].collect()] == [("c", "")]
    assert [(r.id, r.bioLink) for r in t["author"].collect()] == [("u", "l")]
    assert [(r.challengeId, r.challengeViewCount, r.challengeVideoCount) for r in t["challenge"].collect()] == [("h", 5, None)]
    first = ingest.first_wins(t["video"], "videoId", "received_at").where("videoId = '1'").first()
    assert first.videoDescription == "d"


def test_first_wins_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, n int")
    assert sorted(r.n for r in ingest.first_wins(df, "k", "n").collect()) == [1, 2, 3]
    target = spark.createDataFrame([("a", 0)], "k string, n int")
    assert sorted(r.n for r in ingest.new_rows(df, target, "k", "n").collect()) == [1, 2]


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    src, names = str(tmp_path / "src"), ("video", "hashtag", "comment", "author", "challenge")
    responses(spark).drop("n").write.json(src)
    for _ in range(2):
        for q in streaming.start(str(tmp_path / "out"), str(tmp_path / "check"), landing.stream(spark, src)):
            q.awaitTermination()
    rows = lambda root, n: sorted(map(str, spark.read.parquet(f"{tmp_path}/{root}/{n}").drop("batch").collect()))
    assert {n: len(rows("out", n)) for n in names} == {"video": 4, "hashtag": 1, "comment": 1, "author": 1, "challenge": 1}
    for number in (0, 0, 1):
        streaming.upsert(landing.read(spark, src), str(tmp_path / "batch"), number)
    assert all(rows("out", n) == rows("batch", n) for n in names)
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/out/dead").collect()] == ["malformed JSON"]


def test_empty_bodies(spark):
    df = spark.createDataFrame([("author", ""), ("author", "{}"), ("video", None)], "endpoint string, body string")
    keep, reject = ingest.accepted(df)
    assert keep.count() == 2 and reject.count() == 1


def test_resume(spark, tmp_path):
    path, schema = str(tmp_path / "stage"), "id string, ok boolean, value string, error string"
    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "id string, s string")
    seen = []

    def stage(fail):
        def run(rows):
            seen.append(sorted(r.id for r in rows.select("id").collect()))
            return models.run_stage(rows, "t", lambda: models.FakeClient(fail), F.col("s"), ("id",))

        return run

    assert [r.id for r in cache.with_stage_cache(df, path, ("id",), stage("bad"), schema).collect()] == ["1"]
    assert sorted(r.id for r in cache.with_stage_cache(df, path, ("id",), stage(None), schema).collect()) == ["1", "2"]
    assert seen == [["1", "2", "3"], ["2", "3"]]


def test_failed_rows_are_logged(spark, tmp_path):
    """Each row is asked once, those that fail go to the errors table, and answered ones of the same batch stay."""
    path, schema = str(tmp_path / "stage"), "id string, ok boolean, value string, error string"
    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "id string, s string")
    stage = lambda rows: models.run_stage(rows, "t", lambda: models.FakeClient("bad"), F.col("s"), ("id",))
    assert [r.id for r in cache.with_stage_cache(df, path, ("id",), stage, schema).collect()] == ["1"]
    cache.with_stage_cache(df, path, ("id",), stage, schema)
    log = cache.errors(spark, path, schema).collect()
    assert sorted((r.id, r.error) for r in log) == sorted([("2", "t failed"), ("3", "no input")] * 2) and all(r.logged_at for r in log)
    assert cache.errors(spark, str(tmp_path / "none"), schema).count() == 0


def test_replies_have_a_form():
    for task, fields in (("sentiment", {"topics", "entities", "positive", "neutral", "negative"}), ("formula", {"populism_analysis", "populism_us", "populism_frontier"})):
        form = json.loads(models.SPECS[task].schema)
        assert set(form["required"]) == set(form["properties"]) == fields


def test_all_stages_are_kept(spark, tmp_path):
    """A second run asks for what has failed alone; results of each stage stand below the root."""
    from agora.plans.queries import _Stub, _decoded, as_videos

    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1300) for i in (1, 5, 7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [enrichment.enrich(as_videos(docs), str(tmp_path), _Stub, decode=_decoded, media=F.col("videoId")) for _ in range(2)]
    first, again = (sorted(map(str, df.collect())) for df in out)
    assert first == again and len(first) == 3
    path = f"{tmp_path}/frame/{models.SPECS['frame'].version}"
    schema = "videoId string, frame_number string, ok boolean, value string, error string"
    assert cache.stage_table(spark, path, schema).count() == 6 and cache.errors(spark, path, schema).count() == 6


def test_posted_records(spark):
    rows = [("author", '{"usedId": "a", "desc": "d", "heart": 3, "verified": true, "diggCount": "many"}'), ("video", '{"videoId": "v", "scrapedCountry": "Finland", "videoDuration": 9}'), ("video", "no JSON"), ("challenge", None)]
    out = ingest.posted(spark.createDataFrame(rows, "endpoint string, body string"))
    a = out["author"].first()
    assert (a.id, a.description, a.heart, a.verified, a.diggCount) == ("a", "d", 3, True, None)
    assert sorted((r.videoId or "", r.scrapedCountry, r.videoDuration) for r in out["video"].collect()) == [("", None, None), ("v", "Finland", 9)]
    assert [tuple(r) for r in out["challenge"].collect()] == [(None,) * 4] and out["hashtag"].count() == 0


def test_first_wins_keeps_equal_null_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "n"), (None, 1, "n")], "k string, t int, v string")
    assert sorted(map(str, ingest.first_wins(df, "k", "t").collect())) == sorted(map(str, df.where("v != 'x'").collect()))


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    api = "https://www.tiktok.com/api/user/detail"
    body = lambda i: json.dumps({"userInfo": {"user": {"id": i, "nickname": "n"}}})
    rows = [(api, body("1")), (api, body(None)), (api, "no JSON"), (api, body("1"))]
    batch = spark.createDataFrame(rows, "request_url string, body string").withColumn("received_at", F.current_timestamp())
    for number in (0, 0, 1):
        streaming.upsert(batch, str(tmp_path), number)
    ids = sorted(str(r.id) for r in spark.read.parquet(f"{tmp_path}/author").collect())
    assert ids == ["1", "None", "None"] and spark.read.parquet(f"{tmp_path}/dead").count() == 2


def test_model_runs_once_per_row(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("s")).select(models.apply("t", models.FakeClient, F.col("s")).alias("r"))
    plan = df.where("r.ok").select("r.value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_keyframes(spark):
    plan = models.frame_plan_rows(spark.createDataFrame([("1", "p", 65), ("2", "bad", 31), ("3", "p", None)], "id string, path string, s int"), F.col("s"), F.col("path"), ("id",))

    def decode(path, offsets):
        if path == "bad":
            raise ValueError("broken file")
        return [None if s == 30 else b"x" for s in offsets]

    rows = models.keyframes(plan, decode, ("id",)).collect()
    assert sorted((r.id, r.frame_number, r.offset_s, r.ok, r.error) for r in rows) == [("1", 1, 0, True, None), ("1", 2, 30, False, "no image"), ("1", 3, 60, True, None), ("2", 1, 0, False, "broken file"), ("2", 2, 30, False, "broken file")]
    assert {r.error for r in models.keyframes(plan, None, ("id",)).collect()} == {"no decoder"}


def test_keyframes_of_a_long_file_are_decoded_in_parts(spark, tmp_path):
    plan = models.frame_plan_rows(spark.createDataFrame([("1", "p", 5 * 3600 + 1), ("2", "q", 31)], "id string, path string, s int"), F.col("s"), F.col("path"), ("id",))
    log = str(tmp_path)

    def decode(path, offsets):
        with open(f"{log}/{path}-{offsets[0]}", "w") as f:
            f.write(str(len(offsets)))
        return [b"%d" % s + b"x" * 100_000 for s in offsets]

    rows = models.keyframes(plan, decode, ("id",)).select("id", "frame_number", "offset_s", "ok", F.expr("int(string(substring(image, 1, length(image) - 100000)))").alias("at")).collect()
    assert sorted(map(tuple, rows)) == [("1", k + 1, 30 * k, True, 30 * k) for k in range(601)] + [("2", 1, 0, True, 0), ("2", 2, 30, True, 30)]
    assert sorted((p.name, int(p.read_text())) for p in tmp_path.iterdir()) == sorted([(f"p-{1800 * k}", 60) for k in range(10)] + [("p-18000", 1), ("q-0", 2)])


def test_enrich(spark, tmp_path):
    sentiment = json.dumps({"topics": ["t"], "entities": [], "positive": [], "neutral": [], "negative": []})
    formula = json.dumps({"populism_analysis": "a", "populism_us": [{"populism_element": " People ", "populism_affect": "hope"}], "populism_frontier": [{"populism_element": "elite", "populism_affect": "deep anger"}]})
    replies = {"sentiment": sentiment, "formula": formula}
    videos = spark.createDataFrame([("1", "u", "n", "s", "#a", 0, 5, 1, 1, 1, 1, "w")], "videoId string, authorUniqueId string, authorNickname string, authorSignature string, videoDescription string, videoCreated long, videoDuration long, videoDiggCount long, videoShareCount long, videoCommentCount long, videoPlayCount long, whisperResult string")
    out = enrichment.enrich(videos, str(tmp_path), lambda task: models.FakeClient(replies=replies))
    row = out.first()
    assert row.topics == ["t"] and row.populism_analysis == "a"
    rows = sorted((r.side, r.element, r.affect, r.single_word) for r in extract.elements(out, "videoId").collect())
    assert rows == [("frontier", "elite", "deep anger", False), ("us", "people", "hope", True)]
    flat = extract.export(out).first()
    assert flat.populism_us == " People ^hope\n" and flat.topics == "t"


def test_corpus_csv(spark, tmp_path):
    videos = spark.createDataFrame([("7123456789012345678", 'line\n"two"', 5, "en"), ("2", None, None, "fr")], "videoId string, whisperResult string, videoDuration long, language string")
    corpus.export_csv(videos, str(tmp_path / "csv"), by=None)
    schema = videos.schema
    back = sorted(corpus.read_csv(spark, str(tmp_path / "csv"), schema).collect())
    assert [tuple(r) for r in back] == [("2", None, None, "fr"), ("7123456789012345678", 'line\n"two"', 5, "en")]
    assert corpus.usable(videos, ["whisperResult"], "en").count() == 1
    corpus.write_partitions(videos, str(tmp_path / "p"))
    assert corpus.read_partitions(spark, str(tmp_path / "p"), "fr").count() == 1


def test_media(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x00" * 100)
    assert len(media.images(spark, str(tmp_path)).first().base64) == 136
    files = media.listing(spark, str(tmp_path))
    df = spark.createDataFrame([(str(tmp_path / "a.jpg"),), ("/none.jpg",)], "p string")
    assert sorted(r.found for r in media.existing(df, files, F.col("p")).collect()) == [False, True]
    got = df.select(media.probe(F.col("p"), lambda p: (0, 10) if "none" in p else (25, 100)).alias("r")).collect()
    assert got[0].r.duration == 4 and got[1].r.error


def test_windows(spark):
    e = spark.sql("SELECT timestamp_seconds(x) AS ts, 'a' AS k FROM (SELECT explode(array(0, 10, 100, 86500)) AS x)")
    assert sorted(r.n for r in windows.tumbling(e, "1 day", "k").collect()) == [1, 3]
    assert sorted(r.n for r in windows.sessions(e, "30 seconds", "k").collect()) == [1, 1, 2]


def test_names(spark):
    df = spark.createDataFrame([("The EU",), ("the  eu!",), ("The EU",), ("Nato",)], "n string")
    assert {(r.label, r.n) for r in analytics.merge_names(df, "n").collect()} == {("The EU", 3), ("Nato", 1)}
