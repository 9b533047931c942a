"""The landing zone and the pieces that have no query: chunks, posting, provenance, addresses, tables, a chat server."""

import base64
import http.server
import json
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agora.config import ModelSpec
from agora.functions import frames, urls
from agora.operators import analytics, cache, extract, models
from agora.schemas import CHALLENGES
from agora.sources import corpus, landing
from agora.streaming import ingest as streaming
from agora.streaming import windows


@pytest.fixture
def server():
    """Counts requests by their key of repetition; refuses bodies that contain what `refuse` holds."""
    seen, bodies, refuse = Counter(), [], set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            bad = any(x in body for x in refuse)
            if not bad:
                seen[self.headers["Idempotency-Key"]] += 1
                bodies.append(json.loads(body))
            said = json.dumps({"message": {"content": f"reply to {len(body)}"}}).encode()
            self.send_response(500 if bad else 200)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *a):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/", seen, bodies, refuse
    made.shutdown()


def test_rows_are_posted_once(spark, tmp_path, server):
    url, seen, bodies, refuse = server
    df = spark.createDataFrame([(str(i), f"row {i}") for i in range(12)], "id string, v string").repartition(3)
    refuse.add("row 7")
    path = str(tmp_path / "posted")
    assert landing.post_once(df, url, path, ("id",)).count() == 11
    refuse.clear()
    for _ in range(2):
        assert landing.post_once(df, url, path, ("id",)).count() == 12
    assert len(seen) == 12 and set(seen.values()) == {1} and sorted(b["v"] for b in bodies) == sorted(f"row {i}" for i in range(12))
    lost = cache.errors(spark, path, "id string, ok boolean, status int, error string").collect()
    assert [(r.id, r.status) for r in lost] == [("7", 500)]
    nobody = landing.post(df.limit(1), "http://127.0.0.1:1/", ("id",)).first()
    assert nobody.ok is False and nobody.status is None and nobody.error


def test_a_replayed_epoch_posts_nothing(spark, tmp_path, server):
    url, seen, _, _ = server
    src = str(tmp_path / "src")
    spark.createDataFrame([(str(i % 5), i) for i in range(20)], "id string, n int").write.json(src)
    rows = lambda: spark.readStream.schema("id string, n int").json(src)
    for checkpoint in ("a", "a", "b"):  # the last one has no memory of the others
        streaming.start_posting(rows(), url, str(tmp_path / "posted"), ("id",), str(tmp_path / checkpoint)).awaitTermination()
    assert len(seen) == 5 and set(seen.values()) == {1}


def test_chunks(spark, tmp_path):
    """Pieces out of order, repeated, cut inside a character, in several batches; a response that lacks one does not appear."""
    rng, rows, want = random.Random(7), [], {}
    for k in range(12):
        body = f"é{k} " * rng.randint(1, 9) + "\U0001f600"
        raw, n = body.encode(), rng.randint(1, 6)
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(n - 1))
        pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        for i, p in enumerate(pieces):
            for _ in range(rng.randint(1, 2)):
                if not (k == 3 and i == 0):
                    rows.append({"response_id": f"r{k}", "chunk": i, "chunks": n, "data": base64.b64encode(p).decode(), "request_url": f"u{k}", "received_at": f"2024-01-01T00:00:{i:02}Z", "scrapedCountry": "Finland"})
        if k != 3:
            want[f"r{k}"] = (f"u{k}", body, "Finland")
    rows += [{"response_id": None, "chunk": 0, "chunks": 1, "data": "eA=="}, {"response_id": "bad", "chunk": 5, "chunks": 2, "data": "eA=="}, {"response_id": "odd", "chunk": 0, "chunks": 1, "data": None, "request_url": "o"}, {"response_id": "raw", "chunk": 0, "chunks": 1, "data": base64.b64encode(b"\xff").decode()}]
    want |= {"odd": ("o", "", None), "raw": (None, "�", None)}
    rng.shuffle(rows)
    src = tmp_path / "src"
    src.mkdir()
    for part in range(3):
        (src / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[part::3]))
    told = lambda df: {r.response_id: (r.request_url, r.body, r.scrapedCountry) for r in df.collect()}
    batch = landing.assembled(landing.read(spark, str(src), landing.CHUNKS))
    assert told(batch) == want and batch.count() == len(want)
    for _ in range(2):
        streaming.start_assembling(landing.stream(spark, str(src), landing.CHUNKS, 1), str(tmp_path / "whole"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "whole"))
    assert told(out) == want and out.count() == len(want)


def test_chat_server(server):
    url, _, bodies, refuse = server
    refuse.add("secret")
    spec = ModelSpec("m", "be brief", schema='{"type": "object"}')
    out = models.ChatServer(url, spec).run("t", ["hello", "secret", b"\x00image"])
    assert out[0].startswith("reply to") and isinstance(out[1], Exception) and out[2].startswith("reply to")
    assert bodies[0]["messages"] == [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}]
    assert bodies[0]["format"] == {"type": "object"} and bodies[0]["options"]["num_predict"] == 2048 and bodies[1]["messages"][1]["images"] == [base64.b64encode(b"\x00image").decode()]


def test_provenance_tables_and_addresses(spark):
    df = spark.createDataFrame([("u", "b")], "request_url string, body string")
    assert landing.with_provenance(df, "Finland", "user", "yle", "https://x").first().asDict() == {"request_url": "u", "body": "b", "scrapedCountry": "Finland", "scrapedType": "user", "scrapedItem": "yle", "scrapedUrl": "https://x"}
    for _ in range(2):
        corpus.create_table(spark, "challenges_made", CHALLENGES)
    assert spark.table("challenges_made").columns == CHALLENGES.names
    row = spark.createDataFrame([("yle", "France", "7", ["a1 x", "b2"])], "name string, country string, id string, tags array<string>")
    made = row.select(urls.profile_url(F.col("name"), F.col("country")), urls.first_with(F.col("tags"), "b"), urls.first_with(F.col("tags"), "c"), frames.media_path("/m", F.col("name"), F.col("id")))
    assert tuple(made.first()) == ("https://www.tiktok.com/@yle?lang=fr-FR", "b2", None, "/m/yle/7")


def test_lists_and_results(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"], "x")], "id int, l array<string>, s string")
    assert extract.distinct_lists(df).first().l == ["b", "a"]
    rows = spark.sql("SELECT named_struct('ok', true) AS r UNION ALL SELECT named_struct('ok', false)")
    assert [x.count() for x in extract.split_results(rows, "r")] == [1, 1]


def test_topics(spark):
    rows = [(k, (["tax", "work", "pay"] if k % 2 else ["border", "war", "army"]) * 5) for k in range(30)]
    out = analytics.topics(spark.createDataFrame(rows, "id int, words array<string>"), "words", k=2).collect()
    side = {r.id: int(r.topicDistribution.argmax()) for r in out}
    assert len({side[k] for k in range(0, 30, 2)}) == len({side[k] for k in range(1, 30, 2)}) == 1 and side[0] != side[1]


def test_event_time(spark):
    e = windows.timed(spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts"))
    assert dict(e.dtypes)["ts"] == "timestamp"
