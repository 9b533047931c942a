import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.config import LOCALES, NA_TOKENS
from agora.functions import frames, strict, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, [{str: "string", int: "long", list: "array<string>"}.get(type(v), "string") for v in values.values()], strict=True)))
    return df.select(column.alias("x")).first().x


def test_frame_counts(spark):
    want = {0: 0, 1: 1, 30: 1, 31: 2, 60: 2, 179: 6, 180: 6, 181: 6, 10000: 6, -5: 0}
    got = spark.createDataFrame([(d,) for d in want], "d long").select("d", F.size(frames.frame_offsets(F.col("d"))).alias("n")).collect()
    assert {r.d: r.n for r in got} == want
    assert one(spark, frames.frame_offsets(F.lit(None).cast("int")), a=1) is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-100, 10**6), min_size=1, max_size=50))
def test_frame_count_is_a_ceiling(spark, ds):
    got = spark.createDataFrame([(d,) for d in ds], "d long").select("d", F.size(frames.frame_offsets(F.col("d"))).alias("n")).collect()
    assert all(r.n == max(0, math.ceil(min(r.d, 180) / 30)) for r in got)


def test_frames_of_the_whole_duration(spark):
    want = {0: 0, 1: 1, 180: 6, 181: 7, 10000: 334, -5: 0, None: None}
    got = spark.createDataFrame([(d,) for d in want], "d long").select("d", frames.frame_offsets(F.col("d"), None).alias("s")).collect()
    assert {r.d: r.s if r.s is None else len(r.s) for r in got} == want
    assert all(r.s == list(range(0, r.d, 30)) for r in got if r.d is not None)


def test_duration(spark):
    assert one(spark, frames.duration(F.lit(100), F.lit(30)), a=1) == 3
    assert one(spark, frames.duration(F.lit(100), F.lit(0)), a=1) is None


@pytest.mark.parametrize(("s", "want"), [("#a b #c", "#a, #c"), ("x#y", ""), ("#a,", "#a,"), ("#", "#"), ("", ""), (None, ""), ("a #b\n#c\x1c#d\x85#e", "#b, #c, #d, #e")])
def test_hashtags(spark, s, want):
    assert one(spark, text.hashtags(F.col("s")), s=s) == want


def test_na_tokens(spark):
    rows = spark.createDataFrame([(x,) for x in (*NA_TOKENS, "none", " ", "0")], "s string").select("s", text.na_to_null(F.col("s")).alias("x")).collect()
    assert len(NA_TOKENS) == 19
    assert {r.s for r in rows if r.x is not None} == {"none", " ", "0"}


def test_text_helpers(spark):
    assert one(spark, text.epoch_text(F.col("n")), n=1714521600) == "2024-05-01 00:00:00"
    assert "\n" not in one(spark, text.base64_text(F.col("s")), s="x" * 100)
    assert one(spark, text.lines_joined(F.col("l")), l=["a", "b"]) == "a\nb\n"
    assert one(spark, text.lines_joined(F.lit(None).cast("array<string>")), a=1) == ""
    assert one(spark, text.first_of(F.col("l")), l=["a"]) == "a"
    assert one(spark, text.first_of(F.array().cast("array<string>")), a=1) == ""
    assert one(spark, text.translate_input(F.col("s")), s="é" * 4000) == "é" * 3000


@pytest.mark.parametrize("s", ["", "a b ", "x" * 3000, "x" * 3001, " " * 7000, "word " * 3000, "é😀" * 4000, "a\n" * 2999 + "b" * 3001 + "\n"])
def test_translated_pieces_are_the_whole_text(spark, s):
    got = one(spark, text.translate_pieces(F.col("s")), s=s)
    assert "".join(got) == s and max(map(len, got)) <= 3000 and (len(got) == 1) is (len(s) <= 3000)
    assert all(p[-1].isspace() for p, after in zip(got, got[1:]) if any(map(str.isspace, p)))


def test_translated_pieces_are_joined(spark):
    df = spark.sql("SELECT array(named_struct('said', 'un deux\n', 'english', 'one two'), named_struct('said', 'trois ', 'english', null), named_struct('said', '四', 'english', 'four'), named_struct('said', ' cinq ', 'english', ' five')) AS p")
    assert df.select(text.pieces_joined(F.col("p")).alias("x")).first().x == "one two\ntrois four five"
    assert df.select(text.pieces_joined(F.lit(None).cast("array<struct<said:string,english:string>>")).alias("x")).first().x is None


def test_report_skips_null_and_empty(spark):
    df = spark.sql("SELECT array(named_struct('frame_number', 1, 'offset_s', 0, 'ocr', 'o', 'analysis', 'a'), named_struct('frame_number', 2, 'offset_s', 30, 'ocr', null, 'analysis', ''), named_struct('frame_number', 3, 'offset_s', 60, 'ocr', null, 'analysis', null), named_struct('frame_number', 4, 'offset_s', 90, 'ocr', null, 'analysis', 'd')) AS f")
    got = df.select(frames.frame_report(F.col("f")).alias("x")).first().x
    assert got == "### Frame 1 at 0 seconds:\na\nOCR:\no\n### Frame 4 at 90 seconds:\nd\nOCR:\n\n"


def test_urls(spark):
    for url, want in {"https://x/@a": "list", "https://x/@a/video/1": "video", "https://x/tag/b": "list", "https://x/search?q=1": "list", "https://x/": "other", "https://x/tag/@a/video/1": "list"}.items():
        assert one(spark, urls.page_class(F.col("u")), u=url) == want
    for country, want in {**LOCALES, "Nowhere": "en-IE"}.items():
        assert one(spark, urls.locale(F.col("c")), c=country) == want
    assert one(spark, urls.locale(F.lit(None).cast("string")), a=1) == "en-IE"
    assert one(spark, urls.search_url(F.col("q")), q="a b\tc") == "https://www.tiktok.com/search?q=a%20b%20c"
    assert one(spark, urls.choose(F.col("l"), F.lit("s")), l=["a", "b"]) in "ab"
    assert one(spark, urls.choose(F.array().cast("array<string>"), F.lit("s")), a=1) is None


GOOD = {"topics": ["a"], "entities": [], "positive": ["b", "c"], "neutral": [], "negative": []}


@pytest.mark.parametrize(
    ("reply", "ok"),
    [
        (json.dumps(GOOD), True),
        ("  " + json.dumps(GOOD | {"extra": {"x": 1}}) + "\n", True),
        (json.dumps({k: v for k, v in GOOD.items() if k != "topics"}), False),
        (json.dumps(GOOD | {"topics": [1]}), False),
        (json.dumps(GOOD | {"topics": "a"}), False),
        (json.dumps(GOOD | {"topics": [None]}), False),
        (json.dumps(GOOD | {"topics": ["a", None]}), False),
        (json.dumps(GOOD | {"topics": None}), False),
        (json.dumps(GOOD)[:-1] + ",}", False),
        ("[]", False),
        ("", False),
        (None, False),
        (json.dumps(GOOD)[:-1] + ', "topics": ["z"]}', True),
    ],
)
def test_strict_sentiment(spark, reply, ok):
    got = one(spark, strict.parse_sentiment(F.col("r")), r=reply)
    assert got.ok is ok
    assert (got.value is not None) is ok and (got.error is None) is ok
    if reply and '"z"' in reply:
        assert got.value.topics == ["z"]


def test_strict_formula(spark):
    pair = {"populism_element": "people", "populism_affect": "hope"}
    good = {"populism_analysis": "x", "populism_us": [pair], "populism_frontier": []}
    got = one(spark, strict.parse_formula(F.col("r")), r=json.dumps(good))
    assert got.ok and got.value.populism_us[0].populism_affect == "hope"
    for bad in (good | {"populism_us": [{"populism_element": "people"}]}, good | {"populism_us": [pair | {"populism_affect": 1}]}, good | {"populism_us": [None]}, good | {"populism_analysis": 1}, {}):
        assert not one(spark, strict.parse_formula(F.col("r")), r=json.dumps(bad)).ok
