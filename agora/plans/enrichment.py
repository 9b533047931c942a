"""The enrichment of a corpus: work list, frame reports, prompts, and the model stages with their caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames, text, urls
from ..functions.strict import parse_formula, parse_sentiment
from ..operators import cache, models
from ..operators.extract import elements, formulas, sentiments
from ..operators.shared import new_folder


def described(videos: DataFrame) -> DataFrame:
    """Adds addresses, the timestamp, hashtags, and the metadata block."""
    df = videos.withColumns({
        "video_url": urls.video_url(F.col("authorUniqueId"), F.col("videoId")),
        "author_url": urls.author_url(F.col("authorUniqueId")),
        "timestamp": text.epoch_text(F.col("videoCreated")),
        "hashtags": text.hashtags(F.col("videoDescription")),
    })
    return df.withColumn("metadata", text.metadata_block({name: F.col(name) for _, name in text.METADATA}))


def work_list(videos: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("videoId",)) -> DataFrame:
    """Videos with a transcript that the cache lacks, with their keyframe plan and metadata block."""
    rows = cache.todo(videos.na.drop(subset=["whisperResult"]), done, keys)
    return described(rows).withColumn("frames", frames.frame_plan(F.col("videoDuration")))


Decoder = Callable[[str, list[int]], list[bytes | None]]


class Stages:
    """Model stages, each with a table of results and errors below `root`; without a root, in a new folder of the shared one, so that no stage is evaluated twice.

    Stage tables are named after the task and its model's version, so another model or prompt starts afresh.
    """

    def __init__(self, factory: Callable[[str], models.ModelClient], root: str, partitions: int | None = None):
        self.factory, self.root, self.partitions = factory, root, partitions

    @staticmethod
    def schema(keys: tuple[str, ...]) -> str:
        return ", ".join([*(f"{k} string" for k in keys), "ok boolean, value string, error string"])

    def path(self, task: str) -> str:
        return f"{self.root}/{task}/{models.SPECS[task].version}"

    def __call__(self, task: str, rows: DataFrame, value: Column, keys: tuple[str, ...], fits: Callable[[Column], Column] | None = None) -> DataFrame:
        """(keys..., ok, value, error) of the task on every row. A reply that does not fit is an error, so the next run asks again."""

        def run(df: DataFrame) -> DataFrame:
            out = models.run_stage(df, task, lambda: self.factory(task), value, keys, self.partitions)
            if fits is None:
                return out
            good = F.coalesce(fits(F.col("value")), F.lit(False))
            return out.withColumns({"error": F.when(F.col("ok") & ~good, "reply does not fit its schema").otherwise(F.col("error")), "ok": F.col("ok") & good})

        return cache.with_stage_cache(rows, self.path(task), keys, run, self.schema(keys))

    def frames(self, plan: DataFrame, decode: Decoder | None) -> DataFrame:
        """(videoId, frame_number, offset_s, ok, image, error) of the planned frames: kept, so that no frame is decoded twice."""
        keys = ("videoId", "frame_number")
        kept = cache.with_stage_cache(plan, f"{self.root}/keyframes", keys, lambda df: models.keyframes(df, decode, ("videoId",)), FRAMES)
        return kept.join(cache.keyed(plan.select(*keys), keys), list(keys), "left_semi")


#: The table of kept keyframes.
FRAMES = "videoId string, frame_number string, offset_s int, ok boolean, image binary, error string"


def with_frames(videos: DataFrame, stages: Stages, decode: Decoder | None, path: Column) -> DataFrame:
    """Adds `frames`: each keyframe of the whole video with its on-screen text and its description; what fails is null there and does not stop the rest."""
    key, each = ("videoId",), ("videoId", "frame_number")
    images = stages.frames(models.frame_plan_rows(cache.keyed(videos, key), F.col("videoDuration"), path, key), decode)
    image = F.col("image")
    read = stages("ocr", images, image, each).select(*each, F.col("value").alias("ocr"))
    seen = stages("frame", images, image, each).select(*each, F.col("value").alias("analysis"))
    plan = images.select(*each, "offset_s").join(read, list(each), "left").join(seen, list(each), "left")
    one = F.struct(F.col("frame_number").cast("int").alias("frame_number"), "offset_s", "ocr", "analysis")
    return cache.keyed(videos, key).join(plan.groupBy("videoId").agg(F.array_sort(F.collect_list(one)).alias("frames")), "videoId", "left")


def with_transcripts(videos: DataFrame, stages: Stages, path: Column) -> DataFrame:
    """Adds `whisperResult`, the speech in English where a translation was had, and `language`; all speech is translated, in pieces, and a piece whose translation fails keeps the original."""
    key, each = ("videoId",), ("videoId", "piece")
    spoken = stages("transcribe", videos, path, key).select("videoId", F.col("value").alias("speech"))
    named = stages("language", spoken, F.col("speech"), key).select("videoId", F.col("value").alias("language"))
    pieces = cache.keyed(spoken.select("videoId", F.posexplode(text.translate_pieces(F.col("speech"))).alias("piece", "said")), each)
    english = stages("translate", pieces, F.col("said"), each).select(*each, F.col("value").alias("english"))
    one = F.struct(F.col("piece").cast("int").alias("piece"), "said", "english")
    told = pieces.join(english, list(each), "left").groupBy("videoId").agg(F.array_sort(F.collect_set(one)).alias("pieces"))
    heard = spoken.join(named, "videoId", "left").join(told, "videoId", "left").select("videoId", text.pieces_joined(F.col("pieces")).alias("whisperResult"), "language")
    return cache.keyed(videos, key).drop("whisperResult", "language").join(heard, "videoId", "left")


def enrich(videos: DataFrame, root: str | None, factory: Callable[[str], models.ModelClient], partitions: int | None = None, decode: Decoder | None = None, media: Column | None = None) -> DataFrame:
    """All stages over what their caches below root lack, one row per video with every result.

    With `media`, the path of each video's file: keyframes, their on-screen text and description, speech and its translation come first;
    else the frames and whisperResult that the videos have are used. Then come the summary and both extractions from it.
    """
    key, stages = ("videoId",), Stages(factory, root or new_folder(videos.sparkSession, "enrich"), partitions)
    if media is not None:
        videos = with_transcripts(with_frames(videos, stages, decode, media), stages, media)
    rows = described(videos)
    report = text.filled(frames.frame_report(F.col("frames"))) if "frames" in videos.columns else F.lit("")
    summaries = stages("summary", rows, text.user_prompt(report, F.col("metadata"), F.col("whisperResult")), key).select("videoId", F.col("value").alias("summary"))
    asked = cache.keyed(rows.select("videoId"), key).join(summaries, "videoId")
    reply = lambda task, parse: stages(task, asked, F.col("summary"), key, lambda v: parse(v)["ok"]).select("videoId", F.col("value").alias(task))
    sentiment = sentiments(reply("sentiment", parse_sentiment), "sentiment", "videoId").drop("ok", "error")
    formula = formulas(reply("formula", parse_formula), "formula", "videoId").drop("ok", "error")
    return cache.keyed(videos, key).join(summaries, "videoId", "left").join(sentiment, "videoId", "left").join(formula, "videoId", "left")


def formula_counts(enriched: DataFrame) -> DataFrame:
    return elements(enriched, "videoId").groupBy("side", "element", "affect").agg(F.count("*").alias("n"))
