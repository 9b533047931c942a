"""Ingest: from landed API responses to the five collection tables.

Responses are rows (request_url, body, received_at, provenance...). The route is
chosen by the url alone, each route's documents are parsed with a fixed schema,
lists become rows, and the first record of a key wins. The same functions serve
batch and streaming.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64_text, first_of, or_default
from ..schemas import AUTHORS, CHALLENGES, COMMENTS, DOCUMENTS, HASHTAGS, KEYS, PROVENANCE, VIDEOS
from .cache import read

#: Url parts in the order in which they are looked for, the route, and the form of its document.
ROUTES = (
    ("comment", "comments", "comment"),
    ("search/general/full", "search", "search"),
    ("post/item_list", "videos", "list"),
    ("challenge/item_list", "challenge_videos", "list"),
    ("user/detail", "author", "user"),
    ("challenge/detail", "challenge", "challenge"),
    ("user/playlist", "playlist", "playlist"),
)
API = "tiktok.com/api/"
VIDEO_ROUTES = {"videos": "list", "challenge_videos": "list", "search": "search", "playlist": "playlist"}


def route(url: Column) -> Column:
    """The first route whose part is in the url; `other` without one."""
    out = None
    for part, name, _ in ROUTES:
        hit = F.contains(url, F.lit(part))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("other"))


def routed(responses: DataFrame, api: str = API) -> DataFrame:
    """Responses of the API only, with their route."""
    return responses.where(F.contains("request_url", F.lit(api))).withColumn("route", route(F.col("request_url")))


def split_bodies(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies that are JSON, dead letters: null, empty or malformed ones with a reason)."""
    ok = F.coalesce(F.try_parse_json("body").isNotNull(), F.lit(False))
    reason = F.when(F.coalesce("body", F.lit("")) == "", F.lit("empty body")).otherwise(F.lit("malformed JSON"))
    return responses.where(ok), responses.where(~ok).withColumn("reason", reason)


def _parsed(responses: DataFrame, name: str, form: str) -> DataFrame:
    return responses.where(F.col("route") == name).withColumn("doc", F.from_json("body", DOCUMENTS[form])).drop("body")


def _carried(df: DataFrame) -> list[str]:
    """Provenance and arrival, where the responses have them."""
    return [c for c in ("received_at", *PROVENANCE.names) if c in df.columns]


def items(responses: DataFrame) -> DataFrame:
    """One row per video item of any list, from one pass over the responses; a search hit counts only if its type is the number 1."""
    rows = responses.where(F.col("route").isin(*VIDEO_ROUTES)).withColumns({form: F.from_json(F.when(F.col("route").isin(*(r for r, f in VIDEO_ROUTES.items() if f == form)), F.col("body")), DOCUMENTS[form]) for form in set(VIDEO_ROUTES.values())})
    one = F.schema_of_variant  # the string "1" is no number: a variant tells them apart
    hits = F.filter("search.data", lambda x: (one(x["type"]) == "BIGINT") & (F.try_variant_get(x["type"], "$", "bigint") == 1))
    listed = F.coalesce(F.col("list.itemList"), F.transform("playlist.itemList", lambda x: x["item"]), F.transform(hits, lambda x: x["item"]))
    return rows.select(*_carried(rows), F.explode(listed).alias("v")).where("v is not null")


def videos(item: DataFrame) -> DataFrame:
    """33 columns from nested fields; missing author counts are 0, other missing fields null."""
    same = {
        "videoId": "id", "videoDescription": "desc", "videoCreated": "createTime", "authorId": "author.id", "authorUniqueId": "author.uniqueId", "authorNickname": "author.nickname",
        "authorAvatar": "author.avatarLarger", "authorSignature": "author.signature", "videoUrl": "video.downloadAddr", "videoCover": "video.cover", "videoDuration": "video.duration",
        "videoHeight": "video.height", "videoWidth": "video.width", "videoRatio": "video.ratio", "videoPlayCount": "stats.playCount", "videoShareCount": "stats.shareCount",
        "videoCommentCount": "stats.commentCount", "videoDiggCount": "stats.diggCount", "videoCollectCount": "stats.collectCount", "videoMusicId": "music.id", "videoMusicTitle": "music.title",
        "videoMusicAuthor": "music.authorName", "videoMusicOriginal": "music.original", "videoMusicCover": "music.coverLarge", "videoMusicPlayUrl": "music.playUrl", "videoMusicDuration": "music.duration",
    }
    counts = ("Digg", "Follower", "Following", "Friend", "Heart", "Video")
    cols = [F.col(f"v.{path}").alias(name) for name, path in same.items()]
    cols += [or_default(F.col(f"v.authorStats.{c.lower()}Count"), 0).alias(f"author{c}Count") for c in counts]
    return item.select(*cols, or_default(F.col("v.authorStats.heart"), 0).alias("authorHeart"), *_carried(item))


def hashtags(item: DataFrame) -> DataFrame:
    """(video, hashtag) rows of tags that have both an id and a name."""
    tag = item.select(F.col("v.id").alias("videoId"), F.explode("v.textExtra").alias("t"), *_carried(item))
    full = (F.coalesce("t.hashtagId", F.lit("")) != "") & (F.coalesce("t.hashtagName", F.lit("")) != "")
    hashed = base64_text(F.concat(F.coalesce("videoId", F.lit("")), F.col("t.hashtagId")))
    return tag.where(full).select("videoId", F.col("t.hashtagId").alias("hashtagId"), F.col("t.hashtagName").alias("hashtagName"), hashed.alias("hashtagHash"), *_carried(item))


def comments(responses: DataFrame) -> DataFrame:
    rows = _parsed(responses, "comments", "comment")
    c = rows.select(F.explode("doc.comments").alias("c"), *_carried(rows))
    same = ("aweme_id", "cid", "comment_language", "create_time", "digg_count", "reply_comment_total", "reply_id", "reply_to_reply_id")
    return c.select(
        *(F.col(f"c.{n}").alias(n) for n in same),
        (F.col("c.collect_stat") != 0).alias("collect_stat"),
        F.col("c.text").alias("comment_text"),
        F.col("c.share_info.desc").alias("description"),
        F.col("c.share_info.title").alias("title"),
        F.col("c.share_info.url").alias("url"),
        F.col("c.user.uid").alias("uid"),
        F.col("c.user.nickname").alias("nickname"),
        first_of(F.col("c.user.avatar_thumb.url_list")).alias("avatar_thumb"),
        *_carried(c),
    )


def authors(responses: DataFrame) -> DataFrame:
    """Author records, keyed by the payload's own id."""
    a = _parsed(responses, "author", "user")
    user = ("id", "nickname", "secUid", "signature", "uniqueId", "avatarLarger", "verified")
    stats = ("diggCount", "followerCount", "followingCount", "friendCount", "heart", "heartCount", "videoCount")
    return a.select(
        *(F.col(f"doc.userInfo.user.{n}").alias(n) for n in user),
        F.col("doc.userInfo.user.nickNameModifyTime").alias("nicknameModifyTime"),
        or_default(F.col("doc.userInfo.user.bioLink.link"), "").alias("bioLink"),
        *(F.col(f"doc.userInfo.stats.{n}").alias(n) for n in stats),
        F.col("doc.shareMeta.desc").alias("description"),
        F.col("doc.shareMeta.title").alias("title"),
        *_carried(a),
    )


def challenges(responses: DataFrame) -> DataFrame:
    c = _parsed(responses, "challenge", "challenge")
    info = "doc.challengeInfo"
    return c.select(F.col(f"{info}.challenge.id").alias("challengeId"), F.col(f"{info}.challenge.title").alias("challengeTitle"), F.expr(f"try_cast({info}.statsV2.viewCount AS bigint)").alias("challengeViewCount"), F.expr(f"try_cast({info}.statsV2.videoCount AS bigint)").alias("challengeVideoCount"), *_carried(c))


#: Endpoints that reject an empty body; the others take it as a record of nulls.
REJECT_EMPTY = ("author", "comment")


def accepted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posted records to keep, rejected ones) by endpoint and body."""
    empty = F.coalesce(F.trim("body"), F.lit("")) == ""
    bad = empty & F.col("endpoint").isin(*REJECT_EMPTY)
    return records.where(~bad), records.where(bad)


#: Endpoints of posted records, the table of each, and the names that its records have where the table's differ.
POSTED = {
    "challenge": (CHALLENGES, {}),
    "author": (AUTHORS, {"description": "desc", "id": "usedId"}),
    "hashtag": (HASHTAGS, {"videoId": "video_id", "hashtagId": "hashtag_id", "hashtagName": "hashtag_name", "hashtagHash": "hashtag_hash"}),
    "comment": (COMMENTS, {"description": "desc"}),
    "video": (VIDEOS, {}),
}


def posted(records: DataFrame) -> dict[str, DataFrame]:
    """The five tables' rows from posted records (endpoint, body): one flat document each; a field that is missing or of another type is null."""
    out = {}
    for name, (schema, renamed) in POSTED.items():
        fields = [*schema, *PROVENANCE] if name == "video" else [*schema]
        doc = F.try_parse_json(F.coalesce("body", F.lit("")))
        rows = records.where(F.col("endpoint") == name).withColumn("doc", doc)
        out[name] = rows.select(*(F.try_variant_get("doc", f"$.{renamed.get(f.name, f.name)}", f.dataType.simpleString()).alias(f.name) for f in fields), *(c for c in ("received_at",) if c in records.columns))
    return out


def tables(responses: DataFrame) -> dict[str, DataFrame]:
    """All five tables' records from one batch of responses (with their route)."""
    item = items(responses)
    return {"video": videos(item), "hashtag": hashtags(item), "comment": comments(responses), "author": authors(responses), "challenge": challenges(responses)}


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key by arrival; rows with a null key never conflict and all stay, where they are."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*by)).alias("__row")).select("__row.*")
    return first.unionAll(df.where(F.col(key).isNull()))


def new_rows(df: DataFrame, target: DataFrame | None, key: str, *order: str | Column) -> DataFrame:
    """What insert-or-ignore would add to the target: first per key, and no key that the target has."""
    fresh = first_wins(df, key, *order)
    return fresh if target is None else fresh.join(target.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*fresh.columns)


def arrivals(responses: DataFrame | None = None, records: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the rows that responses and posted records bring to each table, dead letters with a reason); batch or streams.

    Both ways bring the same columns; provenance is null where a way does not have it.
    """
    ways, dead = [], []
    if responses is not None:
        good, bad = split_bodies(routed(responses))
        ways.append(tables(good))
        dead.append(bad.select(F.col("route").alias("at"), "body", "received_at", "reason"))
    if records is not None:
        kept, rejected = accepted(records)
        ways.append(posted(kept))
        dead.append(rejected.select(F.col("endpoint").alias("at"), "body", "received_at", F.lit("empty body").alias("reason")))
    out = {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (w[name] for w in ways)) for name in KEYS}
    return out, reduce(DataFrame.unionAll, dead)


def insert(rows: dict[str, DataFrame], root: str, number: int = 0) -> None:
    """Adds a batch to the tables below root as insert-or-ignore would.

    Each batch is a partition of its own, which a repeated batch writes over; so a replay adds nothing, null keys included.
    The target's keys are read and joined: for one large batch that is the cheaper way, for many small ones a stream is.
    """
    for name, fresh in rows.items():
        path, key = f"{root}/{name}", KEYS[name]
        target = read(fresh.sparkSession, path, f"{key} string, batch bigint").where(F.col("batch") != number)
        new_rows(fresh, target, key, "received_at").write.mode("overwrite").parquet(f"{path}/batch={number}")


__all__ = ["ROUTES", "KEYS", "route", "routed", "split_bodies", "items", "videos", "hashtags", "comments", "authors", "challenges", "tables", "posted", "accepted", "arrivals", "insert", "first_wins", "new_rows"]
