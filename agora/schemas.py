"""Schemas of the collection tables, the API documents, the stage tables and the model replies."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, fields.split(","))])


# Columns of the five collection tables, and of provenance, in their order.
VIDEOS = _table("""
    videoId string, videoDescription string, videoCreated bigint,
    authorId string, authorUniqueId string, authorNickname string, authorAvatar string, authorSignature string,
    authorDiggCount bigint, authorFollowerCount bigint, authorFollowingCount bigint, authorFriendCount bigint, authorHeart bigint, authorHeartCount bigint, authorVideoCount bigint,
    videoUrl string, videoCover string, videoDuration bigint, videoHeight bigint, videoWidth bigint, videoRatio string,
    videoPlayCount bigint, videoShareCount bigint, videoCommentCount bigint, videoDiggCount bigint, videoCollectCount bigint,
    videoMusicId string, videoMusicTitle string, videoMusicAuthor string, videoMusicOriginal boolean, videoMusicCover string, videoMusicPlayUrl string, videoMusicDuration bigint
""")
PROVENANCE = _table("scrapedCountry string, scrapedUrl string, scrapedType string, scrapedItem string, scrapedTime string, scrapedFilename string, scrapedVideoCreatedDate string, scrapedVideoTikTokUrl string, scrapedVideoWarning string")
HASHTAGS = _table("videoId string, hashtagId string, hashtagName string, hashtagHash string")
CHALLENGES = _table("challengeId string, challengeTitle string, challengeViewCount bigint, challengeVideoCount bigint")
COMMENTS = _table("""
    aweme_id string, cid string, collect_stat boolean, comment_language string, comment_text string, create_time string, digg_count bigint, reply_comment_total bigint,
    reply_id string, reply_to_reply_id string, description string, title string, url string, uid string, nickname string, avatar_thumb string
""")
AUTHORS = _table("""
    description string, diggCount bigint, followerCount bigint, followingCount bigint, friendCount bigint, heart bigint, heartCount bigint, videoCount bigint,
    avatarLarger string, bioLink string, id string, nickname string, nicknameModifyTime string, secUid string, signature string, uniqueId string, verified boolean,
    title string
""")
KEYS = {"video": "videoId", "hashtag": "hashtagHash", "challenge": "challengeId", "comment": "cid", "author": "id"}

_STATS = "struct<diggCount:bigint,followerCount:bigint,followingCount:bigint,friendCount:bigint,heart:bigint,heartCount:bigint,videoCount:bigint>"
ITEM = (
    "struct<id:string,desc:string,createTime:bigint,author:struct<id:string,uniqueId:string,nickname:string,avatarLarger:string,signature:string>,"
    f"authorStats:{_STATS},stats:struct<playCount:bigint,shareCount:bigint,commentCount:bigint,diggCount:bigint,collectCount:bigint>,"
    "video:struct<downloadAddr:string,cover:string,duration:bigint,height:bigint,width:bigint,ratio:string>,"
    "music:struct<id:string,title:string,authorName:string,coverLarge:string,playUrl:string,original:boolean,duration:bigint>,"
    "textExtra:array<struct<hashtagId:string,hashtagName:string>>>"
)
#: What each route's document holds, as Spark reads it.
DOCUMENTS = {
    "comment": (
        "comments array<struct<aweme_id:string,cid:string,collect_stat:int,comment_language:string,text:string,create_time:string,digg_count:bigint,"
        "reply_comment_total:bigint,reply_id:string,reply_to_reply_id:string,share_info:struct<desc:string,title:string,url:string>,"
        "user:struct<uid:string,nickname:string,avatar_thumb:struct<url_list:array<string>>>>>"
    ),
    "search": f"data array<struct<type:variant,item:{ITEM}>>",
    "list": f"itemList array<{ITEM}>",
    "playlist": f"itemList array<struct<item:{ITEM}>>",
    "user": (
        "userInfo struct<user:struct<id:string,uniqueId:string,nickname:string,secUid:string,signature:string,avatarLarger:string,nickNameModifyTime:string,"
        f"verified:boolean,bioLink:struct<link:string>>,stats:{_STATS}>,shareMeta struct<desc:string,title:string>"
    ),
    "challenge": "challengeInfo struct<challenge:struct<id:string,title:string>,statsV2:struct<viewCount:string,videoCount:string>>",
}
FRAME = "struct<frame_number:int,offset_s:int,path:string,ocr:string,analysis:string,error:string>"
TRANSCRIPT = "struct<text:string,language:string,translated:string,error:string>"
RESULT = "struct<ok:boolean,value:string,error:string>"
ELEMENT = "struct<populism_element:string,populism_affect:string>"
SENTIMENT = ("topics", "entities", "positive", "neutral", "negative")


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
