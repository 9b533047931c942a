"""Registered queries over the driver's tables, each with its SQL for DuckDB.

The tables stand in for the engine's own: documents for videos (source for
author, lang for language, n_chars div 20 for seconds), labels for a stage
cache, conversations for comments, events for the API stream, pages for crawled
pages, nation for countries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOCALES, NA_TOKENS
from ..functions import frames, strict, text, urls
from ..operators import analytics, annotators, bursts, cache, chains, extract, graph, ingest, models, names
from ..operators.shared import materialised, new_folder, small_batches
from ..sources import corpus
from ..streaming.windows import tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def seconds():
    """Seconds of a stand-in video."""
    return F.expr("cast(n_chars div 20 AS int)")

_na = ", ".join(f"'{x}'" for x in NA_TOKENS)
_locale = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LOCALES.items())
_BLOCK = """concat_ws(chr(10), '- Author name: ' || coalesce(source, ''), '- Author username: ' || coalesce(source, ''), '- Author signature: ', '- Description: ' || coalesce(text, ''),
 '- Timestamp: ' || strftime(to_timestamp(1714521600 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '- Duration: ' || (n_chars // 20)::VARCHAR, '- Diggs: ', '- Shares: ', '- Comments: ', '- Plays: ',
 '- Video URL: https://www.tiktok.com/@' || source || '/video/' || doc_id::VARCHAR, '- Author URL: https://www.tiktok.com/@' || source,
 '- Hashtags: ' || array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: starts_with(x, '#')), ', '))"""


def as_videos(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return docs.select(
        F.col("doc_id").cast("string").alias("videoId"), F.col("text").alias("videoDescription"), (F.lit(1714521600) + F.col("doc_id")).alias("videoCreated"), F.col("source").alias("authorUniqueId"), F.col("source").alias("authorNickname"),
        F.lit(None).cast("string").alias("authorSignature"), seconds().alias("videoDuration"), none.alias("videoDiggCount"), none.alias("videoShareCount"), none.alias("videoCommentCount"), none.alias("videoPlayCount"),
        F.col("text").alias("whisperResult"), F.col("lang").alias("language"),
    )


def lined_frames(text_: str = "text"):
    """The first six lines of a text as frame analyses, the source as on-screen text."""
    lines = F.slice(F.split(F.col(text_), "\n"), 1, 6)
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("frame_number"), (i * 30).alias("offset_s"), x.alias("analysis"), F.col("source").alias("ocr")))


@query(f"""SELECT d.doc_id::VARCHAR AS video_id, {_BLOCK} AS metadata, len(range(0, least(n_chars // 20, 180), 30))::INT AS n_frames
FROM documents d ANTI JOIN (SELECT doc_id FROM labels) l USING (doc_id) WHERE text IS NOT NULL AND text NOT IN ({_na})""")
def enrichment_worklist(t):
    from .enrichment import work_list

    videos = as_videos(t("documents")).withColumn("whisperResult", text.na_to_null(F.col("whisperResult")))
    out = work_list(videos, t("labels").select(F.col("doc_id").alias("videoId")))
    return out.select(F.col("videoId").alias("video_id"), "metadata", F.size("frames").alias("n_frames"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE text IS NOT NULL AND lang = 'en'")
def filter_language(t):
    return corpus.usable(t("documents").withColumnRenamed("lang", "language"), ["text"], "en").select("doc_id", "source", "n_chars")


@query(f"SELECT doc_id, turn_text FROM (SELECT conv_id AS doc_id, CASE WHEN text IN ({_na}) THEN NULL ELSE text END AS turn_text FROM conversations)")
def na_normalise(t):
    return t("conversations").select(F.col("conv_id").alias("doc_id"), text.na_to_null(F.col("text")).alias("turn_text"))


@query("SELECT doc_id, (i // 30 + 1)::INT AS frame_number, i::INT AS offset_s FROM (SELECT doc_id, unnest(range(0, least(n_chars // 20, 180), 30)) AS i FROM documents)")
def keyframe_plan(t):
    return t("documents").select("doc_id", F.explode(frames.frame_plan(seconds())).alias("f")).select("doc_id", "f.frame_number", "f.offset_s")


@query("SELECT doc_id, " + ", ".join(f"r[{i}]::INT AS offset_{i}" for i in range(1, 7)) + " FROM (SELECT doc_id, range(0, least(n_chars // 20, 180), 30) AS r FROM documents)")
def frames_wide(t):
    return t("documents").select("doc_id", frames.frame_plan(seconds()).alias("f")).select("doc_id", *frames.wide(F.col("f"), "offset_s", "offset"))


@query("SELECT doc_id, len(range(0, least(n_chars // 20, 180), 30))::INT AS n_frames FROM documents")
def frame_count(t):
    return t("documents").select("doc_id", F.size(frames.frame_offsets(seconds())).alias("n_frames"))


@query("SELECT event_id, CASE WHEN event_id % 30 <> 0 THEN least(floor(user_id * 100 / (event_id % 30))::INT, 180) END AS seconds FROM events")
def video_duration(t):
    d = frames.duration(F.col("user_id") * 100, F.col("event_id") % 30)
    return t("events").select("event_id", F.when(d.isNotNull(), F.least(d, F.lit(180))).alias("seconds"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: ends_with(x, '###')), ', ') AS marked, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: starts_with(x, '#')), ', ') AS hashtags FROM documents")
def token_extract(t):
    return t("documents").select("doc_id", F.array_join(F.filter(text.tokens(F.col("text")), lambda x: F.endswith(x, F.lit("###"))), ", ").alias("marked"), text.hashtags(F.col("text")).alias("hashtags"))


@query("SELECT doc_id, substring(text, 1, 3000) AS input, length(substring(text, 1, 3000))::INT AS n FROM documents")
def translate_input(t):
    return t("documents").select("doc_id", text.translate_input(F.col("text")).alias("input")).withColumn("n", F.length("input"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(t):
    return ingest.first_wins(t("documents"), "text", "doc_id").select("doc_id", "source")


@query("SELECT text, doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def upsert_ignore(t):
    return ingest.new_rows(t("documents").select("text", "doc_id"), t("benchmark"), "text", "doc_id")


@query("SELECT doc_id::VARCHAR AS doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def cache_hit(t):
    return cache.hits(t("documents").select("doc_id"), t("labels"), ("doc_id",))


@query("SELECT doc_id::VARCHAR AS doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def cache_todo(t):
    return cache.todo(t("documents").select("doc_id"), t("labels"), ("doc_id",))


@query("SELECT d.doc_id::VARCHAR AS doc_id, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality) = 1) l USING (doc_id)")
def cache_left(t):
    return cache.lookup(t("documents").select("doc_id"), t("labels"), ("doc_id",), "quality")


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars::INT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def stage_coalesce(t):
    return cache.updated(t("documents").select("doc_id", F.col("n_chars").cast("int").alias("quality")), t("labels"), ("doc_id",), ["quality"])


@query("SELECT doc_id, NULL::VARCHAR AS summary, 1 AS n_null FROM documents")
def empty_columns(t):
    return cache.with_empty(t("documents").select("doc_id"), {"summary": "string"}).withColumn("n_null", F.col("summary").isNull().cast("int"))


@query(f"SELECT doc_id::VARCHAR AS video_id, {_BLOCK} AS metadata FROM documents")
def metadata_block(t):
    from .enrichment import described

    return described(as_videos(t("documents"))).select(F.col("videoId").alias("video_id"), "metadata")


_SECTIONS = "coalesce(string_agg('### Frame ' || i::VARCHAR || ' at ' || ((i - 1) * 30)::VARCHAR || ' seconds:' || chr(10) || line || chr(10) || 'OCR:' || chr(10) || coalesce(source, '') || chr(10), '' ORDER BY i) FILTER (WHERE line <> ''), '')"


@query(f"SELECT doc_id, {_SECTIONS} AS report FROM (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, source, list_slice(string_split(text, chr(10)), 1, 6) AS ls FROM documents)) GROUP BY doc_id")
def frame_report(t):
    return t("documents").select("doc_id", frames.frame_report(lined_frames()).alias("report"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_messages(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return turns.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("chat"))


@query("SELECT doc_id, 'Frames:' || chr(10) || '' || chr(10) || chr(10) || 'Metadata:' || chr(10) || source || chr(10) || chr(10) || 'Transcript:' || chr(10) || text || chr(10) || chr(10) || 'Analyse the politics of this video from the three sources above.' AS prompt FROM documents")
def user_prompt(t):
    return t("documents").select("doc_id", text.user_prompt(F.lit(None).cast("string"), F.col("source"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10)), chr(10)) || chr(10) AS ocr FROM documents")
def ocr_join(t):
    return t("documents").select("doc_id", models.ocr_text(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(0.9).alias("conf")))).alias("ocr"))


_URLS = {"comment/list": "comments", "search/general/full": "search", "post/item_list": "videos", "challenge/item_list": "challenge_videos", "user/detail": "author", "challenge/detail": "challenge", "user/playlist": "playlist", "user/detail/comment": "comments"}


@query("SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_URLS.values())) + " ELSE 'other' END AS route FROM events")
def route_events(t):
    """All eight outcomes; an address with two parts goes by the first that is looked for."""
    url = F.element_at(F.array(*map(F.lit, _URLS), F.concat(F.lit("x/"), "event_type")), (F.col("event_id") % 9 + 1).cast("int"))
    return t("events").select("event_id", ingest.route(F.concat(F.lit("api/"), url)).alias("route"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def parse_props(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _listed(t) -> DataFrame:
    """Responses built from documents: one list of one video with two tags, as JSON."""
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("desc"), F.col("n_chars").alias("createTime"), F.struct(F.col("source").alias("uniqueId")).alias("author"), F.array(F.struct(F.col("lang").alias("hashtagId"), F.col("source").alias("hashtagName")), F.struct(F.lit("").alias("hashtagId"), F.col("source").alias("hashtagName"))).alias("textExtra"))
    return t("documents").select(F.lit("https://www.tiktok.com/api/post/item_list").alias("request_url"), F.to_json(F.struct(F.array(item).alias("itemList"))).alias("body"))


@query("SELECT doc_id::VARCHAR AS \"videoId\", text AS \"videoDescription\", n_chars AS \"videoCreated\", source AS \"authorUniqueId\", 0::BIGINT AS \"authorHeart\" FROM documents")
def json_flatten_explode(t):
    return ingest.tables(ingest.routed(_listed(t)))["video"].select("videoId", "videoDescription", "videoCreated", "authorUniqueId", "authorHeart")


@query("SELECT doc_id::VARCHAR AS \"videoId\", lang AS \"hashtagId\", source AS \"hashtagName\", to_base64(encode(doc_id::VARCHAR || lang)) AS \"hashtagHash\" FROM documents")
def json_hashtags(t):
    return ingest.tables(ingest.routed(_listed(t)))["hashtag"]


#: Of each nested record: the table's column, its path in the document, and its kind.
_COMMENT = {"aweme_id": ("aweme_id", "string"), "cid": ("cid", "string"), "comment_language": ("comment_language", "string"), "comment_text": ("text", "string"), "create_time": ("create_time", "string"), "reply_id": ("reply_id", "string"), "reply_to_reply_id": ("reply_to_reply_id", "string"), "description": ("share_info.desc", "string"), "title": ("share_info.title", "string"), "url": ("share_info.url", "string"), "uid": ("user.uid", "string"), "nickname": ("user.nickname", "string"), "digg_count": ("digg_count", "long"), "reply_comment_total": ("reply_comment_total", "long"), "collect_stat": ("collect_stat", "flag"), "avatar_thumb": ("user.avatar_thumb.url_list", "first")}
_AUTHOR = {"id": ("user.id", "string"), "nickname": ("user.nickname", "string"), "secUid": ("user.secUid", "string"), "signature": ("user.signature", "string"), "uniqueId": ("user.uniqueId", "string"), "avatarLarger": ("user.avatarLarger", "string"), "verified": ("user.verified", "boolean"), "nicknameModifyTime": ("user.nickNameModifyTime", "string"), "bioLink": ("user.bioLink.link", "string"), "diggCount": ("stats.diggCount", "long"), "followerCount": ("stats.followerCount", "long"), "followingCount": ("stats.followingCount", "long"), "friendCount": ("stats.friendCount", "long"), "heart": ("stats.heart", "long"), "heartCount": ("stats.heartCount", "long"), "videoCount": ("stats.videoCount", "long")}
_CELLS = {"string": "'{n}:' || x", "long": "k + {i}", "flag": "k % 2 = 1", "boolean": "k % 2 = 0", "first": "'{n}:' || x"}


def _nested(spec: dict) -> Column:
    """A struct with a value of its own at every path, from the columns k (a number) and x (its text)."""
    made = {"string": lambda n, i: F.concat(F.lit(f"{n}:"), "x"), "long": lambda n, i: F.col("k") + i, "flag": lambda n, i: F.col("k") % 2, "boolean": lambda n, i: F.col("k") % 2 == 0, "first": lambda n, i: F.array(F.concat(F.lit(f"{n}:"), "x"), F.lit("second"))}
    tree: dict = {}
    for i, (n, (path, kind)) in enumerate(spec.items()):
        *above, last = path.split(".")
        at = tree
        for part in above:
            at = at.setdefault(part, {})
        at[last] = made[kind](n, i)

    def struct(of: dict) -> Column:
        return F.struct(*((struct(v) if isinstance(v, dict) else v).alias(name) for name, v in of.items()))

    return struct(tree)


def _nested_sql(spec: dict, rows: str) -> str:
    return "SELECT " + ", ".join(f'{_CELLS[kind].format(n=n, i=i)} AS "{n}"' for i, (n, (_, kind)) in enumerate(spec.items())) + f" FROM ({rows})"


@query(_nested_sql(_COMMENT, "SELECT conv_id::BIGINT * 1000 + turn AS k, conv_id::VARCHAR || '-' || turn::VARCHAR AS x FROM conversations"))
def json_comments(t):
    """All 16 columns, each from a value of its own."""
    rows = t("conversations").select((F.col("conv_id").cast("long") * 1000 + F.col("turn")).alias("k"), F.concat_ws("-", "conv_id", "turn").alias("x"))
    responses = rows.select(F.lit("https://www.tiktok.com/api/comment/list").alias("request_url"), F.to_json(F.struct(F.array(_nested(_COMMENT)).alias("comments"))).alias("body"))
    return ingest.comments(ingest.routed(responses)).select(*_COMMENT)


@query(_nested_sql(_AUTHOR, "SELECT s_suppkey::BIGINT AS k, s_name AS x FROM supplier").replace("SELECT ", "SELECT 'd:' || x AS description, 't:' || x AS title, ", 1))
def json_authors(t):
    """All 18 columns, each from a value of its own."""
    rows = t("supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("x"))
    share = F.struct(F.concat(F.lit("d:"), "x").alias("desc"), F.concat(F.lit("t:"), "x").alias("title"))
    responses = rows.select(F.lit("https://www.tiktok.com/api/user/detail").alias("request_url"), F.to_json(F.struct(_nested(_AUTHOR).alias("userInfo"), share.alias("shareMeta"))).alias("body"))
    return ingest.authors(ingest.routed(responses)).select("description", "title", *_AUTHOR)


@query("SELECT p_partkey::VARCHAR AS \"challengeId\", p_name AS \"challengeTitle\", p_size::BIGINT AS \"challengeViewCount\", NULL::BIGINT AS \"challengeVideoCount\" FROM part")
def json_challenges(t):
    info = F.struct(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")).alias("challenge"), F.struct(F.col("p_size").cast("string").alias("viewCount"), F.lit("many").alias("videoCount")).alias("statsV2"))
    responses = t("part").select(F.lit("https://www.tiktok.com/api/challenge/detail").alias("request_url"), F.to_json(F.struct(info.alias("challengeInfo"))).alias("body"))
    return ingest.challenges(ingest.routed(responses))


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(first, '') AS first FROM (SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN NULL ELSE string_split(text, ' ')[1] END AS first FROM documents d LEFT JOIN labels l USING (doc_id))")
def null_defaults(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", text.or_default(F.col("quality"), 0).alias("quality"), text.first_of(F.when(F.col("quality").isNotNull(), F.split("text", " "))).alias("first"))


@query("SELECT doc_id, to_base64(encode(doc_id::VARCHAR || text)) AS hash FROM documents")
def hash_key(t):
    return t("documents").select("doc_id", text.base64_text(F.concat(F.col("doc_id").cast("string"), "text")).alias("hash"))


@query("SELECT page_id, CASE WHEN contains(url, 'search') OR contains(url, 'tag') OR (contains(url, '@') AND NOT contains(url, 'video')) THEN 'list' WHEN contains(url, '@') AND contains(url, 'video') THEN 'video' ELSE 'other' END AS class, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
def page_class(t):
    return t("pages").select("page_id", urls.page_class(F.col("url")).alias("class"), F.size(urls.links(F.col("html"))).alias("n_links"))


@query("SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) WHERE contains(link, '/th')")
def page_links(t):
    return t("pages").select("page_id", F.explode(urls.links(F.col("html"), "/th")).alias("link"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(t):
    return t("pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY")).alias("query"))


@query("SELECT doc_id, 'https://www.tiktok.com/search?q=' || regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]', '%20', 'g') AS url, 'https://www.tiktok.com/tag/' || lang || '?lang=en-IE' AS tag FROM documents")
def url_build(t):
    return t("documents").select("doc_id", urls.search_url(F.col("text")).alias("url"), urls.tag_url(F.col("lang"), F.lit(None).cast("string")).alias("tag"))


@query(f"SELECT n_nationkey, n_name, CASE upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) {_locale} ELSE 'en-IE' END AS locale FROM nation")
def locale_lookup(t):
    return t("nation").select("n_nationkey", "n_name", urls.locale(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))).alias("locale"))


@query("SELECT event_id, strftime(to_timestamp(1714521600 + user_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_format(t):
    return t("events").select("event_id", text.epoch_text(F.lit(1714521600) + F.col("user_id")).alias("at"))


@query("SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN 1 END AS label FROM documents WHERE lang IS NOT NULL")
def union_partitions(t):
    d = t("documents").select("doc_id", "lang").where("lang is not null")
    langs = [r.lang for r in d.select("lang").distinct().orderBy("lang").collect()]  # one row per partition
    return corpus.union([part.withColumn("label", F.lit(1)) if x == "fr" else part for x in langs for part in [d.where(F.col("lang") == x)]])


def _reply(quote_last: bool) -> str:
    return "concat('{\"topics\": [\"', lang, '\"], \"entities\": [\"', source, '\"], \"positive\": [], \"neutral\": [\"x\", ', if(doc_id % 3 = 0, 'null', '\"y\"'), '], ', if(doc_id % 5 = 0, '', '\"extra\": 1, '), if(doc_id % 7 = 0, '\"negated\"', '\"negative\"'), ': [', if(doc_id % 11 = 0, '1', '\"z\"'), ']', if(doc_id % 13 = 0, ',', ''), '}')"


@query("SELECT doc_id, ok, CASE WHEN ok THEN lang || ',' || source || ',2' END AS value FROM (SELECT *, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok FROM documents)")
def strict_parse(t):
    r = t("documents").select("doc_id", strict.parse_sentiment(F.expr(_reply(False))).alias("r"))
    return r.select("doc_id", "r.ok", F.concat_ws(",", "r.value.topics", "r.value.entities", F.size("r.value.neutral").cast("string")).alias("v")).select("doc_id", "ok", F.when(F.col("ok"), F.col("v")).alias("value"))


@query("SELECT doc_id, lang || '^' || source || chr(10) || source || '^' || chr(10) AS us FROM documents")
def us_frontier_strings(t):
    pair = lambda a, b: F.struct(F.col(a).alias("populism_element"), b.cast("string").alias("populism_affect"))
    return t("documents").select("doc_id", text.pairs_text(F.array(pair("lang", F.col("source")), pair("source", F.lit(None)))).alias("us"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10)), ', ') AS lines FROM documents")
def extraction_lists(t):
    return t("documents").select("doc_id", text.list_text(F.split("text", "\n")).alias("lines"))


@query("SELECT side, element, affect, count(*) AS n FROM (SELECT 'us' AS side, lower(lang) AS element, lower(source) AS affect FROM documents UNION ALL SELECT 'frontier', lower(source), lower(lang) FROM documents) GROUP BY ALL")
def us_frontier_counts(t):
    pair = lambda a, b: F.array(F.struct(F.col(a).alias("populism_element"), F.col(b).alias("populism_affect")))
    d = t("documents").select("doc_id", pair("lang", "source").alias("populism_us"), pair("source", "lang").alias("populism_frontier"))
    return analytics.counts(extract.elements(d, "doc_id"), "side", "element", "affect")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_summary(t):
    return analytics.daily(t("events"), "ts", "event_type")


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_days(t):
    out = tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT day, n, round(mean, 6) AS mean FROM (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)) WHERE n > mean * 1.05")
def peak_days(t):
    return analytics.peaks(analytics.daily(t("events"), "ts")).select("day", "n", F.round("mean", 6).alias("mean"))


@query("SELECT lang, source, count(*) AS n, grouping_id(lang, source)::INT AS level FROM documents GROUP BY CUBE (lang, source)")
def group_compare(t):
    return analytics.group_compare(t("documents"), "lang", "source")


@query("SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) x JOIN (SELECT DISTINCT user_id, event_type FROM events) y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL")
def cooccurrence(t):
    return analytics.cooccurrence(t("events"), "user_id", "event_type")


_parts = "(SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL)"


@query(f"SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM {_parts} x JOIN {_parts} y ON x.sale_id = y.sale_id AND x.item_id < y.item_id GROUP BY ALL HAVING count(*) >= 3")
def frequent_pairs(t):
    """Items that three sales or more have together."""
    return analytics.cooccurrence(t("sale_lines"), "sale_id", "item_id", 3)


@query("SELECT canonical, max(p_brand) AS label, count(*) AS n FROM (SELECT trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS canonical, p_brand FROM part) GROUP BY canonical")
def merge_names(t):
    return analytics.merge_names(t("part"), "p_brand")


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars::INT % 2) AS quality, CASE WHEN l.quality IS NULL THEN 'model' ELSE 'human' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def human_override(t):
    model = t("documents").select("doc_id", (F.col("n_chars").cast("int") % 2).alias("quality"))
    return analytics.override(model, t("labels"), "doc_id", "quality")


@query("SELECT doc_id, doc_id % 3 <> 0 AS chosen, CASE WHEN doc_id % 3 = 1 THEN lang END AS only FROM documents")
def pick_one(t):
    """From no, one or four distinct elements; what is chosen is one of them."""
    four = F.array("lang", "source", F.col("doc_id").cast("string"), F.lit("x"))
    some = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array("lang")).otherwise(four)
    picked = t("documents").select("doc_id", "lang", some.alias("some"), urls.choose(some, F.col("doc_id")).alias("choice"))
    return picked.select("doc_id", F.coalesce(F.array_contains("some", F.col("choice")), F.lit(False)).alias("chosen"), F.when(F.col("doc_id") % 3 == 1, F.col("choice")).alias("only"))


def _model(task: str):
    def run(t) -> DataFrame:
        rows = cache.todo(t("documents").select("doc_id", "text"), t("labels"), ("doc_id",))
        with small_batches(rows.sparkSession):
            return materialised(models.run_stage(rows, task, models.FakeClient, F.col("text"), ("doc_id",)), "stage")

    run.__name__ = f"model_{task}"
    query(f"SELECT doc_id::VARCHAR AS doc_id, true AS ok, '{task}:' || length(text)::VARCHAR AS value, NULL::VARCHAR AS error FROM documents ANTI JOIN labels USING (doc_id)")(run)


_model("summary")


class _Stub:
    """Replies of a text's own length; a frame at 60 seconds, speech of every fifth video and translations of every seventh fail."""

    def __init__(self, task: str):
        self.task = task

    def run(self, task: str, inputs: list) -> list:
        return [self.reply(x) for x in inputs]

    def reply(self, x):
        x = x.decode() if isinstance(x, bytes) else x
        if self.task == "frame" and x.endswith("@60") or self.task == "transcribe" and int(x) % 5 == 0 or self.task == "translate" and int(x.split()[1]) % 7 == 0:
            return ValueError(f"no {self.task}")
        if self.task == "sentiment":
            return '{"topics": ["t"], "entities": [], "positive": [], "neutral": [], "negative": []}' if len(x) % 2 else "no JSON"
        if self.task == "formula":
            return '{"populism_analysis": "%d", "populism_us": [{"populism_element": "people", "populism_affect": "hope"}], "populism_frontier": []}' % len(x)
        return {"ocr": f"o {x}", "frame": f"f {x}", "transcribe": f"speech {x} said", "language": "en", "translate": f"english {x}", "summary": f"summary of {len(x)}"}[self.task]


def _decoded(path: str, offsets: list[int]) -> list[bytes | None]:
    return [f"{path}@{s}".encode() for s in offsets]


_FRAME = "'### Frame ' || (i // 30 + 1)::VARCHAR || ' at ' || i::VARCHAR || ' seconds:' || chr(10) || 'f ' || id || '@' || i::VARCHAR || chr(10) || 'OCR:' || chr(10) || 'o ' || id || '@' || i::VARCHAR || chr(10)"


@query(f"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS id, 'speech ' || doc_id::VARCHAR || ' said' AS speech, doc_id % 5 <> 0 AS heard, doc_id % 7 <> 0 AS translated FROM documents),
f AS (SELECT id, string_agg({_FRAME}, '' ORDER BY i) FILTER (WHERE i <> 60) AS report, count(*) AS n FROM (SELECT doc_id::VARCHAR AS id, unnest(range(0, n_chars // 20, 30)) AS i FROM documents) GROUP BY id),
m AS (SELECT video_id AS id, metadata FROM (SELECT doc_id::VARCHAR AS video_id, {_BLOCK} AS metadata FROM documents)),
s AS (SELECT d.id, coalesce(n, 0) AS n_frames, CASE WHEN heard THEN CASE WHEN translated THEN 'english ' || speech ELSE speech END END AS transcript,
  'summary of ' || length('Frames:' || chr(10) || coalesce(report, '') || chr(10) || chr(10) || 'Metadata:' || chr(10) || metadata || chr(10) || chr(10) || 'Transcript:' || chr(10) || coalesce(transcript, '') || chr(10) || chr(10) || 'Analyse the politics of this video from the three sources above.')::VARCHAR AS summary
  FROM d LEFT JOIN f USING (id) JOIN m USING (id))
SELECT id AS video_id, n_frames, transcript, summary, CASE WHEN length(summary) % 2 = 1 THEN 't' END AS topics, length(summary)::VARCHAR AS analysis FROM s""")
def enrich_stages(t):
    from .enrichment import enrich

    out = enrich(as_videos(t("documents")), new_folder(t("documents").sparkSession, "enrich"), _Stub, decode=_decoded, media=F.col("videoId"))
    return out.select(F.col("videoId").alias("video_id"), F.coalesce(F.size("frames"), F.lit(0)).cast("long").alias("n_frames"), F.col("whisperResult").alias("transcript"), "summary", F.array_join("topics", ",").alias("topics"), F.col("populism_analysis").alias("analysis"))


@query("""WITH d AS (SELECT doc_id::VARCHAR AS id, doc_id, least(n_chars // 20, 180) AS s FROM documents)
SELECT 'frame' AS stage, id AS video_id, 'no frame' AS error, 2::BIGINT AS n FROM d WHERE s > 60
UNION ALL SELECT 'transcribe', id, 'no transcribe', 2 FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT 'translate', id, 'no translate', 2 FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0""")
def enrich_errors(t):
    """Two runs of the first stages over one root: what fails is logged by each, and nothing else is asked again."""
    from .enrichment import Stages, with_frames, with_transcripts

    spark, videos = t("documents").sparkSession, as_videos(t("documents"))
    stages = Stages(_Stub, new_folder(spark, "enrich"))
    for _ in range(2):
        with_frames(videos, stages, _decoded, F.col("videoId"))
        with_transcripts(videos, stages, F.col("videoId"))
    keys = {"frame": ("videoId", "frame_number"), "transcribe": ("videoId",), "translate": ("videoId",)}
    logs = [cache.errors(spark, stages.path(task), stages.schema(k)).select(F.lit(task).alias("stage"), F.col("videoId").alias("video_id"), "error") for task, k in keys.items()]
    return logs[0].unionAll(logs[1]).unionAll(logs[2]).groupBy("stage", "video_id", "error").agg(F.count("*").alias("n"))


def _found(route: str, body: Column) -> tuple[Column, Column]:
    return F.lit(f"https://www.tiktok.com/api/{route}").alias("request_url"), F.to_json(body).alias("body")


@query("SELECT doc_id::VARCHAR AS \"videoId\", lang AS \"authorUniqueId\" FROM documents WHERE doc_id % 3 = 0")
def json_search(t):
    """Of three kinds of hits, type 1, "1" and 2, only the number 1 is a video."""
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.col("lang").alias("uniqueId")).alias("author"))
    kind = F.when(F.col("doc_id") % 3 == 0, "1").when(F.col("doc_id") % 3 == 1, '"1"').otherwise("2")
    body = F.concat(F.lit('{"data": [{"type": '), kind, F.lit(', "item": '), F.to_json(item), F.lit("}]}"))
    rows = t("documents").select(F.lit("https://www.tiktok.com/api/search/general/full").alias("request_url"), body.alias("body"))
    return ingest.tables(ingest.routed(rows))["video"].select("videoId", "authorUniqueId")


@query("SELECT route || doc_id::VARCHAR AS \"videoId\", n_chars AS \"videoDuration\" FROM documents, (VALUES ('p'), ('c')) AS r(route)")
def json_lists(t):
    """Playlists wrap each item once more; lists of a challenge do not."""
    item = lambda p: F.struct(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("id"), F.struct(F.col("n_chars").alias("duration")).alias("video"))
    d = t("documents")
    playlist = d.select(*_found("user/playlist", F.struct(F.array(F.struct(item("p").alias("item"))).alias("itemList"))))
    challenge = d.select(*_found("challenge/item_list", F.struct(F.array(item("c")).alias("itemList"))))
    return ingest.tables(ingest.routed(playlist.unionAll(challenge)))["video"].select("videoId", "videoDuration")


_VIDEO = {"videoId": ("id", "string"), "videoDescription": ("desc", "string"), "videoCreated": ("createTime", "long"), "authorId": ("author.id", "string"), "authorUniqueId": ("author.uniqueId", "string"), "authorNickname": ("author.nickname", "string"), "authorAvatar": ("author.avatarLarger", "string"), "authorSignature": ("author.signature", "string"), "authorDiggCount": ("authorStats.diggCount", "long"), "authorFollowerCount": ("authorStats.followerCount", "long"), "authorFollowingCount": ("authorStats.followingCount", "long"), "authorFriendCount": ("authorStats.friendCount", "long"), "authorHeart": ("authorStats.heart", "long"), "authorHeartCount": ("authorStats.heartCount", "long"), "authorVideoCount": ("authorStats.videoCount", "long"), "videoUrl": ("video.downloadAddr", "string"), "videoCover": ("video.cover", "string"), "videoDuration": ("video.duration", "long"), "videoHeight": ("video.height", "long"), "videoWidth": ("video.width", "long"), "videoRatio": ("video.ratio", "string"), "videoPlayCount": ("stats.playCount", "long"), "videoShareCount": ("stats.shareCount", "long"), "videoCommentCount": ("stats.commentCount", "long"), "videoDiggCount": ("stats.diggCount", "long"), "videoCollectCount": ("stats.collectCount", "long"), "videoMusicId": ("music.id", "string"), "videoMusicTitle": ("music.title", "string"), "videoMusicAuthor": ("music.authorName", "string"), "videoMusicOriginal": ("music.original", "boolean"), "videoMusicCover": ("music.coverLarge", "string"), "videoMusicPlayUrl": ("music.playUrl", "string"), "videoMusicDuration": ("music.duration", "long")}
_cell = {"string": "'{n}:' || doc_id::VARCHAR", "long": "doc_id::BIGINT + {i}", "boolean": "doc_id % 2 = 0"}


@query("SELECT " + ", ".join(f'{_cell[k].format(n=n, i=i)} AS "{n}"' for i, (n, (_, k)) in enumerate(_VIDEO.items())) + " FROM documents")
def json_videos(t):
    """All 33 columns, each from a value of its own."""
    made = {"string": lambda n, i: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")), "long": lambda n, i: F.col("doc_id") + i, "boolean": lambda n, i: F.col("doc_id") % 2 == 0}
    top: dict[str, list] = {}
    for i, (n, (path, kind)) in enumerate(_VIDEO.items()):
        first, _, last = path.rpartition(".")
        top.setdefault(first, []).append(made[kind](n, i).alias(last))
    item = F.struct(*top.pop(""), *(F.struct(*fields).alias(name) for name, fields in top.items()))
    rows = t("documents").select(*_found("post/item_list", F.struct(F.array(item).alias("itemList"))))
    return ingest.tables(ingest.routed(rows))["video"]


@query("SELECT doc_id::VARCHAR AS \"videoId\", lang AS \"hashtagId\", source AS \"hashtagName\", NULL::VARCHAR AS \"hashtagHash\" FROM documents")
def posted_hashtags(t):
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("video_id"), F.col("lang").alias("hashtag_id"), F.col("source").alias("hashtag_name")))
    return ingest.posted(t("documents").select(F.lit("hashtag").alias("endpoint"), body.alias("body")))["hashtag"]


@query("SELECT conv_id::VARCHAR AS cid, role AS nickname, text AS comment_text, role AS description, turn::BIGINT AS digg_count, NULL::VARCHAR AS url FROM conversations")
def posted_comments(t):
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("cid"), F.col("role").alias("nickname"), F.col("text").alias("comment_text"), F.col("role").alias("desc"), F.col("turn").alias("digg_count")))
    rows = ingest.posted(t("conversations").select(F.lit("comment").alias("endpoint"), body.alias("body")))["comment"]
    return rows.select("cid", "nickname", "comment_text", "description", "digg_count", "url")


_FORMULA = "concat('{\"populism_analysis\": ', if(doc_id % 7 = 0, '1', '\"a\"'), ', \"populism_us\": [{\"populism_element\": \"', source, '\", \"populism_affect\": ', if(doc_id % 5 = 0, 'null', '\"hope\"'), '}], \"populism_', if(doc_id % 11 = 0, 'front', 'frontier'), '\": [', if(doc_id % 2 = 0, '{\"populism_element\": \"e\", \"populism_affect\": \"x\", \"more\": 1}', ''), ']}')"


@query("SELECT doc_id, ok, CASE WHEN ok THEN source || '^hope' || chr(10) END AS us, CASE WHEN ok THEN CASE WHEN doc_id % 2 = 0 THEN 'e^x' || chr(10) ELSE '' END END AS frontier FROM (SELECT *, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS ok FROM documents)")
def formula_parse(t):
    """Formula replies through the strict parser and the export of pairs."""
    d = extract.formulas(t("documents").select("doc_id", F.expr(_FORMULA).alias("reply")), "reply", "doc_id")
    flat = extract.export(d.select("doc_id", "ok", "populism_us", "populism_frontier"))
    return flat.select("doc_id", "ok", F.when(F.col("ok"), F.col("populism_us")).alias("us"), F.when(F.col("ok"), F.col("populism_frontier")).alias("frontier"))


#: Of each endpoint: the table's key, and its columns as the posted name, the column and the value's SQL in either engine. Every 97th key is missing.
_KEY = "CASE WHEN doc_id % 97 <> 0 THEN cast(doc_id % 700 AS string) END"
_POSTED = {
    "video": [("videoId", "videoId", _KEY), ("videoDescription", "videoDescription", "source"), ("scrapedCountry", "scrapedCountry", "lang"), ("videoDuration", "videoDuration", "n_chars")],
    "hashtag": [("hashtag_hash", "hashtagHash", _KEY), ("hashtag_id", "hashtagId", "lang"), ("hashtag_name", "hashtagName", "source"), ("video_id", "videoId", "cast(doc_id AS string)")],
    "comment": [("cid", "cid", _KEY), ("comment_text", "comment_text", "source"), ("desc", "description", "lang"), ("digg_count", "digg_count", "n_chars")],
    "author": [("usedId", "id", _KEY), ("nickname", "nickname", "source"), ("desc", "description", "lang"), ("diggCount", "diggCount", "n_chars")],
    "challenge": [("challengeId", "challengeId", _KEY), ("challengeTitle", "challengeTitle", "source"), ("challengeViewCount", "challengeViewCount", "n_chars"), ("challengeVideoCount", "challengeVideoCount", "doc_id")],
}


def _records(docs: DataFrame, endpoint: str) -> DataFrame:
    """Each document posted as a record, in the order of ids."""
    body = F.to_json(F.struct(*(F.expr(value).alias(name) for name, _, value in _POSTED[endpoint])))
    return docs.select("doc_id", F.lit(endpoint).alias("endpoint"), body.alias("body"), F.timestamp_seconds("doc_id").alias("received_at"))


def _inserted_sql(endpoint: str, parts: int) -> str:
    """First by part and id; all without a key."""
    cols = ", ".join(f'{value} AS "{column}"' for _, column, value in _POSTED[endpoint])
    return f'SELECT {cols} FROM documents QUALIFY doc_id % 97 = 0 OR row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id % {parts}, doc_id) = 1'


def _insert(endpoint: str):
    def run(t) -> DataFrame:
        """Posted records inserted in two batches, the second one twice."""
        docs, spark = t("documents"), t("documents").sparkSession
        root = new_folder(spark, "tables")
        for part in (0, 1, 1):
            rows, _ = ingest.arrivals(records=_records(docs.where(F.col("doc_id") % 2 == part), endpoint))
            ingest.insert({endpoint: rows[endpoint]}, root, part)
        return spark.read.parquet(f"{root}/{endpoint}").select(*(c for _, c, _ in _POSTED[endpoint]))

    run.__name__ = f"insert_{endpoint}"
    query(_inserted_sql(endpoint, 2))(run)


for _name in _POSTED:
    _insert(_name)


@query(_inserted_sql("comment", 3))
def stream_first_wins(t):
    """Posted comments land in three parts; a stream that is started anew for each keeps the first of every key."""
    from ..sources import landing
    from ..streaming import ingest as streaming

    docs, spark = t("documents"), t("documents").sparkSession
    home = new_folder(spark, "stream")
    for part in range(3):
        _records(docs.where(F.col("doc_id") % 3 == part), "comment").drop("doc_id").write.mode("append").json(f"{home}/landed")
        for q in streaming.start(f"{home}/tables", f"{home}/checkpoints", records=landing.stream(spark, f"{home}/landed", landing.RECORDS), names=("comment",)):
            q.awaitTermination()
    return spark.read.parquet(f"{home}/tables/comment").select(*(c for _, c, _ in _POSTED["comment"]))


_NAME = "CASE WHEN p_partkey % 3 = 0 THEN concat(substring(p_name, 1, 3), substring(p_name, 5)) WHEN p_partkey % 3 = 1 THEN concat(p_name, 'x') ELSE p_name END"
_NORMAL = f"trim(regexp_replace(lower({_NAME}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH f AS (SELECT DISTINCT {_NORMAL} AS name FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS distance FROM f a JOIN f b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= greatest(length(a.name), length(b.name)) // 6 WHERE levenshtein(a.name, b.name) <= greatest(length(a.name), length(b.name)) // 6")
def similar_names(t):
    """Part names, of which a third lost a letter and a third got one: all pairs within the allowed distance."""
    forms = t("part").select(analytics.canonical(F.expr(_NAME)).alias("name")).distinct()
    return names.similar(forms)


@query()
def fuzzy_names(t):
    """The same names merged: one label for each component."""
    return names.merged(t("part").select(F.expr(_NAME).alias("name")), "name")


_ODDS = """WITH c AS (SELECT flag AS g, vendor_id AS s, count(*)::DOUBLE AS n FROM sale_lines WHERE flag IS NOT NULL AND vendor_id IS NOT NULL GROUP BY ALL),
x AS (SELECT g, s, n, sum(n) OVER (PARTITION BY s) AS al, sum(n) OVER (PARTITION BY g) AS size, sum(n) OVER () AS whole, (SELECT count(DISTINCT g) FROM c) AS k FROM c),
y AS (SELECT *, al / k AS a, whole / k AS a0, al - n AS rest, whole - size AS lef FROM x)
SELECT g AS "group", s AS signifier, n::BIGINT AS n, rest::BIGINT AS others, round(d, 6) AS delta, round(d / sqrt(1 / (n + a) + 1 / (rest + a)), 6) AS z
FROM (SELECT *, ln((n + a) / (size + a0 - n - a)) - ln((rest + a) / (lef + a0 - rest - a)) AS d FROM y)"""


@query(_ODDS)
def signifier_odds(t):
    out = analytics.log_odds(t("sale_lines"), "flag", "vendor_id")
    return out.withColumns({"delta": F.round("delta", 6), "z": F.round("z", 6)})


#: Three annotators of a document's toxicity: the label, its quality turned round, and one who looks at the length and skips every fifth.
_ANNOTATED = "SELECT doc_id AS item, 'toxic' AS annotator, toxic AS label FROM labels UNION ALL SELECT doc_id, 'quality', 1 - quality FROM labels UNION ALL SELECT l.doc_id, 'length', d.n_chars % 2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 5 <> 0"


def _annotated(t) -> DataFrame:
    marks, docs = t("labels"), t("documents")
    one = marks.select(F.col("doc_id").alias("item"), F.lit("toxic").alias("annotator"), F.col("toxic").cast("int").alias("label"))
    two = marks.select("doc_id", F.lit("quality"), (1 - F.col("quality")).cast("int"))
    three = marks.where("doc_id % 5 <> 0").join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.lit("length"), (F.col("n_chars") % 2).cast("int"))
    return one.unionAll(two).unionAll(three)


@query(f"""WITH c AS (SELECT item, label, count(*)::DOUBLE AS n FROM ({_ANNOTATED}) WHERE item IS NOT NULL AND label IS NOT NULL GROUP BY ALL), p AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM c) WHERE m > 1),
l AS (SELECT label, sum(n) AS n, sum(n * (m - n) / (m - 1)) AS apart FROM p GROUP BY label)
SELECT sum(n)::BIGINT AS n, round(1 - (sum(n) - 1) * sum(apart) / (sum(n) * sum(n) - sum(n * n)), 6) AS alpha FROM l""")
def annotator_agreement(t):
    return annotators.alpha(_annotated(t)).withColumn("alpha", F.round("alpha", 6))


@query()
def annotator_truth(t):
    """The likeliest label of every annotated document, and its probability."""
    truth, _ = annotators.dawid_skene(_annotated(t))
    return truth.groupBy("item").agg(F.max_by("label", F.struct("p", "label")).alias("label"), F.round(F.max("p"), 4).alias("p"))


@query()
def term_bursts(t):
    """Bursts of each kind of click over the days of arrival."""
    return bursts.bursts(t("clicks"), "ts", "kind", scale=1.3, gamma=0.5)


def _network(t) -> DataFrame:
    """Who trades with whom: nations of clients and vendors, by lines of sales."""
    lines = t("sale_lines").select("sale_id", "vendor_id").na.drop()
    sold = t("sales").select("sale_id", "client_id").na.drop()
    home = t("clients").select("client_id", "nation_id").na.drop().distinct()
    return lines.join(sold, "sale_id").join(home, "client_id").groupBy(F.concat(F.lit("n"), "nation_id").alias("a"), F.concat(F.lit("v"), "vendor_id").alias("b")).agg(F.count("*").alias("n"))


@query()
def actor_communities(t):
    return graph.communities(_network(t), "n")


@query()
def actor_cores(t):
    return graph.cores(_network(t))


@query()
def actor_betweenness(t):
    """From 16 pivots."""
    return graph.betweenness(_network(t), 16).withColumn("betweenness", F.round("betweenness", 6))


@query("""SELECT 'd' || doc_id::VARCHAR AS node, min('d' || doc_id::VARCHAR) OVER (PARTITION BY text) AS component FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 't' || md5(text), min('d' || doc_id::VARCHAR) FROM documents WHERE text IS NOT NULL GROUP BY text""")
def text_components(t):
    """Documents and the texts that they have, as one graph: its components are the groups of equal texts."""
    d = t("documents").where("text is not null")
    return graph.components(d.select(F.concat(F.lit("d"), "doc_id").alias("a"), F.concat(F.lit("t"), F.md5("text")).alias("b")))


@query()
def vendor_chains(t):
    """Vendors that many sales have together, by their nations."""
    lines = t("sale_lines").select("sale_id", "vendor_id").join(t("vendors").select("vendor_id", "nation_id").na.drop().distinct(), "vendor_id")
    return chains.chains(lines, "sale_id", "nation_id", 0.002).select(F.array_join("elements", ",").alias("elements"), "n")


def visit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's events would have been looked at, by a stream of the events; one batch, so that no file of the table is late."""
    from ..streaming.visits import visits

    home, schema = new_folder(spark, "visits"), spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be one file, a path must be a folder
    out = visits(events, "user_id", "ts").writeStream.format("parquet").option("path", f"{home}/plan").option("checkpointLocation", f"{home}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/plan")


QUERIES["visit_plan"] = visit_plan
