"""Captured page payloads to typed rows. Payload schemas are PLAYER, ABOUT, GRID, TABS and COMMENTS."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_to_days, clock_to_seconds, norm, or_null, parse_count, prefix, publish_age, publish_date, text, views_per_day

PLAYER = """ok boolean, status string, reason string, hasVideoDetails boolean, title string, author string, channelId string,
lengthSeconds string, viewCount string, keywords array<string>, shortDescription string, isLiveContent boolean, publishDate string,
category string, isFamilySafe boolean, tracks array<struct<lang:string,kind:string>>"""
ABOUT = """ok boolean, title string, externalId string, description string, subscriberCountText string, viewCountText string,
videoCountText string, country string, joinedDateText string, links array<struct<title:string,url:string>>, channelKeywords string, isFamilySafe boolean"""
GRID = "n int, vids array<struct<id:string,title:string,views:string,age:string>>"
TABS = "n int, tabs array<string>"
COMMENTS = "count_text string, comments array<struct<author:string,text:string,likes:string>>"
SEGMENTS = "n int, segs array<struct<t:string,text:string>>"

SHORT_SECONDS = 180


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def flatten_video(payloads: DataFrame, as_of: Column, col: str = "payload") -> DataFrame:
    """video_id and a player payload (JSON text) to video rows. as_of: the moment that ages are taken at."""
    p = payloads.withColumn("p", F.from_json(col, PLAYER)).select(*[c for c in payloads.columns if c != col], "p.*")
    loaded = F.coalesce("ok", F.lit(False))
    playable = loaded & (F.coalesce(or_null(F.col("status")), F.lit("OK")) == "OK") & F.coalesce("hasVideoDetails", F.lit(True))
    error = F.when(~loaded, F.lit("player response unavailable (page failed to load?)")).when(~playable, F.coalesce(or_null(F.col("reason")), or_null(F.col("status")), F.lit("video unavailable")))
    kept = lambda c, default=None: F.when(playable, c).otherwise(F.lit(default))
    views = F.coalesce(F.col("viewCount").try_cast("long"), F.lit(0).cast("long"))
    p = p.withColumn("playable", playable).withColumn("days_since_publish", F.when(playable, publish_age(F.col("publishDate"), as_of)).otherwise(F.lit(365.0)))
    kind, lang = caption_provenance(F.col("tracks"))
    own = [c for c in payloads.columns if c != col]
    return p.select(
        *own, F.col("playable").alias("ok"), error.alias("error"), kept(_or_empty("title"), "").alias("title"), kept(_or_empty("author"), "").alias("author"),
        kept(_or_empty("channelId"), "").alias("channel_id"), kept(F.coalesce(F.col("lengthSeconds").try_cast("double"), F.lit(0.0)), 0.0).alias("duration_s"),
        kept(views, 0).cast("long").alias("view_count"), kept(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"),
        kept(_or_empty("shortDescription"), "").alias("description"), kept(_or_empty("category"), "").alias("youtube_category"),
        kept(publish_date(F.col("publishDate")), "").alias("publish_date"), kept(F.col("isFamilySafe")).alias("is_family_safe"),
        kept(F.coalesce("isLiveContent", F.lit(False)), False).alias("is_live"), "days_since_publish",
        kept(views_per_day(views, F.col("days_since_publish")), 0.0).alias("views_per_day"), kind.alias("track_kind"), lang.alias("track_lang"),
        provenance(metadata=F.when(~loaded, F.lit("none")).when(playable, F.lit("player_response")).otherwise(F.lit("unavailable"))).alias("provenance"),
    )


def flatten_channel(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """channel_id and an about payload to channel rows; `found` tells if the payload was there."""
    own = [c for c in payloads.columns if c != col]
    p = payloads.withColumn("p", F.from_json(col, ABOUT)).select(*own, "p.*")
    found = F.coalesce("ok", F.lit(False))
    kept = lambda c, default="": F.when(found, c).otherwise(F.lit(default))
    return p.select(
        *own, found.alias("found"), kept(_or_empty("title")).alias("title"), kept(_or_empty("externalId")).alias("external_id"), kept(_or_empty("description")).alias("description"),
        kept(parse_count(F.col("subscriberCountText")), 0).alias("subscribers"), kept(parse_count(F.col("viewCountText")), 0).alias("total_views"),
        kept(parse_count(F.col("videoCountText")), 0).alias("video_count"), kept(_or_empty("country")).alias("country"),
        kept(F.replace(_or_empty("joinedDateText"), F.lit("Joined "), F.lit(""))).alias("joined_date"), F.when(found, F.col("links")).alias("links"),
        kept(_or_empty("channelKeywords")).alias("channel_keywords"), kept(F.col("isFamilySafe"), None).alias("is_family_safe"),
        provenance(about=F.when(found, F.lit("ytInitialData")).otherwise(F.lit("none"))).alias("provenance"),
    )


# Fixed value: the error of a channel page that shows nothing.
NO_CHANNEL = "channel page extraction failed (not found / renamed?)"


def channel_error(title: Column, tiles: Column) -> Column:
    return F.when((title == "") & (F.size(tiles) == 0), F.lit(NO_CHANNEL))


def tiles_of(*grids: Column) -> Column:
    """Tiles of the first grid that has any: array of (video_id, title, views, days_ago), each id once."""
    none = F.array().cast("array<struct<id:string,title:string,views:string,age:string>>")
    first = F.coalesce(*[F.when(F.size(g["vids"]) > 0, g["vids"]) for g in grids], none)
    once = F.aggregate(first, none, lambda a, v: F.when(F.exists(a, lambda x: x["id"] == v["id"]), a).otherwise(F.concat(a, F.array(v))))
    return F.transform(once, lambda v: F.struct(v["id"].alias("video_id"), F.coalesce(v["title"], F.lit("")).alias("title"), parse_count(v["views"]).alias("views"), age_to_days(v["age"]).alias("days_ago")))


def explode_tiles(df: DataFrame, key: str, tiles: str = "tiles") -> DataFrame:
    return df.select(key, F.posexplode(tiles).alias("pos", "t")).select(key, "pos", "t.*")


def has_shorts_tab(tabs: Column) -> Column:
    return F.coalesce(F.exists(tabs, lambda t: norm(t) == "shorts"), F.lit(False))


def shorts_only(tabs: Column, long_form: Column, shorts: Column) -> Column:
    """A shorts tab, no long-form uploads, and shorts."""
    return has_shorts_tab(tabs) & (F.coalesce(F.size(long_form), F.lit(0)) == 0) & (F.coalesce(F.size(shorts), F.lit(0)) > 0)


def channel_catalog(df: DataFrame, long_form: Column, shorts: Column, tabs: Column) -> DataFrame:
    """df with tiles, long_form_count, shorts_count, has_shorts_tab and is_shorts_only."""
    only = shorts_only(tabs, long_form, shorts)
    return (
        df.withColumn("is_shorts_only", only).withColumn("has_shorts_tab", has_shorts_tab(tabs)).withColumn("long_form_count", F.size(long_form))
        .withColumn("shorts_count", F.when(F.col("is_shorts_only"), F.size(shorts)).otherwise(0)).withColumn("tiles", F.when(F.col("is_shorts_only"), shorts).otherwise(long_form))
    )


def is_short_video(duration: Column, live: Column) -> Column:
    return (duration > 0) & (duration <= SHORT_SECONDS) & ~live


def caption_provenance(tracks: Column) -> tuple[Column, Column]:
    """(kind, language) of the track to trust: a manual one before a generated one."""
    manual = F.filter(tracks, lambda t: ~t["kind"].eqNullSafe(F.lit("asr")))
    kind = F.when(F.size(manual) > 0, F.lit("manual")).when(F.size(tracks) > 0, F.lit("asr"))
    return kind, F.coalesce(F.get(manual, F.lit(0))["lang"], F.get(tracks, F.lit(0))["lang"])


def transcript_segments(segs: Column) -> Column:
    """(t, text) to (start_s, text); rows that lack either go."""
    both = F.filter(segs, lambda s: (text(s["t"]) != "") & (text(s["text"]) != ""))
    return F.transform(both, lambda s: F.struct(clock_to_seconds(s["t"]).alias("start_s"), s["text"].alias("text")))


def flatten_comments(payload: Column, top: int = 20) -> Column:
    """(count, count_text, top_comments) of a comments payload."""
    p = F.from_json(payload, COMMENTS)
    cut = lambda c: F.struct(F.substring(c["author"], 1, 60).alias("author"), F.substring(c["text"], 1, 300).alias("text"), c["likes"].alias("likes"))
    return F.struct(parse_count(p["count_text"]).alias("count"), F.coalesce(p["count_text"], F.lit("")).alias("count_text"), F.transform(prefix(F.coalesce(p["comments"], F.array().cast("array<struct<author:string,text:string,likes:string>>")), top), cut).alias("top_comments"))


def likes_count(label: Column) -> tuple[Column, Column]:
    """(likes, provenance) from a button's label."""
    found = F.regexp_extract(F.coalesce(label, F.lit("")), r"(?i)[\d,.]+\s*[KMB]?", 0)
    return parse_count(found), F.when(found != "", F.lit("dom-aria")).otherwise(F.lit("none"))


# Labels that a statistics panel shows beside its numbers.
SIMILAR = r"(?i)([A-Za-z0-9][A-Za-z0-9 ._'&-]*?)\s+[\d.,]+[KMB]?\s+subscribers"
LOCKED = ["(?i)Controversial Keywords", "(?i)(Upgrade to Boost|Unlock controversial)"]
PANEL = {
    "video": {
        "subscribers": r"(?i)Subs\s+([\d.,]+[KMB]?)", "total_views": r"(?i)Subs\s+[\d.,]+[KMB]?\s+Views\s+([\d.,]+[KMB]?)",
        "video_count": r"(?i)([\d.,]+)\s+videos", "channel_age": r"(?i)(\d+\s+years?\s+old)", "seo_score": r"(?i)([\d.]+)\s*/\s*100\s*vidIQ SEO",
    },
    "channel": {
        "subscribers": r"(?i)Subscribers\s+([\d.,]+[KMB]?)", "rank": r"(?i)Ranked\s*(#[\d.,]+[KMB]?)",
        "views_gained_7d": r"(?i)Views gained \(7 days\)\s*([+\-]?[\d.,]+)", "est_monthly_earnings": r"(?i)Est\. monthly earnings\s*(US?\$[\d.,]+[KMB]?)",
        "subscribers_growth": r"(?i)Subscribers\s+[\d.,]+[KMB]?\s+([+\-][\d.,]+%)", "video_count": r"(?i)([\d.,]+)\s+videos",
        "avg_video_length": r"(?i)Avg\. video length\s*([\d.,]+\s*\w+)", "upload_frequency": r"(?i)Upload frequency\s*(~?[\d.,]+\s*uploads?\s*per\s*\w+)",
    },
}
PANEL_KEYS = {"video": ["subscribers", "seo_score"], "channel": ["subscribers", "rank", "views_gained_7d", "est_monthly_earnings"]}


def panel_stats(df: DataFrame, col: str, scope: str = "video", patterns: dict | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with the fields of a statistics panel's text, verbatim, and `present`: whether one of its key values is there."""
    patterns, keys = patterns or PANEL[scope], keys or PANEL_KEYS[scope]
    t = text(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"(?U)\s+", " "))
    df = df.withColumn("_panel", t)
    got = {k: F.trim(F.regexp_extract("_panel", p, 1)) for k, p in patterns.items()}
    present = F.lit(False)
    for k in keys:
        present = present | (got[k] != "")
    df = df.withColumn("present", present)
    for k, c in got.items():
        df = df.withColumn(k, F.when(F.col("present"), c).otherwise(F.lit("")))
    locked = F.col("_panel").rlike(LOCKED[0]) & F.col("_panel").rlike(LOCKED[1])
    tail = F.regexp_extract("_panel", r"(?is)Similar channels(.*)", 1)
    similar = F.slice(F.transform(F.regexp_extract_all(tail, F.lit(SIMILAR), F.lit(1)), lambda x: F.trim(x)), 1, 8)
    return df.withColumn("controversial_locked", F.col("present") & locked).withColumn("similar_channels", F.when(F.col("present"), similar)).drop("_panel")


def panel_copy(scope: Column, field: str, only: str | None = None) -> Column:
    """A panel field for the record; fields of one scope are empty in the other."""
    c = F.coalesce(F.col(f"panel.{field}"), F.lit(""))
    c = F.when(F.col("panel.ok"), c).otherwise(F.lit(""))
    return F.when(scope == only, c).otherwise(F.lit("")) if only else c


def upload_velocity(uploads: DataFrame, key: str, order: str, views: str = "views") -> DataFrame:
    """(key, avg_last5, avg_prev5, velocity_score) of uploads, `order` ascending from the newest."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    top = uploads.select(key, F.col(views).alias("views"), rn.alias("rn")).where("rn <= 10")
    avg = top.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("rn") <= 5, F.col("views"))), F.lit(0.0)).alias("r"), F.coalesce(F.avg(F.when(F.col("rn") > 5, F.col("views"))), F.lit(0.0)).alias("p"))
    return avg.select(key, F.bround("r", 0).alias("avg_last5"), F.bround("p", 0).alias("avg_prev5"), F.bround((F.col("r") - F.col("p")) / F.greatest("p", F.lit(1.0)), 4).alias("velocity_score"))


def tile_velocity(tiles: Column) -> Column:
    """The same from a row's own tiles: struct of avg_last5, avg_prev5, velocity_score."""
    views = F.transform(tiles, lambda t: t["views"].cast("double"))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)).otherwise(F.lit(0.0))
    r, p = mean(F.slice(views, 1, 5)), mean(F.slice(views, 6, 5))
    return F.struct(F.bround(r, 0).alias("avg_last5"), F.bround(p, 0).alias("avg_prev5"), F.bround((r - p) / F.greatest(p, F.lit(1.0)), 4).alias("velocity_score"))


def greedy_budget(sizes: Column, item_cap: int, total_cap: int) -> Column:
    """Places (from 0) of elements kept in order: none over item_cap, none that would break total_cap; a later, smaller one may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    each = F.transform(sizes, lambda s, i: F.struct(s.cast("long").alias("s"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["s"] <= item_cap) & (acc["used"] + x["s"] <= total_cap)
        return F.when(fits, F.struct((acc["used"] + x["s"]).alias("used"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))).otherwise(acc)

    return F.aggregate(each, start, step, lambda a: a["kept"])


def provenance(**sources: Column) -> Column:
    """A map of field -> where its value came from."""
    return F.create_map(*[x for k, c in sources.items() for x in (F.lit(k), c)])


class _DeepFind:
    def eval(self, page: str, key: str):
        if page is None:
            return
        try:
            root = json.loads(page)
        except ValueError:
            return
        stack = [("", root, 0)]
        while stack:
            path, x, depth = stack.pop()
            if depth > 28:
                continue
            pairs = list(x.items()) if isinstance(x, dict) else [(str(i), v) for i, v in enumerate(x)] if isinstance(x, list) else []
            for k, v in pairs:
                if isinstance(x, dict) and k == key:
                    yield f"{path}/{k}", json.dumps(v, ensure_ascii=False)
            stack.extend((f"{path}/{k}", v, depth + 1) for k, v in reversed(pairs))


def deep_find(df: DataFrame, col: str, key: str) -> DataFrame:
    """df's rows once for every value under `key` anywhere in a JSON text: path and value (JSON)."""
    find = F.udtf(_DeepFind, returnType="path string, value string")
    return df.lateralJoin(find(F.col(col).outer(), F.lit(key)))
