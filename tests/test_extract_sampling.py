import json

import pytest
from pyspark.sql import functions as F

from qcloom.operators import extract as X
from qcloom.operators import sampling as T


def video(spark, **p):
    base = {"ok": True, "status": "OK", "hasVideoDetails": True, "title": "t", "lengthSeconds": "814", "viewCount": "100711", "publishDate": "2026-05-12T20:50:47-07:00", "tracks": [{"lang": "de", "kind": "asr"}, {"lang": "en", "kind": None}]}
    d = spark.createDataFrame([("v", json.dumps(base | p))], "id string, payload string")
    return X.flatten_video(d, F.lit("2026-05-22T20:50:47-07:00")).first()


def test_video(spark):
    r = video(spark)
    assert (r.ok, r.duration_s, r.view_count, r.publish_date, r.views_per_day, r.track_kind, r.track_lang) == (True, 814.0, 100711, "2026-05-12", 10071.1, "manual", "en")
    r = video(spark, status="ERROR", reason="Video unavailable", hasVideoDetails=False)
    assert (r.ok, r.error, r.provenance["metadata"]) == (False, "Video unavailable", "unavailable")
    assert video(spark, ok=False).error == "player response unavailable (page failed to load?)"
    r = video(spark, publishDate="", viewCount="36500")
    assert (r.days_since_publish, r.views_per_day) == (365, 100)
    assert video(spark, publishDate="May 12, 2026").days_since_publish == 365


@pytest.mark.parametrize("d,live,short", [(45, False, True), (180, False, True), (181, False, False), (814, False, False), (0, False, False), (45, True, False)])
def test_short(spark, d, live, short):
    assert spark.range(1).select(X.is_short_video(F.lit(float(d)), F.lit(live)).alias("s")).first().s is short


def tiles(spark, vids, shorts, tabs):
    d = spark.createDataFrame([(vids, shorts, tabs)], "a array<struct<id:string,title:string,views:string,age:string>>, b array<struct<id:string,title:string,views:string,age:string>>, tabs array<string>")
    d = X.channel_catalog(d, X.tiles_of(F.struct(F.col("a").alias("vids"))), X.tiles_of(F.struct(F.col("b").alias("vids"))), F.col("tabs"))
    return d.withColumn("v", X.tile_velocity(F.col("tiles"))).first()


GRID = [(f"v{i}", "t", v, a) for i, (v, a) in enumerate(zip(["100K views", "250K", "80K", "1.1M", "45K", "600K"], ["2 days ago", "1 week ago", "3 weeks ago", "2 months ago", "5 months ago", "8 months ago"]))]


def test_channel(spark):
    r = tiles(spark, GRID + GRID[:1], [], ["Home", "Shorts"])
    assert [t.days_ago for t in r.tiles] == [2, 7, 21, 60, 150, 240] and r.tiles[0].views == 100000
    assert (r.v.avg_last5, r.v.avg_prev5, r.v.velocity_score, r.is_shorts_only, r.shorts_count) == (315000, 600000, -0.475, False, 0)
    r = tiles(spark, [], GRID[:4], ["Home", " Shorts "])
    assert (r.is_shorts_only, r.shorts_count, len(r.tiles)) == (True, 4, 4)
    assert not tiles(spark, [], [], ["Shorts"]).is_shorts_only and not tiles(spark, [], GRID, ["Videos"]).is_shorts_only
    flat = spark.createDataFrame([(c, i, v) for c in ("x",) for i, v in enumerate([100e3, 250e3, 80e3, 1.1e6, 45e3, 600e3])], "c string, pos int, views double")
    assert X.upload_velocity(flat, "c", "pos").first().velocity_score == -0.475


def test_about_comments_likes(spark):
    about = {"ok": True, "title": "C", "subscriberCountText": "1.2M subscribers", "viewCountText": "458,000,000 views", "videoCountText": "642 videos", "joinedDateText": "Joined Mar 3, 2015"}
    r = X.flatten_channel(spark.createDataFrame([("c", json.dumps(about)), ("d", "{}")], "id string, payload string")).orderBy("id").collect()
    assert (r[0].subscribers, r[0].total_views, r[0].video_count, r[0].joined_date) == (1200000, 458000000, 642, "Mar 3, 2015") and not r[1].found
    c = json.dumps({"count_text": "1,204 Comments", "comments": [{"author": "a" * 70, "text": "x" * 400, "likes": "3"}] * 5})
    got = spark.createDataFrame([(c,)], "p string").select(X.flatten_comments(F.col("p"), 2).alias("c")).first().c
    assert (got["count"], len(got.top_comments), len(got.top_comments[0].text), len(got.top_comments[0].author)) == (1204, 2, 300, 60)
    n, where = X.likes_count(F.lit("like along with 12K people"))
    assert tuple(spark.range(1).select(n, where).first()) == (12000, "dom-aria")


def test_panel(spark):
    text = "Overview Subs 4.51M Views 2.5B 427 videos 11 years old 93.7 / 100 vidIQ SEO Controversial Keywords Upgrade to Boost"
    r = X.panel_stats(spark.createDataFrame([(text,), ("Overview Subs",), (None,)], "p string"), "p").collect()
    assert (r[0].present, r[0].subscribers, r[0].total_views, r[0].video_count, r[0].channel_age, r[0].seo_score, r[0].controversial_locked) == (True, "4.51M", "2.5B", "427", "11 years old", "93.7", True)
    assert not r[1].present and not r[2].present
    text = "Subscribers 1.2M +0.22% Ranked #9.7k Quick channel stats Views gained (7 days) +15,333,011 Est. monthly earnings US$13.3k Similar channels Macha 2M subscribers Other One 3K subscribers"
    r = X.panel_stats(spark.createDataFrame([(text,)], "p string"), "p", "channel").first()
    assert (r.rank, r.subscribers_growth, r.views_gained_7d, r.est_monthly_earnings, r.similar_channels) == ("#9.7k", "+0.22%", "+15,333,011", "US$13.3k", ["Macha", "Other One"])


def test_budget_and_deep_find(spark):
    d = spark.createDataFrame([([5, 20, 4, 3, 1],), ([],)], "s array<int>").select(X.greedy_budget(F.col("s"), 10, 10).alias("k"))
    assert [r.k for r in d.collect()] == [[0, 2, 4], []]
    page = json.dumps({"a": [{"k": 1}, {"b": {"k": {"k": 2}}}], "k": "x"})
    got = X.deep_find(spark.createDataFrame([(1, page), (2, "no json"), (3, None)], "id int, page string"), "page", "k").collect()
    assert sorted((r.path, r.value) for r in got) == [("/a/0/k", "1"), ("/a/1/b/k", '{"k": 2}'), ("/a/1/b/k/k", "2"), ("/k", '"x"')]


def windows(spark, d, segs=None, **profile):
    df = spark.createDataFrame([(float(d), segs)], "duration_s double, segments array<struct<start_s:double,text:string>>")
    return T.sample(df, **profile).first().windows


def test_windows(spark):
    w = windows(spark, 30)
    assert [(x.label, x.start_s, x.end_s, x.frame_t) for x in w] == [("intro", 0.0, 15.0, 7.5)]
    assert sum(x.end_s - x.start_s for x in windows(spark, 300)) == 73.5
    assert sum(x.end_s - x.start_s for x in windows(spark, 1800)) <= 121
    w = windows(spark, 7200)
    assert w[0].label == "intro" and w[-1].label == "outro" and w[-1].frame_t > 6000
    w = windows(spark, 814)
    assert [round(x.start_s, 2) for x in w] == [4.28, 191.5, 395, 598.5, 736.88] and all(x.start_s <= x.frame_t <= x.end_s for x in w)
    assert [x.text for x in windows(spark, 600)] == [""] * 5


def test_speech(spark):
    segs = [(3.0, "a"), (42.0, "b"), (135.0, "c"), (330.0, "d"), (648.0, "e")]
    w = windows(spark, 814, segs)
    assert [len(x.text.split()) for x in w] == [4, 2, 1, 1, 0] and [round(x.frame_t, 2) for x in w] == [28.28, 215.5, 419, 622.5, 748.88]
    every = [(6.0 * i, f"words at {6 * i}") for i in range(150)]
    full = windows(spark, 814, every)
    base = spark.createDataFrame([("v", 814.0)], "id string, duration_s double")
    _, want = T.window_seconds(F.col("duration_s"))
    flat = base.select("id", want.alias("want_s"), F.explode(T.merge_windows(T.plan_windows(F.col("duration_s")))).alias("w")).select("id", "want_s", "w.*")
    for s, ws in ((segs, w), (every, full)):
        joined = T.speech_join(flat, spark.createDataFrame([("v", *x) for x in s], "id string, start_s double, text string"), "id").collect()
        assert {(r.label, r.text, round(r.frame_t, 6)) for r in joined} == {(x.label, x.text, round(x.frame_t, 6)) for x in ws}
    df = spark.createDataFrame([(814.0, segs)], "duration_s double, segments array<struct<start_s:double,text:string>>")
    block = T.sample(df).select(T.format_excerpts(F.col("windows"), F.col("duration_s")).alias("b")).first().b
    assert block.startswith("== TRANSCRIPT EXCERPTS (sampled ~") and "[intro 0:04-0:28] b c d e" in block and block.count("\n") == 4
