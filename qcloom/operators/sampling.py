"""Transcript windows: where to sample a video, and what is said there. Arrays inside a row; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mmss, text

# Window names and where in the video their centres lie.
ANCHORS = [("intro", 0.02), ("early", 0.25), ("middle", 0.50), ("late", 0.75), ("outro", 0.92)]
FULL = {"target_min": 60.0, "target_max": 120.0, "pct": 0.25, "n_windows": 5}
LITE = {"target_min": 30.0, "target_max": 60.0, "pct": 0.25, "n_windows": 2}
SECONDS = 6.0  # a spoken segment's usual length

WINDOWS = "array<struct<label:string,start_s:double,end_s:double,frame_t:double>>"


def sampling_profile(depth: str) -> dict:
    return FULL if depth == "full" else LITE


def window_seconds(duration: Column, target_min=60.0, target_max=120.0, pct=0.25, n_windows=5) -> tuple[Column, Column]:
    """(number of windows, seconds of each)."""
    d = F.greatest(duration, F.lit(1.0))
    short = d <= target_min + 15
    target = F.when(short, F.least(d, F.lit(target_min))).otherwise(F.least(F.greatest(d * pct, F.lit(target_min)), F.lit(target_max)))
    n = F.when(short, F.when(d > 45, 3).otherwise(2)).otherwise(n_windows)
    return n, target / n


def plan_windows(duration: Column, **profile) -> Column:
    """Windows around the first n anchors, clipped to the video, empty ones left out."""
    d = F.greatest(duration, F.lit(1.0))
    n, w = window_seconds(duration, **(profile or FULL))
    anchors = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(a).alias("at")) for k, a in ANCHORS])

    def window(a: Column) -> Column:
        s, e = F.greatest(F.lit(0.0), a["at"] * d - w / 2), F.least(d - 0.5, a["at"] * d + w / 2)
        return F.struct(a["label"].alias("label"), s.alias("start_s"), e.alias("end_s"), ((s + e) / 2).alias("frame_t"))

    return F.filter(F.transform(F.slice(anchors, F.lit(1), n), window), lambda x: x["end_s"] > x["start_s"])


def merge_windows(windows: Column) -> Column:
    """Windows that start before the one in front ends become one, under the first one's name."""

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["end_s"], w["end_s"])
        joined = F.struct(last["label"].alias("label"), last["start_s"].alias("start_s"), end.alias("end_s"), ((last["start_s"] + end) / 2).alias("frame_t"))
        return F.when(F.size(acc) == 0, F.array(w)).when(w["start_s"] <= F.try_element_at(acc, F.lit(-1))["end_s"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(windows, F.array().cast(WINDOWS), step)


def fill_speech(windows: Column, segments: Column, want_s: Column) -> Column:
    """Windows with `text`: segments that start inside; where there are none, the next ones; where there are few, some more.

    segments: array of (start_s, text) in order. want_s: a window's length before merging.
    """
    none = F.array().cast("array<struct<start_s:double,text:string>>")
    segs = F.coalesce(segments, none)

    def fill(w: Column) -> Column:
        inside = F.filter(segs, lambda s: (s["start_s"] >= w["start_s"]) & (s["start_s"] < w["end_s"]))
        after = F.slice(F.filter(segs, lambda s: s["start_s"] >= w["start_s"]), F.lit(1), F.greatest(F.lit(3), F.floor(want_s / SECONDS).cast("int")))
        more = F.greatest(F.floor((want_s - F.size(inside) * SECONDS) / SECONDS).cast("int"), F.lit(0))
        extra = F.slice(F.filter(segs, lambda s: s["start_s"] >= w["end_s"]), F.lit(1), more)
        got = F.when(F.size(inside) == 0, after).otherwise(F.concat(inside, extra))
        said = F.array_join(F.filter(F.transform(got, lambda s: text(s["text"])), lambda x: x != ""), " ")
        frame = F.when(F.size(got) > 0, F.least(F.greatest(F.get(got, F.lit(0))["start_s"] + 2.0, w["start_s"]), w["end_s"])).otherwise(w["frame_t"])
        return F.struct(w["label"].alias("label"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), frame.alias("frame_t"), said.alias("text"))

    return F.transform(windows, fill)


def sample(df: DataFrame, duration: str = "duration_s", segments: str = "segments", **profile) -> DataFrame:
    """df with `windows`."""
    _, want = window_seconds(F.col(duration), **(profile or FULL))
    return df.withColumn("windows", fill_speech(merge_windows(plan_windows(F.col(duration), **profile)), F.col(segments), want))


SLOT = 600.0  # seconds of transcript that are numbered together


def numbered(segments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Segments (key, start_s, text) with `slot` and `i`, their place within the key by time, and the segments of each slot.

    Rows are sorted within slots of time only, so that a very long transcript is many small sorts.
    """
    s = segments.where(F.col("start_s").isNotNull()).select(key, "start_s", "text", F.floor(F.col("start_s") / SLOT).alias("slot"))
    slots = s.groupBy(key, "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rn = F.row_number().over(Window.partitionBy(key, "slot").orderBy("start_s", "text"))
    return s.withColumn("rn", rn).join(slots.withColumn("before", before).drop("n"), [key, "slot"]).withColumn("i", F.col("before") + F.col("rn")).drop("rn", "before"), slots


def speech_join(windows: DataFrame, segments: DataFrame, key: str, want: str = "want_s") -> DataFrame:
    """The same for transcripts kept as a table: windows (key, label, start_s, end_s, frame_t, want_s), one for each key and
    label, and segments (key, start_s, text).

    Segments are numbered within their key; a window's own and next ones are a range of numbers, and only those are
    joined, by key and number.
    """
    segs, slots = numbered(segments, key)
    w = windows.select(key, "label", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), "frame_t", want)
    at = w.select(key, "label", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("w_start").alias("x")), F.struct(F.lit(1).alias("end"), F.col("w_end").alias("x")))).alias("p"))
    at = at.select(key, "label", "p.*", F.floor(F.col("p.x") / SLOT).alias("in_slot"))
    full = at.join(slots, key).where("slot < in_slot").select(key, "label", "end", "n")
    part = at.join(segs.withColumnRenamed("slot", "in_slot").select(key, "in_slot", "start_s"), [key, "in_slot"]).where("start_s < x").select(key, "label", "end", F.lit(1).cast("long").alias("n"))
    n = lambda end: F.coalesce(F.sum(F.when(F.col("end") == end, F.col("n"))), F.lit(0))
    before = full.unionByName(part).groupBy(key, "label").agg(n(0).alias("first"), n(1).alias("last"))
    d = w.join(before, [key, "label"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first", "last")})
    inside = F.col("last") - F.col("first")
    more = F.greatest(F.floor((F.col(want) - inside * SECONDS) / SECONDS), F.lit(0))
    wanted = F.when(inside == 0, F.greatest(F.lit(3), F.floor(F.col(want) / SECONDS))).otherwise(inside + more)
    asked = d.select(key, "label", F.explode(F.sequence(F.col("first") + 1, F.col("first") + wanted)).alias("i"))
    got = asked.join(segs.select(key, "i", "start_s", "text"), [key, "i"]).groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("start_s", "text"))).alias("segs"))
    lists = w.join(got, [key, "label"], "left")
    one = F.array(F.struct("label", F.col("w_start").alias("start_s"), F.col("w_end").alias("end_s"), "frame_t"))
    return lists.select(key, F.explode(fill_speech(one, F.col("segs"), F.col(want))).alias("w")).select(key, "w.*")


def format_excerpts(windows: Column, duration: Column) -> Column:
    """A header and a line for each window in which something is said."""
    seconds = F.aggregate(windows, F.lit(0.0), lambda a, w: a + (w["end_s"] - w["start_s"]))
    head = F.concat(F.lit("== TRANSCRIPT EXCERPTS (sampled ~"), F.floor(seconds).cast("string"), F.lit("s of "), F.floor(duration).cast("string"), F.lit("s) =="))
    line = lambda w: F.concat(F.lit("["), w["label"], F.lit(" "), mmss(w["start_s"]), F.lit("-"), mmss(w["end_s"]), F.lit("] "), w["text"])
    return F.array_join(F.concat(F.array(head), F.transform(F.filter(windows, lambda w: w["text"] != ""), line)), "\n")


def frame_times(windows: Column, n: int, live: Column) -> Column:
    """Moments to look at; none for live items."""
    return F.when(live, F.array().cast("array<double>")).otherwise(F.slice(F.transform(windows, lambda w: w["frame_t"]), 1, n))
