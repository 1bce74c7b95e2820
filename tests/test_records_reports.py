import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qcloom.functions import vocab as V
from qcloom.operators import conflict as C
from qcloom.operators import record as R
from qcloom.operators import report as B
from qcloom.operators import score as K
from qcloom.operators import state as ST

CLEAN = {"ok": True, "visual_kids_signals": {"present": False, "signals": []}, "visual_safety_flags": [], "visible_language": "en"}
KIDS = {"visual_kids_signals": {"present": True, "signals": ["toys"]}}
FLAG = lambda s: {"visual_safety_flags": [{"category": "x", "evidence": "y", "severity": s}]}


@pytest.mark.parametrize("vision,tier,risk,lang,voted,share,want", [
    ({}, "Gaming", "none", "en", None, None, []),
    ({"ok": False} | KIDS, "Gaming", "none", "en", None, None, []),
    (KIDS, "Automobile", "none", "en", None, None, ["tier_1"]),
    (KIDS, "Kids", "none", "en", None, None, []),
    (FLAG("high"), "Gaming", "none", "en", None, None, ["brand_safety.risk_level"]),
    (FLAG("high"), "Gaming", "low", "en", None, None, []),
    (FLAG("low"), "Gaming", "none", "en", None, None, []),
    ({"visible_language": "es"}, "Gaming", "none", "en", None, None, ["language"]),
    ({}, "Automobile", "none", "en", "Gaming", 0.6, ["tier_1"]),
    ({}, "Gaming", "none", "en", "Gaming", 0.4, ["tier_1"]),
    ({}, "Automobile", "none", "en", "Gaming", None, []),
    (KIDS | FLAG("medium") | {"visible_language": "es"}, "Automobile", "none", "en", "Gaming", 0.6, ["tier_1", "brand_safety.risk_level", "language", "tier_1"]),
])
def test_conflicts(spark, vision, tier, risk, lang, voted, share, want):
    d = spark.createDataFrame([(json.dumps(CLEAN | vision), tier, risk, lang, voted, share)], "v string, tier string, risk string, lang string, voted string, share double")
    d = d.withColumn("v", F.from_json("v", C.VISION))
    got = d.select(C.detect_conflicts(*map(F.col, ("tier", "risk", "lang", "v", "voted", "share"))).alias("c")).first().c
    assert [x.field for x in got] == want


def test_resolution(spark):
    rec = spark.createDataFrame([(i, "Gaming", "fps", "en", "none", None, "note") for i in "abc"], "id string, tier_1 string, tier_2 string, language string, risk_level string, kids_age_group string, qc_notes string")
    res = spark.createDataFrame([("a", {"tier_2": "Nursery Rhymes", "language": "Spanish", "brand_safety.risk_level": "HIGH", "tier_1": "Nonsense"}, "why"), ("b", {"risk_level": "catastrophic"}, None)], "id string, resolved_fields map<string,string>, judge_notes string")
    r = {x.id: x for x in C.apply_resolution(rec, res).collect()}
    assert (r["a"].tier_2, r["a"].language, r["a"].risk_level, r["a"].is_safe, r["a"].qc_notes, r["a"].tier_1) == ("nursery rhymes", "sp", "high", False, "note | Judge: why", "Nonsense")
    assert (r["b"].risk_level, r["b"].judge_invoked, r["c"].judge_invoked, r["c"].qc_notes) == ("none", True, False, "note")
    assert {x.id: x.tier_1 for x in C.apply_resolution(rec, res, revalidate=True).collect()}["a"] == "Gaming"


def test_vote(spark):
    d = spark.createDataFrame([("c", "Gaming", "low"), ("c", "Gaming", "none"), ("c", "Kids", "high"), ("d", "A", "none"), ("d", "B", "none")], "c string, tier_1 string, risk string")
    got = {r.c: (r.tier_1, round(r.tier_1_vote_share, 3), r.worst_risk) for r in C.channel_vote(d, "c", risk="risk").collect()}
    assert got == {"c": ("Gaming", 0.667, "high"), "d": ("A", 0.5, "none")}


def test_confidence(spark):
    on, off = F.lit(True), F.lit(False)
    got = spark.range(1).select(R.confidence(on, on, on, on, on, on), R.confidence(off, off, off, off), R.confidence(F.lit(None), off, on, off)).first()
    assert tuple(got) == (0.25, 1.0, 0.9)


RECORD = "id string, name string, subscribers long, country string, status string, brand_safety_is_safe boolean, brand_safety_risk_level string, tier_1 string, tier_2 string, kids_age_group string, suitable_age_group string, language string, is_shorts boolean, is_premium_luxury boolean, seq int"


def records(spark, *rows):
    base = {"id": "UCa", "name": "n", "subscribers": 5, "country": "India", "status": "OK", "brand_safety_is_safe": True, "brand_safety_risk_level": "none", "tier_1": "Gaming", "tier_2": "fps", "kids_age_group": None, "suitable_age_group": "all ages", "language": "en", "is_shorts": False, "is_premium_luxury": None, "seq": 0}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RECORD)


def test_qc_row(spark):
    d = R.qc_row(records(spark, {}, {"brand_safety_is_safe": False, "brand_safety_risk_level": "high", "suitable_age_group": "18+"}, {"kids_age_group": "3-5 years"}, {"status": "ERROR", "brand_safety_is_safe": None, "suitable_age_group": None, "tier_1": None}, {"id": "@mrbeast", "name": "@mrbeast"}, {"name": "=cmd|'/c calc'!A1"}))
    assert d.columns == V.QC_COLUMNS
    r = d.collect()
    assert r[0][4:] == ("Safe", "None", "Gaming", "fps", "All Ages", "en", "No", "No") and r[1][4:6] + (r[1][8],) == ("Unsafe", "High", "18+")
    assert r[2][8] == "3-5 years" and r[3][4:9] == ("Error", "", "", "fps", "") and r[4][:2] == ("@mrbeast", "'@mrbeast") and r[5][1].startswith("'=")


def test_keep_last_and_merge(spark):
    d = spark.createDataFrame([("UCa", 1, 0), ("UCb", 2, 1), ("UCa", 3, 2), ("UCc", 4, 3)], "id string, v int, seq int")
    assert [(r.id, r.v) for r in R.keep_last(d, "id", "seq").orderBy("seq").collect()] == [("UCb", 2), ("UCa", 3), ("UCc", 4)]
    new = spark.createDataFrame([("UCa", 9, 0)], "id string, v int, seq int")
    assert {(r.id, r.v) for r in R.merge_prior(d.drop("v"), new, "id", "seq").collect()} == {("UCa", 9), ("UCb", None), ("UCc", None)}


def test_state(spark):
    log = spark.createDataFrame([("r1", "a", "EXTRACTED", 0.0, 1, None), ("r1", "a", "SUNK", 0.0, 2, None), ("r1", "b", "SUNK", 0.0, 3, "boom"), ("r2", "a", "EXTRACTED", 0.0, 4, None)], ST.STATE)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    one = log.where("run_id = 'r1'")
    assert [r.id for r in ST.pending_items(items, one).collect()] == ["c"]
    assert sorted(r.id for r in ST.pending_items(items, one, retry_errors=True).collect()) == ["b", "c"]
    m = spark.createDataFrame([("r1", "f", 2, "", 1.0, 5.0, None), ("r2", "f", 2, "", 1.0, 4.0, None), ("r3", "f", 2, "", 1.0, 6.0, None), ("r4", "g", 9, "", 1.0, 9.0, None)], ST.MANIFEST)
    assert ST.find_resumable(m, log, "f") == "r3" and ST.find_completed(m, log, "f") == "r1" and ST.find_resumable(m, log, "zz") is None
    assert [r.run_id for r in ST.list_runs(ST.run_progress(m, log), 2).collect()] == ["r4", "r3"]
    old = spark.createDataFrame([("r1", "f", 2, "", 1.0, 5.0, [("a", "video")])], ST.MANIFEST)
    new = spark.createDataFrame([("r1", "f", 2, "", 7.0, 7.0, None), ("r9", "f", 2, "", 7.0, 7.0, None)], ST.MANIFEST)
    got = {r.run_id: r for r in ST.next_manifest(old, new).collect()}
    assert got["r1"].created_at == 1.0 and got["r1"]["items"][0].id == "a" and got["r9"].created_at == 7.0


def test_cache(spark):
    cache = spark.createDataFrame([("k", "video", "p", 0.0), ("l", "channel", "q", 0.0)], "key string, kind string, payload string, created_at double")
    asked = spark.createDataFrame([("k", "video"), ("l", "channel"), ("m", "video")], "key string, kind string")
    hit = lambda t: {r.key: r.hit for r in K.cache_lookup(asked, cache, F.lit(t), K.ttl_of(F.col("kind"))).collect()}
    assert hit(3 * 86400.0) == {"k": "p", "l": "q", "m": None} and hit(3 * 86400.0 + 1) == {"k": "p", "l": None, "m": None}
    s = K.cache_stats(K.cache_lookup(asked, cache, F.lit(0.0), K.ttl_of(F.col("kind")))).first()
    assert (s.hits, s.misses) == (2, 1)
    import hashlib

    h = hashlib.sha256(b"p|m|v" + b"sys" + b"user" + hashlib.sha256(b"img").digest()).hexdigest()
    assert spark.range(1).select(K.response_key("p", "m", "v", F.lit("sys"), F.lit("user"), F.array(F.lit("img"))).alias("k")).first().k == h


def test_scoring_asks_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def scorer(prompts: pd.Series) -> pd.Series:
        for p in prompts:
            (asked / f"{p}-{__import__('uuid').uuid4().hex}").touch()
        return prompts.str.upper()

    prompts = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "c")], "key string, prompt string")
    cache = spark.createDataFrame([("k3", "old", 50.0)], "key string, response string, created_at double")
    answers, new = K.score_batch(prompts, cache, scorer, 100.0, str(tmp_path / "store"), tasks=2)
    assert answers.count() == 4 and new.count() == 2 and {r.response for r in answers.collect()} == {"A", "B", "old"}  # three actions
    cache2 = cache.unionByName(new)
    assert sorted(p.name[0] for p in asked.iterdir()) == ["a", "b"]
    answers, again = K.score_batch(prompts, cache2, scorer, 101.0, str(tmp_path / "store"))
    assert again.count() == 0 and {(r.key, r.response) for r in answers.collect()} == {("k1", "A"), ("k2", "B"), ("k3", "old")}


@pytest.mark.parametrize("raw,want", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure! {"a": 1} Hope it helps', {"a": 1}), ('<think>{"x": 2}</think>{"a": 1}', {"a": 1}),
    ('[{"a": 1}]', {"items": [{"a": 1}]}), ('{"a": 1, "b": ["x", "y', {"a": 1, "b": ["x"]}), ('{"a": 1, "b": {"c": "d"', {"a": 1, "b": {"c": "d"}}), ("no json here", None), (None, None), ("{broken", None), ('{"a": 1, "b": {"c": 1}, "n": 12', {"a": 1, "b": {"c": 1}}), ('{"b": ["x", "y"], "s": "A look at', {"b": ["x", "y"]}),
])
def test_parse(spark, raw, want):
    ok, bad = K.parse_responses(spark.createDataFrame([(raw,)], "raw string"), "raw", "a int, b string, items array<struct<a:int>>")
    r = ok.first()
    if want is None:
        assert r is None and bad.first().reason
    else:
        got = {k: v for k, v in r.parsed.asDict(True).items() if v is not None}
        got = {k: json.loads(v) if k == "b" else v for k, v in got.items()}
        assert got == want


def test_retry(spark, tmp_path):
    from qcloom.operators.validate import normalize

    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    good = {0.1: ["a"], 0.3: ["b"], 0.6: []}
    schema = __import__("qcloom.operators.validate", fromlist=["RAW"]).RAW

    def raw(todo, t):
        j = F.when(F.col("id").isin(*good[t]) if good[t] else F.lit(False), F.lit('{"tier_1": "Gaming"}')).otherwise(F.lit('{"tier_1": "?"}'))
        return todo.select("id", F.from_json(j, schema).alias("p")).select("id", "p.*")

    ok, bad = K.retry_ladder(raw, items, normalize, str(tmp_path))
    assert {(r.id, r.tier_recovered) for r in ok.collect()} == {("a", False), ("b", True)} and [r.id for r in bad.collect()] == ["c"]


def test_prompts(spark):
    d = spark.createDataFrame([([("a", "x\ny", "5"), ("b", None, None)],)], "c array<struct<author:string,text:string,likes:string>>")
    assert d.select(K.comments_block(F.col("c"), F.lit("2 Comments")).alias("b")).first().b == "== TOP COMMENTS (2 Comments) ==\n[5 likes] x y\n[0 likes] "
    v = spark.range(1).select(K.vision_prompt(F.lit("T"), F.lit("A"), F.array(F.lit("frame (intro)"), F.lit("t=5s")), F.lit(True)).alias("p")).first().p
    assert v.endswith("Images: image 1 = thumbnail; image 2 = frame (intro); image 3 = t=5s")
    assert spark.range(1).select(K.panel_facts({"a": F.lit("1"), "b": F.lit("")}).alias("p")).first().p == '{"a":"1"}'
    one = {k: F.lit("x") for k in ("title", "country", "joined_date", "channel_keywords", "description")} | {k: F.lit(1200) for k in ("subscribers", "total_views", "video_count")}
    one |= {"velocity_score": F.lit(0.5), "links": F.array(F.struct(F.lit("s").alias("title"), F.lit("u").alias("url"))), "titles": F.array(F.lit("t1"), F.lit("")), "is_shorts_only": F.lit(True)}
    p = spark.range(1).select(K.channel_prompt(one, F.lit("")).alias("p")).first().p
    assert "Subscribers: 1,200" in p and "- t1\n---" in p and "SHORTS ONLY" in p and "== VIDEO TITLES (1) ==" in p


def frame(spark, **cols):
    rows = list(zip(*cols.values()))
    return spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in cols))


def test_accuracy(spark):
    gold = frame(spark, id=["1", "2", "3", "3"], tier_1=["Gaming", "Kids", None, "Music"], tier_2=["fps game", "x", "y", "z"], language=["en", "en", "de", "de"], keywords=["a; b", "a,b,c,d,e,f,g,h", "", "q"])
    pred = frame(spark, id=["1", "2", "3", "9"], tier_1=["gaming ", "Music", "Music", "x"], tier_2=["game", "y", "", "x"], language=["en", "en", "de", "x"], keywords=["b,a", "a,b,c,d,e,f,g,h", "z", "x"])
    got = {r.field: (round(r.accuracy, 4), r.passed) for r in B.accuracy(gold, pred).collect()}
    assert got == {"tier_1": (0.6667, False), "tier_2": (0.25, None), "language": (1.0, True), "keyword_overlap@5": (0.65, None)}
    assert [r.field for r in B.accuracy(gold, pred, "auto").collect()] == ["tier_1", "tier_2", "language", "keywords", "keyword_overlap@5"]
    assert B.accuracy(gold.select("id"), pred).count() == 0


def test_show(spark):
    d = frame(spark, id=["v1", "v2"], name=["a", "b"], tier_1=["Gaming", "Kids"], brand_safety_is_safe=["True", "False"], needs_review=["False", "True"], status=["OK", "OK"], confidence=["1", "1"])
    r = B.show_results(d, "wide", "unsafe")
    s = r["summary"].first()
    assert (s.total, s.unsafe, s.needs_review, s.errors, s.matched, s.truncated) == (2, 1, 1, 0, 1, False) and [x.id for x in r["rows"].collect()] == ["v2"]
    assert B.show_results(d, "wide", "gaming")["rows"].first().id == "v1" and B.show_results(d, "wide", "nothing")["summary"].first().matched == 0
    qc = R.qc_row(records(spark, {}, {"brand_safety_is_safe": False}))
    assert B.show_results(qc, "qc", "review")["note"] and B.show_results(qc, "qc", "unsafe")["summary"].first().matched == 1
