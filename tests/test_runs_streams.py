import json

import pytest
from pyspark.sql import functions as F

from qcloom.operators.gate import HIT
from qcloom.operators.validate import RAW
from qcloom.operators import worklist as W
from qcloom.plans import runs
from qcloom.sources import readers, sinks
from qcloom.streaming import streams


def channels(spark, n):
    lines = spark.createDataFrame([(i, f"UC{i:022d}") for i in range(n)], "line_no long, line string")
    return W.parse_items(lines)[0]


def extracts(spark, n, skip=()):
    rows = [(f"UC{i:022d}", True, None, f"Channel {i}", 1000 * (i + 1), "India", i % 3 == 0, 8, 1) for i in range(n) if i not in skip]
    d = spark.createDataFrame(rows, "id string, ok boolean, error string, name string, subscribers long, country string, is_shorts_only boolean, n_titles int, n_grid_shots int")
    return d.withColumn("hits", F.array().cast(HIT))


def scorer(d):
    answer = json.dumps({"tier_1": "Gaming", "tier_2": "fps gameplay", "language": "en", "suitable_age_group": "all ages", "brand_safety": {"risk_level": "none"}})
    return d.select("id", F.from_json(F.lit(answer), RAW).alias("p")).select("id", "p.*").withColumns({"vision_ok": F.lit(True), "judge_invoked": F.lit(False), "tier_recovered": F.lit(False)})


def test_run_interrupt_resume(spark, tmp_path):
    root = str(tmp_path)
    items = channels(spark, 6)
    a = runs.run_qc(items, extracts(spark, 6), scorer, root, "channel", limit=2)
    assert (a["done"], a["remaining"], a["complete"]) == (2, 4, False)
    assert {r.id for r in runs.resume_run(spark, root, a["run_id"]).collect()} == {f"UC{i:022d}" for i in range(2, 6)}
    b = runs.run_qc(items, extracts(spark, 6, skip=(4,)), scorer, root, "channel", sink_names=["qc", "csv"])
    assert b["run_id"] == a["run_id"] and b["complete"]
    df, schema = readers.load_run_frame(spark, f"{root}/{b['run_id']}")
    assert schema == "wide" and df.count() == 6
    qc = spark.read.option("header", True).csv(f"{root}/{b['run_id']}/qc_output")
    rows = {r["Channel ID"]: r for r in qc.collect()}
    assert len(rows) == 6 and rows[f"UC{0:022d}"]["Shorts"] == "Yes" and rows[f"UC{1:022d}"]["Subscribers"] == "2000" and rows[f"UC{4:022d}"]["Brand Safety Status"] == "Error"
    assert runs.list_runs(spark, root).first().done == 6
    assert runs.show_results(spark, f"{root}/{b['run_id']}", "errors")["summary"].first().matched == 1
    c = runs.run_qc(items, extracts(spark, 6), scorer, root, "channel")
    assert c["finished_before"] == b["run_id"] and c["run_id"] != b["run_id"] or c["run_id"]
    assert runs.show_taxonomy(spark).count() > 60 and runs.inspect_input(items, items.limit(0).select("line_no", F.col("id").alias("line")))["report"].first().channels == 6


def test_run_parses_its_list_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    lines = spark.createDataFrame([(i, f"UC{i:022d}") for i in range(6)], "line_no long, line string")
    items = W.parse_items(lines.mapInArrow(count, lines.schema))[0]
    a = runs.run_qc(items, extracts(spark, 6, skip=(1,)), scorer, str(tmp_path), "channel", limit=2)
    assert made.value == 6 and a["done"] == 2 and a["total"] == 6
    b = runs.run_qc(items, extracts(spark, 6, skip=(1,)), scorer, str(tmp_path), "channel", sink_names=["qc", "csv"])
    assert made.value == 12 and b["run_id"] == a["run_id"] and b["complete"]
    assert not list(tmp_path.glob("stage-*"))


def test_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text(" ID , Type,Label\nUC0000000000000000000001,channel,a\n@x_y,,b\nraw thing,video,c\n")
    items, rejects, col = readers.read_worklist(spark, str(tmp_path / "w.csv"))
    assert col == "id" and {(r.id, r.type, r.label) for r in items.collect()} == {("UC0000000000000000000001", "channel", "a"), ("@x_y", "channel", "b"), ("raw thing", "video", "c")} and rejects.count() == 0
    (tmp_path / "several").mkdir()
    (tmp_path / "several" / "b.csv").write_text("id,label\n" + "".join(f"@name_{i},b{i}\n" for i in range(300)))
    (tmp_path / "several" / "a.csv").write_text("id,label\n@name_7,a7\n@name_5,a5\n")
    several = readers.read_worklist(spark, str(tmp_path / "several"))[0].orderBy("line_no", "pos").select("id", "label").collect()
    assert [tuple(r) for r in several[:4]] == [("@name_7", "a7"), ("@name_5", "a5"), ("@name_0", "b0"), ("@name_1", "b1")] and len(several) == 300
    (tmp_path / "n.csv").write_text("name,notes\na,b\n")
    with pytest.raises(ValueError):
        readers.read_worklist(spark, str(tmp_path / "n.csv"))
    (tmp_path / "t.txt").write_bytes(b"one\r\ntwo\rthree")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == ["one", "two", "three"]
    (tmp_path / "s.jsonl").write_text('{"item_id": "a", "stage": "SUNK", "seq": 1}\nbroken\n{"stage": "SUNK"}\n')
    assert [r.item_id for r in readers.read_state_log(spark, str(tmp_path / "s.jsonl")).collect()] == ["a"]
    for run, body in (("r1", json.dumps({"fingerprint": "f", "total_items": 3})), ("r2", "{oops")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "manifest.json").write_text(body)
    assert [(r.run_id, r.total_items) for r in readers.read_manifests(spark, str(tmp_path / "runs")).collect()] == [("r1", 3)]
    (tmp_path / "runs" / "r 3+4").mkdir()
    (tmp_path / "runs" / "r 3+4" / "manifest.json").write_text(json.dumps({"fingerprint": "g", "total_items": 4}, indent=1))
    some = readers.read_manifests(spark, str(tmp_path / "runs"), ["r 3+4", "r2", "none"])
    assert [(r.run_id, r.total_items) for r in some.collect()] == [("r 3+4", 4)] and len(some.inputFiles()) == 2
    assert readers.read_manifests(spark, str(tmp_path / "runs"), []).count() == 0
    (tmp_path / "e.jsonl").write_text('{"title": "t", "ok": true}\nnot json\n')
    ok, bad = readers.read_extracts(spark, str(tmp_path / "e.jsonl"))
    assert ok.first().title == "t" and bad.count() == 1
    (tmp_path / "g.csv").write_text("ID,Tier_1\n1,NA\n2,x\n")
    assert {(r.id, r.tier_1) for r in readers.load_labels(spark, str(tmp_path / "g.csv")).collect()} == {("1", None), ("2", "x")}
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "c", "value": json.dumps({"n": 1, "tabs": ["Home"]})}) + "\n")
    assert readers.read_page_payloads(spark, str(tmp_path / "p.jsonl"), "tabs").first().tabs == ["Home"]
    assert readers.load_run_frame(spark, str(tmp_path / "none")) == (None, None)


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.build_sinks(["qc", "nope"])
    m = spark.createDataFrame([("tier_1", 0.5), ("language", 1.0)], "field string, accuracy double")
    sinks.accuracy_report(m, str(tmp_path / "acc"))
    sinks.accuracy_report(m, str(tmp_path / "acc"))
    assert spark.read.option("header", True).csv(str(tmp_path / "acc")).first().asDict() == {"language": "1.0", "tier_1": "0.5"}


def test_stress(spark):
    times = [0, 10, 300, 301, 650, 650]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(1))
    want = {i: sum(t - 300 <= u <= t for u in times) for i, t in enumerate(times)}
    for key in (None, "k"):
        assert {r.id: r.level for r in streams.stress_level(d, "ts", key).collect()} == want
    lanes = [r.a for r in spark.createDataFrame([(0,), (1,), (2,), (9,)], "n int").select(streams.alert_tier(F.col("n"), 4, 1).alias("a")).collect()]
    assert lanes == [4, 4, 3, 1]


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int").coalesce(1).write.parquet(src)
    rows = lambda b: b.withColumn("w", F.col("v") * 2)
    streams.qc_stream(streams.read_landing(spark, src, "id string, v int"), rows, out, ck).awaitTermination()
    spark.createDataFrame([("a", 5)], "id string, v int").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        streams.qc_stream(streams.read_landing(spark, src, "id string, v int"), rows, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert {(r.id, r.w) for r in streams.compact(spark, out, "id").collect()} == {("a", 10), ("b", 2)}
