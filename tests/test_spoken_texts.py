"""Windows of the speech queries hold whole turns."""

import math
import os

import pytest

from qcloom.operators import sampling as T
from qcloom.plans import queries as Q

DIR = "/root/testdata/sf0.001"


def brute(spark, turns):
    """(conversation, window, what is said) by the rule of fill_speech, in plain Python."""
    by = {}
    for conv, turn, text in turns:
        by.setdefault(conv, []).append((turn * 6.0, text))
    length = spark.createDataFrame([(c, max(s for s, _ in x) + 6.0) for c, x in by.items()], "conv_id long, d double")
    w = T.window_seconds(length.d)[1]
    out = []
    for conv, want, windows in length.select("conv_id", w, T.merge_windows(T.plan_windows(length.d))).collect():
        segs = sorted(by[conv])
        for x in windows:
            got = [s for s in segs if x.start_s <= s[0] < x.end_s]
            if got:
                got += [s for s in segs if s[0] >= x.end_s][: max(0, math.floor((want - 6.0 * len(got)) / 6))]
            else:
                got = [s for s in segs if s[0] >= x.start_s][: max(3, math.floor(want / 6))]
            out.append((conv, x.label, " ".join(t.strip() for _, t in got if t.strip())))
    return sorted(out)


@pytest.mark.parametrize("name", ["fill_speech", "speech_join"])
def test_long_turns_stay_whole(spark, tmp_path, name):
    turns = [(c, k, f"turn {k} of {c}: " + f"word{k} " * 200) for c in (1, 2) for k in range(1, 30)] + [(3, 1, " short "), (3, 2, "")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.label, r.text) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == brute(spark, turns) and max(len(x) for _, _, x in got) > 1000


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_both_queries_agree(spark):
    one, two = (sorted(map(tuple, Q.QUERIES[n](spark, DIR).select("conv_id", "label", "frame_t", "text").collect()), key=repr) for n in ("fill_speech", "speech_join"))
    assert one == two
