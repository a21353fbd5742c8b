import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from draftlake.functions import records
from draftlake.functions import text as T
from draftlake.functions import viewer as V
from draftlake.operators import relational as R
from draftlake.plans import samples
from draftlake.sinks import gltf, svg
from draftlake.sources import limits
from draftlake.streaming import windows


def rows_of(n=900, seed=1):
    rng = random.Random(seed)
    # one key holds most rows; nulls and ties are in the order and in the value
    return [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(n // 2)]), i, rng.choice([None, 1, 5, 100])) for i in range(n)]


DDL = "k string, o int, id int, v bigint"


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def test_sums_in_ranges_equal_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, DDL)
    got = {r["id"]: r["offset"] for r in R.running_offset(df, ["k"], [F.col("o"), F.col("id")], "v", 7).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        at = 7
        for r in ordered(x for x in rows if x[0] == k):
            want[r[2]] = at
            at += r[3] or 0
    assert got == want
    assert R.running_offset(df.limit(0), ["k"], [F.col("id")], "v", 0).count() == 0


def test_deltas_in_ranges_come_back(spark):
    rows = [r for r in rows_of(seed=2) if r[3] is not None]
    df = spark.createDataFrame(rows, DDL)
    order = [F.col("o"), F.col("id")]
    diff = R.deltas(df, ["k"], order, "v")
    got = {r["id"]: r["delta"] for r in diff.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        before = 0
        for r in ordered(x for x in rows if x[0] == k):
            want[r[2]], before = r[3] - before, r[3]
    assert got == want
    assert all(r["value"] == r["v"] for r in R.undelta(diff, ["k"], order).collect())


def test_ends_of_groups(spark):
    rows = rows_of(700, 3)
    df = spark.createDataFrame(rows, DDL)
    got = sorted(r["id"] for r in R.ends_of(df, ["k"], ["o", "id"], 4, 2).collect())
    want = []
    for k in {r[0] for r in rows}:
        own = ordered(x for x in rows if x[0] == k)
        want += {r[2] for r in own[:4] + own[-2:]}
    assert got == sorted(want)
    assert R.ends_of(df.filter("id < 3"), ["k"], ["id"], 5, 5).count() == 3 and R.ends_of(df.limit(0), ["k"], ["id"], 5, 5).count() == 0


def test_first_of_and_messages(spark):
    rows = [("a", None, 1, 1), ("a", 5, 2, 1), ("a", 5, 1, 9), (None, 1, 1, 1), ("b", None, 7, None)]
    df = spark.createDataFrame(rows, DDL)
    assert {tuple(r) for r in R.first_of(df, ["k"], [F.col("o")]).collect()} == {("a", 5, 1, 9), (None, 1, 1, 1), ("b", None, 7, None)}
    errors = spark.createDataFrame([("p", i, "x") for i in range(1005)] + [("q", 1, None)], "path string, seq int, reason string")
    assert [tuple(r) for r in R.kept_messages(errors, ["path"]).collect()] == [("p", 1005, 5, 1000)]
    kept = R.first_messages(errors, ["path"], ["seq"]).collect()
    assert sorted(r["seq"] for r in kept) == list(range(1000))


def test_streams_close_windows_once_and_leave_late_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    ddl = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    rows = [(1, at(0), 1, "a", 1.0), (2, at(0, 30), 1, "a", 2.0), (3, at(5), 1, "b", 4.0), (4, None, 1, "b", 8.0)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    got = {(r["window_start"].hour, r["event_type"]): (r["n"], r["total"]) for r in windows.run_available(spark, f"{tmp_path}/e.parquet", windows.tumbling).collect()}
    assert got == {(0, "a"): (2, 3.0), (5, "b"): (1, 4.0)}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {r["window_start"].hour for r in windows.run_available(spark, f"{tmp_path}/e.parquet", windows.tumbling).collect()} == {0, 5}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_limits(spark):
    assert limits.named("paranoid").max_handles == 100_000 and limits.named("safe", max_polyline=1).max_polyline == 1
    with pytest.raises(ValueError):
        limits.named("none")
    bits, _ = samples.encode(next(s.text for s in samples.SAMPLES if s.kind == "LWPOLYLINE"), 2018, 0)
    df = spark.createDataFrame([(samples._to_bytes(bits), 2018)], "raw binary, version int")
    assert records.decode_records(df, "LWPOLYLINE", limits=limits.SAFE).first()["status"] == "ok"
    row = records.decode_records(df, "LWPOLYLINE", limits=limits.named("safe", max_polyline=1)).first()
    assert row["status"] == "error" and "max_polyline" in row["message"] and row["rec"] is None


def test_notes_on_pages(spark):
    df = spark.createDataFrame([("a{\\C1;b<\\fArial|b0;c}\\P\\Ld\\l \\S1#2;",), ("",), (None,)], "t string").select("t", T.note_runs("t").alias("runs"))
    got = {r["t"]: r["s"] for r in df.select("t", svg.note_fragment(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.col("runs")).alias("s")).collect()}
    assert got[""] is None and got[None] is None
    text = next(v for v in got.values() if v)
    assert text == (
        '<text transform="translate(1,2) scale(1,-1)" font-size="3"><tspan>a</tspan><tspan fill="#FF0000">b&lt;</tspan><tspan font-family="Arial" fill="#FF0000">c</tspan>'
        '<tspan x="0" dy="3.6" text-decoration="underline">d</tspan><tspan> </tspan><tspan>1/2</tspan></text>'
    )


def test_scenes_and_states(spark):
    name, rgb = gltf.layer_material(1)
    assert name == "layer-1" and rgb == (1.0, 0.0, 0.0)
    bad = [r["s"]["problem"] for r in spark.createDataFrame([("RFdH",), (None,), ("!",)], "t string").select(V.state_of("t").alias("s")).collect()]
    assert bad[0] == "no state" and bad[1] == "no text" and bad[2] in ("no base64", "no state")
