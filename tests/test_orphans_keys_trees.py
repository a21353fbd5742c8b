import datetime as dt
import random

import pytest

from draftlake.operators import hierarchy, hotkeys, orphans

T = dt.datetime(2025, 3, 31, 12)
DAY = dt.timedelta(days=1)
H = "struct<code:tinyint,counter:tinyint,value:bigint>"
MAP = "entry_id bigint, path string, handle bigint, loaded_at timestamp, status string"
DEC = f"object_id bigint, path string, handle bigint, loaded_at timestamp, acad_layout struct<block_record_handle:{H}>, acad_group struct<member_handles:array<{H}>>, lofted_surface struct<cross_section_handles:array<{H}>>"
RAW = f"object_id bigint, path string, handle {H}, status string, loaded_at timestamp, target_handle bigint"


def found(spark, m, d, r):
    o = orphans.orphan_references(spark.createDataFrame(m, MAP), spark.createDataFrame(d, DEC), spark.createDataFrame(r, RAW))
    return {(x["ref_field"].split(".")[1], x["src_id"], x["target_handle"], x["reason"]) for x in o.collect()}, o


def test_orphans(spark):
    h = lambda c, v: (c, 1, v)
    raw = [
        (1, "p", h(0, 10), "ok", T, 0), (2, "p", h(0, 11), "ok", T, 0), (2, "p", h(0, 11), "erased", T + DAY, 0), (3, "p", h(0, 12), "erased", T, 0), (3, "p", h(0, 12), "ok", T + DAY, 0),
        (4, "p", h(0, 13), "ok", T + 2 * DAY, 0), (5, "p", h(0, 14), "ok", T + DAY, 0), (6, "q", h(0, 99), "ok", T, 0), (7, "p", None, "ok", T, 0), (8, "p", h(0, 15), "erased", T, 0), (8, "p", h(0, 15), "ok", T, 0),
    ]
    index = [(i, "p", v, T, "x") for i, v in enumerate([10, 11, 12, 13, 14, 99, None, -5, 15])] + [(0, "p", 10, T, "x")]
    dec = [
        (100, "p", 20, T, (h(4, 0),), None, None), (101, "p", 20, T, (h(6, 7),), None, None), (102, "p", 20, T, (h(12, 10),), None, None), (103, "p", None, T, (h(8, 1),), None, None),
        (104, "p", 9, T, None, ([h(5, 10), h(5, 77), h(5, 77), None, h(10, 1), (5, 1, None)],), None), (105, "p", 9, T, None, (None,), None), (106, "p", 9, T, None, None, ([],)), (107, "p", 9, T, None, None, ([h(2, 11)],)), (108, "p", 9, T, (None,), None, None),
    ]
    got, o = found(spark, index, dec, raw)
    assert got == {
        ("handle", 1, 11, "erased"), ("handle", 3, 13, "late"), ("handle", 5, 99, "missing"), ("handle", 7, -5, "missing"), ("handle", 8, 15, "erased"),
        ("block_record_handle", 101, 21, "missing"), ("member_handles", 104, 77, "missing"), ("cross_section_handles", 107, 11, "erased"),
    }
    months = {(r["ref_field"], r["month"], r["reason"]): r["n_refs"] for r in orphans.orphans_by_month(o).collect()}
    assert months[orphans.HANDLE_MAP, "2025-03", "missing"] == 2


def test_orphans_empty(spark):
    assert found(spark, [], [], [])[0] == set()
    assert found(spark, [(1, "p", 5, T, "x"), (2, None, 5, T, "x")], [], [])[0] == {("handle", 1, 5, "missing")}


def test_packing():
    bins, loads = hotkeys.pack([("a", 900), ("b", 60), ("c", 30), ("d", 10)], 4)
    assert len(bins["a"]) == 4 and max(loads) <= 2 * 250 and sum(loads) == pytest.approx(1000)
    assert hotkeys.pack([], 3)[1] == [0.0] * 3


def test_profile_equals_brute_force(spark):
    rng = random.Random(3)
    kinds = ["LINE"] * 60 + ["Line"] * 5 + [None] * 3 + ["", " x"] + [f"K{i}" for i in range(30)]
    rows = []
    for i in range(3000):
        row = (i, rng.choice(["p", "p", "q", None, f"d{i % 40}"]), rng.choice([None, 5, 10]), rng.choice([19, 19, 7, None]), rng.choice(kinds), 1)
        rows += [row] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "object_id bigint, path string, size_bytes bigint, type_code int, kind string, bin int")
    got = {(r["field"], r["key_text"]): tuple(r)[2:] for r in hotkeys.key_profile(df, ["type_code", "kind"], 6).collect()}
    want = {}
    for field, at in (("type_code", 3), ("kind", 4)):
        for k in {r[at] for r in rows} - {None}:
            own = [r for r in rows if r[at] == k]
            objects = {r[0]: r for r in own}
            want[field, str(k)] = (len(own), len(own) / len(rows), len(objects), sum(r[2] or 0 for r in objects.values()), len({r[1] for r in own} - {None}))
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w), k
    assert hotkeys.key_profile(df.limit(0), ["kind"], 6).count() == 0


def test_profile_of_an_object_under_two_paths(spark):
    rows = [(1, "a", 5, "K", "x"), (1, "b", 7, "K", "x"), (1, "b", 6, "K", "x"), (2, "a", None, "K", "x"), (None, "a", 1, "K", "x"), (3, None, 2, None, "x")]
    df = spark.createDataFrame(rows, "object_id bigint, path string, size_bytes bigint, kind string, shard string")
    got = [tuple(r) for r in hotkeys.key_profile(df, ["kind"], 3).collect()]
    assert got == [("kind", "K", 5, pytest.approx(5 / 6), 2, 13, 2)]


NODES = "entity_id bigint, path string, handle bigint, owner_handle bigint, depth int, loaded_at timestamp, exit string, status int"


def solve(nodes):
    up = {(p, h): o for _, p, h, o, *_ in nodes if p is not None and h is not None}
    out = {}
    for p, h in up:
        chain, at, seen = [], h, set()
        while at is not None and (p, at) in up and at not in seen:
            chain.append(at)
            seen.add(at)
            at = up[p, at]
        out[p, h] = None if at in seen else chain[::-1]
    return out


@pytest.mark.parametrize("shift", [1, 3, 13])
def test_hierarchy_equals_brute_force(spark, shift, monkeypatch):
    # a small limit makes the quotient go through several levels
    monkeypatch.setattr(hierarchy, "WHOLE", 5)
    rng = random.Random(shift)
    nodes = []
    for p in range(6):
        handles = rng.sample(range(16, 2000), 150)
        for h in handles:
            nodes.append((len(nodes), f"d{p}", h, rng.choice([None, rng.choice(handles), rng.choice(handles), h - 1, 99999]) if rng.random() < 0.6 else handles[max(0, handles.index(h) - 1)], rng.choice([None, 0, 1]), T, "x", 1))
    nodes += [(5000, "long", k, k - 1 if k > 20 else None, 3, T, "x", 1) for k in range(20, 420)]
    nodes += [(6000, "self", 5, 5, 0, T, "x", 1), (6001, "two", -7, -8, 0, T, "x", 1), (6002, "two", -8, -7, 0, T, "x", 1), (6003, None, 1, None, 0, T, "x", 1), (6004, "n", None, 1, 0, T, "x", 1)]
    df = spark.createDataFrame(nodes + nodes[:50], NODES)
    want = solve(nodes)
    rows = hierarchy.hierarchy(df, with_path=True, shift=shift).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["path"], r["handle"]]
        assert r["in_cycle"] == (w is None)
        assert r["node_path"] == w and r["depth"] == (None if w is None else len(w) - 1) and r["root_handle"] == (None if w is None else w[0])
    plain = {(r["path"], r["handle"]): r["depth"] for r in hierarchy.hierarchy(df, shift=shift).collect()}
    assert plain == {k: None if w is None else len(w) - 1 for k, w in want.items()}
    below = hierarchy.descendants(hierarchy.hierarchy(df, with_path=True, shift=shift)).collect()
    pairs = {(p, a, h, len(w) - 1 - i) for (p, h), w in want.items() if w for i, a in enumerate(w[:-1])}
    assert {tuple(r[c] for c in ("path", "handle", "descendant_handle", "distance")) for r in below} == pairs and len(below) == len(pairs)


def test_hierarchy_empty_and_latest(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], NODES), with_path=True).count() == 0
    rows = [(1, "p", 5, None, 0, T, "x", 1), (1, "p", 5, 6, 0, T + DAY, "x", 1), (2, "p", 6, None, 0, T, "x", 1)]
    got = {r["handle"]: r["depth"] for r in hierarchy.hierarchy(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {5: 1, 6: 0}
