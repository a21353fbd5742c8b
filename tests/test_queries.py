import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from draftlake.functions import geometry as G
from draftlake.functions import text as T
from draftlake.operators import graph
from draftlake.plans import catalog, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
#: Every query with SQL but those of record kinds, of which one of each family runs.
SOME = [q for q in registry.SQL if not q.startswith("s_decoded_")] + [f"s_decoded_{k}" for k in ("hatch", "mesh", "ltype", "dictionary", "xdata")]


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    result = con.execute(registry.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found"} <= set(entry.queries())


def test_geometry_edges(spark):
    df = spark.range(1)
    p = lambda *a: G.point(*a)
    nan = F.lit(float("nan"))
    row = df.select(
        G.normalize(p(0.0, 0.0, 0.0)).alias("zero"), G.is_empty(G.empty_box()).alias("empty"), G.contains(G.empty_box(), p(0.0, 0.0, 0.0)).alias("inside"),
        G.bounds_of(F.array(p(1.0, 2.0), p(-1.0, 5.0))).alias("b"), G.union(G.box(p(nan, 0.0), p(nan, 1.0)), G.box(p(2.0, 0.0), p(3.0, 1.0))).alias("u"),
        G.bulge_arc(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("flat"), G.bulge_arc(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.tan(F.lit(3.141592653589793 / 8))).alias("quarter"),
        G.polygon_area(F.array(p(0.0, 0.0), p(1.0, 0.0))).alias("two"), F.size(G.polyline_path(F.array(p(0.0, 0.0)), F.lit(False))).alias("one"), G.segments_of_sweep(F.lit(1.0), F.lit(1.0)).alias("round"),
        G.spline_form(nan, F.array(F.lit(1.0), F.lit(1.0))).alias("spline"), G.fit_view(G.box(p(0.0, 0.0), p(0.0, 0.0)), 100, 50, 0.9).alias("view"), T.dash_array(F.array(F.lit(-0.5), F.lit(0.0))).alias("dash"),
    ).first()
    assert tuple(row["zero"]) == (0, 0, 0) and row["empty"] and not row["inside"] and row["b"]["max"]["y"] == 5 and row["u"]["max"]["x"] == 3 and row["flat"] is None
    assert abs(row["quarter"]["cx"] - 0.5) < 1e-9 and abs(row["quarter"]["cy"] - 0.5) < 1e-9
    assert row["two"] == 0 and row["one"] == 0 and row["round"]["segments"] == 64 and row["spline"]["degree"] == 3 and row["spline"]["weights"] is None and row["view"]["zoom"] > 0 and row["dash"] == "0,0.5,0.001"


def test_expand_inserts(spark):
    ddl = "path string, block bigint, seq int, entity bigint, child_block bigint, transform array<double>"
    move = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("p", 1, 0, 10, None, None), ("p", 1, 1, 11, 2, move(5.0)), ("p", 2, 0, 20, None, None), ("p", 2, 1, 21, 3, move(7.0)), ("p", 3, 0, 30, None, None), ("q", 1, 0, 40, 1, None)]
    df = spark.createDataFrame(rows, ddl)
    out = graph.expand_inserts(df.filter("path = 'p'"), spark.createDataFrame([("p", 1)], "path string, block bigint")).orderBy("order_key").collect()
    assert [(r["entity"], r["depth"], r["transform"][3]) for r in out] == [(10, 1, 0.0), (11, 1, 5.0), (20, 2, 5.0), (21, 2, 12.0), (30, 3, 12.0)]
    roots = spark.createDataFrame([("q", 1)], "path string, block bigint")
    with pytest.raises(graph.CycleError):
        graph.expand_inserts(df, roots)
    assert [r["cut"] for r in graph.expand_inserts(df, roots, strict=False).collect()] == ["cycle"]
    shallow = graph.expand_inserts(df.filter("path = 'p'"), spark.createDataFrame([("p", 1)], "path string, block bigint"), max_depth=2, strict=False)
    assert {r["entity"]: r["cut"] for r in shallow.collect()} == {10: None, 11: None, 20: None, 21: "depth"}
    assert graph.expand_inserts(df, roots.limit(0)).count() == 0


def test_expand_all_reaches_every_root_and_depth(spark, tmp_path):
    # a chain of 20 below the missing owner 7, an entity without an owner with one member, a circle with a tail
    links = [("p", 100 + k, 99 + k if k else 7, k) for k in range(20)] + [("p", 300, None, 0), ("p", 301, 300, 4), ("q", 1, 2, 0), ("q", 2, 1, 0), ("q", 3, 2, 0)]
    rows = [(i, p, h, o, s, 0, [1.0, 0.0, 0.0, 2.0] if h != 105 else None) for i, (p, h, o, s) in enumerate(links)]
    df = spark.createDataFrame(rows + rows[:3], "entity_id bigint, path string, handle bigint, owner_handle bigint, seq int, depth int, transform array<double>")
    df.withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/expanded_entities.parquet")
    got = {(r["path"], r["entity"]): r for r in graph.expand_tree(catalog._nested(spark, str(tmp_path))).collect()}
    owner = {(p, h): o for p, h, o, _ in links}
    seq = {(p, h): s for p, h, _, s in links}
    want = {}
    for (p, h), o in owner.items():
        chain, at = [], h
        while at is not None and (p, at) in owner and len(chain) < 99:
            chain, at = [at, *chain], owner[p, at]
        if len(chain) == 99:
            want[p, h] = None
        elif at is not None or len(chain) > 1:
            members = chain if at is not None else chain[1:]
            x, scale = 0.0, 1.0
            for m in members:
                x, scale = (x, scale) if m == 105 else (x + scale, scale * 2)
            want[p, h] = (at if at is not None else chain[0], len(members), [seq[p, m] for m in members], x, scale)
    assert got.keys() == want.keys() and len(got) == 24
    for k, w in want.items():
        r = got[k]
        assert (r["root"] is None and r["depth"] is None) if w is None else (r["root"], r["depth"], r["order_key"], r["transform"][3], r["transform"][0]) == w


def test_outlines(spark):
    from draftlake.functions import records
    from draftlake.sinks import svg

    p2, p3 = "struct<x:double,y:double>", "struct<x:double,y:double,z:double>"
    pts = ", ".join(f"def_point_{k} {p3}" for k in (10, 13, 14, 15)) + f", feature_location_13 {p3}, leader_endpoint_14 {p3}, kind string"
    z = (0.0, 0.0, 0.0)
    df = spark.createDataFrame([((1.0, 5.0, 0.0), z, (4.0, 0.0, 0.0), z, z, z, k) for k in ("DIMENSION_LINEAR", "DIMENSION_RADIUS", "LINE")], pts)
    got = [r["s"] for r in df.select(G.dimension_segments(F.col("kind"), F.struct("*")).alias("s")).collect()]
    assert [tuple(s["b"]) for s in got[0]] == [(0.0, 5.0, 0.0), (4.0, 5.0, 0.0), (4.0, 5.0, 0.0)] and len(got[1]) == 1 and got[2] is None
    row = df.select(G.arrow(G.point(0.0, 0.0), G.point(10.0, 0.0)).alias("a"), G.arrow(G.point(0.0, 0.0), G.point(0.0, 0.0)).alias("n")).first()
    assert len(row["a"]) == 3 and row["n"] is None
    hatch = spark.createDataFrame([], f"rec {records.schema('HATCH')}")
    assert hatch.select(F.transform("rec.paths", lambda p: G.hatch_curves(p, F.col("rec.elevation"))).alias("c")).count() == 0
    block = df.select(svg.title_block(0, 0, 100, 50, F.array(F.struct(F.lit("a<").alias("name"), F.lit("b").alias("value")))).alias("t")).first()["t"]
    assert "a&lt;: b" in block
    clips = svg.viewport_clips(spark.createDataFrame([("p", 1, 0.0, 0.0, 5.0, 5.0), ("p", 1, 1.0, 0.0, 5.0, 5.0)], "path string, id int, x double, y double, width double, height double"))
    assert clips.count() == 1 and p2
