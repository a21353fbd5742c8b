"""Queries that show each operator of the library on the test tables, with SQL for those that SQL can state.

Drawing operators run on the drawing tables; where those have no suitable
column (points, text with markup), the order, part, event and embedding tables
stand in: a row is a point, an item or an entity, as each query says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import bits, codecs, records
from draftlake.functions import geometry as G
from draftlake.functions import text as T
from draftlake.functions import viewer as V
from draftlake.operators import graph
from draftlake.operators import relational as R
from draftlake.runtime import load
from draftlake.sinks import dxf, gltf, svg
from draftlake.sources import limits
from draftlake.streaming import windows

def _table_entry(i: int, polynomial: int) -> int:
    """An entry of the table of a reflected checksum."""
    for _ in range(8):
        i = i >> 1 ^ polynomial * (i & 1)
    return i


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    """Six decimals, without a minus zero."""
    return F.round(c, 6) + F.lit(0.0)


# Types and coverage

_TYPES_SQL = "(values " + ", ".join(f"({c}, '{k}', '{cls}')" for c, k, cls in records.TYPE_CODES) + ") t(type_code, type_name, type_class)"
_OUTCOME = "case when status = 'ok' then 'decoded' when status in ('skipped','unhandled','erased') then 'unhandled' else 'errored' end"


@query(f"select coalesce(type_name, case when r.type_code >= 500 then 'CUSTOM' else 'UNKNOWN' end) as type_name, coalesce(type_class, case when r.type_code >= 500 then 'custom' else 'unknown' end) as type_class, count(*) as n from raw_objects r left join {_TYPES_SQL} using (type_code) group by 1, 2")
def q_type_names(spark, d):
    return records.with_types(load(spark, d, "raw_objects")).groupBy("type_name", "type_class").agg(F.count("*").alias("n"))


_COV = f"count(*) filter ({_OUTCOME} = 'decoded') as decoded, count(*) filter ({_OUTCOME} = 'unhandled') as unhandled, count(*) filter ({_OUTCOME} = 'errored') as errored, count(*) as total, count(*) filter ({_OUTCOME} = 'decoded') / cast(count(*) as double) as decoded_ratio"


@query(f"select path, {_COV} from raw_objects group by path")
def q_coverage(spark, d):
    return R.coverage(load(spark, d, "raw_objects"), ["path"])


@query(f"select {_COV} from raw_objects")
def q_coverage_total(spark, d):
    return R.coverage(load(spark, d, "raw_objects"), [])


@query("select kind, count(*) as n from raw_objects group by kind")
def q_kind_histogram(spark, d):
    return R.histogram(load(spark, d, "raw_objects"), "kind")


@query("select kind, count(*) as n from raw_objects where status = 'skipped' group by kind")
def q_skipped_histogram(spark, d):
    return R.histogram(load(spark, d, "raw_objects").filter("status = 'skipped'"), "kind")


@query("select type_code, count(*) as n from raw_objects where status = 'error' group by 1 order by n desc, type_code nulls last limit 10")
def q_top_errors(spark, d):
    return R.top(load(spark, d, "raw_objects").filter("status = 'error'"), "type_code")


@query("select path, count(*) as errors, greatest(count(*) - 1000, 0) as suppressed, least(count(*), 1000) as kept from raw_objects where reason is not null group by path")
def q_error_messages(spark, d):
    return R.kept_messages(load(spark, d, "raw_objects"), ["path"])


@query("select path, greatest(0.0, least(1.0, coalesce(count(*) filter (status = 'ok') / cast(nullif(count(*) filter (status in ('ok','skipped','error')), 0) as double), 1.0))) as confidence from raw_objects group by path")
def q_walk_confidence(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    return load(spark, d, "raw_objects").groupBy("path").agg(R.walk_confidence(n("ok"), n("skipped"), n("error")).alias("confidence"))


@query("select version, coalesce(greatest(count(*) - (count(*) filter (section_map_status = 'Deferred') + count(*) filter (section_map_status = 'Fallback') + count(*) filter (reason <> '')), 0) / cast(nullif(count(*), 0) as double), 1.0) as confidence from files group by version")
def q_read_confidence(spark, d):
    n = lambda c: F.count_if(c)
    status = F.col("section_map_status")
    return load(spark, d, "files").groupBy("version").agg(R.read_confidence(F.count("*"), n(status == "Deferred"), n(status == "Fallback"), n(F.col("reason") != ""), F.lit(0)).alias("confidence"))


@query("select version, grouping(version) = 1 as is_total, count(*) as n, sum(length) as length from files group by rollup(version)")
def q_corpus_totals(spark, d):
    return R.totals(load(spark, d, "files"), "version", ["length"])


@query("select section_map_status, count(*) as n, count(*) filter (section_map_status = 'Full') as ok from files group by 1")
def q_verify_counts(spark, d):
    return load(spark, d, "files").groupBy("section_map_status").agg(F.count("*").alias("n"), F.count_if(F.col("section_map_status") == "Full").alias("ok"))


@query("select path, sum(size_bytes) / cast(nullif(any_value(length), 0) as double) as ratio from raw_objects join (select distinct path, length from files) f using (path) group by path having count(distinct length) = 1")
def q_compression_ratio(spark, d):
    sizes = load(spark, d, "raw_objects").groupBy("path").agg(F.sum("size_bytes").alias("size"))
    files = load(spark, d, "files").groupBy("path").agg(F.min("length").alias("lo"), F.max("length").alias("hi")).filter("lo = hi")
    return sizes.join(files, "path").select("path", F.try_divide(F.col("size").cast("double"), F.col("lo")).alias("ratio"))


_KNOWN = ", ".join(str(c) for c, _, _ in records.TYPE_CODES)


@query(f"select p_brand, array_to_string(list_sort(list(distinct code)), ',') as unknown, count(*) as n from (select p_brand, cast(p_partkey % 700 as integer) as code from part) where code < 500 and code not in ({_KNOWN}) group by p_brand")
def q_unknown_types(spark, d):
    """Codes that no type has, per brand: part numbers stand in for codes."""
    rows = load(spark, d, "part").select("p_brand", (F.col("p_partkey") % 700).cast("int").alias("type_code"))
    return records.with_types(rows).filter("type_class = 'unknown'").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("type_code")), ",").alias("unknown"), F.count("*").alias("n"))


# Filters and joins

_SPACE = "case when n = '*Model_Space' then 'model' when regexp_full_match(n, '\\*Paper_Space[0-9]*') then 'paper' when n is not null then 'custom' end"
_BLOCKS = "(select c_custkey, case c_mktsegment when 'BUILDING' then '*Model_Space' when 'MACHINERY' then '*Paper_Space' when 'FURNITURE' then '*Paper_Space12' when 'AUTOMOBILE' then '*model_space' else c_mktsegment end as n from customer)"


def _blocks(spark, d):
    """Customers as entities of blocks named by their segment."""
    s = F.col("c_mktsegment")
    name = F.when(s == "BUILDING", "*Model_Space").when(s == "MACHINERY", "*Paper_Space").when(s == "FURNITURE", "*Paper_Space12").when(s == "AUTOMOBILE", "*model_space").otherwise(s)
    return load(spark, d, "customer").select("c_custkey", name.alias("n"))


@query(f"select n, {_SPACE} as space, count(*) as rows_ from {_BLOCKS} group by 1, 2")
def q_block_space(spark, d):
    return _blocks(spark, d).groupBy("n", T.block_space(F.col("n")).alias("space")).agg(F.count("*").alias("rows_"))


@query(f"select c_custkey, {_SPACE} as kind, case when n <> '*Model_Space' then n end as name from {_BLOCKS}")
def q_membership(spark, d):
    return _blocks(spark, d).select("c_custkey", R.membership(F.col("n")).alias("m")).select("c_custkey", "m.kind", "m.name")


@query(f"select c_custkey from {_BLOCKS} where n = '*Paper_Space12'")
def q_in_block(spark, d):
    return R.in_block(_blocks(spark, d), "n", "*Paper_Space12").select("c_custkey")


@query("select event_id, value is not null and isfinite(value) and abs(value) < 50 as plausible from events")
def q_plausible(spark, d):
    return load(spark, d, "events").select("event_id", R.plausible(F.col("value"), 50).alias("plausible"))


@query("select e.path, e.handle, e.seq, o.object_id, o.kind, o.status from (select path, handle, seq, stream_offset, row_number() over (partition by path, handle order by seq nulls last, stream_offset nulls last) n from handle_map where handle is not null) e left join raw_objects o on e.path = o.path and e.handle = o.handle.value and o.kind = 'LINE' where e.n = 1")
def q_lines_by_handle(spark, d):
    return R.by_handle(load(spark, d, "handle_map"), load(spark, d, "raw_objects"), "LINE")


@query("select count(*) as n, count(s_suppkey) as filled, sum(coalesce(s_acctbal, 0)) as total from nation left join supplier on n_nationkey = s_nationkey")
def q_outer_default(spark, d):
    j = load(spark, d, "nation").join(load(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.agg(F.count("*").alias("n"), F.count("s_suppkey").alias("filled"), F.sum(F.coalesce("s_acctbal", F.lit(0.0))).alias("total"))


@query("select (select count(*) from lineitem l join orders o on l.l_orderkey = o.o_orderkey) as matched, (select count(*) from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)) as orphans")
def q_referential(spark, d):
    child = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    good, bad = R.referenced(child, load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return good.agg(F.count("*").alias("matched")).crossJoin(bad.agg(F.count("*").alias("orphans")))  # one row by one row


@query("select min(p_partkey) as p_partkey, p_name from part group by p_name")
def q_first_of_name(spark, d):
    return R.first_of(load(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], [F.col("p_partkey")])


@query("select path, codepage from (select path, codepage from files where section_map_status = 'Full' union all select path, codepage from files f where section_map_status <> 'Full' and not exists (select 1 from files g where g.section_map_status = 'Full' and g.path = f.path))")
def q_prefer_full(spark, d):
    f = load(spark, d, "files")
    return R.prefer(f.filter("section_map_status = 'Full'").select("path", "codepage"), f.filter("section_map_status <> 'Full'").select("path", "codepage"), ["path"])


# Windows, order


@query("select path, object_id, 256 + coalesce(sum(size_bytes) over (partition by path order by stream_offset nulls first, object_id nulls first, loaded_at nulls first, status nulls first rows between unbounded preceding and 1 preceding), 0) as page_offset from raw_objects")
def q_running_offset(spark, d):
    order = [F.col(c) for c in ("stream_offset", "object_id", "loaded_at", "status")]
    rows = load(spark, d, "raw_objects").select("path", "size_bytes", *order)
    return R.running_offset(rows, ["path"], order, "size_bytes", 256).select("path", "object_id", F.col("offset").alias("page_offset"))


@query("select path, handle, handle - lag(handle, 1, 0) over (partition by path order by handle) as delta, handle as value from (select distinct path, handle from handle_map where handle is not null)")
def q_deltas(spark, d):
    rows = load(spark, d, "handle_map").select("path", "handle").filter("handle is not null").distinct()
    return R.undelta(R.deltas(rows, ["path"], [F.col("handle")], "handle"), ["path"], [F.col("handle")])


@query("select path, seq, entry_id from (select *, row_number() over (partition by path order by seq, entry_id, loaded_at) u, row_number() over (partition by path order by seq desc, entry_id desc, loaded_at desc) v from handle_map) where u <= 5 or v <= 5")
def q_head_tail(spark, d):
    return R.head_and_tail(load(spark, d, "handle_map"), ["path"], ["seq", "entry_id", "loaded_at"]).select("path", "seq", "entry_id")


@query("with g as (select distinct path, handle from handle_map where handle >= 1 union select distinct path, 0 from handle_map), w as (select path, handle, lead(handle) over (partition by path order by handle) nxt from g), c as (select path, unnest(generate_series(handle + 1, least(coalesce(nxt - 1, handle + 3), handle + 3))) handle from w where coalesce(nxt, handle + 2) > handle + 1) select path, n_th, handle from (select path, handle, row_number() over (partition by path order by handle) n_th from c) where n_th <= 3")
def q_free_handles(spark, d):
    return graph.free_handles(load(spark, d, "handle_map"), 3)


# Geometry: embeddings give points


def _points(spark, d):
    e = load(spark, d, "embeddings")
    p = lambda i: G.point(*[F.col("embedding")[i + k].cast("double") for k in range(3)])
    return e.select("vec_id", "label", p(0).alias("a"), p(3).alias("b"), p(6).alias("c"))


_E = "(select vec_id, label, cast(embedding[1] as double) ax, cast(embedding[2] as double) ay, cast(embedding[3] as double) az, cast(embedding[4] as double) bx, cast(embedding[5] as double) by_, cast(embedding[6] as double) bz from embeddings)"


@query(f"select vec_id, round(sqrt((ax-bx)**2 + (ay-by_)**2 + (az-bz)**2), 6) + 0.0 as dist, round(sqrt((ax-bx)**2 + (ay-by_)**2), 6) + 0.0 as dist_2d, round(ax*bx + ay*by_ + az*bz, 6) + 0.0 as dot, round(ay*bz - az*by_, 6) + 0.0 as cross_x, round(ax + (bx - ax) * 0.25, 6) + 0.0 as lerp_x, round(ax / sqrt(ax*ax + ay*ay + az*az), 6) + 0.0 as unit_x, round((ax - bx) * 2, 6) + 0.0 as scaled_x from {_E}")
def q_vectors(spark, d):
    a, b = F.col("a"), F.col("b")
    return _points(spark, d).select(
        "vec_id", r6(G.distance(a, b)).alias("dist"), r6(G.distance_2d(a, b)).alias("dist_2d"), r6(G.dot(a, b)).alias("dot"), r6(G.cross(a, b)["x"]).alias("cross_x"),
        r6(G.lerp(a, b, 0.25)["x"]).alias("lerp_x"), r6(G.normalize(a)["x"]).alias("unit_x"), r6(G.scale(G.sub(a, b), 2.0)["x"]).alias("scaled_x"),
    )


@query(f"select vec_id, round(bx + 2 * (cos(0.5) * ax - sin(0.5) * ay), 6) + 0.0 as x, round(by_ + 2 * (sin(0.5) * ax + cos(0.5) * ay), 6) + 0.0 as y, round(bz + 3 * az, 6) + 0.0 as z, round(2 * (cos(0.5) * ax - sin(0.5) * ay), 6) + 0.0 as vx from {_E}")
def q_transform(spark, d):
    m = G.compose_chain(F.array(G.translation(F.col("b")), G.scaling(G.point(2.0, 2.0, 3.0)), G.rotation_z(F.lit(0.5))))
    p = _points(spark, d).withColumn("m", m)
    t, v = G.transform_point(F.col("m"), F.col("a")), G.transform_vector(F.col("m"), F.col("a"))
    return p.select("vec_id", r6(t["x"]).alias("x"), r6(t["y"]).alias("y"), r6(t["z"]).alias("z"), r6(v["x"]).alias("vx"))


_AXES = f"""with n as (select e.*, cx, cy, cz, ax / sqrt(ax*ax + ay*ay + az*az) nx, ay / sqrt(ax*ax + ay*ay + az*az) ny, az / sqrt(ax*ax + ay*ay + az*az) nz from {_E} e join (select vec_id, cast(embedding[7] as double) cx, cast(embedding[8] as double) cy, cast(embedding[9] as double) cz from embeddings) c using (vec_id)),
u as (select *, abs(nx) < 1.0/64 and abs(ny) < 1.0/64 up from n),
x as (select *, case when up then nz / sqrt(nz*nz + nx*nx) else -ny / sqrt(nx*nx + ny*ny) end xx, case when up then 0 else nx / sqrt(nx*nx + ny*ny) end xy, case when up then -nx / sqrt(nz*nz + nx*nx) else 0 end xz from u),
y as (select *, ny*xz - nz*xy yx, nz*xx - nx*xz yy, nx*xy - ny*xx yz from x)
select vec_id, round(xx, 6) + 0.0 as x_x, round(xy, 6) + 0.0 as x_y, round(xz, 6) + 0.0 as x_z, round(yx, 6) + 0.0 as y_x, round(yy, 6) + 0.0 as y_y, round(yz, 6) + 0.0 as y_z, round(bx + xx*cx + yx*cy + nx*cz, 6) + 0.0 as moved_x, round(by_ + xy*cx + yy*cy + ny*cz, 6) + 0.0 as moved_y, round(cx, 6) + 0.0 as back_x, round(cz, 6) + 0.0 as back_z from y"""


@query(_AXES)
def q_axes(spark, d):
    """Axes of an extrusion, a point moved by their transform, and back by its inverse."""
    p = _points(spark, d).withColumn("axes", G.axes(F.col("a"))).select("*", "axes.*").withColumn("m", G.axes_matrix(F.col("b"), F.col("x"), F.col("y"), F.col("z")))
    p = p.withColumn("inverse", G.invert_orthonormal(F.col("m"))).withColumn("moved", G.transform_point(F.col("m"), F.col("c")))
    p = p.withColumn("back", G.transform_point(F.col("inverse"), F.col("moved")))
    return p.select("vec_id", *[r6(F.col(f"{a}.{k}")).alias(f"{a}_{k}") for a in "xy" for k in "xyz"], r6(F.col("moved.x")).alias("moved_x"), r6(F.col("moved.y")).alias("moved_y"), r6(F.col("back.x")).alias("back_x"), r6(F.col("back.z")).alias("back_z"))


@query(f"select vec_id, round(bx + 2 * (cos(0.3) * ax - sin(0.3) * ay), 6) + 0.0 as x, round(by_ + 2 * (sin(0.3) * ax + cos(0.3) * ay), 6) + 0.0 as y from {_E}")
def q_insert(spark, d):
    m = G.insert_transform(F.col("b"), G.point(2.0, 2.0, 2.0), F.lit(0.3), G.point(0.0, 0.0, 1.0))
    p = _points(spark, d).withColumn("m", m)
    t = G.transform_point(F.col("m"), F.col("a"))
    return p.select("vec_id", r6(t["x"]).alias("x"), r6(t["y"]).alias("y"))


@query(f"select label, min(ax) as min_x, min(ay) as min_y, min(az) as min_z, max(ax) as max_x, max(ay) as max_y, max(az) as max_z, round(max(ax) - min(ax), 6) + 0.0 as width, round((max(ay) + min(ay)) / 2, 6) + 0.0 as center_y from {_E} group by label")
def q_bounds(spark, d):
    b = _points(spark, d).groupBy("label").agg(G.bounds_agg(F.col("a")).alias("b"))
    return b.select("label", *[F.col(f"b.{s}.{k}").alias(f"{s}_{k}") for s in ("min", "max") for k in "xyz"], r6(G.size(F.col("b"))["x"]).alias("width"), r6(G.center(F.col("b"))["y"]).alias("center_y"))


@query(f"select vec_id, bx between least(ax, 0) and greatest(ax, 0) and by_ between least(ay, 0) and greatest(ay, 0) and bz between least(az, 0) and greatest(az, 0) as inside from {_E}")
def q_contains(spark, d):
    zero = G.point(0.0, 0.0, 0.0)
    return _points(spark, d).select("vec_id", G.contains(G.expand(G.box(F.col("a"), F.col("a")), zero), F.col("b")).alias("inside"))


@query(f"select vec_id, round(5 + 0.1 * (cos(0.7) * (ax - bx) - sin(0.7) * (ay - by_)), 6) + 0.0 as x, round(7 + 0.1 * (sin(0.7) * (ax - bx) + cos(0.7) * (ay - by_)), 6) + 0.0 as y from {_E}")
def q_viewport(spark, d):
    p = G.model_to_paper(F.col("a"), F.col("b"), F.lit(0.7), F.lit(0.1), F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y")))
    return _points(spark, d).select("vec_id", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


_ITEMS = "(select l_orderkey k, list(struct_pack(x := l_quantity, y := l_extendedprice) order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) pts from lineitem group by 1)"


def _paths(spark, d):
    """Items of an order as the vertices of a path; an order has a handful."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pts = F.transform(F.array_sort(F.collect_list(item)), lambda i: G.point(i["l_quantity"], i["l_extendedprice"], 0.0))
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pts.alias("pts"))


@query(f"select k, case when len(pts) < 3 then 0.0 else round(abs(list_sum(list_transform(range(1, len(pts) + 1), lambda i: pts[i].x * pts[i % len(pts) + 1].y - pts[i % len(pts) + 1].x * pts[i].y))) / 2, 3) end as area, case when len(pts) < 2 then 0.0 else round(list_sum(list_transform(range(1, len(pts)), lambda i: sqrt((pts[i].x - pts[i+1].x)**2 + (pts[i].y - pts[i+1].y)**2))), 4) end as len from {_ITEMS}")
def q_area_length(spark, d):
    return _paths(spark, d).select("k", F.round(G.polygon_area(F.col("pts")), 3).alias("area"), F.round(G.polyline_length(F.col("pts")), 4).alias("len"))


@query(f"select k, cast(i - 1 as integer) as i, pts[i].x as ax, pts[i].y as ay, pts[i % len(pts) + 1].x as bx, pts[i % len(pts) + 1].y as by_, i < len(pts) as in_open from {_ITEMS}, range(1, 1000) t(i) where i <= len(pts)")
def q_path_edges(spark, d):
    """Every edge of the closed path of an order, and whether the open path has it."""
    p = F.col("pts")
    edges = _paths(spark, d).select("k", F.size(G.polyline_path(p, F.lit(False))).alias("n"), F.posexplode(G.polyline_path(p, F.lit(True))).alias("i", "e"))
    return edges.select("k", "i", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by_"), (F.col("i") < F.col("n")).alias("in_open"))


@query(f"select k, t as triangle, case t when 0 then pts[1].x + pts[2].x * 10 + pts[3].x * 100 else pts[1].x + pts[3].x * 10 + pts[4].x * 100 end as corners from {_ITEMS}, (values (0), (1)) v(t) where len(pts) >= 4 and (t = 0 or pts[3] <> pts[4])")
def q_face_triangles(spark, d):
    """Triangles of the faces that the first four items of an order make, by their corners."""
    p = F.slice("pts", 1, 4)
    t = _paths(spark, d).filter(F.size("pts") >= 4).select("k", p.alias("p"), F.posexplode(G.face_triangles(p)).alias("triangle", "t"))
    return t.select("k", "triangle", (F.col("p")[F.col("t")[0]]["x"] + F.col("p")[F.col("t")[1]]["x"] * 10 + F.col("p")[F.col("t")[2]]["x"] * 100).alias("corners"))


@query(f"select vec_id, round(least(ax, bx), 6) + 0.0 as line_x, round(ax - abs(bz), 6) + 0.0 as round_x, round(az + abs(bz), 6) + 0.0 as round_z from {_E}")
def q_curve_bounds(spark, d):
    """Boxes of a line and of a circle around its start."""
    line, circle = G.curve("line", a=F.col("a"), b=F.col("b")), G.curve("circle", center=F.col("a"), radius=F.abs(F.col("b.z")))
    return _points(spark, d).select("vec_id", r6(G.curve_bounds(line)["min"]["x"]).alias("line_x"), r6(G.curve_bounds(circle)["min"]["x"]).alias("round_x"), r6(G.curve_bounds(circle)["max"]["z"]).alias("round_z"))


@query(f"select vec_id, round(sqrt((cx - ax)**2 + (cy - ay)**2), 6) + 0.0 as radius, round(cx, 6) + 0.0 as cx, round(cy, 6) + 0.0 as cy, az > 0 as ccw from (select vec_id, ax, ay, az, (ax + bx) / 2 - (by_ - ay) * (1 - az * az) / (4 * az) cx, (ay + by_) / 2 + (bx - ax) * (1 - az * az) / (4 * az) cy from {_E} where az <> 0)")
def q_bulge(spark, d):
    """The arc over the chord from a to b with the third number of a as its bulge."""
    a, b = F.col("a"), F.col("b")
    arc = _points(spark, d).withColumn("arc", G.bulge_arc(a["x"], a["y"], b["x"], b["y"], a["z"])).filter("arc is not null")
    return arc.select("vec_id", r6(F.col("arc.radius")).alias("radius"), r6(F.col("arc.cx")).alias("cx"), r6(F.col("arc.cy")).alias("cy"), F.col("arc.ccw").alias("ccw"))


@query("select p_partkey, cast(i as integer) as i, round(p_size + p_size * cos(i * (2 * pi() / 64)), 6) + 0.0 as x, round(p_size * sin(i * (2 * pi() / 64)), 6) + 0.0 as y from part, range(0, 64) t(i)")
def q_tessellation(spark, d):
    r = F.col("p_size").cast("double")
    return load(spark, d, "part").select("p_partkey", F.posexplode(G.tessellate_circle(r, F.lit(0.0), r)).alias("i", "p")).select("p_partkey", "i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


# Codes, masks, checksums


@query("select p_partkey, case when p_size in (0, 256) then 2 when p_size between 1 and 255 then 10 else 18 end as short_bits, case when p_partkey = 0 then 2 when p_partkey between 1 and 255 then 10 else 34 end as long_bits, case when p_retailprice in (0, 1) then 2 else 66 end as double_bits from part")
def q_bit_sizes(spark, d):
    return load(spark, d, "part").select("p_partkey", bits.short_bits(F.col("p_size")).alias("short_bits"), bits.long_bits(F.col("p_partkey")).alias("long_bits"), bits.double_bits(F.col("p_retailprice")).alias("double_bits"))


@query("select object_id, handle.code = 2 as soft, handle.code = 3 as hard, handle.code between 2 and 5 as absolute, handle.code in (6, 8, 10, 12) as is_offset from (select object_id, acad_layout.block_record_handle handle from decoded_objects where acad_layout is not null)")
def q_handle_kinds(spark, d):
    h = F.col("acad_layout.block_record_handle")
    return load(spark, d, "decoded_objects").filter("acad_layout is not null").select("object_id", bits.is_soft_owner(h).alias("soft"), bits.is_hard_owner(h).alias("hard"), bits.is_absolute(h).alias("absolute"), bits.is_offset(h).alias("is_offset"))


@query("select entry_id, xor(1097093995::bigint, stream_offset) as mask from handle_map")
def q_page_mask(spark, d):
    return load(spark, d, "handle_map").select("entry_id", codecs.mask_of(F.col("stream_offset")).alias("mask"))


@query("select p_partkey, (list_sum(list_transform(range(1, length(p_name) + 1), lambda i: (length(p_name) - i + 1) * ord(substr(p_name, i, 1)))) + length(p_name)) % 65521 * 65536 + (list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i, 1)))) + 1) % 65521 as checksum from part")
def q_page_checksum(spark, d):
    return load(spark, d, "part").select("p_partkey", codecs.page_checksum_of(codecs.text_bytes(F.col("p_name")), 1).alias("checksum"))


@query("select p_partkey, list_reduce(list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i, 1))::bigint), lambda s, b: ((((s << 1) & 4294967295) | (s >> 31)) + b) & 4294967295, 0::bigint) as checksum from part")
def q_rotate_add(spark, d):
    return load(spark, d, "part").select("p_partkey", codecs.rotate_add_of(codecs.text_bytes(F.col("p_name"))).alias("checksum"))


_T32, _T16 = ([str(_table_entry(i, poly)) for i in range(256)] for poly in (0xEDB88320, 0xA001))
_BYTES = "list_transform(range(1, length(c_name) + 1), lambda i: ord(substr(c_name, i, 1))::bigint)"
_FOLD = "list_reduce({b}, lambda s, b: xor(s >> 8, ([{t}])[(xor(s, b) & 255) + 1]), {seed}::bigint)"


@query(f"select c_custkey, xor({_FOLD.format(b=_BYTES, t=', '.join(_T32), seed=0xFFFFFFFF)}, 4294967295) as crc32, {_FOLD.format(b=_BYTES, t=', '.join(_T16), seed=codecs.SECTION_SEED)} as crc16 from customer")
def q_crc(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.crc32(F.encode("c_name", "utf-8")).alias("crc32"), codecs.crc16_of(codecs.text_bytes(F.col("c_name")), codecs.SECTION_SEED).alias("crc16"))


_BASE = "p_name || substr(repeat(p_name, 20), 1, k) || '#'"


@query(f"select p_partkey, base || left(repeat(right(base, 2), 3), 5) as text from (select p_partkey, {_BASE} as base from (select p_partkey, p_name, p_size % 12 + 3 as k from part))")
def q_lz77_references(spark, d):
    """Streams with back references: the name as literals, its first letters again from its own length back, a literal, and five letters from two back."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    n, k = F.length("p_name"), (F.col("p_size") % 12 + 3)
    head = F.when(n <= 18, byte(n - 3)).otherwise(F.concat(byte(F.lit(0)), byte(n - 18)))
    near = F.concat(byte((k + 1) * 16 + F.pmod(n - 1, F.lit(4)) * 4 + 1), byte(F.floor((n - 1) / 4)), byte(F.lit(0x23)))
    far = F.concat(byte(F.lit(0x23)), byte(F.lit(1 << 2)), byte(F.lit(0)), byte(F.lit(0x11)))
    stream = F.concat(head, F.encode("p_name", "utf-8"), near, far)
    return load(spark, d, "part").select("p_partkey", F.decode(codecs.lz77_decompressed(stream)["data"], "utf-8").alias("text"))


@query("select object_id, md5(raw) as raw_md5 from raw_objects where raw is not null and (octet_length(raw) = 0 or octet_length(raw) > 3)")
def q_lz77(spark, d):
    """What was packed comes back: every object's bytes."""
    rows = load(spark, d, "raw_objects").filter(F.col("raw").isNotNull() & ((F.length("raw") == 0) | (F.length("raw") > 3)))
    return rows.select("object_id", "raw", codecs.lz77_compressed("raw").alias("packed")).select("object_id", F.md5(codecs.lz77_decompressed("packed")["data"]).alias("raw_md5"))


@query("select c_custkey, c_custkey % 10 <= 8 as mended, case when c_custkey % 10 <= 8 then cast(c_custkey % 10 as integer) end as corrected, case when c_custkey % 10 <= 8 then c_name end as name from customer")
def q_reed_solomon(spark, d):
    """Names as messages, with none to nine bytes damaged: up to eight are mended."""
    rows = load(spark, d, "customer").select("c_custkey", F.encode("c_name", "utf-8").alias("m"))
    rows = rows.withColumn("word", codecs.rs_encoded("m"))
    part = lambda at, n: F.substring("word", at + 1, n)
    flipped = lambda byte: F.unhex(F.translate(F.hex(byte), "0123456789ABCDEF", "FEDCBA9876543210"))
    hits = [F.when(F.col("c_custkey") % 10 > i, flipped(part(25 * i + 3, 1))).otherwise(part(25 * i + 3, 1)) for i in range(9)]
    damaged = F.concat(part(0, 3), *[p for i, hit in enumerate(hits) for p in (hit, part(25 * i + 4, 24 if i < 8 else 51))])
    back = rows.withColumn("back", codecs.rs_decoded(damaged))
    return back.select("c_custkey", (F.col("back.status") == "ok").alias("mended"), "back.corrected", F.decode(F.substring(F.col("back.data"), F.lit(1), F.length("m")), "utf-8").alias("name"))


# Colour and text


_HSV = "case cast(floor(hue / 4.0) as integer) % 6 when {0} then 1.0 when {1} then 1.0 when {2} then 1 - s * (hue / 4.0 - floor(hue / 4.0)) when {3} then 1 - s * (1 - (hue / 4.0 - floor(hue / 4.0))) else 1 - s end"
_RGB = [_HSV.format(*o) for o in ((0, 5, 1, 4), (1, 2, 3, 0), (3, 4, 5, 2))]
_FIXED = " ".join(f"when {i} then '#{r:02X}{g:02X}{b:02X}'" for i, (r, g, b) in T.BASIC.items())
_SHADE = "(case (aci % 10) // 2 when 0 then 255 when 1 then 165 when 2 then 127 when 3 then 76 else 38 end)"
_GREY = "(case aci when 250 then 51 when 251 then 80 when 252 then 105 when 253 then 130 when 254 then 190 else 255 end)"


@query(f"select p_partkey, case aci {_FIXED} else case when aci < 250 then printf('#%02X%02X%02X', " + ", ".join(f"cast(trunc({c} * {_SHADE}) as integer)" for c in _RGB) + f") when aci < 256 then printf('#%02X%02X%02X', {_GREY}, {_GREY}, {_GREY}) end end as rgb_hex from (select p_partkey, cast(p_partkey % 300 as integer) as aci, (p_partkey % 300 - 10) // 10 as hue, case when (p_partkey % 300) % 2 = 1 then 0.5 else 1.0 end::double as s from part)")
def q_colors(spark, d):
    """All colours of the index, and numbers beyond it."""
    return T.with_rgb(load(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("aci")), "aci").select("p_partkey", "rgb_hex")


_HUE = "fmod(aci * 137.508, 360.0)"
_X = f"(0.7 * (1 - abs(fmod({_HUE} / 60.0, 2.0) - 1)))"
_PART = lambda order: "cast(round((case cast(floor(" + _HUE + " / 60.0) as integer) " + " ".join(f"when {i} then {dict(c='0.7', x=_X)[w] if w != '0' else '0.0'}" for i, w in enumerate(order)) + " end + 0.15) * 255) as integer)"


@query(f"select p_partkey, case aci {_FIXED} when 256 then '#000000' else printf('#%02X%02X%02X', {_PART('cx00xc')}, {_PART('xccx00')}, {_PART('00xccx')}) end as rgb_hex from (select p_partkey, cast(p_partkey % 300 as integer) as aci from part)")
def q_page_colors(spark, d):
    """Colours of the index as vector pages show them."""
    return load(spark, d, "part").select("p_partkey", T.page_rgb(F.col("p_partkey") % 300).alias("rgb_hex"))


@query("select event_id, replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as xml, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as attr from events")
def q_escape(spark, d):
    return load(spark, d, "events").select("event_id", T.escape_xml(F.col("props")).alias("xml"), T.escape_attribute(F.col("props")).alias("attr"))


@query("select object_id, len(string_split(rec.text, '\\P')) as paragraphs, string_split(rec.text, '\\P')[1] as first from decoded_mtext where rec.text is not null")
def q_paragraphs(spark, d):
    t = T.paragraphs(F.col("rec.text"))
    return load(spark, d, "decoded_mtext").filter("rec.text is not null").select("object_id", F.size(t).alias("paragraphs"), t[0].alias("first"))


@query()
def q_note_runs(spark, d):
    runs = load(spark, d, "decoded_mtext").select("object_id", F.posexplode(T.note_runs("rec.text")).alias("n", "run"))
    return runs.select("object_id", "n", "run.*")


@query("select p_partkey, case when p_size % 3 = 0 then '0,' else '' end || p_size || ',' || case when p_size % 2 = 0 then '0.001' else '0.5' end as dashes from part")
def q_dashes(spark, d):
    size = F.col("p_size").cast("double")
    first = F.when(F.col("p_size") % 3 == 0, -size).otherwise(size)
    second = F.when(F.col("p_size") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.5))
    return load(spark, d, "part").select("p_partkey", T.dash_array(F.array(first, second)).alias("dashes"))


@query("select p_partkey, case when p_type is null or trim(p_type) = '' or lower(p_type) like '%.shx' then 'Arial' else p_type end as font from (select p_partkey, case when p_size % 2 = 0 then p_type || '.SHX' else p_type end p_type from part)")
def q_fonts(spark, d):
    f = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(".SHX"))).otherwise(F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", T.font_fallback(f).alias("font"))


# Graphs


_LAST = "select * from (select *, row_number() over (partition by path, handle order by loaded_at desc nulls last, entity_id) as nth from expanded_entities where path is not null and handle is not null) where nth = 1"
_LINKED = f"with recursive rows_ as ({_LAST}), linked as (select n.*, case when p.handle is null then null else n.owner_handle end as parent from rows_ n left join rows_ p on n.path = p.path and n.owner_handle = p.handle)"


@query(_LINKED + ", walk as (select path, handle, cast(handle as varchar) as chain from linked where parent is null union all select l.path, l.handle, l.handle || '/' || w.chain from walk w join linked l on l.path = w.path and l.parent = w.handle) select l.path, l.handle, w.chain from linked l left join walk w on l.path = w.path and l.handle = w.handle")
def q_owner_chains(spark, d):
    """The owners of each entity from inside to outside; null where they run in a circle."""
    return graph.owner_chains(load(spark, d, "expanded_entities")).withColumn("chain", F.array_join("chain", "/"))


def _nested(spark, d):
    """The last row of every entity, its transform as a matrix."""
    rows = R.first_of(load(spark, d, "expanded_entities").filter("path is not null and handle is not null"), ["path", "handle"], [-F.unix_micros(F.col("loaded_at").cast("timestamp")), F.col("entity_id")])
    own = F.when(F.size("transform") == 4, G.compose(G.translation(G.point(F.col("transform")[0], F.col("transform")[1], F.col("transform")[2])), G.scaling(G.point(F.col("transform")[3], F.col("transform")[3], F.col("transform")[3]))))
    return rows.withColumn("transform", own)


_STEP = "case when len(transform) = 4 then w.s * transform[{i}] else 0 end"


@query(
    _LINKED + ", walk as (select path, handle, coalesce(owner_handle, handle) as root, case when owner_handle is null then 0 else 1 end as depth, case when owner_handle is null then 0 else seq end as seqs, case when owner_handle is not null and len(transform) = 4 then transform[1] else 0.0 end as x, case when owner_handle is not null and len(transform) = 4 then transform[3] else 0.0 end as z, case when owner_handle is not null and len(transform) = 4 then transform[4] else 1.0 end as s from linked where parent is null "
    "union all select l.path, l.handle, w.root, w.depth + 1, w.seqs + l.seq, w.x + " + _STEP.format(i=1) + ", w.z + " + _STEP.format(i=3) + ", w.s * case when len(transform) = 4 then transform[4] else 1.0 end from walk w join linked l on l.path = w.path and l.parent = w.handle) "
    "select l.path, w.root, l.handle as entity, w.depth, cast(w.seqs as bigint) as seqs, floor(w.x * 1e4 + 0.5) / 1e4 + 0.0 as x, floor(w.z * 1e4 + 0.5) / 1e4 + 0.0 as z, floor(w.s * 1e6 + 0.5) / 1e6 + 0.0 as s from linked l left join walk w on l.path = w.path and l.handle = w.handle where w.depth is null or w.depth > 0"
)
def q_expand_all(spark, d):
    """What every root block of each drawing holds, to the full depth, and where; entities caught in circles without a root."""
    out = graph.expand_tree(_nested(spark, d))
    # many places are decimals with ties, so they are rounded by the same steps as in SQL
    place = lambda i, n: F.floor(F.col("transform")[i] * 10.0**n + 0.5).cast("double") / 10.0**n + F.lit(0.0)
    return out.select("path", "root", "entity", "depth", F.aggregate("order_key", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("seqs"), place(3, 4).alias("x"), place(11, 4).alias("z"), place(0, 6).alias("s"))


# Sinks


def _entities(spark, d):
    """Suppliers as circles and orders' customers as lines of one drawing per nation."""
    s = load(spark, d, "supplier").select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("path"), F.col("s_suppkey").alias("seq"), F.lit("CIRCLE").alias("kind"), F.col("s_acctbal").alias("v"))
    c = load(spark, d, "customer").select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("path"), (F.col("c_custkey") + 1_000_000_000).alias("seq"), F.lit("LINE").alias("kind"), F.col("c_acctbal").alias("v"))
    e = s.unionByName(c)
    return e.withColumn("circle", F.struct(G.point(F.col("v"), 0.0, 0.0).alias("center"), F.lit(2.0).alias("radius"))).withColumn("line", F.struct(G.point(0.0, 0.0, 0.0).alias("start"), G.point(F.col("v"), 1.0, 0.0).alias("end")))


def _pairs():
    return dxf.entity_pairs(F.col("kind"), {"CIRCLE": F.col("circle"), "LINE": F.col("line")}, F.lit("0"), F.col("seq"))


_ENT = "(select 'nation-' || s_nationkey path, s_suppkey seq, 'CIRCLE' kind, s_acctbal v from supplier union all select 'nation-' || c_nationkey, c_custkey + 1000000000, 'LINE', c_acctbal from customer)"
_ZERO, _HEXOF = "0.0000000000000000", "upper(to_hex(seq))"
_REAL = "replace(printf('%.16f', v), '-" + _ZERO + "', '" + _ZERO + "')"
_FORMS = {
    "CIRCLE": [(0, "'CIRCLE'"), (5, _HEXOF), (100, "'AcDbEntity'"), (8, "'0'"), (100, "'AcDbCircle'"), (10, _REAL), (20, f"'{_ZERO}'"), (30, f"'{_ZERO}'"), (40, "'2.0000000000000000'")],
    "LINE": [(0, "'LINE'"), (5, _HEXOF), (100, "'AcDbEntity'"), (8, "'0'"), (100, "'AcDbLine'"), *[(c, f"'{_ZERO}'") for c in (10, 20, 30)], (11, _REAL), (21, "'1.0000000000000000'"), (31, f"'{_ZERO}'")],
}
_PAIRS_SQL = " union all ".join(f"select path, seq, {i} as pair, {c} as code, {v} as value from {_ENT} where kind = '{k}'" for k, form in _FORMS.items() for i, (c, v) in enumerate(form))
_FRAME = [
    (0, 0, [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1032"), (0, "ENDSEC")]), (1, 0, [(0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER")]), (1, 2**63 - 1, [(0, "ENDTAB"), (0, "ENDSEC")]),
    (2, 0, [(0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "*Model_Space"), (0, "ENDBLK"), (0, "ENDSEC")]), (3, -(2**63), [(0, "SECTION"), (2, "ENTITIES")]), (3, 2**63 - 1, [(0, "ENDSEC")]), (4, 0, [(0, "SECTION"), (2, "OBJECTS"), (0, "ENDSEC")]), (5, 0, [(0, "EOF")]),
]
_FRAME_SQL = "(values " + ", ".join(f"({s}, {q}, {i}, {c}, '{v}')" for s, q, ps in _FRAME for i, (c, v) in enumerate(ps)) + ") t(section, seq, pair, code, value)"


@query(_PAIRS_SQL)
def q_dxf_pairs(spark, d):
    return dxf.entity_rows(_entities(spark, d), _pairs()).select("path", "seq", "pair", "code", "value")


@query(f"select path, 3 as section, seq, pair, code, value from ({_PAIRS_SQL}) union all select path, section, seq, pair, code, value from (select distinct path from {_ENT}), {_FRAME_SQL}")
def q_dxf_document(spark, d):
    e = _entities(spark, d)
    return dxf.entity_rows(e, _pairs()).unionByName(dxf.frame_rows(e))


_NUM = "regexp_replace(regexp_replace(printf('%.6f', {}), '0+$', ''), '\\.$', '')"


@query("select n_nationkey, '<circle cx=\"' || " + _NUM.format("n_nationkey * 10.5") + " || '\" cy=\"' || " + _NUM.format("n_regionkey * 1.25") + " || '\" r=\"2\" fill=\"none\" stroke=\"#FFFFFF\" stroke-width=\"1\"/>' as fragment from nation")
def q_svg_fragments(spark, d):
    c = G.curve("circle", center=G.point(F.col("n_nationkey") * 10.5, F.col("n_regionkey") * 1.25, 0.0), radius=F.lit(2.0))
    return load(spark, d, "nation").select("n_nationkey", svg.curve_fragment(c, F.lit("#FFFFFF")).alias("fragment"))


_COLOURED = "case kind when 'CIRCLE' then '<circle cx=\"' || " + _NUM.format("v") + " || '\" cy=\"0\" r=\"2\" fill=\"none\" stroke=\"#FF0000\" stroke-width=\"1\"/>' else '<line x1=\"0\" y1=\"0\" x2=\"' || " + _NUM.format("v") + " || '\" y2=\"1\" fill=\"none\" stroke=\"#0000FF\" stroke-width=\"1\"/>' end"


@query(
    f"select path, 1 as part, kind as layer, seq, {_COLOURED} as line from {_ENT} "
    f"union all select path, 1, kind, -1, '<g data-layer=\"' || kind || '\">' from (select distinct path, kind from {_ENT}) union all select path, 1, kind, {2**62}, '</g>' from (select distinct path, kind from {_ENT}) "
    f"union all select path, 0, '', 0, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"1000\" height=\"1000\" viewBox=\"0 0 1000 1000\"><g transform=\"translate(0,1000) scale(1,-1)\">' from (select distinct path from {_ENT}) union all select path, 2, '', 0, '</g></svg>' from (select distinct path from {_ENT})"
)
def q_svg_document(spark, d):
    curve = F.when(F.col("kind") == "CIRCLE", svg.curve_fragment(G.circle_curve(F.col("circle")), F.lit("#FF0000"))).otherwise(svg.curve_fragment(G.line_curve(F.col("line")), F.lit("#0000FF")))
    return svg.document(_entities(spark, d).select("path", F.col("kind").alias("layer"), "seq", curve.alias("fragment")), 1000, 1000)


@query("select c_custkey, n > 0 as drawn, round(n, 6) as measure, round(-3 * y / n, 6) + 0.0 as x0, round(3 * x / n, 6) + 0.0 as y0, round(x - 3 * y / n - x / n - 0.3 * y / n, 6) + 0.0 as head_x, round((x - 6 * y / n) / 2, 6) + 0.0 as text_x from (select c_custkey, c_acctbal x, cast(c_custkey as double) y, sqrt(c_acctbal * c_acctbal + cast(c_custkey as double) * c_custkey) n from customer)")
def q_svg_dimension(spark, d):
    """A dimension from the origin: its line, the second corner of its far head, the place of its text."""
    a, b = G.point(0.0, 0.0, 0.0), G.point(F.col("c_acctbal"), F.col("c_custkey").cast("double"), 0.0)
    p = svg.dimension_points(a, b, F.lit(3.0), F.lit(2.0))
    return load(spark, d, "customer").select("c_custkey", p.isNotNull().alias("drawn"), r6(p["measure"]).alias("measure"), r6(p["line"][0]["x"]).alias("x0"), r6(p["line"][0]["y"]).alias("y0"), r6(p["head_b"][1]["x"]).alias("head_x"), r6(p["text_at"]["x"]).alias("text_x"))


@query(f"select path, cast(row_number() over (partition by path order by seq) - 1 as integer) as node, 2 as n_positions, 2 as n_indices, cast(cast(least(v, 0) as float) as double) as low_x, cast(cast(greatest(v, 0) as float) as double) as high_x, 1.0::double as high_y from {_ENT} where kind = 'LINE'")
def q_gltf(spark, d):
    """Lines of a drawing as a scene, read back from its bytes."""
    e = _entities(spark, d).filter("kind = 'LINE'").select("path", "seq", F.lit("layer-7").alias("material"), F.array("line.start", "line.end").alias("points"))
    got = gltf.contents(gltf.documents(gltf.line_meshes(e)))
    return got.select("path", "node", "n_positions", "n_indices", F.col("low")[0].alias("low_x"), F.col("high")[0].alias("high_x"), F.col("high")[1].alias("high_y"))


# Viewer


@query("select c_custkey, case when s > 0 then 10 - (10 - (x + 2)) / 2 * (2 * s) else x + 2 end as pan_x, case when s > 0 then 2 * s else 2.0 end as zoom, 7 * 2.0 + x as to_x, case when c_nationkey = 0 then 0.0 else (7 - x) / c_nationkey end as from_x, greatest(x, 1.0) as width from (select *, c_acctbal x, cast(c_nationkey % 3 as double) s from customer)")
def q_views(spark, d):
    """Panning, zooming about a place, and the way between drawing and viewport."""
    x, zero = F.col("c_acctbal"), F.lit(0.0)
    v = V.view(x, zero, F.lit(2.0))
    z = V.zoom_at(V.pan_by(v, F.lit(2.0), zero), F.lit(10.0), F.lit(10.0), (F.col("c_nationkey") % 3).cast("double"))
    back = V.to_drawing(V.view(x, zero, F.col("c_nationkey").cast("double")), F.lit(7.0), zero)
    return load(spark, d, "customer").select("c_custkey", z["pan_x"].alias("pan_x"), z["zoom"].alias("zoom"), V.to_viewport(v, F.lit(7.0), zero)["x"].alias("to_x"), back["x"].alias("from_x"), V.viewport(x, zero)["width"].alias("width"))


@query("select c_custkey, c_acctbal as pan_x, 1.5::double as zoom, c_nationkey % 2 = 0 as is_model, c_nationkey as layout_index, array_to_string(list_transform(range(0, c_custkey % 20), lambda i: case when i % 3 = 0 then '1' else '0' end), '') as layers, cast(ceil((37 + ceil((c_custkey % 20) / 8.0)) * 4 / 3.0) as integer) as size from customer")
def q_view_links(spark, d):
    """States of a viewer as text for a link, and back."""
    n = (F.col("c_custkey") % 20).cast("int")
    layers = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i % 3 == 0)).otherwise(F.array().cast("array<boolean>"))
    text = load(spark, d, "customer").select("c_custkey", V.state_text(F.col("c_acctbal"), F.lit(0.0), F.lit(1.5), F.col("c_nationkey") % 2 == 0, F.col("c_nationkey"), layers).alias("t"))
    got = text.select("c_custkey", F.length("t").alias("size"), V.state_of("t").alias("s"))
    return got.select("c_custkey", "s.pan_x", "s.zoom", "s.is_model", "s.layout_index", F.array_join(F.transform("s.layers", lambda b: F.when(b, "1").otherwise("0")), "").alias("layers"), "size")


@query(f"select vec_id, 4 as angular, round((ax + bx) / 2, 6) + 0.0 as mid_x, round(ay, 6) + 0.0 as knee_y, round(bx, 6) + 0.0 as knee_x, round(bx, 6) + 0.0 as radial_x, bx between least(ax, 0) and greatest(ax, 0) and by_ between least(ay, 0) and greatest(ay, 0) and bz between least(az, 0) and greatest(az, 0) or label % 2 = 0 as shown from {{_E}}".format(_E=_E))
def q_dimension_outlines(spark, d):
    """Outlines of angular, ordinate and radial dimensions, and points shown by a section box that is on for odd labels."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    angular, ordinate, radial = V.angular_outline(a, b, b, c, c), V.ordinate_outline(a, b), V.radial_outline(a, b)
    box = G.expand(G.box(a, a), G.point(0.0, 0.0, 0.0))
    return _points(spark, d).select(
        "vec_id", F.size(angular["segments"]).alias("angular"), r6(angular["segments"][2]["a"]["x"]).alias("mid_x"), r6(ordinate["segments"][0]["b"]["y"]).alias("knee_y"), r6(ordinate["segments"][1]["a"]["x"]).alias("knee_x"),
        r6(radial["label_at"]["x"]).alias("radial_x"), V.in_section_box(box, b, F.col("label") % 2 != 0).alias("shown"),
    )


@query("select * from (values " + ", ".join(f"('{n}', '{k}', {v})" for n, k, v in limits.table()) + ") t(set_name, limit_name, most)")
def q_limits(spark, d):
    return spark.createDataFrame(limits.table(), "set_name string, limit_name string, most bigint")


# Streams


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def q_stream_tumbling(spark, d):
    return windows.run_available(spark, f"{d}/events.parquet", windows.tumbling).withColumn("total", F.round("total", 4))


@query("select time_bucket(interval 15 minutes, ts) - interval (15 * k) minutes as window_start, count(*) as n from events, range(0, 4) t(k) group by 1")
def q_stream_sliding(spark, d):
    return windows.run_available(spark, f"{d}/events.parquet", windows.sliding)


@query("with o as (select user_id, ts, case when ts > coalesce(lag(ts) over w, timestamp '1970-01-01') + interval 30 minutes then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from o) select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end, count(*) as n from g group by user_id, s")
def q_stream_sessions(spark, d):
    return windows.run_available(spark, f"{d}/events.parquet", windows.sessions)
