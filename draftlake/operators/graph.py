"""Walks over drawings: chains of owners, expansion of inserts, free handles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import geometry as G
from draftlake.operators.hierarchy import hierarchy
from draftlake.runtime import checkpoint

#: Deepest nesting of blocks.
MAX_DEPTH = 16


class CycleError(ValueError):
    """Blocks that contain themselves, or nest too deep."""


def owner_chains(entities: DataFrame) -> DataFrame:
    """(path, handle, chain): the owners of each entity from inside to outside, itself first; null where they run in a circle."""
    tree = hierarchy(entities, with_path=True)
    return tree.select("path", "handle", F.reverse("node_path").alias("chain"))


def reactors(edges: DataFrame) -> DataFrame:
    """Reactors of each object from an edge table (path, src, dst, role), in order."""
    return edges.filter("role = 'reactor'").groupBy("path", "src").agg(F.sort_array(F.collect_list("dst")).alias("reactors"))


def expand_inserts(inserts: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, strict: bool = True) -> DataFrame:
    """What each root block holds, with the composed transform of every entity.

    inserts: path, block (handle), seq, entity, child_block (null but for an
    insert), transform (16 doubles). roots: path, block. Returns path, root,
    entity, depth (1 for direct members), transform, order_key (sequence numbers
    from the root down; sorting by it gives the depth-first order). A block
    inside itself, or one deeper than max_depth, raises, or with strict=False is
    not entered and its insert marked by cut ('cycle' or 'depth', else null).
    One join and one aggregate per level, which is written once.
    """
    frontier = roots.select("path", F.col("block").alias("root"), "block", F.array("block").alias("seen"), G.matrix(*G.IDENTITY).alias("outer"), F.array().cast("array<int>").alias("prefix"))
    out = None
    for depth in range(1, max_depth + 2):
        level = frontier.join(inserts.select("path", "block", "seq", "entity", "child_block", F.col("transform").alias("own")), ["path", "block"])
        level = level.withColumn("order_key", F.concat("prefix", F.array(F.col("seq").cast("int"))))
        level = level.withColumn("transform", F.when(F.col("own").isNull(), F.col("outer")).otherwise(G.compose(F.col("outer"), F.col("own"))))
        loop = F.coalesce(F.array_contains("seen", F.col("child_block")), F.lit(False))
        level = checkpoint(level.withColumn("cut", F.when(loop, "cycle").when(F.col("child_block").isNotNull() & F.lit(depth == max_depth), "depth")))
        loops, n = level.agg(F.count_if(F.col("cut") == "cycle"), F.count("*")).first()
        if not n:
            break
        if strict and (loops or depth > max_depth):
            raise CycleError("a block inside itself" if loops else f"deeper than {max_depth}")
        if depth > max_depth:
            break
        rows = level.select("path", "root", "entity", F.lit(depth).alias("depth"), "transform", "order_key", "cut")
        out = rows if out is None else out.unionByName(rows)
        frontier = level.filter(F.col("child_block").isNotNull() & (F.coalesce("cut", F.lit("")) != "cycle")).select("path", "root", F.col("child_block").alias("block"), F.concat("seen", F.array("child_block")).alias("seen"), F.col("transform").alias("outer"), F.col("order_key").alias("prefix"))
    if out is None:
        return inserts.limit(0).select("path", F.col("block").alias("root"), "entity", F.lit(0).alias("depth"), "transform", F.array().cast("array<int>").alias("order_key"), F.lit(None).cast("string").alias("cut"))
    return out


def expand_tree(entities: DataFrame) -> DataFrame:
    """`expand_inserts` from every root block to the full depth, where an entity is itself the block of its members and so has one place.

    entities: path, handle, owner_handle, seq, transform (16 doubles or null),
    entity_id, depth, loaded_at, a row per (path, handle). Root blocks are
    owners that have no row and entities without an owner. Returns path, root,
    entity, depth (1 for direct members), transform, order_key; an entity whose
    owners run in a circle has only path and entity. No join per level: the
    transforms of a chain are folded in its order, however deep it is.
    """
    tree = hierarchy(entities.select("path", "handle", "owner_handle", "entity_id", "depth", "loaded_at"), with_path=True)
    tree = checkpoint(tree.select("path", F.col("handle").alias("entity"), "in_cycle", "node_path"))
    own = entities.select("path", "handle", "owner_handle", "seq", "transform")
    steps = tree.filter("not in_cycle").select("path", "entity", F.posexplode("node_path").alias("pos", "handle")).join(own, ["path", "handle"])
    chain = F.sort_array(F.collect_list(F.struct("pos", "handle", "owner_handle", "seq", "transform"))).alias("chain")
    placed = steps.groupBy("path", "entity").agg(chain).withColumn("top", F.col("chain")[0])
    # an entity without an owner is the block at the root and no member of it
    bare = F.col("top.owner_handle").isNull()
    placed = placed.withColumn("members", F.when(bare, F.slice("chain", 2, F.size("chain"))).otherwise(F.col("chain"))).filter(F.size("members") > 0)
    folded = G.compose_chain(F.filter(F.transform("members", lambda m: m["transform"]), lambda t: t.isNotNull()))
    out = placed.select(
        "path", F.coalesce("top.owner_handle", "top.handle").alias("root"), "entity", F.size("members").alias("depth"), folded.alias("transform"), F.transform("members", lambda m: m["seq"].cast("int")).alias("order_key")
    )
    caught = tree.filter("in_cycle").select("path", F.lit(None).cast("bigint").alias("root"), "entity", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<double>").alias("transform"), F.lit(None).cast("array<int>").alias("order_key"))
    return out.unionByName(caught)


def free_handles(used: DataFrame, n: int, start: int = 1) -> DataFrame:
    """(path, n_th, handle): the n smallest handles from `start` on that a drawing doesn't use.

    Gaps lie between neighbours in the sorted handles of a path, so no range is
    ever laid out whole: from each gap at most n handles are taken.
    """
    from pyspark.sql import Window

    taken = used.filter(F.col("handle") >= start).select("path", "handle").distinct()
    bounds = taken.unionByName(used.select("path").distinct().withColumn("handle", F.lit(start - 1).cast("bigint")))
    w = Window.partitionBy("path").orderBy("handle")
    gaps = bounds.withColumn("next", F.lead("handle").over(w)).withColumn("last", F.least(F.coalesce(F.col("next") - 1, F.col("handle") + n), F.col("handle") + n)).filter("last > handle")
    # only the first n gaps can matter
    gaps = gaps.withColumn("g", F.row_number().over(w)).filter(F.col("g") <= n)
    each = gaps.select("path", F.explode(F.sequence(F.col("handle") + 1, F.col("last"))).alias("handle"))
    return each.withColumn("n_th", F.row_number().over(w)).filter(F.col("n_th") <= n).select("path", "n_th", "handle")
