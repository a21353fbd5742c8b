"""Parent-child links to full hierarchies.

Chains are contracted inside each partition to their exits, the quotient
forest of exits is solved by the same step over coarser fragments, and the
solutions are expanded into the fragments again. A cycle shows where it is
local to a fragment: at once, or in the quotient that holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.runtime import checkpoint, tasks_for

ROOT, EXIT, CYCLE = 0, 1, 2

#: Handles per fragment at the first level, as a power of two, and its growth per level.
SHIFT, STEP = 13, 3
#: Once no drawing has more quotient nodes than this, the next level takes drawings whole; the results don't depend on it.
WHOLE = 500_000
ROWS_PER_TASK = 400_000
#: Path elements per emitted batch.
CHUNK = 2_000_000


def contract(group: np.ndarray, handle: np.ndarray, owner: np.ndarray, has_owner: np.ndarray, weight: np.ndarray, settled: np.ndarray, shift: int) -> dict[str, np.ndarray]:
    """Follow owners as far as the fragments at hand reach.

    group and handle name a node, owner its parent in the same group. settled
    holds a status for nodes solved before, else -1. A node whose owner would
    lie in a fragment at hand but isn't there is a root; one whose owner lies in
    another fragment is the end of a chain with an exit. Returns for each node
    the index of its chain's end, the summed weight to it, the status of that
    end, the number of hops and the next node.
    """
    n = len(handle)
    ids, inverse = np.unique(np.concatenate([handle, owner]), return_inverse=True)
    width = max(1, len(ids))
    own = group * width + inverse[:n]
    up = group * width + inverse[n:]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own, up, sorter=order), max(0, n - 1))
    target = order[at] if n else at
    found = has_owner & (own[target] == up) & (settled < 0) if n else has_owner
    frags, finv = np.unique(np.concatenate([handle >> shift, owner >> shift]), return_inverse=True)
    fw = max(1, len(frags))
    here = np.isin(group * fw + finv[n:], group * fw + finv[:n])
    status = np.where(settled >= 0, settled, np.where(has_owner & ~found & ~here, EXIT, ROOT))
    parent = np.where(found, target, np.arange(n))
    jump, dist, hops = parent.copy(), np.where(found, weight, 0), found.astype(np.int64)
    for _ in range(int(n).bit_length() + 1):
        if not found[jump].any():
            break
        dist, hops, jump = dist + dist[jump], hops + hops[jump], jump[jump]
    loop = found[jump]
    return {"end": jump, "dist": dist, "hops": hops, "parent": parent, "status": np.where(loop, CYCLE, status[jump]), "loop": loop}


def _column(table: pa.Table, name: str, null: int = 0) -> tuple[np.ndarray, np.ndarray]:
    col = table.column(name).combine_chunks()
    valid = np.asarray(col.is_valid())
    return np.asarray(col.fill_null(null)), valid


def _groups(table: pa.Table) -> np.ndarray:
    coded = table.column("path").combine_chunks().dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _chain_batches(hops: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(hops + 1)
    start = 0
    while start < len(hops):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        yield start, stop
        start = stop


def _first_level(with_path: bool, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        group, (handle, _), (loaded, _) = _groups(table), _column(table, "handle"), _column(table, "us", -(2**62))
        # the last delivery of a node counts; of several at one time that with the largest owner
        owner, has_owner = _column(table, "owner_handle")
        ids, inverse = np.unique(handle, return_inverse=True)
        key = group * max(1, len(ids)) + inverse
        order = np.lexsort((owner, has_owner, loaded, key))
        keep = np.sort(order[np.append(key[order][1:] != key[order][:-1], True)])
        table = table.take(pa.array(keep))
        group, handle, owner, has_owner = group[keep], handle[keep], owner[keep], has_owner[keep]
        n = len(keep)
        c = contract(group, handle, owner, has_owner, np.ones(n, np.int64), np.full(n, -1), shift)
        leaving = c["status"] == EXIT
        base = {
            "path": table.column("path").combine_chunks(),
            "handle": table.column("handle").combine_chunks(),
            "entity_id": table.column("entity_id").combine_chunks(),
            "recorded_depth": table.column("depth").combine_chunks(),
            "top": pa.array(handle[c["end"]]),
            "dist": pa.array(c["dist"]),
            "status": pa.array(c["status"].astype(np.int32)),
            "exit": pa.array(owner[c["end"]], mask=~leaving),
        }
        if not with_path:
            for b in pa.table(base).to_batches(max_chunksize=100_000):
                yield b
            return
        hops = np.where(c["loop"], 0, c["hops"])
        for start, stop in _chain_batches(hops):
            offsets = np.concatenate([[0], np.cumsum(hops[start:stop] + 1)])
            flat = np.empty(offsets[-1], np.int64)
            at, cur, left = offsets[1:] - 1, np.arange(start, stop), hops[start:stop].copy()
            while len(cur):
                flat[at] = handle[cur]
                go = left > 0
                at, cur, left = at[go] - 1, c["parent"][cur[go]], left[go] - 1
            part = {k: v.slice(start, stop - start) for k, v in base.items()} | {"chain": _lists(flat, offsets)}
            yield from pa.table(part).to_batches()

    return run


def _next_level(with_path: bool, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        group = _groups(table)
        (handle, _), (top, _), (dist, _), (status, _) = (_column(table, k) for k in ("handle", "top", "dist", "status"))
        owner, has_owner = _column(table, "exit")
        settled = np.where(status == EXIT, -1, status)
        c = contract(group, handle, owner, has_owner, dist + 1, settled, shift)
        end = c["end"]
        leaving = c["status"] == EXIT
        base = {
            "path": table.column("path").combine_chunks(),
            "handle": pa.array(handle),
            "top": pa.array(top[end]),
            "dist": pa.array(c["dist"] + dist[end]),
            "status": pa.array(c["status"].astype(np.int32)),
            "exit": pa.array(owner[end], mask=~leaving),
        }
        if not with_path:
            for b in pa.table(base).to_batches(max_chunksize=100_000):
                yield b
            return
        col = table.column("chain").combine_chunks()
        off, vals = np.asarray(col.offsets), np.asarray(col.values)
        hops = np.where(c["loop"], 0, c["hops"])
        rows, size, first = [], 0, 0
        for i in range(len(handle)):
            parts, cur = [vals[off[i] : off[i + 1]]], i
            for _ in range(hops[i]):
                cur = c["parent"][cur]
                parts.append(vals[off[cur] : off[cur + 1]])
            rows.append(np.concatenate(parts[::-1]))
            size += len(rows[-1])
            if size >= CHUNK or i == len(handle) - 1:
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                part = {k: v.slice(first, len(rows)) for k, v in base.items()} | {"chain": _lists(np.concatenate(rows), offsets)}
                yield from pa.table(part).to_batches()
                rows, size, first = [], 0, i + 1

    return run


_CORE = "path string, handle bigint, top bigint, dist bigint, status int, exit bigint"


def _solve(chains: DataFrame, with_path: bool, shift: int) -> DataFrame:
    """Chains with exits turned into chains to the end."""
    open_ends = chains.filter(F.col("status") == EXIT)
    exits = open_ends.groupBy("path", F.col("exit").alias("handle")).agg(F.count("*").alias("n_below"))
    sizes = exits.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if not sizes["all"]:
        return chains
    shift = 63 if sizes["most"] <= WHOLE else min(63, shift + STEP)
    cols = ["path", "handle", "top", "dist", "status", "exit"] + ["chain"] * with_path
    quotient = exits.drop("n_below").join(chains.select(*cols), ["path", "handle"]).select(*cols)
    tasks = tasks_for(chains.sparkSession, sizes["all"], ROWS_PER_TASK)
    placed = quotient.repartition(tasks, F.col("path"), F.shiftright("handle", shift))
    solved = checkpoint(placed.mapInArrow(_next_level(with_path, shift), _CORE + ", chain array<bigint>" * with_path))
    solved = _solve(solved, with_path, shift).select("path", F.col("handle").alias("exit"), F.col("top").alias("_top"), F.col("dist").alias("_dist"), F.col("status").alias("_status"), *[F.col("chain").alias("_chain")] * with_path)
    # chains that end where they are need no partner, so the rows that meet are spread by their exits
    met = chains.filter(F.col("exit").isNotNull()).join(solved, ["path", "exit"], "left")
    # an exit that is no node makes the end of the chain a root
    out = (
        met.withColumn("dist", F.col("dist") + F.coalesce(F.col("_dist") + 1, F.lit(0)))
        .withColumn("top", F.coalesce("_top", "top"))
        .withColumn("status", F.coalesce("_status", F.lit(ROOT)))
    )
    if with_path:
        out = out.withColumn("chain", F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain")))
    out = out.withColumn("exit", F.lit(None).cast("long")).drop("_top", "_dist", "_status", "_chain")
    return out.unionByName(chains.filter(F.col("exit").isNull()))


def hierarchy(entities: DataFrame, with_path: bool = False, shift: int = SHIFT) -> DataFrame:
    """Place of each node in its tree.

    Input: path, handle, owner_handle, entity_id, depth, loaded_at; other
    columns are ignored. Output, a row per (path, handle): entity_id, path,
    handle, recorded_depth, in_cycle, depth, root_handle and, with_path,
    node_path (handles from the root to the node). in_cycle is true where the
    chain of owners reaches no root; depth, root_handle and node_path are null
    there. A null owner or one that has no row in the path makes a root. Rows
    with a null path or handle are nodes of no tree and are left out. Repeated
    deliveries count once, the last one. An empty table gives no rows.
    """
    spark = entities.sparkSession
    nodes = entities.filter("path is not null and handle is not null").select("path", "handle", "owner_handle", "entity_id", F.col("depth").cast("int").alias("depth"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("us"))
    tasks = tasks_for(spark, entities.count(), ROWS_PER_TASK)
    placed = nodes.repartition(tasks, F.col("path"), F.shiftright("handle", shift))
    schema = "path string, handle bigint, entity_id bigint, recorded_depth int, top bigint, dist bigint, status int, exit bigint" + ", chain array<bigint>" * with_path
    chains = checkpoint(placed.mapInArrow(_first_level(with_path, shift), schema))
    solved = _solve(chains, with_path, shift)
    bad = F.col("status") == CYCLE
    return solved.select(
        "entity_id", "path", "handle", "recorded_depth", bad.alias("in_cycle"),
        F.when(~bad, F.col("dist")).alias("depth"), F.when(~bad, F.col("top")).alias("root_handle"),
        *[F.when(~bad, F.col("chain")).alias("node_path")] * with_path,
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All (path, handle, descendant_handle, distance) of a `hierarchy(..., with_path=True)`: a row per pair, not a list per node."""
    size = F.size("node_path")
    return (
        tree.filter(~F.col("in_cycle") & (size > 1))
        .select("path", F.col("handle").alias("descendant_handle"), size.alias("n"), F.posexplode(F.slice("node_path", 1, size - 1)).alias("pos", "ancestor"))
        .select("path", F.col("ancestor").alias("handle"), "descendant_handle", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    )
