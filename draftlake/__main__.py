"""Drawings from the command line: python -m draftlake COMMAND PATH [...].

    info PATH                 header fields and sections of each file, a JSON text a line
    dump PATH                 kinds with their counts, and the ends of the handle index
    corpus PATH               files and bytes by version, with a total
    coverage PATH             decoded, unhandled and failed records by kind and version
    verify PATH               sections that unpack and that don't
    extract PATH NAME FOLDER  one section of each file, as a file below FOLDER
    to-dxf PATH FOLDER        tagged text, a folder per drawing
    to-gltf PATH FOLDER       binary scenes, a file per drawing
    dots PATH FOLDER          a page with a dot per object, a folder per drawing

PATH is a file or a folder, local or in an object store that the cluster reads;
FOLDER is one that all executors share.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import records
from draftlake.operators import relational as R
from draftlake.plans import exports as X
from draftlake.plans.drawings import _versions
from draftlake.runtime import checkpoint
from draftlake.sinks import dxf, gltf, svg
from draftlake.sources import drawing

COMMANDS = ("info", "dump", "corpus", "coverage", "verify", "extract", "to-dxf", "to-gltf", "dots")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object decoded once: path, seq (its handle), kind, status, record, version."""
    table = lambda name: drawing.read(spark, path, name)
    rows = table("raw_objects").filter("raw is not null").join(_versions(table("files")).select("path", "version"), "path")
    typed = records.with_kinds(rows, table("classes")).select("path", F.col("handle.value").alias("seq"), "type_name", "version", "raw", "body_bit")
    return records.decode_all(typed).withColumnRenamed("type_name", "kind")


def save(rows: DataFrame, data: str, suffix: str, folder: str) -> DataFrame:
    """A file for each row (path, data), named by the whole path of its drawing, and the names that were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [p.removeprefix("file:").strip("/").replace("/", "__") + suffix for p in batch.column("path").to_pylist()]
            for name, content in zip(names, batch.column(data).to_pylist()):
                # a repeated task writes the same file again, and readers never see half of one
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    os.makedirs(folder, exist_ok=True)
    return rows.select("path", data).mapInArrow(run, "name string")


def run(spark: SparkSession, command: str, path: str, rest: list[str]) -> DataFrame:
    """The rows that a command shows; what it writes is written."""
    table = lambda name: drawing.read(spark, path, name)
    if command == "info":
        sections = table("sections").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "size"))).alias("sections"))
        return table("files").join(sections, "path", "left").select(F.to_json(F.struct("*")).alias("info"))
    if command == "dump":
        kinds = R.histogram(objects(spark, path), "kind").select("kind", F.col("n").cast("string").alias("value"))
        ends = R.head_and_tail(table("handle_map"), ["path"], ["seq"]).select(F.concat(F.lit("handle "), F.col("seq").cast("string")).alias("kind"), F.hex("handle").alias("value"))
        return kinds.unionByName(ends).orderBy("kind")
    if command == "corpus":
        return R.totals(table("files"), "version", ["length"]).orderBy("version")
    if command == "coverage":
        return R.coverage(objects(spark, path), ["kind", "version"]).orderBy("kind", "version")
    if command == "verify":
        return table("payloads").groupBy("name").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed")).orderBy("name")
    if command == "extract":
        name, folder = rest
        return save(table("payloads").filter((F.col("name") == name) & F.col("payload").isNotNull()), "payload", "." + name.replace(":", "_"), folder)
    (folder,) = rest
    if command == "dots":
        from pyspark.sql import Window

        rows = table("raw_objects").filter("status = 'ok'").select("path", F.row_number().over(Window.partitionBy("path").orderBy("stream_offset")).alias("n"), F.col("handle.value").alias("handle"))
        svg.write(svg.document(svg.dots(rows.withColumn("n", F.col("n") - 1)).select("path", F.lit("objects").alias("layer"), F.col("n").alias("seq"), "fragment"), 800, 600), folder)
        return rows.groupBy("path").count()
    rows, rec = X.with_records(objects(spark, path))
    rows = checkpoint(rows)
    if command == "to-dxf":
        lines = X.document_rows(rows, rec)
        dxf.write(lines, folder)
        return lines.groupBy("path").count()
    return save(gltf.documents(gltf.entity_meshes(rows, rec), dict([gltf.layer_material(7)])), "glb", ".glb", folder)


def main() -> None:
    parser = argparse.ArgumentParser(prog="draftlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("path")
    parser.add_argument("rest", nargs="*")
    a = parser.parse_args()
    wanted = {"extract": 2, "to-dxf": 1, "to-gltf": 1, "dots": 1}.get(a.command, 0)
    if len(a.rest) != wanted:
        parser.error(f"{a.command} takes {wanted} more")
    spark = SparkSession.builder.appName("draftlake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for row in run(spark, a.command, a.path, a.rest).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    spark.stop()


if __name__ == "__main__":
    main()
