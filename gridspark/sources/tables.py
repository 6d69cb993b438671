"""Declared tables: contracted reads, manifests, feature pages, and writes that refuse before they commit."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.contracts import raise_if_any, refuse, require, require_matching
from gridspark.functions import cells
from gridspark.operators.ordered import match
from gridspark.sources.grid import grid_cells, grid_edges


def read_contracted(spark: SparkSession, path: str, column: str, expected: dict) -> DataFrame:
    """Open a table only where its column carries every required attribute with the expected value."""
    df = spark.read.parquet(path)
    require(column in df.columns, column, "read_contracted", f"{path} holds no such column")
    require_matching(df, column, expected, "read_contracted")
    return df


WHOLE = 32 << 20  # a file up to this long is one value; a longer one is hashed as it is read
# Names that tell a text reader to unpack a file: these are hashed as one value whatever their length.
PACKED = r"\.(gz|bz2|deflate|lz4|lzo|snappy|zst|zstd)$"
MARK = b"\xef\xbb\xbf"  # a text reader leaves this out where a file begins with it


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, sha256) of files that come one after another as (path, bytes, line and its end) in order.

    The last line of a file may have no end, and a mark in front of the first is not among the lines: the length tells both.
    """
    path = size = plain = marked = None
    read = 0

    def closed() -> pa.RecordBatch:
        for digest, lacking in ((plain, 0), (marked, len(MARK))):
            if read + lacking in (size, size + 1):
                if read + lacking == size:
                    digest.update(b"\n")
                return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})
        raise ValueError(f"{path}: {read} bytes read of {size}")

    for batch in batches:
        # of a run of rows of one file, the lines lie side by side in memory
        runs = pc.run_end_encode(batch.column(0), run_end_type=pa.int32())
        _, at, raw = (memoryview(b) if b else b"" for b in batch.column(2).buffers())
        at = np.frombuffer(at, "int64" if pa.types.is_large_binary(batch.column(2).type) else "int32")[batch.column(2).offset :]
        first = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != path:
                if path is not None:
                    yield closed()
                path, size, read = name, batch.column(1)[first].as_py(), 0
                plain, marked = hashlib.sha256(), hashlib.sha256(MARK)
            else:
                plain.update(b"\n")
                marked.update(b"\n")
            # all but the end of the last line, which may not be in the file
            held = raw[at[first] : at[end] - 1]
            plain.update(held)
            marked.update(held)
            read += len(held) + 1
            first = end
    if path is not None:
        yield closed()


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files under a folder; paths count from the folder.

    Files are hashed beside each other, one in one task, which the digest's definition asks for. Long ones are read
    as lines, never split, so no file is held whole.
    """

    def files(source: str, session: SparkSession) -> DataFrame:
        return session.read.format(source).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")

    here = files("binaryFile", spark).load(folder)
    # of the names and lengths in the listing, so a file that is left out is not opened
    long = (F.col("_metadata.file_size") > WHOLE) & ~F.col("_metadata.file_name").rlike(PACKED)
    root = "/" + re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", folder).strip("/") + "/"
    name = F.expr(f"substring(path, locate('{root}', path) + {len(root)})")
    found = here.filter(~long).select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    longest = here.filter(long).agg(F.max("length")).first()[0]
    if longest is None:
        return found
    unsplit = spark.newSession()  # of its settings only these differ, and only for this scan
    unsplit.conf.set("spark.sql.files.maxPartitionBytes", str(longest))
    unsplit.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = files("text", unsplit).option("lineSep", "\n").load(folder).filter(long).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    hashed = lines.mapInArrow(_hash_files, "path string, bytes bigint, sha256 string")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # this reader names files as URLs
    return found.unionByName(hashed.withColumn("path", plain).select(name.alias("path"), "bytes", "sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): ok, absent, extra, or which of bytes and sha256 differs."""
    m = manifest.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    both = found.join(m, "path", "full")
    status = (
        F.when(F.col("bytes").isNull(), "absent").when(F.col("_b").isNull(), "extra")
        .when(F.col("bytes") != F.col("_b"), "bytes differ").when(F.col("sha256") != F.col("_s"), "sha256 differs").otherwise("ok"))
    return both.select("path", status.alias("status"))


def table_of(path: str = "path") -> Column:
    """The table a file belongs to: the first part of its path, which is a file or a folder of them."""
    return F.substring_index(F.col(path), "/", 1)


def table_statuses(statuses: DataFrame) -> DataFrame:
    """(path, status) of whole tables from those of their files: ok where every file is, else the first that any file has of
    absent, extra, bytes differ and sha256 differs."""
    worst = F.array(*[F.lit(x) for x in ("absent", "extra", "bytes differ", "sha256 differs", "ok")])
    at = statuses.groupBy(table_of().alias("path")).agg(F.min(F.array_position(worst, F.col("status"))).alias("_at"))
    return at.select("path", F.element_at(worst, F.col("_at").cast("int")).alias("status"))


FEATURE_SCHEMA = (
    "features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<id: string, "
    "monitoring_location_id: string, value: string, unit_of_measure: string, time: string, qualifier: array<string>, "
    "approval_status: string, altitude: string, state_name: string>>>"
)


def read_feature_pages(spark: SparkSession, path: str, indented: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sites, measurements) from paged GeoJSON; gzip pages are read as they are.

    `indented` reads one document per file; otherwise each line is a page.
    """
    pages = spark.read.schema(FEATURE_SCHEMA).json(path, multiLine=indented)
    f = pages.select(F.explode("features").alias("f")).select("f.geometry", "f.properties.*")
    sites = f.filter("id IS NOT NULL").select("id", F.get("geometry.coordinates", 0).alias("lon"), F.get("geometry.coordinates", 1).alias("lat"),
                                              "state_name", "altitude")
    readings = f.filter("monitoring_location_id IS NOT NULL").select(
        F.col("monitoring_location_id").alias("site"), "value", F.col("unit_of_measure").alias("unit"), "time", "qualifier", "approval_status")
    return sites, readings


# Sinks


def content_key(inputs: dict) -> str:
    """The key of a dataset: digest of everything it is made from, names in order."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


MANIFEST_SCHEMA = "key string, inputs string, path string"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file only where none of that name is; False where another writer was first.

    The file system decides, so of two writers one wins: create without overwrite is atomic on HDFS and on
    local disks, and on object stores whose connector has conditional writes. A writer that dies while it writes
    this one file leaves it empty: readers pass over it, and its name stays taken until it is deleted.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    try:
        out = fs.create(target, False)
    except Exception:
        if fs.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(key, inputs, path) of the datasets committed under a root: one small file each."""
    create_once(spark, f"{root}/manifest/_log", "")
    lines = spark.read.text(f"{root}/manifest", pathGlobFilter="*.json")
    return lines.select(F.from_json("value", MANIFEST_SCHEMA).alias("r")).filter("r.key IS NOT NULL").select("r.*")


def put_dataset(df: DataFrame, root: str, inputs: dict, ledger: DataFrame | None = None) -> str:
    """Write under a content-derived key and commit it last.

    Each attempt writes a folder of its own; the commit creates the key's file in the manifest, which only one
    attempt can. A write that dies, or loses to another of the same key, leaves a folder that no reader
    sees and never touches the data of the one that won. A table whose ledger is open is refused before
    anything is written.
    """
    spark, key = df.sparkSession, content_key(inputs)
    if ledger is not None:
        raise_if_any(ledger.filter(~F.col("closed")), "ledger", "put_dataset")
    if not read_manifest(spark, root).filter(F.col("key") == key).isEmpty():
        refuse(key, "put_dataset", "a dataset of this key is recorded already")
    path = f"{root}/data/{key}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    row = json.dumps({"key": key, "inputs": json.dumps(inputs, sort_keys=True), "path": path})
    if not create_once(spark, f"{root}/manifest/{key}.json", row):
        refuse(key, "put_dataset", "a dataset of this key was recorded while this one was written")
    return path


def put_geometry(spark: SparkSession, root: str, level: int, support_id: str) -> str:
    """Cell and edge geometry of a level, stored once per support. Its rows are made in runs of ids, so they are not dealt out again."""
    for name, df in (("cells", grid_cells(spark, level)), ("edges", grid_edges(spark, level, lengths=True))):
        tagged = df.withColumn("support_id", F.lit(support_id))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("support_id").parquet(f"{root}/{name}")
    return root


def clustered_write(df: DataFrame, path: str, depth: int, partitions: int | None = None) -> None:
    """Rows of one coarse ancestor stay together, so row groups can be skipped by chunk and by cell."""
    placed = df.withColumn("chunk", cells.ancestor(F.col("cell"), depth))
    ranged = placed.repartitionByRange(partitions, "chunk", "cell") if partitions else placed.repartitionByRange("chunk", "cell")
    ranged.sortWithinPartitions("chunk", "cell").write.mode("overwrite").parquet(path)


EXPORTED = ("area", "lat", "lon", "ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")


def export_with_geometry(df: DataFrame, level: int, units: dict[str, str] | None = None) -> DataFrame:
    """A field beside its cells' area, latitude, longitude and corners, units kept as column metadata."""
    geometry = grid_cells(df.sparkSession, level).select("cell", *EXPORTED)
    out = df.join(geometry, "cell")
    for column, unit in (units or {}).items():
        out = out.withMetadata(column, {"units": unit, "location": "face"})
    return out


def write_with_geometry(df: DataFrame, level: int, path: str, units: dict[str, str], support_id: str, radius: float = 1.0) -> None:
    """Write a field of (cell, values...) with its cells' geometry, ordered by cell.

    Every column carries its attributes in the schema: units and place of the fields, units of the geometry, and on
    `cell` the support, level and radius. Refused where a field has a geometry column's name, a cell is not of
    the level, a cell comes twice, or something is at the path already.
    """
    site = "write_with_geometry"
    fields = [c for c in df.columns if c != "cell"]
    require("cell" in df.columns and bool(fields), "cell", site, "the table is not (cell, values...)")
    for name in fields:
        require(name not in EXPORTED, name, site, "is a geometry variable of the file")
    require(set(units) <= set(fields), "units", site, "name a column that is not there")
    last = 20 * 4**level
    raise_if_any(df.filter(~F.coalesce(F.col("cell").between(1, last), F.lit(False))).select("cell"), "support", site)
    raise_if_any(df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "support", site)
    out = export_with_geometry(df, level, {c: units.get(c, "1") for c in fields})
    fixed = {"area": "m2", "lat": "radians", "lon": "radians"}
    for name in EXPORTED:
        out = out.withMetadata(name, {"units": fixed.get(name, "1")})
    out = out.withColumns({"area": F.col("area") * radius**2}).withMetadata("area", {"units": "m2"}) if radius != 1.0 else out
    out = out.withMetadata("cell", {"support_id": support_id, "level": level, "radius": radius})
    out.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("errorifexists").parquet(path)


def written_files(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Range of a column in each file of a table: what a reader can skip by."""
    df = spark.read.parquet(path)
    return df.groupBy(F.input_file_name().alias("file")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("rows"))
