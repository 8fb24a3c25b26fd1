"""Inventory of files with size and SHA-256, hashed in chunks: a Python data source, large files alone in their partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import ship

#: Bytes that are read at a time, and bytes of files that one partition hashes, unless one file alone has more.
CHUNK, PARTITION = 8 << 20, 256 << 20
#: Files that one partition hashes at most.
FILES = 5000
SCHEMA = "path string, name string, bytes long, sha256 string"


def opened(path: str):
    """File system and plain path of a URI; Hadoop writes file:/x for file:///x."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(stream, chunk: int = CHUNK) -> tuple[int, str]:
    """Bytes and SHA-256 of a stream; only one chunk is held."""
    size, state = 0, hashlib.sha256()
    while block := stream.read(chunk):
        size += len(block)
        state.update(block)
    return size, state.hexdigest()


@dataclass
class Files(InputPartition):
    paths: list[str]


def grouped(files: list[tuple[str, int]]) -> list[Files]:
    """Files, largest first, in partitions of about PARTITION bytes and at most FILES files."""
    parts, held = [], 0
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if not parts or held + size > PARTITION or len(parts[-1].paths) == FILES:
            parts.append(Files([]))
            held = 0
        parts[-1].paths.append(path)
        held += size
    return parts or [Files([])]


class InventoryReader(DataSourceReader):
    """Files below a path or the path itself; `glob` on names is applied before anything is read."""

    def __init__(self, options):
        self.path, self.chunk, self.glob = options["path"], int(options.get("chunkBytes", CHUNK)), options.get("glob", "*")

    def partitions(self) -> list[Files]:
        from pyarrow import fs as pafs

        fs, top = opened(self.path)
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(top, recursive=True))
        hidden = lambda x: any(p[:1] in "._" for p in x.path[len(top) :].strip("/").split("/") if p)
        files = [x for x in found if x.type == pafs.FileType.File and not hidden(x)]
        return grouped([(x.path, x.size) for x in files if fnmatchcase(x.base_name, self.glob)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path) as stream:
                size, sha = digest(stream, self.chunk)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path.rsplit("/", 1)[-1]]), pa.array([size], pa.int64()), pa.array([sha])], ["path", "name", "bytes", "sha256"])


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options)


def read_file_inventory(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """path, name, bytes and sha256 of every file below a path, or of one file; what begins with `.` or `_` is left out.

    A file is read in chunks with the state of its hash carried over, so its size doesn't matter; files whose name doesn't
    match `glob` are not read. A path that isn't there raises.
    """
    ship(spark.sparkContext)
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").option("path", path).option("glob", glob).option("chunkBytes", str(chunk)).load()


def inventory_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem) of files against manifest(name, bytes, sha256): missing, unlisted, repeated, size or hash."""
    have = found.groupBy("name").agg(F.count("*").alias("copies"), F.min("bytes").alias("found_bytes"), F.min("sha256").alias("found_sha256"))
    both = manifest.select("name", "bytes", F.lower("sha256").alias("sha256"), F.lit(True).alias("listed")).join(have, "name", "full_outer")
    problem = (
        F.when(F.col("copies").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("copies") > 1, "repeated")
        .when(~F.col("bytes").eqNullSafe(F.col("found_bytes")), "size").when(~F.col("sha256").eqNullSafe(F.col("found_sha256")), "hash")
    )
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")
