"""Sinks: idempotent release loads, bounded deterministic results, fingerprints, quality rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F


def staged(df: DataFrame, measures: Mapping[str, Column], check: Callable[[dict], None], write: Callable[[DataFrame], None]) -> dict:
    """Writes df to where nobody looks yet, with `measures` observed in the same pass, and raises as `check` says.

    Whoever calls it publishes what was written after it has returned; a failed check or write leaves nothing published.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    check(seen.get)
    return seen.get


def replace_release(df: DataFrame, path: str, key: str = "source_release_id", measures: Mapping[str, Column] | None = None, check: Callable[[dict], None] | None = None) -> int:
    """Replaces the releases that df holds and leaves all others as they are, in one step; returns the version.

    Rows go to a folder of this load. A new version of the manifest, one small file that says which load each release is
    read from, publishes it. A load that fails half-way, or whose measures don't pass the check, is in no version, and a
    reader sees either all old or all new releases. Versions aren't overwritten: of two loads at the same time one raises.
    """
    spark, load = df.sparkSession, uuid.uuid4().hex
    folder = f"{path}/loads/load={load}"
    none = F.count_if(F.col(key).isNull())

    def allowed(seen: dict) -> None:
        if seen["__none"]:
            raise ValueError(f"{seen['__none']} rows have no {key}")
        if check is not None:
            check({k: v for k, v in seen.items() if k != "__none"})

    staged(df, {"__none": none, **(measures or {})}, allowed, lambda rows: rows.write.partitionBy(key).parquet(folder))
    old = manifest(spark, path)
    # Partition values as texts, as they stand in the folders' names.
    new = spark.read.option("basePath", f"{path}/loads").schema(f"{key} string, load string").parquet(folder).select(F.col(key).alias("release"), "load").distinct()
    last = 0 if old is None else old.agg(F.max("version")).first()[0]
    if new.isEmpty():  # nothing is replaced
        return last
    version = last + 1
    both = new if old is None else new.unionByName(old.join(new, "release", "left_anti").select("release", "load"))
    both.coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/version={version}")
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(version, release, load) of a version of the releases under a path, the latest if none is stated; None before the first load."""
    try:
        versions = spark.read.schema("release string, load string, version long").json(f"{path}/manifests")
        last = versions.agg(F.max("version")).first()[0]
    except AnalysisException:  # no manifest yet
        return None
    return None if last is None else versions.filter(F.col("version") == (last if version is None else version))


def read_releases(spark: SparkSession, path: str, key: str = "source_release_id", version: int | None = None) -> DataFrame:
    """The rows of all releases in a version, the latest if none is stated; the list of releases is short."""
    listed = manifest(spark, path, version)
    if listed is None:
        raise ValueError(f"no release has been loaded to {path}")
    folders = [f"{path}/loads/load={r.load}/{key}={r.release}" for r in listed.select("load", "release").collect()]
    return spark.read.option("basePath", f"{path}/loads").parquet(*folders).drop("load")


def write_bounded_csv(df: DataFrame, path: str, order: Sequence[str], most: int, most_bytes: int | None = None) -> int:
    """Writes at most `most` rows, of at most `most_bytes` as CSV text, in order and never over an existing result.

    One evaluation of df: at most one row more than allowed is taken, sorted and written aside, counted on the way, and
    moved to `path` if it keeps the caps; else it raises and there is no result.
    """
    size = F.octet_length(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 1
    head = len(",".join(df.columns).encode()) + 1

    def within(seen: dict) -> None:
        if seen["n"] > most:
            raise ValueError(f"the result exceeds its cap of {most} rows")
        if most_bytes is not None and seen["length"] + head > most_bytes:
            raise ValueError(f"the result exceeds its cap of {most_bytes} bytes")

    some = df.limit(most + 1).coalesce(1)
    return _published(some, path, {"n": F.count("*"), "length": F.coalesce(F.sum(size), F.lit(0))}, within, lambda rows: rows.sortWithinPartitions(*order).write.option("header", True))["n"]


def write_csv_parts(df: DataFrame, path: str, order: Sequence[str], most: int) -> int:
    """Writes all rows in order as CSV files of at most `most` rows each, never over an existing result; returns the rows.

    For results that may outgrow one bounded file: ranges of the order are written by as many tasks, files follow each
    other in the order of their names, and all appear at once.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _published(dealt, path, {"n": F.count("*")}, lambda seen: None, lambda rows: rows.write.option("header", True).option("maxRecordsPerFile", most))["n"]


def _published(df: DataFrame, path: str, measures: Mapping[str, Column], check: Callable[[dict], None], writer: Callable[[DataFrame], DataFrameWriter]) -> dict:
    """df written aside as CSV, and moved to `path` once the measures seen on the way pass; raises if there is a result."""
    spark = df.sparkSession
    target, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} already exists")
    try:
        seen = staged(df, measures, check, lambda rows: writer(rows).csv(aside.toString()))
        if not fs.rename(aside, target):
            raise ValueError(f"{path} already exists")
    finally:
        fs.delete(aside, True)
    return seen


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a content hash that does not depend on the order of rows or columns.

    Values are written with their length, nulls with a mark of their own, so that no two rows share a text; the hash adds
    the first 60 bits of each row's digest.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    marked = F.concat(*[F.when(text(c).isNull(), "n;").otherwise(F.concat(F.lit("v"), F.length(text(c)).cast("string"), F.lit(":"), text(c))) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(marked), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content_hash"))


def write_quality_results(profile: DataFrame, path: str, run_id: int, warn: Sequence[str] = (), info: Sequence[str] = ("rows",)) -> None:
    """Appends (check, observed, status) rows of a run: what is zero or informational passes, the rest warns or fails."""
    status = F.when(F.col("check").isin(list(info)) | (F.col("observed") == 0), "pass").when(F.col("check").isin(list(warn)), "warn").otherwise("fail")
    profile.select("check", "observed", status.alias("status"), F.lit(run_id).cast("long").alias("ingestion_run_id")).write.mode("append").parquet(path)
