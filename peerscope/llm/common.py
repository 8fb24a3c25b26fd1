"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 agree on this class: everything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes up to which a derived side table is small enough to send to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def body(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text is divisible by five; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a local one only on a local master with none set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a derived table: broadcast where it is within BROADCAST_ROWS and BROADCAST_BYTES, shuffled beyond that.

    The result is the same either way. Bytes are those of strings, binaries and lists of strings, plus 16 for every column
    of a row.
    """
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema if f.dataType.typeName() in ("string", "binary")]
    wide += [F.coalesce(F.octet_length(F.array_join(f.name, "")) + 16 * F.size(f.name), F.lit(0)) for f in small.schema if f.dataType.simpleString() == "array<string>"]
    size = sum(wide, F.lit(16 * len(small.columns)))
    n, total = small.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else small.hint("merge"), on, how)


_shipped: set[str] = set()


def ship(sc: SparkContext) -> None:
    """Sends this package to the Python workers, once an application, so that they can import it wherever they run."""
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{top.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(made))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package at hand in the workers."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(function, schema)
