"""WARC archives as a Spark data source, and the writing of pages with revisit records.

Reading plans one partition per file, or per record-aligned part of a file where the writer left a manifest. Equality,
membership and prefix predicates on header columns are pushed down; a record's headers are parsed first, and the block
of a record that the predicates reject, or whose payload isn't asked for, is skipped by seeking, undecoded.

Writing makes one file per task under a name of its own; the manifest, written when all tasks are done, lists the files
that count, so a repeated or lost task leaves nothing that is read. Files are reached by pyarrow's file systems, so a
path may be in any store they know.

Digests are computed once into a narrow checkpointed table; which pages revisit is decided on it. The pages are then read
once more for writing, and learn by (page_id, digest) whether they revisit: without a shuffle where the revisits' size
allows sending them to every executor, by a join on these keys beyond that, of which none is hot.

Malformed input: what doesn't begin with a WARC version line, or has no usable Content-Length, is skipped up to the next
such line; a record that the end of its file cuts off is dropped, as is what a damaged gzip member leaves unreadable; a
revisit whose HTTP headers tell no usable length has the length of its block.

Defined results: a null html is an empty payload; of records with equal payloads that with the smallest id is the
response (several, if rows repeat that id; all of them, if every id is null) and the others are revisits; payloads
shorter than min_bytes are all responses; an empty table makes an archive without records.
"""

from __future__ import annotations

import gzip
import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import cut, join_small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns that come from headers, with the header each is read from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
WRITTEN = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
MANIFEST = "_manifest.json"
#: Bytes of a file that one task reads, and of payloads that are held before a batch goes on.
SPLIT, HELD = 64 << 20, 8 << 20


def opened(path: str):
    """File system and plain path of a URI; Hadoop writes file:/x for file:///x."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: Longest header line; longer ones come in pieces, of which the first holds the name.
LINE = 1 << 16


def number(value: str | None) -> int | None:
    """A header's length, None where it is missing or not a count."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 16 else None


def header_block(stream, opening: bytes = b"") -> dict[str, str] | None:
    """The lines up to the next empty one as lower-case names and values; None where the file ends before that.

    Lines before the first that starts with `opening` are skipped.
    """
    line = stream.readline(LINE)
    while line and (line in (b"\r\n", b"\n") or not line.startswith(opening)):
        line = stream.readline(LINE)
    if not line:
        return None
    found = {"": line.strip().decode("utf-8", "replace")}
    name = ""
    while (line := stream.readline(LINE)) not in (b"\r\n", b"\n"):
        if not line:
            return None
        if line[:1] in b" \t" and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Buffered:
    """readline, read and skip over a seekable or a decompressed stream."""

    def __init__(self, raw, seekable: bool):
        import io

        self.raw, self.seekable = raw, seekable
        self.file = io.BufferedReader(raw, 1 << 18) if seekable else raw
        self.readline, self.read, self.tell = self.file.readline, self.file.read, self.file.tell

    def skip(self, n: int, size: int) -> bool:
        """Skips n bytes; False where the file, of `size` bytes if seekable, ends before that."""
        if self.seekable:
            return self.file.seek(n, 1) <= size
        while n > 0 and (got := len(self.file.read(min(n, 1 << 20)))):
            n -= got
        return n == 0


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, top = opened(self.path)
        if fs.get_file_info(f"{top}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{top}/{MANIFEST}") as f:
                files = json.loads(f.read())["files"]
            return [Part(f"{top}/{x['name']}", a, b) for x in files for a, b in zip(x["splits"], [*x["splits"][1:], x["bytes"]], strict=True)] or [Part("", 0, 0)]
        info = fs.get_file_info(top)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(top, recursive=True))
        return [Part(x.path, 0, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))] or [Part("", 0, 0)]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in v if how == "in" else row[c].startswith(v[0])) for c, how, v in self.tests)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        size = fs.get_file_info(partition.path).size
        with fs.open_input_file(partition.path) as raw:
            raw.seek(partition.start)
            rows, held = [], 0
            for row in self.records(raw, partition, size):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > HELD:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    def records(self, raw, partition: Part, size: int) -> Iterator[dict]:
        """The wanted records that begin in the partition and are whole."""
        packed = partition.path.endswith(".gz")
        stream = Buffered(gzip.GzipFile(fileobj=raw) if packed else raw, not packed)
        try:
            while (packed or stream.tell() < partition.end) and (head := header_block(stream, b"WARC/")) is not None:
                length = number(head.get("content-length"))
                if length is None:
                    continue
                row = {c: head.get(h) for c, h in HEADERS.items()}
                if not self.wanted(row):
                    stream.skip(length, size)
                elif (found := self.block(stream, head, length, size)) is not None:
                    yield row | found
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return

    def block(self, stream, head: dict, length: int, size: int) -> dict | None:
        """What the block holds: payload and its length. HTTP headers are parsed, the payload is skipped unless asked for."""
        body, told = length, None
        if head.get("content-type", "").startswith("application/http"):
            at = stream.tell()
            http = header_block(stream)
            body = length - (stream.tell() - at)
            if http is None or body < 0:  # no HTTP headers, or they don't end inside the block
                return None
            # A revisit has no payload of its own; its HTTP headers tell the length.
            told = number(http.get("content-length")) if head.get("warc-type") == "revisit" else None
        told = body if told is None else told
        if self.payload and head.get("warc-type") != "revisit":
            payload = stream.read(body)
            return {"payload_bytes": told, "payload": payload} if len(payload) == body else None
        return {"payload_bytes": told, "payload": None} if stream.skip(body, size) else None

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        types = {**{c: pa.string() for c in HEADERS}, "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))


@dataclass
class Written(WriterCommitMessage):
    name: str
    bytes: int
    splits: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    @staticmethod
    def record(row: dict, date: str) -> tuple[bytes, bytes, bytes]:
        """WARC headers, HTTP headers and payload of a row."""
        revisit = row["record_type"] == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        payload = b"" if revisit else row["payload"]
        clean = "".join(c for c in row["url"] or "" if c >= " ")
        lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
        if revisit:
            lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
        return ("\r\n".join(lines) + "\r\n\r\n").encode(), http, payload

    def write(self, iterator) -> Written:
        fs, top = opened(self.path)
        fs.create_dir(top, recursive=True)
        name, size, splits = f"part-{uuid.uuid4().hex}.warc", 0, [0]
        with fs.open_output_stream(f"{top}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    if size - splits[-1] >= SPLIT:
                        splits.append(size)
                    for piece in (*self.record(row, self.date), b"\r\n\r\n"):
                        size += len(piece)
                        out.write(piece)
        return Written(name, size, splits)

    def commit(self, messages) -> None:
        fs, top = opened(self.path)
        fs.create_dir(top, recursive=True)
        files = [{"name": m.name, "bytes": m.bytes, "splits": m.splits} for m in messages if m is not None and m.bytes]
        with fs.open_output_stream(f"{top}/{MANIFEST}") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        fs, top = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{top}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options)


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits as eight groups of twenty, each four digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row to write per page. Only digests are grouped."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    made = made.withColumn("payload_digest", sha1_base32(F.col("payload"))).withColumn("payload_bytes", F.length("payload").cast("long"))
    digests = cut(made.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"))
    first = digests.groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    again = join_small(digests, first, ["payload_digest"]).filter("__first is not null and not page_id <=> __first")
    # A null id is keyed as such; rows that repeat an id and a payload revisit together.
    key = [F.col("page_id").isNull().alias("__none"), F.coalesce("page_id", F.lit(0)).alias("__id"), "payload_digest"]
    again = cut(again.select(*key, "__first").distinct())
    known = join_small(made.select("*", *key[:2]), again, ["__none", "__id", "payload_digest"], "left")
    revisit = F.col("__first").isNotNull()
    return known.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("__first").alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages, min_bytes).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of an archive; with payload=False the payload column is null and no payload is read.

    Spark pushes filters down to Python sources only under a session setting, which this turns on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
