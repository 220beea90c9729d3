"""Files, archives and containers as blobs.

``binaryFile`` lists and reads; path filters run before the content is read.
Unpacking needs the bytes of one file at a time and runs in Arrow batches.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import ingest, scope


@dataclass(frozen=True)
class Limits:
    """Bounds of what is opened; what exceeds them becomes an error row, never silence."""

    file_bytes: int = 512 << 20
    member_bytes: int = 64 << 20
    depth: int = 3
    members: int = 5000
    expansion: int = 200
    piece_bytes: int = 4 << 20
    overlap_lines: int = 64


def _dotted(spark: SparkSession, path: str) -> DataFrame:
    """Files Spark's own listing leaves out: those that begin with a dot or an underscore or lie in such a folder.

    Names come from the shared file system's listing; contents are read by the tasks, when asked for."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    start = fs.makeQualified(root).toString().rstrip("/")
    rows, listed = [], fs.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().toString()
        if any(part[:1] in (".", "_") for part in name[len(start):].split("/") if part):
            rows.append((name, status.getModificationTime() / 1000.0, status.getLen()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        for batch in batches:
            for row in range(batch.num_rows):
                uri = batch.column(0)[row].as_py()
                if uri.startswith("file:"):
                    with open(uri.removeprefix("file://").removeprefix("file:"), "rb") as file:
                        body = file.read()
                else:
                    system, inner = arrow_fs.FileSystem.from_uri(uri)
                    with system.open_input_stream(inner) as file:
                        body = file.read()
                one = batch.slice(row, 1)
                yield pa.record_batch([*one.columns, pa.array([body], pa.binary())], names=["path", "modificationTime", "length", "content"])

    frame = spark.createDataFrame(rows, "path string, at double, length bigint").select("path", F.timestamp_seconds("at").alias("modificationTime"), "length")
    return frame.mapInArrow(read, "path string, modificationTime timestamp, length bigint, content binary")


def walk(spark: SparkSession, path: str, include: Sequence[str] = (), exclude: Sequence[str] = (), only: Sequence[str] | None = None, scope_only: bool = False, all_folders: bool = False, hidden: bool = True) -> DataFrame:
    """Files under a path: path, modificationTime, length, content (not read unless selected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if hidden:
        files = files.unionByName(_dotted(spark, path))
    keep = scope.allowed(F.col("path"), include, exclude, only, scope_only)
    if not all_folders:
        keep = keep & ~scope.denied_folder(F.col("path"))
    if not hidden:
        keep = keep & ~F.col("path").rlike(r"/\.[^/]")
    return files.where(keep & (F.col("length") > 0))


def readable(files: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(files within the limit, errors(source_path, message)); the split is by length alone, so no content is read for it."""
    return files.where(F.col("length") <= limits.file_bytes), files.where(F.col("length") > limits.file_bytes).select(F.col("path").alias("source_path"), F.lit("file too large").alias("message"))


def _members(data: bytes, kind: str, name: str, limits: Limits) -> Iterator[tuple[str, bytes | None, str]]:
    """(member name, bytes, error) of one container."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as box:
            for info in box.infolist():
                if info.is_dir():
                    continue
                if info.file_size > limits.member_bytes:
                    yield info.filename, None, "member too large"
                elif info.file_size > limits.expansion * max(1, info.compress_size):
                    yield info.filename, None, "expands too much"
                else:
                    yield info.filename, box.read(info), ""
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as box:
            for info in box:
                if info.isfile():
                    if info.size > limits.member_bytes:
                        yield info.name, None, "member too large"
                    else:
                        yield info.name, box.extractfile(info).read(), ""
    elif kind in ("gzip", "bzip2", "xz"):
        opener = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[kind]
        with opener(io.BytesIO(data)) as stream:
            body = stream.read(limits.member_bytes + 1)
        if len(body) > limits.member_bytes or len(body) > limits.expansion * max(1, len(data)):
            yield name, None, "expands too much"
            return
        base = name.rsplit("/", 1)[-1]
        for suffix in (".gz", ".tgz", ".bz2", ".tbz2", ".xz", ".txz"):
            if base.lower().endswith(suffix):
                base = base[:-len(suffix)] + (".tar" if suffix[1] == "t" else "")
        yield base or "data", body, ""
    else:
        yield name, None, f"no reader for {kind}"


def _kind(data: bytes) -> str:
    for kind, magic in ingest.MAGIC:
        if data.startswith(bytes.fromhex(magic)):
            return kind
    return "tar" if data[257:262] == b"ustar" else ""


def unpack(data: bytes, path: str, limits: Limits = Limits(), depth: int = 0) -> Iterator[tuple[str, bytes | None, int, str]]:
    """(logical path, bytes, depth, error) of the leaves of a file; a plain file is its own leaf.

    Depth, members per container, member size and expansion are bounded; what is
    over a bound comes as an error."""
    kind = _kind(data)
    if not kind:
        yield path, data, depth, ""
        return
    if depth >= limits.depth:
        yield path, None, depth, "containers too deep"
        return
    try:
        for n, (member, body, error) in enumerate(_members(data, kind, path, limits)):
            parts = [p for p in member.replace("\\", "/").split("/") if p not in ("", ".", "..")]
            inner = f"{path}!/{'/'.join(parts)}"
            if n >= limits.members:
                yield inner, None, depth + 1, "too many members"
                return
            if body is None:
                yield inner, None, depth + 1, error
            elif body:
                yield from unpack(body, inner, limits, depth + 1)
    except Exception as error:  # noqa: BLE001 - a broken container is an error row
        yield path, None, depth, f"{kind}: {type(error).__name__}"


_UNPACKED = pa.schema([("logical_path", pa.string()), ("source_path", pa.string()), ("content", pa.binary()), ("container_depth", pa.int32()), ("message", pa.string())])


def unpacked(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Leaves of ``files(path, content)``: logical_path (outer!/inner), source_path, content, container_depth, message.

    Rows with a message are errors and have no content.  Null paths or contents give nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for logical, body, depth, message in unpack(content.as_py(), path, limits):
                    yield pa.record_batch([[logical], [path], pa.array([body], pa.binary()), pa.array([depth], pa.int32()), [message]], schema=_UNPACKED)

    ready = files.select(F.col("path").cast("string"), F.col("content").cast("binary")).where("path is not null and content is not null")
    return ready.mapInArrow(run, "logical_path string, source_path string, content binary, container_depth int, message string")


def texts(leaves: DataFrame) -> DataFrame:
    """Blobs of leaves: text decoded, or the strings carved out of binaries; source maps also give their sources."""
    binary = ingest.looks_binary(F.col("content"))
    plain = leaves.where("content is not null").withColumn("is_binary", binary)
    blobs = plain.select("logical_path", "source_path", F.when(F.col("is_binary"), ingest.strings_of(F.col("content"))).otherwise(ingest.text_of(F.col("content"))).alias("text"), "is_binary",
                         F.when(F.col("is_binary"), "application/octet-stream").otherwise("text/plain").alias("media_type"), F.lit(0).alias("line_offset"), "container_depth", F.lit(0).alias("commit_line"))
    return blobs.unionByName(source_map_blobs(blobs))


def source_map_blobs(blobs: DataFrame) -> DataFrame:
    """The sources inside ``.map`` blobs, each a blob ``map!/source``; broken ones give nothing."""
    parsed = F.from_json("text", "struct<sources:array<string>,sourcesContent:array<string>>")
    maps = blobs.where(~F.col("is_binary") & F.endswith("logical_path", F.lit(".map"))).withColumn("m", parsed).where("m.sourcesContent is not null")
    rows = maps.select("*", F.posexplode("m.sourcesContent").alias("i", "body")).where("body is not null and body <> ''")
    name = F.regexp_replace(F.coalesce(F.get("m.sources", F.col("i")), F.concat(F.lit("source"), F.col("i").cast("string"))), r"^[./]+", "")
    return rows.withColumns({"logical_path": F.concat_ws("!/", "logical_path", name), "text": F.col("body"), "container_depth": F.col("container_depth") + 1}).select(*blobs.columns)


def pieces(blobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Texts over ``piece_bytes`` cut at line ends with ``overlap_lines`` repeated; smaller ones stay whole.

    ``line_offset`` says how many lines stand before a piece, ``commit_line``
    the first line (from 1) it owns, so that a hit in the repeat counts once."""
    size, repeat = limits.piece_bytes, limits.overlap_lines
    for name in ("line_offset", "commit_line"):
        if name not in blobs.columns:
            blobs = blobs.withColumn(name, F.lit(0))
    others = [c for c in blobs.columns if c not in ("text", "line_offset", "commit_line")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text, offset = one.column("text")[0].as_py(), one.column("line_offset")[0].as_py() or 0
                lines = text.split("\n")
                at = 0
                while at < len(lines):
                    first, total, last = max(0, at - repeat), 0, at
                    while last < len(lines) and (last == at or total + len(lines[last]) < size):
                        total += len(lines[last]) + 1
                        last += 1
                    made = {"text": "\n".join(lines[first:last]), "line_offset": offset + first, "commit_line": at - first + 1 if first < at else 0}
                    yield pa.record_batch([one.column(c) for c in others] + [pa.array([made["text"]], pa.string()), pa.array([made["line_offset"]], pa.int32()), pa.array([made["commit_line"]], pa.int32())],
                                          names=[*others, "text", "line_offset", "commit_line"])
                    at = last

    types = {f.name: f.dataType.simpleString() for f in blobs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "text string, line_offset int, commit_line int"])
    long = blobs.where(F.octet_length("text") > size).mapInArrow(run, schema)
    return blobs.where("text is not null").where(F.octet_length("text") <= size).select(*others, "text", F.col("line_offset").cast("int"), F.col("commit_line").cast("int")).unionByName(long)


def image_blobs(files: DataFrame, image: str, limits: Limits = Limits()) -> DataFrame:
    """Blobs of a saved container image (a tar of layer tars), named by the image."""
    named = texts(unpacked(files, limits))
    return named.withColumn("logical_path", F.concat(F.lit(image + "!/"), F.regexp_replace("logical_path", r"^.*?!/", "")))
