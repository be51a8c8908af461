"""File metadata, archive listings, decompression, and listings of discovered logs with their rotations."""

from __future__ import annotations

import io
import os
import posixpath
import re
import tarfile
import zipfile
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.functions.text import glob_pattern, human_size
from emberlog.operators import formats
from emberlog.session import shared_folder
from emberlog.sources.lines import clamp, compression_of, first_lines, is_binary, read_lines

#: One rotation ending, and all of them at the end of a path.
ROTATION = r"\.\d+(?:\.gz|\.bz2)?"
ROTATIONS = rf"((?:{ROTATION})+)\z"


def list_archive(spark: SparkSession, path: str, pattern: str = "", max_entries: int = 200) -> DataFrame:
    """(name, size, mod_time, is_dir, total) of a zip, tar, tar.gz or tar.bz2; the pattern is a glob on the base name.

    ``total`` counts all matching entries; at most ``max_entries`` (200 by default, 1,000 at most) are listed.
    """
    return archive_entries(spark.read.format("binaryFile").load(path), pattern, max_entries)


def archive_entries(files: DataFrame, pattern: str = "", max_entries: int = 200) -> DataFrame:
    """``list_archive`` of one archive given as (path, content); its listing is made where the archive is."""
    wanted = re.compile(glob_pattern(pattern).replace(r"\z", r"\Z")) if pattern else None
    most = clamp(max_entries, 200, 1000)

    def entries(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, total = [], 0
                for entry in _entries(name.lower(), content):
                    if wanted is None or wanted.match(entry[0].rstrip("/").rpartition("/")[2]):
                        total += 1
                        if total <= most:
                            rows.append((total, *entry))
                columns = list(zip(*(r + (total,) for r in rows), strict=True)) or [()] * 6
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["position", "name", "size", "mod_time", "is_dir", "total"])

    listed = files.select("path", "content").mapInArrow(entries, "position long, name string, size long, mod_time string, is_dir boolean, total long")
    return listed.orderBy("position").limit(most).drop("position")


def _entries(name: str, content: bytes):
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for e in archive.infolist():
                yield e.filename, e.file_size, datetime(*e.date_time, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), e.is_dir()
    elif re.search(r"\.(tar|tgz|tar\.gz|tar\.bz2|tbz2)$", name):
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for e in archive:
                yield e.name, e.size, datetime.fromtimestamp(e.mtime, UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), e.isdir()
    else:
        raise QueryError("INVALID_INPUT", f"unsupported archive {name}")


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, line_count, first_timestamp, last_timestamp, format, compression, is_binary): one row.

    The timestamps are those of the first and last line, in file order, that has one; a binary file has none and no lines.
    """
    size, kind = os.path.getsize(path), compression_of(path)
    fixed = [F.lit(path).alias("path"), F.lit(size).cast("long").alias("size_bytes")]
    if is_binary(path):
        none = F.lit(None).cast("string")
        return spark.range(1).select(*fixed, F.lit(0).cast("long").alias("line_count"), none.alias("first_timestamp"), none.alias("last_timestamp"), F.lit("unknown").alias("format"), F.lit(kind).alias("compression"), F.lit(True).alias("is_binary"))
    lines = read_lines(spark, path)
    found = formats.detect_one(first_lines(spark, path))
    stamp = formats.parse(F.col("text"), found)["timestamp"] if found != "unknown" else F.lit(None).cast("string")
    stamped = F.when(F.col("timestamp") != "", F.col("line_number"))
    return lines.withColumn("timestamp", stamp).agg(F.count(F.lit(1)).alias("line_count"), F.min_by("timestamp", stamped).alias("first_timestamp"), F.max_by("timestamp", stamped).alias("last_timestamp")).select(*fixed, "line_count", "first_timestamp", "last_timestamp", F.lit(found).alias("format"), F.lit(kind).alias("compression"), F.lit(False).alias("is_binary"))


def decompress(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Write the decompressed lines as text; (source, target, compression, compressed_bytes, line_count)."""
    kind = compression_of(path)
    if kind == "none":
        raise QueryError("INVALID_INPUT", f"{path} is not compressed")
    if target is None:
        target = posixpath.join(shared_folder(spark), f"decompressed-{zlib.crc32(repr((path, os.path.getmtime(path))).encode()):08x}")
    if kind == "bzip2":  # the one kind that is read in several splits
        rows = read_lines(spark, path).orderBy("line_number").select("text")
    else:
        rows = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r\z", "").alias("text")) if kind == "gzip" else read_lines(spark, path).select("text")
    rows.write.mode("overwrite").text(target)
    return spark.read.text(target, lineSep="\n").agg(F.count(F.lit(1)).alias("line_count")).select(F.lit(path).alias("source"), F.lit(target).alias("target"), F.lit(kind).alias("compression"), F.lit(os.path.getsize(path)).cast("long").alias("compressed_bytes"), "line_count")


def flatten_path(path: str) -> str:
    """A remote path as one file name."""
    return path.strip("/").replace("/", "_")


def discovery_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """``path<TAB>size<TAB>epoch.fraction`` lines as (path, size_bytes, modified_time, size_human); others are left out."""
    parts = F.split(text, "\t", 3)
    epoch = F.expr(f"try_cast(get(split({text}, '\t', 3), 2) AS DECIMAL(20, 9))")
    size = F.expr(f"try_cast(get(split({text}, '\t', 3), 1) AS BIGINT)")
    rows = lines.select(F.get(parts, 0).alias("path"), size.alias("size_bytes"), F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_time"))
    return rows.where("path <> '' AND size_bytes IS NOT NULL AND modified_time IS NOT NULL").withColumn("size_human", human_size(F.col("size_bytes")))


def rotation_groups(paths: DataFrame) -> DataFrame:
    """(path, variants): top-level logs with their rotations, by rotation number and then path.

    A rotation belongs to its nearest ancestor, without one or more of its endings, that is itself in ``paths``.
    """
    paths = paths.select("path").dropDuplicates()
    ending = F.regexp_extract("path", ROTATIONS, 1)
    parts = F.regexp_extract_all(ending, F.lit(f"({ROTATION})"), 1)
    stem = F.substring("path", F.lit(1), F.length("path") - F.length(ending))
    ended = paths.where(ending != "").select("path", stem.alias("stem"), parts.alias("parts"))
    step = F.struct((F.col("depth") + 1).alias("depth"), F.concat("stem", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1 - F.col("depth")), "")).alias("base"))
    candidates = ended.select("path", "stem", "parts", F.posexplode("parts").alias("depth", "__part")).select("path", step.alias("c")).where("c.base <> path").select("path", "c.depth", "c.base")
    known = candidates.join(paths.withColumnRenamed("path", "base"), "base", "left_semi")
    nearest = known.groupBy("path").agg(F.min_by("base", "depth").alias("base"))
    index = F.coalesce(F.expr(r"try_cast(regexp_extract(path, '\\.(\\d+)(\\.gz|\\.bz2)?$', 1) AS BIGINT)"), F.lit(0))
    grouped = nearest.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), "path"))), lambda v: v["path"]).alias("variants"))
    top = paths.join(nearest.select("path"), "path", "left_anti")
    return top.join(grouped.withColumnRenamed("base", "path"), "path", "left").select("path", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))
