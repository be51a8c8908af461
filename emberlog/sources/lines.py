"""Line sources: text files, plain or compressed, and text columns, as (file, line_number, text).

Line numbers are exact without a sort or a shuffle of lines: Spark numbers the rows of a split, and the line counts of the
splits before it are added from a table with one row per split.  That table is broadcast while files and partitions, known
before any line is read, bound it by ``MAX_SPLITS`` rows; beyond, it is joined by a shuffle.  Lines end at line feeds only; one
trailing carriage return is dropped.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.session import stored

SAMPLE_LINES, SAMPLE_SIZE = 20, 10
SNIFFED_BYTES = 8192
#: Lines in one block, where a window over a file is cut into blocks.
BLOCK_LINES = 100_000
#: Rows up to which the table of splits is broadcast (at most 400 bytes each with common path lengths).
MAX_SPLITS = 100_000
#: Matches up to which the places of their neighbours are broadcast.
MAX_MATCHES = 50_000


def compression_of(path: str) -> str:
    """gzip, bzip2, zip or none, by the path's ending in any case."""
    return {".gz": "gzip", ".bz2": "bzip2", ".zip": "zip"}.get(os.path.splitext(path.lower())[1], "none")


def check_access(path: str) -> None:
    """FILE_NOT_FOUND, PERMISSION_DENIED or BINARY_FILE for local paths; other file systems are left to Spark."""
    if "://" in path:
        return
    if not os.path.exists(path):
        raise QueryError("FILE_NOT_FOUND", path)
    if os.path.isdir(path):
        raise QueryError("FILE_NOT_FOUND", f"{path} is a directory")
    if not os.access(path, os.R_OK):
        raise QueryError("PERMISSION_DENIED", path)
    if is_binary(path):
        raise QueryError("BINARY_FILE", path)


def is_binary(path: str) -> bool:
    """Whether the first bytes, after decompression, have a zero byte."""
    import bz2
    import gzip

    kind = compression_of(path)
    if kind == "zip":
        with zipfile.ZipFile(path) as archive, archive.open(first_entry(archive)) as data:
            return b"\0" in data.read(SNIFFED_BYTES)
    with {"gzip": gzip.open, "bzip2": bz2.open}.get(kind, open)(path, "rb") as data:
        return b"\0" in data.read(SNIFFED_BYTES)


def first_entry(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    entries = [e for e in archive.infolist() if not e.is_dir()]
    if not entries:
        raise QueryError("DECOMPRESS_ERROR", "the zip file has no entries")
    return entries[0]


def read_lines(spark: SparkSession, paths: str | Iterable[str], check: bool = True) -> DataFrame:
    """(file, line_number, text) of text files; .gz, .bz2 and the first entry of .zip are decompressed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if check:
        for p in paths:
            check_access(p)
    parts = []
    if plain := [p for p in paths if compression_of(p) != "zip"]:
        parts.append(_numbered(spark.read.text(plain, lineSep="\n")))
    if zipped := [p for p in paths if compression_of(p) == "zip"]:
        parts.append(_zip_lines(spark, zipped))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    # a split that shares a partition is the only one of its file's rest there, so splits number at most files plus partitions
    bound = len(rows.inputFiles()) + rows.rdd.getNumPartitions()
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("id") - F.col("first") + 1 + F.col("before")
    splits = F.broadcast(splits) if bound <= MAX_SPLITS else splits
    return rows.join(splits, ["file", "start"]).select("file", number.alias("line_number"), _line("value").alias("text"))


def _line(column: str):
    return F.regexp_replace(column, r"\r\z", "")


def first_lines(spark: SparkSession, path: str, limit: int = SAMPLE_LINES) -> DataFrame:
    """(file, line_number, text) of a file's first lines: only the start of its first split is read."""
    if compression_of(path) == "zip":
        return _zip_lines(spark, [path]).where(F.col("line_number") <= limit).limit(limit)
    rows = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    few = rows.where(F.col("start") == 0).limit(limit)
    number = F.row_number().over(Window.partitionBy("file").orderBy("id"))  # over at most ``limit`` rows
    return few.select("file", number.cast("long").alias("line_number"), _line("value").alias("text"))


def _zip_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return zip_lines(spark.read.format("binaryFile").load(paths).select("path", "content"))


def zip_lines(files: DataFrame) -> DataFrame:
    """Lines of the first entry of each zip of ``files`` (path, content); an entry is read as a stream, in batches."""

    def lines(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(first_entry(archive)) as data:
                    rows: list[str] = []
                    done = 0
                    for raw in data:
                        line = raw.removesuffix(b"\n").removesuffix(b"\r")
                        rows.append(line.decode("utf-8", "replace"))
                        if len(rows) == 10_000:
                            yield _batch(path, done, rows)
                            done, rows = done + len(rows), []
                    yield _batch(path, done, rows)

    def _batch(path, done, rows):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(done + 1, done + 1 + len(rows)), pa.int64()), pa.array(rows, pa.string())], ["file", "line_number", "text"])

    return files.select("path", "content").mapInArrow(lines, "file string, line_number long, text string")


def compression_name(path):
    """gzip, bzip2, zip or none, of a path column."""
    ending = F.regexp_extract(F.lower(path), r"\.(gz|bz2|zip)\z", 1)
    return F.when(ending == "gz", "gzip").when(ending == "bz2", "bzip2").when(ending == "zip", "zip").otherwise("none")


def looks_binary(content):
    """Whether the first bytes of a binary column have a zero byte."""
    return F.coalesce(F.position(F.lit(b"\0").cast("binary"), F.substring(content, 1, SNIFFED_BYTES)) > 0, F.lit(False))


def column_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(file, line_number, text) of a text column; the key is the file."""
    lines = F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", ""), "\n", -1)).alias("k", "text")
    return df.select(F.col(key).cast("string").alias("file"), lines).select("file", (F.col("k") + 1).cast("long").alias("line_number"), F.regexp_replace("text", r"\r\z", "").alias("text"))


def sample(lines: DataFrame) -> DataFrame:
    """Of each file's first 20 lines the first 10 that are not empty."""
    few = lines.where((F.col("line_number") <= SAMPLE_LINES) & (F.col("text") != ""))
    return few.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line_number"))).where(F.col("k") <= SAMPLE_SIZE).drop("k")


def read_range(lines: DataFrame, start: int = 1, limit: int = 100) -> DataFrame:
    """Lines ``start`` to ``start + limit - 1``; start at least 1, limit 100 by default and 1,000 at most."""
    start, limit = max(1, start), clamp(limit, 100, 1000)
    return lines.where(F.col("line_number").between(start, start + limit - 1))


def tail(lines: DataFrame, limit: int = 50) -> DataFrame:
    """The last lines (50 by default, 1,000 at most) in order, with exact numbers; of several files those of the last."""
    return lines.orderBy(F.desc("file"), F.desc("line_number")).limit(clamp(limit, 50, 1000)).orderBy("file", "line_number")


def clamp(value: int | None, default: int, most: int, least: int = 1) -> int:
    return min(max(value or default, least), most)


def running(rows: DataFrame, **values) -> DataFrame:
    """Add, per name, a running (sum, column) or (max, column) over a file's lines up to each line.

    The file is cut into blocks of lines; the blocks' own values give each block's start, so no task needs a whole file.
    """
    how = {"sum": F.sum, "max": F.max}
    rows = rows.withColumns({"__block": F.floor(F.col("line_number") / BLOCK_LINES)} | {f"__v_{n}": c for n, (_, c) in values.items()})
    blocks = rows.groupBy("file", "__block").agg(*(how[k](f"__v_{n}").alias(f"__a_{n}") for n, (k, _) in values.items()))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "__block", *(how[k](f"__a_{n}").over(before).alias(f"__b_{n}") for n, (k, _) in values.items()))
    inside = Window.partitionBy("file", "__block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, ["file", "__block"])

    def total(n: str, k: str):
        here = how[k](f"__v_{n}").over(inside)
        return F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.coalesce(here, F.lit(0)) if k == "sum" else F.greatest(F.col(f"__b_{n}"), here)

    return out.withColumns({n: total(n, k) for n, (k, _) in values.items()}).drop("__block", *(f"__{x}_{n}" for n in values for x in "vb"))


def running_sum(rows: DataFrame, value: F.Column, name: str) -> DataFrame:
    """Add the running sum of ``value`` over a file's lines up to each line."""
    return running(rows, **{name: ("sum", value)})


def context(lines: DataFrame, n: int) -> DataFrame:
    """Add ``before_context`` and ``after_context``, the texts of ``n`` (0 to 10) lines around each line.

    Each block of lines gets copies of the ``n`` lines on either side, so no task needs a whole file.
    """
    n = min(max(n, 0), 10)
    if not n:
        empty = F.array().cast("array<string>")
        return lines.withColumns({"before_context": empty, "after_context": empty})
    block = F.floor(F.col("line_number") / BLOCK_LINES)
    near = F.array_distinct(F.array(F.floor((F.col("line_number") - n) / BLOCK_LINES), block, F.floor((F.col("line_number") + n) / BLOCK_LINES)))
    spread = lines.withColumns({"__own": block, "__block": F.explode(near)})
    w = Window.partitionBy("file", "__block").orderBy("line_number")
    out = spread.withColumns({"before_context": F.collect_list("text").over(w.rowsBetween(-n, -1)), "after_context": F.collect_list("text").over(w.rowsBetween(1, n))})
    return out.where(F.col("__own") == F.col("__block")).drop("__own", "__block")


def neighbours(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """``hits`` (file, line_number, text), some of ``lines``, with ``before_context`` and ``after_context``.

    Lines are read once more for the places around the hits, which are broadcast while few; only those lines are shuffled.
    """
    n = min(max(n, 0), 10)
    none = F.array().cast("array<string>")
    hits = hits.select("file", "line_number", "text")
    if not n:
        return hits.withColumns({"before_context": none, "after_context": none})
    hits = stored(hits)
    wanted = hits.select("file", F.col("line_number").alias("hit"), F.explode(F.sequence(F.col("line_number") - n, F.col("line_number") + n)).alias("line_number"))
    wanted = F.broadcast(wanted) if hits.count() <= MAX_MATCHES else wanted
    near = lines.select("file", "line_number", "text").join(wanted, ["file", "line_number"])
    around = near.groupBy("file", F.col("hit").alias("line_number")).agg(F.array_sort(F.collect_list(F.struct(F.col("line_number").alias("at"), "text"))).alias("rows"))

    def texts(test):
        return F.transform(F.filter("rows", test), lambda r: r["text"])

    at = F.col("line_number")
    own = F.filter("rows", lambda r: r["at"] == at)[0]["text"]
    return around.select("file", "line_number", own.alias("text"), texts(lambda r: r["at"] < at).alias("before_context"), texts(lambda r: r["at"] > at).alias("after_context"))


def preview(spark: SparkSession, path: str, limit: int = 100) -> str:
    """A header (name, path, size, change, lines shown, whether there are more) and the first lines of a local file, as text."""
    check_access(path)
    info = os.stat(path)
    rows = [r["text"] for r in first_lines(spark, path, limit + 1).orderBy("line_number").collect()]
    changed = datetime.fromtimestamp(int(info.st_mtime), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # fixed values: the words of the header
    header = [f"# File: {os.path.basename(path)}", f"# Path: {path}", f"# Size: {info.st_size} bytes", f"# Modified: {changed}", f"# Showing: first {min(len(rows), limit)} lines"]
    if len(rows) > limit:
        header.append("# Note: file has more lines beyond this preview")
    return "\n".join([*header, "#", *rows[:limit]]) + "\n"
