from __future__ import annotations

import bz2
import gzip
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from emberlog.errors import QueryError
from emberlog.sources import files, lines


def rows(df):
    return [(r.line_number, r.text) for r in df.orderBy("line_number").collect()]


@pytest.mark.parametrize("content", ["", "\n", "a", "a\nb\n", "a\n\nb", "a\r\nb\r\n", "a\rb\n", "é x\n" * 3])
def test_lines(spark, log, content):
    expected = [x.removesuffix("\r") for x in content.removesuffix("\n").split("\n")] if content else []
    assert rows(lines.read_lines(spark, log(content))) == list(enumerate(expected, 1))


def test_line_numbers_over_splits(spark, log):
    rng = random.Random(1)
    text = [f"{k} " + "x" * rng.randrange(200) for k in range(5000)]
    path = log("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = lines.read_lines(spark, path)
        assert found.rdd.getNumPartitions() >= 1
        assert rows(found) == list(enumerate(text, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_line(spark, log):
    assert rows(lines.read_lines(spark, log("x" * 3_000_000 + "\ny"))) == [(1, "x" * 3_000_000), (2, "y")]


def test_compressed(spark, tmp_path):
    data = b"one\ntwo\r\nthree"
    (tmp_path / "a.log.gz").write_bytes(gzip.compress(data))
    (tmp_path / "a.log.bz2").write_bytes(bz2.compress(data))
    with zipfile.ZipFile(tmp_path / "a.ZIP", "w") as z:
        z.writestr("first.log", data)
        z.writestr("second.log", "other")
    for name, kind in (("a.log.gz", "gzip"), ("a.log.bz2", "bzip2"), ("a.ZIP", "zip")):
        path = str(tmp_path / name)
        assert lines.compression_of(path) == kind
        assert rows(lines.read_lines(spark, path)) == [(1, "one"), (2, "two"), (3, "three")]
        assert files.decompress(spark, path, str(tmp_path / f"out-{kind}")).first().line_count == 3
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    with pytest.raises(QueryError, match="DECOMPRESS_ERROR"):
        lines.read_lines(spark, str(tmp_path / "empty.zip"))


def test_access(spark, log, tmp_path):
    for path, code in ((str(tmp_path / "none"), "FILE_NOT_FOUND"), (str(tmp_path), "FILE_NOT_FOUND"), (log("a\0b"), "BINARY_FILE")):
        with pytest.raises(QueryError) as e:
            lines.check_access(path)
        assert e.value.code == code
    assert not lines.is_binary(log("x" * 8192 + "\0", "late.log"))


def test_range_and_tail(spark, log):
    found = lines.read_lines(spark, log("\n".join(map(str, range(1, 301)))))
    assert [n for n, _ in rows(lines.read_range(found, 5, 3))] == [5, 6, 7]
    assert len(rows(lines.read_range(found, 0, 0))) == 100
    assert [n for n, _ in rows(lines.tail(found, 2))] == [299, 300]


def test_context_and_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_LINES", 4)
    text = [f"t{k}" for k in range(1, 24)]
    frame = spark.createDataFrame([("f", k, t) for k, t in enumerate(text, 1)], "file string, line_number long, text string")
    for r in lines.context(frame, 3).collect():
        k = r.line_number - 1
        assert r.before_context == text[max(0, k - 3) : k] and r.after_context == text[k + 1 : k + 4]
    assert lines.context(frame, 3).count() == 23
    for r in lines.running_sum(frame, F.col("line_number"), "s").collect():
        assert r.s == r.line_number * (r.line_number + 1) // 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x.log", "d/y.log", "d/z.txt"):
            z.writestr(name, "data")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name in ("x.log", "d/y.log"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"data"))
    listed = files.list_archive(spark, str(tmp_path / "a.zip"), "*.log", 1).collect()
    assert [(r.name, r.size, r.is_dir, r.total) for r in listed] == [("x.log", 4, False, 2)]
    assert [r.name for r in files.list_archive(spark, str(tmp_path / "a.tar.gz")).collect()] == ["x.log", "d/y.log"]


def test_file_info(spark, log):
    row = files.file_info(spark, log('{"ts":"2025-01-02T00:00:00Z","msg":"b"}\n{"msg":"x"}\n{"ts":"2025-01-01T00:00:00Z","msg":"a"}\n')).first()
    assert (row.line_count, row.first_timestamp, row.last_timestamp, row.format, row.is_binary) == (3, "2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z", "json", False)
    row = files.file_info(spark, log("a\0", "b.bin")).first()
    assert (row.is_binary, row.line_count, row.first_timestamp) == (True, 0, None)


def test_discovery_and_rotations(spark):
    text = ["/a/app.log\t1536\t1736935200.123", "/a/x\tbad\t1", "nothing", "\t1\t1", "/a/y\t5\t1736935200"]
    found = files.discovery_lines(spark.createDataFrame([(t,) for t in text], "text string")).orderBy("path").collect()
    assert [(r.path, r.size_bytes, r.modified_time, r.size_human) for r in found] == [("/a/app.log", 1536, "2025-01-15T10:00:00Z", "1.5 KB"), ("/a/y", 5, "2025-01-15T10:00:00Z", "5 B")]
    paths = ["app.log", "app.log.1", "app.log.2.gz", "app.log.10.gz", "sys.3", "b.log", "app.log.1.5.bz2"]
    groups = {r.path: r.variants for r in files.rotation_groups(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert groups == {"app.log": ["app.log.1", "app.log.2.gz", "app.log.10.gz"], "sys.3": [], "b.log": []}
    assert files.flatten_path("/var/log/a.log") == "var_log_a.log"


def test_preview(spark, log):
    path = log("a\nb\nc\n")
    text = lines.preview(spark, path, 2).split("\n")
    assert text[0] == "# File: app.log" and text[1] == f"# Path: {path}" and text[2] == "# Size: 6 bytes" and text[3].endswith("Z")
    assert text[4:] == ["# Showing: first 2 lines", "# Note: file has more lines beyond this preview", "#", "a", "b", ""]
    assert lines.preview(spark, path).split("\n")[4:] == ["# Showing: first 3 lines", "#", "a", "b", "c", ""]


def test_line_numbers_of_a_large_file_shuffle_no_lines(spark, tmp_path):
    """Above the broadcast limit of the optimizer too, and detection stops after the first lines."""
    path = tmp_path / "big.log"
    path.write_text("".join(f"{k} {'x' * 190}\n" for k in range(100_000)))
    found = lines.read_lines(spark, str(path))
    plan = found.where(F.col("text").contains("99999 ")).select("text", "line_number")._jdf.queryExecution().executedPlan().toString()
    assert path.stat().st_size > 10 << 20 and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [r.line_number for r in found.where(F.col("text").startswith("99999 ")).collect()] == [100_000]
    head = lines.first_lines(spark, str(path))
    assert rows(head) == [(k + 1, f"{k} {'x' * 190}") for k in range(20)]


def test_neighbours_equal_context(spark, monkeypatch):
    text = [f"t{k % 7}" for k in range(60)]
    frame = spark.createDataFrame([(f, k, t + f) for f in "ab" for k, t in enumerate(text, 1)], "file string, line_number long, text string")
    hit = F.col("text").startswith("t3")
    for most in (lines.MAX_MATCHES, 1):
        monkeypatch.setattr(lines, "MAX_MATCHES", most)
        got = lines.neighbours(frame, frame.where(hit), 3)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, lines.context(frame, 3).where(hit).select(*got.columns).collect()), key=str)


def test_deep_rotations(spark):
    paths = ["a.log", "a.log.1.2.3.4.5.6.7.gz", "a.log.1.2", "b.1.2.3", "c.gz", "c.gz.1.bz2"]
    groups = {r.path: r.variants for r in files.rotation_groups(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert groups == {"a.log": ["a.log.1.2"], "b.1.2.3": [], "c.gz": ["c.gz.1.bz2"]}  # a variant of a variant is in no group
