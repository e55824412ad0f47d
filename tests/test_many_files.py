"""What a write of many files, and reading them back, keeps out of the driver."""

import json
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripwise.sources import files

ROWS = "name string, content string, n long"


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def drafts(folder, many, **options):
    writer = files.FilesWriter({"path": str(folder)} | options)
    return writer, writer.write(iter([pa.RecordBatch.from_pylist([{"name": f"d{i % 7}/é\n{i}", "content": b"%d" % i} for i in range(many)])]))


def test_a_message_does_not_grow_with_the_names(tmp_path):
    few, many = (len(pickle.dumps(drafts(tmp_path, n)[1])) for n in (1, 5000))
    assert many == few


def test_names_are_given_outside_the_driver(spark, tmp_path):
    writer, message = drafts(tmp_path, 500, hidden=".drafts-x")
    writer.commit([message, None])
    assert not any(not name.startswith(".drafts-x/") for name in tree(tmp_path))  # noted only
    assert json.loads((tmp_path / ".drafts-x" / files.KEPT).read_bytes()) == [message.attempt]
    want = {f"d{i % 7}/é\n{i}": b"%d" % i for i in range(500)}
    # A try that ends midway, and one after the end.
    for i in range(0, 500, 3):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / ".drafts-x" / message.attempt / str(i)).rename(tmp_path / f"d{i % 7}" / f"é\n{i}")
    for _ in range(2):
        assert files.give_names(str(tmp_path), ".drafts-x", message.attempt) == 500
    files.clear(str(tmp_path), ".drafts-x")
    assert tree(tmp_path) == want
    # A draft that is nowhere is an error.
    writer, message = drafts(tmp_path / "b", 3, hidden=".drafts-y")
    (tmp_path / "b" / ".drafts-y" / message.attempt / "1").unlink()
    with pytest.raises(OSError):
        files.give_names(str(tmp_path / "b"), ".drafts-y", message.attempt)


def test_stored_files_are_those_spark_finds_and_empty_ones(spark, tmp_path):
    for name in ("a/b/c.txt", "a/b b%20c/é.bin", "a/=x", "top", "_k=1/x", "_metadata", "a/.h/x", "a/_h/x", ".h", "_h", "x._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 3)
    (tmp_path / "a" / "none").touch()
    (tmp_path / "a" / "nothing").mkdir()
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "content")
    for folder in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        found = files.stored_files(spark, folder)
        assert found.schema.simpleString() == plain.schema.simpleString()
        assert sorted(found.filter("length > 0").collect()) == sorted(plain.collect())
        assert [(r.path, bytes(r.content)) for r in found.filter("length = 0").collect()] == [(f"file:{tmp_path}/a/none", b"")]


def test_many_files_are_read_in_few_tasks(spark, tmp_path):
    rows = spark.range(600).select(F.format_string("v%d/%d", F.col("id") % 9, "id").alias("name"), F.col("id").cast("string").alias("content"))
    files.write_files(rows, str(tmp_path / "out"))
    found = files.stored_files(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() <= 4
    assert {(r.path.split("/out/")[1], bytes(r.content)) for r in found.collect()} == {(f"v{i % 9}/{i}", b"%d" % i) for i in range(600)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_no_rows_are_no_files(spark, tmp_path):
    files.write_files(spark.createDataFrame([], ROWS), str(tmp_path / "out"))
    assert files.stored_files(spark, str(tmp_path / "out")).collect() == []
