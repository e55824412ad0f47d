import os

import pytest
from pyspark.sql import functions as F

from tripwise.sources import files

ROWS = "name string, content string, n long"


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_a_file_for_each_name_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i % 5}", f"{i}\n", i) for i in reversed(range(3000))] + [("empty", None, 0), ("blank", "", 0)]
    files.write_files(spark.createDataFrame(rows, ROWS).repartition(7), str(tmp_path / "out"), "n")
    want = {"empty": b"", "blank": b""}
    for i in range(3000):
        want[f"d{i % 3}/f{i % 5}"] = want.get(f"d{i % 3}/f{i % 5}", b"") + f"{i}\n".encode()
    assert tree(tmp_path / "out") == want
    files.write_files(spark.createDataFrame([("empty", "now", 1)], ROWS), str(tmp_path / "out"))  # replaces, leaves the others
    assert tree(tmp_path / "out") == want | {"empty": b"now"}
    files.write_files(spark.createDataFrame([], ROWS), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want | {"empty": b"now"}


@pytest.mark.parametrize("name", [None, "", "/etc/x", "a/../../x"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, name):
    (tmp_path / "out").mkdir()
    rows = spark.createDataFrame([(f"f{i}", "x", i) for i in range(50)] + [(name, "x", 0)], ROWS)
    with pytest.raises(Exception, match="no name of a file"):
        files.write_files(rows, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_a_task_that_runs_twice(tmp_path):
    """Two attempts of one task write drafts; the one that counts gives the files, the other goes with the hidden folder."""
    import pyarrow as pa

    writer = files.FilesWriter({"path": str(tmp_path)})
    rows = pa.RecordBatch.from_pylist([{"name": "a", "content": b"1"}, {"name": "a", "content": b"2"}, {"name": "b/c", "content": b"3"}])
    writer.write(iter([rows]))
    kept = writer.write(iter([rows]))
    assert tree(tmp_path).keys().isdisjoint({"a", "b/c"})
    writer.commit([kept, None])
    assert tree(tmp_path) == {"a": b"12", "b/c": b"3"} and sorted(os.listdir(tmp_path)) == ["a", "b"]
    writer.abort([kept])
    assert tree(tmp_path) == {"a": b"12", "b/c": b"3"}


def test_copies_keep_the_last_of_a_name(spark, tmp_path):
    big = os.urandom(files.PIECE + 17)
    for n, content in enumerate([b"first", b"second", big, b""]):
        (tmp_path / f"in{n}").write_bytes(content)
    rows = [("x/a", f"{tmp_path}/in1", 2), ("x/a", f"{tmp_path}/missing", 1), ("b", f"{tmp_path}/in2", 3), ("c", f"{tmp_path}/in3", 4), ("t", f"{tmp_path}/in0", 5), ("t", f"{tmp_path}/in1", 5)]
    asked = spark.createDataFrame(rows, "name string, source string, n long")
    files.copy_files(asked, str(tmp_path / "out"), "n")
    assert tree(tmp_path / "out") == {"x/a": b"second", "b": big, "c": b"", "t": b"second"}
    with pytest.raises(Exception, match="missing"):
        files.copy_files(asked.filter("n < 2"), str(tmp_path / "out"), "n")
    assert tree(tmp_path / "out") == {"x/a": b"second", "b": big, "c": b"", "t": b"second"}


def test_pictures(spark, tmp_path):
    frames = spark.createDataFrame([("p.pgm", 2, 3, bytearray(range(6)))], "name string, width int, height int, gray binary")
    files.write_files(frames.withColumn("content", files.grey_picture(F.col("width"), F.col("height"), F.col("gray"))), str(tmp_path))
    assert tree(tmp_path) == {"p.pgm": b"P5\n2 3\n255\n" + bytes(range(6))}
