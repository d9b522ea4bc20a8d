"""The data source: whole files, lines of cut files, the gate, commit and abort."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from textlens.sources import files


def load(spark, path, **options):
    files.register(spark)
    return spark.read.format("textlens").option("path", str(path)).options(**options).load()


def save(df, path, mode="append"):
    files.register(df.sparkSession)
    df.write.format("textlens").mode(mode).option("path", str(path)).save()


def test_whole_files(spark, tmp_path):
    made = {"a.md": "é\r\n".encode(), "b.txt": b"", "deep/c.MARKDOWN": b"x", "bad.md": b"\xffa", "_hidden.txt": b"h", ".x/y.txt": b"h", "deep/_t/z": b"h"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {os.path.relpath(r["name"], tmp_path): tuple(r)[1:] for r in load(spark, tmp_path, partitionBytes="2").collect()}
    assert got == {"a.md": ("markdown", "é\r\n", None), "b.txt": ("plain", "", None), "deep/c.MARKDOWN": ("markdown", "x", None), "bad.md": (None, None, "invalid-utf8")}
    assert load(spark, tmp_path / "a.md").count() == 1
    assert load(spark, f"file:{tmp_path}/deep").count() == 1
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").count() == 0
    with pytest.raises(PySparkException, match="nowhere"):
        load(spark, tmp_path / "nowhere").count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"bcd", b"\xff", "漢é".encode(), b"x" * 40]), max_size=12), st.booleans(), st.integers(1, 30))
def test_cut_files_give_every_line_once(tmp_path_factory, made, closed, size):
    folder = tmp_path_factory.mktemp("lines")
    data = b"\n".join(made) + (b"\n" if closed and made else b"")
    (folder / "t.txt").write_bytes(data)
    reader = files._Reader({"path": str(folder), "lines": "true", "partitionbytes": str(size)})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]
    assert [r["text"] for r in got] == [None if x == b"\xff" else x.decode() for x in want]
    assert [r["error"] for r in got] == ["invalid-utf8" if x == b"\xff" else None for x in want]
    assert len({r["name"] for r in got}) == len(got)


def test_commit_and_abort(spark, tmp_path):
    out = tmp_path / "out"
    texts = lambda: sorted(r["text"] for r in load(spark, out, lines="true").collect())
    one = spark.createDataFrame([("{1}",), (None,), ("é",)], "json string").repartition(3)
    save(one, out)
    assert texts() == ["{1}", "é"] and (out / "_SUCCESS").exists() and not (out / "_temporary").exists()
    save(one, out)
    assert texts() == ["{1}", "{1}", "é", "é"]
    with pytest.raises(PySparkException, match="line break"):
        save(spark.createDataFrame([("ok",)] * 50 + [("a\nb",)], "json string").coalesce(1), out, "overwrite")
    assert texts() == ["{1}", "{1}", "é", "é"] and not (out / "_temporary").exists()
    save(spark.createDataFrame([("new",)], "json string"), out, "overwrite")
    assert texts() == ["new"]
    save(one.where("false"), out, "overwrite")
    assert texts() == [] and (out / "_SUCCESS").exists()
    with pytest.raises(PySparkException, match="one string column"):
        save(spark.range(1), out)


def test_a_task_that_ran_twice_is_moved_once(tmp_path):
    import pyarrow as pa

    writer = files._Writer(str(tmp_path / "out"), False)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["json"])
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    kept = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(p.name[:4] for p in kept) == ["_SUC", "part"] and b"".join(p.read_bytes() for p in kept) == b"a\nb\n"


def test_packed_files_come_back(spark, tmp_path):
    files.register(spark)
    folder = str(tmp_path / "packed")
    texts = [f'{{"n":{i},"é":"{"x" * 500}"}}' for i in range(2_000)]
    spark.createDataFrame([(t,) for t in texts], "json string").write.format("textlens").mode("append").option("path", folder).option("compression", "zstd").save()
    packed = [p for p in (tmp_path / "packed").iterdir() if p.name.endswith(".zst")]
    assert packed and sum(p.stat().st_size for p in packed) < sum(map(len, texts)) / 4
    back = spark.read.format("textlens").option("path", folder).option("lines", "true").option("partitionBytes", "100").load()
    assert sorted(r["text"] for r in back.collect()) == sorted(texts)
