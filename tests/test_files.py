"""Folders as a data source: names and contents from tasks, new files as a stream."""

import os
import time

import pytest

from tessera.sources import files, listing


@pytest.fixture
def source(spark):
    spark.dataSource.register(files.FileSource)
    return spark


def put(base, name, data=b"x"):
    path = base / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_nested_folders(source, tmp_path):
    names = {f"a{i % 3}/b{i % 5}/c{i}.pdf": bytes([65 + i]) * i for i in range(20)} | {"top.docx": b"d", "a0/notes.txt": b"t", "ö ä/x%20y.xlsx": b"q"}
    for name, data in names.items():
        put(tmp_path, name, data)
    for wanted in (1, 4, 1000):
        rows = source.read.format("files").option("partitions", wanted).load(f"file:{tmp_path}")
        assert {r.name: bytes(r.content) for r in rows.collect()} == names and rows.count() == len(names)
    assert rows.rdd.getNumPartitions() > 4
    some = {r.name: (r.size, r.content) for r in source.read.format("files").option("suffixes", "pdf,XLSX").load(str(tmp_path)).collect()}
    assert some["a0/notes.txt"] == (1, None) and bytes(some["ö ä/x%20y.xlsx"][1]) == b"q" and some["a0/b0/c0.pdf"] == (0, b"")
    assert source.read.format("files").load(f"{tmp_path}/absent").count() == 0


def test_both_listings_agree(source, tmp_path):
    for name, data in {"KB/a.pdf": b"1", "KB/b/c.docx": b"22", "KB/b/empty.xlsx": b"", "KB/b/x.txt": b"t"}.items():
        put(tmp_path, name, data)
    told = lambda df: sorted((r.name, r.size, r.code, bytes(r.content or b"") if r.code is None else b"") for r in df.collect())
    path = f"file:{tmp_path}/KB"
    here = listing.scan(source, path, "KB")
    assert told(here) == told(listing.classify(listing._listed_by_spark(source, path), "KB", "path"))
    assert {r.logical_path: r.code for r in here.collect()} == {"KB/a.pdf": None, "KB/b/c.docx": None, "KB/b/empty.xlsx": "empty", "KB/b/x.txt": "unsupported"}


def test_many_names_stay_in_tasks(source, tmp_path):
    for d in range(50):
        (tmp_path / f"d{d}").mkdir()
        for i in range(600):
            os.close(os.open(tmp_path / f"d{d}/f{i}.pdf", os.O_CREAT))
    rows = source.read.format("files").option("content", "false").load(str(tmp_path))
    assert rows.count() == 30_000 and rows.rdd.getNumPartitions() >= 50


def test_new_files_as_a_stream(source, tmp_path):
    put(tmp_path, "in/one.pdf")
    put(tmp_path, "in/sub/two.pdf")
    changes = source.readStream.format("files").option("lag", 0).load(f"{tmp_path}/in").select("name")

    def run():
        query = changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted(r.name for r in source.read.schema("name string").parquet(f"{tmp_path}/out").collect())

    assert run() == ["one.pdf", "sub/two.pdf"]
    time.sleep(0.05)
    put(tmp_path, "in/new/three.pdf")
    put(tmp_path, "in/one.pdf", b"again")
    assert run() == ["new/three.pdf", "one.pdf", "one.pdf", "sub/two.pdf"]
