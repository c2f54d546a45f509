"""The data sources: documents by partitions and as a stream, exports that count only when they are whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import datasource, export


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("plain é", "utf-8")
    (root / "deep" / "b.MD").write_bytes("latin é".encode("latin-1"))
    (root / "c.bin").write_bytes(b"\0")
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "_hidden.txt").write_text("no")
    (root / ".x").mkdir()
    (root / ".x" / "d.txt").write_text("no")
    return root


def test_documents_of_a_folder(spark, folder):
    datasource.register(spark)
    df = spark.read.format("documents").load(str(folder))
    got = {r.path.rsplit("/", 1)[-1]: (r.extension, r.text, r.size) for r in df.collect()}
    assert got == {"a.txt": ("txt", "plain é", 8), "b.MD": ("md", "latin é", 7), "broken.docx": ("docx", None, 6)}
    assert df.where("error is not null").count() == 1
    every = spark.read.format("documents").option("unsupported", "keep").option("partitionBytes", 8).load(f"file://{folder}")
    assert every.count() == 4 and every.rdd.getNumPartitions() == 3
    empty = folder.parent / "empty"
    empty.mkdir()
    assert spark.read.format("documents").load(str(empty)).count() == 0
    with pytest.raises(Exception, match="absent"):
        spark.read.format("documents").load(str(folder / "absent")).count()


def test_new_files_come_once_in_a_stream(spark, folder, tmp_path):
    datasource.register(spark)
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("documents").load(str(folder)).select("path", "text")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "progress")).trigger(once=True).start(out)
        q.awaitTermination()
        return sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.schema("path string, text string").parquet(out).collect())

    assert run() == ["a.txt", "b.MD", "broken.docx"]
    newest = max(p.stat().st_mtime_ns for p in folder.rglob("*"))
    (folder / "late.txt").write_text("late")
    (folder / "same.txt").write_text("same")
    os.utime(folder / "late.txt", ns=(newest + 10**9, newest + 10**9))
    os.utime(folder / "same.txt", ns=(newest + 10**9, newest + 10**9))
    assert run() == ["a.txt", "b.MD", "broken.docx", "late.txt", "same.txt"]
    (folder / "twin.txt").write_text("of the same time, but later")
    os.utime(folder / "twin.txt", ns=(newest + 10**9, newest + 10**9))
    assert run() == ["a.txt", "b.MD", "broken.docx", "late.txt", "same.txt", "twin.txt"] == run()


def test_an_export_counts_when_it_is_whole(spark, tmp_path):
    datasource.register(spark)
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "Topic") for i in range(20)], "id string, name string, label string")
    edges = spark.createDataFrame([("n1", "n2", "USES")], "src_id string, dst_id string, type string")
    lines = export.csv_lines(nodes, edges).repartitionByRange(3, "part", "id").sortWithinPartitions("part", "id")
    path = tmp_path / "export"
    lines.write.format("graph").mode("append").save(str(path))
    files = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in files)
    assert text.startswith("# Nodes\nid,name,type\n") and text.endswith('source,target,type\n"n1","n2","USES"\n') and text.count("\n") == 25
    lines.limit(2).coalesce(1).write.format("graph").mode("overwrite").save(str(path))
    assert len([p for p in path.iterdir() if p.name.startswith("part-")]) == 1

    broken = lines.withColumn("line", F.when(F.col("part") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    other = tmp_path / "broken"
    with pytest.raises(Exception, match="lost"):
        broken.write.format("graph").mode("append").save(str(other))
    assert not other.exists() or list(other.iterdir()) == []
    with pytest.raises(Exception, match="column line"):
        nodes.write.format("graph").mode("append").save(str(other))
