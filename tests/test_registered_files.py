"""The data source whose readers are registered by extension."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.sources.registered import register_files


def folder_of(tmp_path):
    root = tmp_path / "in"
    for name, text in {
        "a/one.json": '{"k": 1}\n{"k": 2}\n',
        "a/two.JSON": '{"k": 3}\nno json\n{"k": 4}\n',
        "a/empty.json": "",
        "b/t.csv": "a,b\n1,2\n",
        "b/ragged.csv": "a,b\n1\n",
        "b/long.json": '{"k": 5}\n' * 1000,
        "c/plain.txt": "text",
        "c/.hidden.json": '{"k": 9}\n',
        "_away/x.json": '{"k": 9}\n',
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def reader_that_logs(log):
    def read(data):
        with open(log, "a") as f:
            f.write("opened\n")
        for line in data.decode().splitlines():
            yield str(json.loads(line)["k"])

    return read


def test_rows_and_errors(spark, tmp_path):
    register_files(spark, {".json": reader_that_logs(str(tmp_path / "log"))}, "with_json")
    d = spark.read.format("with_json").load(str(folder_of(tmp_path)))
    assert all(r.path.startswith("/") or r.path.startswith("file:") for r in d.collect())
    rows = sorted((r.name, r.place, r.text, (r.error or "").split(":")[0]) for r in d.filter("name <> 'long.json'").collect())
    assert rows == [
        ("one.json", 0, "1", ""), ("one.json", 1, "2", ""), ("plain.txt", 0, "```txt\ntext\n```", ""), ("ragged.csv", 0, None, "ValueError"),
        ("t.csv", 0, "| a | b |\n|---|---|\n| 1 | 2 |\n", ""), ("two.JSON", 0, "3", ""), ("two.JSON", 1, None, "JSONDecodeError"),
    ]


def test_what_is_ruled_out_is_not_opened(spark, tmp_path):
    log = tmp_path / "log"
    register_files(spark, {"json": reader_that_logs(str(log))}, "counted")
    d = spark.read.format("counted").load(str(folder_of(tmp_path)))
    for condition, opened in (("ext = 'json' and length < 100", 3), ("name like 'o%' and text = '1'", 1), ("path like '%/b/%' and ext in ('json', 'txt')", 1), ("not ext = 'json'", 0), ("length > 100000", 0), ("ext in ('json', null)", 4)):
        log.write_text("")
        expected = {(r.name, r.place) for r in spark.createDataFrame(d.collect(), d.schema).filter(condition).collect()}
        log.write_text("")
        asked = d.filter(condition)
        assert {(r.name, r.place) for r in asked.collect()} == expected
        assert log.read_text().count("opened") == opened


def test_partitions_by_bytes(spark, tmp_path):
    register_files(spark, name="parted")
    root = tmp_path / "many"
    root.mkdir()
    for k in range(40):
        (root / f"{k:02}.txt").write_text("x" * 1000)
    d = spark.read.format("parted").option("bytesPerPartition", str(10 * ((4 << 20) + 1000))).load(str(root))
    counts = d.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sorted(r["count"] for r in counts) == [10, 10, 10, 10]
    one = spark.read.format("parted").option("bytesPerPartition", "1").load(str(root))
    assert one.select(F.spark_partition_id()).distinct().count() == 40


def test_empty_folder(spark, tmp_path):
    register_files(spark, name="none")
    (tmp_path / "none").mkdir()
    assert spark.read.format("none").load(str(tmp_path / "none")).count() == 0
