"""Readers, writers and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import leaks
from tidemark.sources import readers, writers
from tidemark.streaming import state


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "report.json").write_text(json.dumps({"detected_urls": [{"url": "http://a.com/1"}, {}], "undetected_urls": [["http://a.com/2", 0], []]}))
    assert [r.url for r in readers.detected_urls(spark, str(tmp_path / "report.json")).collect()] == ["http://a.com/1", "http://a.com/2"]
    (tmp_path / "targets.txt").write_text("# list\na.com\nhttp://b.com\n\na.com\n")
    got = readers.targets(spark, str(tmp_path / "targets.txt"), 3)
    assert sorted(r.target for r in got.collect()) == ["http://a.com", "http://b.com"] and got.rdd.getNumPartitions() == 3
    one = spark.createDataFrame([("http://a.com/",)], "url string")
    assert sorted((r.url, r.origin) for r in readers.site_addresses(one, one).collect()) == [("http://a.com/", "robots"), ("http://a.com/", "sitemap")]


def test_writers(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.com/")], "page_id int, url string")
    links = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x")], "page_id int, link string")
    writers.details(pages, links, str(tmp_path / "details"))
    got = {r.page_id: (r.n_links, r.links) for r in spark.read.json(str(tmp_path / "details")).collect()}
    assert got == {1: (2, ["x", "y"]), 2: (0, None)}
    writers.run_export({"pages": pages, "links": links}, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "links")).count() == 3
    writers.patterns(links, "link", str(tmp_path / "patterns"))
    assert sorted(lines(spark, tmp_path / "patterns")) == ["x", "y"]
    log = spark.createDataFrame([("2024-01-02", "GET", "http://a.com/", 200), ("2024-01-01", "POST", "http://a.com/", None)], "ts string, method string, url string, status int")
    writers.request_log(log, str(tmp_path / "log"), "text")
    assert sorted(lines(spark, tmp_path / "log")) == ["[2024-01-01] POST http://a.com/ -", "[2024-01-02] GET http://a.com/ 200"]
    writers.request_log(log, str(tmp_path / "log_json"))
    assert spark.read.json(str(tmp_path / "log_json")).count() == 2
    with pytest.raises(ValueError):
        writers.request_log(log, str(tmp_path / "x"), "xml")


def test_leak_rules(spark):
    df = spark.createDataFrame([(1, "id key-12 x\nkey-34")], "id int, t string")
    table = leaks.rules_from_json(spark, json.dumps({"rules": {"k": {"pattern": "key-\\d+"}, "broken": {"pattern": "("}}}))
    found = leaks.scan(df, "id", "t", table)
    assert sorted((r.line_no, r.value) for r in found.collect()) == [(1, "key-12"), (2, "key-34")]
    assert [r.line for r in writers.leak_text(found).collect()] == ["[MEDIUM] k: key-12 (1, line 1)", "[MEDIUM] k: key-34 (1, line 2)"]
    assert leaks.scan(df, "id", "t", []).count() == 0
    assert leaks.rules_from_records([{"category": "APIs", "name": "X key", "regex": "a\n"}, {"name": "mail", "regex": "b"}, {"name": "e"}]) == [("APIs - X key", "a", "HIGH", True), ("mail", "b", "LOW", False)]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("http://a.com/1\n\nftp://x\n")
    (source / "b.txt").write_text("http://a.com/2\n")
    state.filtered_lines(spark, str(source), str(tmp_path / "out"), F.col("value").startswith("http"), str(tmp_path / "c1"), 1).awaitTermination()
    assert sorted(lines(spark, tmp_path / "out")) == ["http://a.com/1", "http://a.com/2"]
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)).where("value <> ''")
    state.latest_rows(stream(), ["value"], 2, str(tmp_path / "latest"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "latest" / "1")).collect()) == ["http://a.com/1", "http://a.com/2"]
    seen = []
    state.in_batches(stream(), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c3")).awaitTermination()
    assert [n for n, _ in seen] == [0, 1] and sum(k for _, k in seen) == 3
    assert [state.next_rate(100, 5, 0), state.next_rate(100, 0, 50), state.next_rate(100, 1, 0), state.next_rate(10, 5, 0), state.next_rate(200, 0, 100)] == [90, 110, 100, 10, 200]
