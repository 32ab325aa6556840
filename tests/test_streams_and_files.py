"""Streams with availableNow, and files written to a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import eventlog


def test_log_is_read_from_where_it_was_left(spark, tmp_path):
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    (tmp_path / "log").mkdir()

    def run():
        q = eventlog.append(eventlog.tail(spark, log).select("event", "ts"), out, check)
        q.awaitTermination()
        return sorted(r.event for r in spark.read.json(out).collect())

    (tmp_path / "log" / "1.jsonl").write_text('{"event":"a","data":{"k":"1"},"ts":"2024-01-01T00:00:00Z"}\nnot json\n\n')
    assert run() == ["a"]
    (tmp_path / "log" / "2.jsonl").write_text('{"event":"b","ts":"2024-01-01T00:00:01Z"}\n')
    assert run() == ["a", "b"] and run() == ["a", "b"]


def test_gated_emitter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kinds = [("k", 1, "fin"), ("k", 2, "legal"), ("k", 3, "fin"), ("k", 4, "done"), ("k", 5, "fin"), ("never", 1, "fin"), ("never", 2, "legal")]
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(json.dumps({"key": k, "seq": s, "kind": t, "row": f"{k}{s}"}) for k, s, t in kinds))
    stream = spark.readStream.schema("key string, seq long, kind string, row string").json(str(tmp_path / "in"))
    q = eventlog.gated(stream, "fin", "done").writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    rows = spark.sql("SELECT * FROM gated").collect()
    assert [r.seq for r in rows if r.key == "k"] == [2, 4, 1, 3, 5] and [r.seq for r in rows if r.key == "never"] == [2]


def test_windowed_counts_and_latest(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("a", 3, 31), ("b", 2, 5)], "k string, t int, v int")
    assert {r.k: r.v for r in eventlog.latest(rows, "k", "t", "v").collect()} == {"a": 31, "b": 5}
    events = spark.range(10).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 2).alias("kind"))
    assert eventlog.windowed_counts(events, "ts", "5 minutes", "1 minute", "kind").count() == 4


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("代码,名称,价\n00700,騰訊,1.5\n00001,長和,NaN\n來源：萬得,,\n".encode("gb18030"))
    df = files.csv(spark, str(tmp_path / "a.csv"), "code string, name string, price double", encoding="gb18030")
    rows = files.with_footers(df, "code", r"^\d{5}$").orderBy("code").collect()
    assert [(r.code, r.name, r.price) for r in rows] == [("00001", "長和", None), ("00700", "騰訊", 1.5)]
    (tmp_path / "w.csv").write_text("x;Index A;Index B\ndate;A1;B1\n2024-01-02;1,000.5;0\n20240103;;2\nsource: z;;\n")
    tall = sorted((str(r.date), r.code, r.name, r.value) for r in files.index_export(spark, str(tmp_path / "w.csv")).collect())
    assert tall == [("2024-01-02", "A1", "Index A", 1000.5), ("2024-01-03", "B1", "Index B", 2.0)]
    assert files.renamed(spark.createDataFrame([(1, 2)], ["日期", "收盘"]), {"日期": "date", "收盘": "close", "开盘": "open"}).columns == ["date", "close"]
    assert files.by_header_part(spark.createDataFrame([(1, 2)], ["公开\n认购倍数", "b"]), {"multiple": "认购倍数", "none": "zz"}).first().multiple == 1


def test_documents_lines_and_names(spark, tmp_path):
    page = {"page": 1, "parse_status": "ok", "elements": [{"category": "text", "text": "hello"}, {"category": "footer", "text": "f"}, {"category": "figure", "text": "", "image_path": ""}, {"category": "figure", "text": "", "image_path": "x.png"}, {"category": "table", "text": " "}]}
    (tmp_path / "d.json").write_text(json.dumps([page]))
    e = files.elements(files.parsed_document(spark, str(tmp_path / "d.json")), "path").collect()
    assert [(r.position, r.category) for r in e] == [(0, "text"), (3, "figure")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "pdf" / "2024").mkdir(parents=True)
    for n in ("00700_16-06-2004_Some Co_final.pdf", "00700_16-06-2004_Some Co_draft.pdf", "other.pdf"):
        (tmp_path / "pdf" / "2024" / n).write_bytes(b"x")
    found = files.files_by_name(spark, str(tmp_path / "pdf"), "*.pdf", [r"^(\d+)_(\d{2}-\d{2}-\d{4})_(.+?)_(\w+)$"])
    best = files.preferred_file(found, "code", "final").first()
    assert found.count() == 2 and best.files == 2 and "final" in best.path


def test_stats_fallback_and_incremental_load(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-03", 2)], "date string, v int")
    stats = files.write_with_stats(df, str(tmp_path / "out"), "date", note="n")
    assert (stats["rows"], stats["date_min"], stats["date_max"], stats["columns"]) == (2, "2024-01-01", "2024-01-03", ["date", "v"])
    assert json.loads(spark.read.text(str(tmp_path / "out_meta")).first().value) == stats
    assert files.first_valid([lambda: df.limit(1), lambda: spark.read.parquet("/nowhere"), lambda: df], 2).count() == 2
    with pytest.raises(ValueError):
        files.first_valid([lambda: df.limit(1)], 2)
