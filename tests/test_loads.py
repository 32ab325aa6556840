"""Workbooks, replaced tables, loads, indexes, progress in streams, ranges."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import findings, ranges, vector_index
from tidemark.sources import files, snapshots, xlsx
from tidemark.streaming import progress

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path):
    """Two sheets: header in two rows, shared, rich and inline strings, dates, numbers, a boolean, an error, gaps and a blank row."""
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Second" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="22"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>证券代码</t></si><si><r><t>网上发行</t></r><r><t>有效认购倍数</t></r><rPh><t>hint</t></rPh></si><si><t>[单位] 倍</t></si><si><t>00700.HK</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>day</t></is></c></row><row r="2"><c r="C2" t="s"><v>2</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" s="3"><v>12.5</v></c><c r="D3" s="1"><v>38154</v></c></row><row r="4"/><row r="6"><c r="A6" t="inlineStr"><is><t>数据来源</t></is></c><c r="C6" t="e"><v>#N/A</v></c><c r="D6" s="2"><v>38154.5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {MAIN}><sheetData><row><c><v>1</v></c></row><row><c><v>2</v></c></row><row><c t="str"><v>text</v></c><c><v>4</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    spark.dataSource.register(xlsx.XlsxSource)
    df = spark.read.format("xlsx").option("header_rows", 2).option("sheet", "First").load(str(tmp_path / "a.xlsx"))
    assert df.columns == ["证券代码", "c1", "网上发行有效认购倍数\n[单位] 倍", "day"]
    assert [tuple(r) for r in df.collect()] == [("00700.HK", "true", "12.5", "2004-06-16"), ("数据来源", None, None, "2004-06-16 12:00:00")]
    named = files.by_header_part(df, {"code": "证券代码", "multiple": "认购倍数", "none": "zz"})
    assert [tuple(r) for r in files.with_footers(named, "code", r"^\d").collect()] == [("00700.HK", "12.5", None)]
    workbook(tmp_path / "b.xlsx")
    both = spark.read.format("xlsx").option("header_rows", 2).load(str(tmp_path))
    assert both.rdd.getNumPartitions() == 4 and both.count() == 6  # files times sheets; two and one rows below the headers
    rows = xlsx.workbook_rows(spark, str(tmp_path / "a.xlsx")).where("sheet = 'Second'").orderBy("row_number").collect()
    assert [(r.row_number, r.cells) for r in rows] == [(1, ["1"]), (2, ["2"]), (3, ["text", "4"])]
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("xlsx").load(str(tmp_path / "none.xlsx"))


def test_replaced_table(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    frame = lambda *v: spark.createDataFrame([(x, {"k": str(x)}) for x in v], "v int, m map<string,string>")
    first = snapshots.replace(frame(1, 2), path)
    reader = snapshots.current(spark, path)  # opened before the next is put in place
    assert snapshots.replace(frame(3), path) != first
    assert sorted(r.v for r in reader.collect()) == [1, 2] and [tuple(r) for r in snapshots.current(spark, path).collect()] == [(3, {"k": "3"})]
    frame(9).write.json(f"{path}/v-unfinished")  # written, but the writer died before the rename
    assert [r.v for r in snapshots.current(spark, path).collect()] == [3]
    for v in (4, 5, 6):
        snapshots.replace(frame(v), path)
    kept = [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]
    assert len(kept) == 4 and not list((tmp_path / "store").glob("*.tmp")) and snapshots.current(spark, path).first().v == 6


def test_loads(spark, tmp_path):
    path = str(tmp_path / "target")
    frame = lambda *v: spark.createDataFrame(v, "k string, v int")
    assert snapshots.load_new(frame(("a", 1), ("b", 2), (None, 3)), path, ["k"], "first")["rows"] == 3
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    line = snapshots.load_new(frame(("b", 9), ("c", 4), ("c", 4), (None, 5)), path, ["k"])
    jobs = len(status.getJobIdsForGroup("load"))
    spark.sparkContext.setJobGroup("other", "other")
    assert line["rows"] == 1 and jobs <= 5  # schema, stages of one write; no counts of the target
    assert snapshots.load_new(frame(("b", 9), ("c", 4)), path, ["k"])["rows"] == 0
    assert sorted((r.k or "", r.v) for r in spark.read.parquet(path).collect()) == [("", 3), ("a", 1), ("b", 2), ("c", 4)]
    assert sorted((r.rows, r.note) for r in snapshots.ledger(spark, path).collect()) == [(0, ""), (1, ""), (3, "first")]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)] + [(600, [0.0] * 8), (601, None), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    path = str(tmp_path / "index")
    assert not vector_index.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        vector_index.search(spark, path, df, "id", "v", 3)
    vector_index.save(df, path, "id", "v", cells=40)
    assert vector_index.exists(spark, path)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (0, 1, 45, 600)], "q long, v array<double>")
    out = vector_index.search(spark, path, asked, "q", "v", 5)
    units = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if i is not None and v is not None}
    truth = set()
    for q in (0, 1, 45, 600):
        best = sorted((-round(float(units[q] @ x), 9) + 0.0, i) for i, x in units.items())[:5]
        truth |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in out.collect()} == truth
    one = vector_index.search(spark, path, asked.where("q = 0"), "q", "v", 5)
    every = len({f.rpartition("cell=")[2].partition("/")[0] for f in spark.read.parquet(f"{path}/vectors").inputFiles()})
    assert len(one.collect()) == 5 and 0 < vector_index.cells_read(one) < every / 2
    vector_index.save(df.limit(0), path, "id", "v")
    assert vector_index.search(spark, path, asked, "q", "v", 5).collect() == []


def test_range_join_of_unlike_lengths(spark):
    rng = random.Random(4)
    points = [(rng.choice([0, 1]), rng.randrange(100_000)) for _ in range(800)] + [(0, 500)] * 300 + [(1, None)]  # a hot point
    spans = [(i, rng.choice([0, 1]), s := rng.randrange(100_000), s + rng.choice([0, 1, 3, 10, 50, 3000, 99_999])) for i in range(300)] + [(900, 0, -5, 10**9), (901, 1, None, 5), (902, 0, 7, 3)]
    p, s = spark.createDataFrame(points, "k int, x long"), spark.createDataFrame(spans, "id int, k int, a long, b long")
    out = ranges.range_join(p, "x", s, "a", "b", ["k"])
    truth = sorted((i, x) for i, k, a, b in spans if a is not None for kk, x in points if kk == k and x is not None and a < x <= b)
    assert sorted((r.id, r.x) for r in out.collect()) == truth and len(truth) > 1000
    assert ranges.range_join(p, "x", s.limit(0), "a", "b", ["k"]).count() == 0


def test_progress_machine_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    stages = ["QUEUED", "BUILDING_SECTION", "BUILDING_INDEX", "BUILDING_PACKAGES", "READY", "FAILED", "LOST", None]
    rows = [(f"j{rng.randrange(12)}", n, rng.choices(stages, [3, 4, 4, 3, 1, 1, 1, 1])[0], rng.choice([None, n, n // 2])) for n in range(400)]
    rows += [("long", n, "QUEUED", n) for n in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1, "READY", 1)], "job string, seq long, stage string, progress int").repartition(4)
    batch = {(r.job, r.seq): (r.verdict, r.now, r.now_progress) for r in progress.judged(df).collect()}
    truth, state = {}, {}
    for job, seq, stage, done in rows:
        state[job], verdict = progress.PREPARATION.step(state.get(job), stage, done)
        truth[job, seq] = (verdict, *state[job])
    assert batch == truth and {v for v, *_ in truth.values()} == {"ok", "unknown", "ended", "skipped", "backwards"}
    last = {r.job: (r.stage, r.progress, r.events) for r in progress.last_states(progress.judged(df)).collect()}
    assert last["long"] == ("QUEUED", 2999, 3000)
    (tmp_path / "in").mkdir()
    for k in range(2):  # two files, read by two triggers: the state is carried over
        part = [r for r in rows if r[0] != "long"][k * 200 : (k + 1) * 200]
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(json.dumps(dict(zip(("job", "seq", "stage", "progress"), r, strict=True))) for r in part))
        stream = spark.readStream.schema("job string, seq long, stage string, progress int").json(str(tmp_path / "in"))
        q = progress.tracked(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    out = {(r.job, r.seq): (r.verdict, r.now, r.now_progress) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {k: v for k, v in truth.items() if k[0] != "long"}


def test_findings_of_single_passages(spark):
    rows = [(1, 120, 1, "PIPELINE_RISK", "我们的产品管线候选产品全部自主研发，已完成一项常规I期临床研究。"), (2, 99, 1, "PIPELINE_RISK", "核心产品HX009因安全性问题被临床搁置，暂停临床。"), (3, 1, 1, None, None), (4, 5, 1, None, "到期及贖回的理財產品"), (5, 7, 2, "CONCENTRATION", "供應商<td>1,000</td><td>55.5</td></tr>"), (5, 8, 1, None, "客戶比例 40")]
    df = spark.createDataFrame(rows, "doc int, page int, rank int, code string, text string")
    out = {(r.doc, r.theme): r for r in findings.findings(df, "doc").collect()}
    first, second = out[1, "pipeline"], out[2, "pipeline"]
    assert first.found and not first.high and first.stages == ["I期"] and first.strength == "medium" and first.evidence[0].page == 120
    assert second.high and second.alarm and second.strength == "high" and second.evidence[0].excerpt.startswith("核心产品HX009")
    assert not out[4, "redemption"].found and out[4, "redemption"].n_noise == 1 and not [k for k in out if k[0] == 3]
    c = out[5, "concentration"]
    assert (c.top1_supplier, c.top5_supplier, c.top1_customer, c.high, [e.page for e in c.evidence]) == (55.5, 55.5, 40.0, True, [8, 7])


def test_parsed_chunks_sets_malformed_aside(spark):
    docs = [(1, json.dumps([{"page": 1, "content": "a"}, {"page_number": 2, "excerpt": "", "text": "b", "type": "table"}, {"page": 3}])),
            (2, json.dumps({"pages": [], "content": [{"page_idx": 4, "items": [{"html": "<p>c", "category": "x"}, {"text": ""}]}, {"elements": [{"content": "d", "page": 9}]}], "chunks": [{"text": "e"}]})),
            (3, "{broken"), (4, None), (5, "7"), (6, "{}")]
    chunks, bad = files.parsed_chunks(spark.createDataFrame(docs, "doc int, j string"), "doc", "j")
    assert sorted((r.doc, r.position, r.page, r.category, r.text) for r in chunks.collect() if r.page) == [(1, 0, 1, "text", "a"), (1, 1, 2, "table", "b"), (2, 0, 4, "x", "<p>c"), (2, 2, 9, "text", "d")]
    assert [(r.doc, r.text) for r in chunks.collect() if r.page is None] == [(2, "e")] and [tuple(r) for r in bad.collect()] == [(3, "{broken")]
    hits = files.keyword_hits(chunks, "doc", ["a", "b", "c"], 1).collect()
    assert [(r.doc, r.matched, r.score) for r in hits if r.doc == 1] == [(1, ["a"], 1.0)]


def test_yaml_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("name: finance\nweights: {grep: 0.4, bm25: 0.3}\nsections:\n  - {code: TBL_IS, labels: [收入, 收益]}\nsince: 2024-01-02\nother: 1\n")
    (tmp_path / "b.yaml").write_text("name: legal\n")
    schema = "name string, weights map<string,double>, sections array<struct<code string, labels array<string>>>, since string"
    a, b = files.yaml_documents(spark, str(tmp_path), schema).orderBy("name").collect()
    assert (a["name"], a.weights, a.sections[0].labels, a.since, b.weights, b.sections) == ("finance", {"grep": 0.4, "bm25": 0.3}, ["收入", "收益"], "2024-01-02", None, None) and a.file.endswith("a.yaml")
    (tmp_path / "c.yaml").write_text("a: [1")
    with pytest.raises(Exception, match="yaml|pars"):
        files.yaml_documents(spark, str(tmp_path / "c.yaml"), schema).collect()
