"""Inline cases for operators: edges that the tables do not hold."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import html_tables, scalars
from tidemark.operators import documents, islands, joins, metrics, quality, rules, text
from tidemark.operators import timeseries as ts

D = dt.date


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_asof_last_row_counts_with_null_value(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2023, 1, 1)), ("b", D(2024, 1, 5)), ("a", D(2024, 1, 3)), ("a", None)], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), None), ("a", D(2024, 1, 9), 9.0), ("a", D(2024, 1, 1), 2.0)], "k string, t date, v double")
    out = {(r.k, r.d): r.v for r in ts.asof_join(left, right, "d", "t", ["v"], by=[("k", "k")]).collect()}
    assert out == {("a", D(2024, 1, 5)): None, ("a", D(2023, 1, 1)): None, ("b", D(2024, 1, 5)): None, ("a", D(2024, 1, 3)): None, ("a", None): None}
    back = ts.asof_join(left.where("k = 'a'"), right, "d", "t", ["v"], by=[("k", "k")], offset_days=1).where("d = date'2024-01-03'").first()
    assert back.v == 2.0


def test_asof_by_spans_is_asof(spark):
    left = spark.createDataFrame([(i, D(2024, 1, 1) + dt.timedelta(days=i * 7)) for i in range(60)], "i int, d date")
    right = spark.createDataFrame([(D(2024, 2, 1) + dt.timedelta(days=i * 50), float(i)) for i in range(6)], "t date, v double")
    whole = {r.i: r.v for r in ts.asof_join(left, right, "d", "t", ["v"]).collect()}
    for buckets in (3, 32, 1000):
        assert {r.i: r.v for r in ts.asof_join(left, right, "d", "t", ["v"], buckets=buckets).collect()} == whole


def test_windows_that_do_not_fit_are_null(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([2.0, 0.0, None, 4.0, 8.0, 8.0])], "k int, t int, v double")
    w = Window.partitionBy("k").orderBy("t")
    out = rows.select("t", ts.change("v", w).alias("c"), ts.rolling(F.avg, "v", w, 3).alias("m"), ts.rolling_max("v", w, 4, 3).alias("h"), ts.two_half_change("v", w, 2).alias("h2")).orderBy("t").collect()
    assert [r.c for r in out] == [None, -1.0, None, None, 1.0, 0.0]
    assert [r.m for r in out] == [None, None, 1.0, 2.0, 6.0, 20 / 3]
    assert [r.h for r in out] == [None, None, None, 4.0, 8.0, 8.0]
    assert [r.h2 for r in out] == [None, None, None, 3.0, None, 1.0]


def test_drawdown_takes_rows_before_nulls(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 8.0, None, 9.0, 12.0, 6.0])] + [(2, i, 1.0) for i in range(4)], "k int, t int, v double")
    out = {r.k: r.max_drawdown for r in ts.max_drawdown(rows, ["k"], ["t"], "v", first=6).collect()}
    assert out == {1: -0.5, 2: None}
    assert ts.max_drawdown(rows, ["k"], ["t"], "v", first=5).where("k = 1").first().max_drawdown is None


def test_keys_resolve_by_first_rule(spark):
    rows = spark.createDataFrame([("02097",), ("00300",), ("99999",), (None,)], "raw string")
    known = spark.createDataFrame([("2097",), ("0300",), ("300X",)], "code string")
    out = {r.raw: (r.resolved_key, r.resolved_rule) for r in joins.resolve_keys(rows, "raw", known, "code", [("strip", F.ltrim("raw", F.lit("0"))), ("pad4", F.lpad(F.ltrim("raw", F.lit("0")), 4, "0"))]).collect()}
    assert out == {"02097": ("2097", "strip"), "00300": ("0300", "pad4"), "99999": (None, "unmatched"), None: (None, "unmatched")}


def test_upsert_and_orphans_and_new_rows(spark):
    base = spark.createDataFrame([(1, 5), (2, 5), (None, 1)], "k int, v int")
    patch = spark.createDataFrame([(2, 4), (3, 1), (None, 2)], "k int, v int")
    plain = {r.k: (r.v, r.action) for r in joins.upsert(base, patch, ["k"]).collect()}
    assert plain == {1: (5, "kept"), 2: (4, "updated"), 3: (1, "inserted"), None: (2, "updated")}
    assert {r.k: r.action for r in joins.upsert(base, patch, ["k"], F.col("p.v") > F.col("b.v")).collect()}[2] == "skipped"
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "x")], "id string, parent string")
    assert [r.id for r in joins.orphans(tree, "id", "parent").collect()] == ["c"]
    assert sorted(r.k for r in joins.new_rows(patch.where("k is not null").union(patch.where("k = 3")), base, ["k"]).collect()) == [3]


def test_walk_reasons(spark):
    rows = spark.createDataFrame([(1, p, True) for p in (1, 2, 4)] + [(2, p, p != 3) for p in (1, 2, 3)] + [(3, p, True) for p in range(1, 9)] + [(4, 7, False)], "doc int, page int, ok boolean")
    out = islands.walk(rows, ["doc"], "page", F.col("ok"), 3).orderBy("doc", "page").collect()
    assert [(r.doc, r.page, r.stop_reason) for r in out] == [(1, 1, None), (1, 2, "gap"), (2, 1, None), (2, 2, "condition"), (3, 1, None), (3, 2, None), (3, 3, "limit"), (4, 7, "end")]


def test_levels_and_rules(spark):
    scores = [(float(s),) for s in (0, 19.9, 20, 40, 60, 80, 100)] + [(None,)]
    out = [r.l for r in spark.createDataFrame(scores, "s double").select(rules.level(F.col("s")).alias("l")).collect()]
    assert out == ["very_low", "very_low", "low", "medium", "high", "very_high", "very_high", None]
    flags = spark.createDataFrame([(1, True, True, True, 3), (2, False, True, True, 0), (3, None, True, True, 1)], "id int, continuous_net_loss boolean, latest_full_year_loss boolean, runway_lt_12 boolean, n int").withColumn("unprofitable", F.col("id") == 1)
    hits = rules.fired(flags, "id", ["continuous_net_loss", "latest_full_year_loss", "runway_lt_12"], rules.rule_table(spark, rules.FINANCE_RULES), ["unprofitable"], "n")
    assert {r.id: (r.risk_score, r.codes) for r in rules.scored(flags, "id", hits).collect()} == {1: (45.0, "CASH_RUNWAY_LT_12,CONTINUOUS_LOSS"), 2: (0.0, ""), 3: (15.0, "SINGLE_YEAR_LOSS")}


def test_rules_and_samples_beyond_a_broadcast(spark, monkeypatch):
    """Above the bounds of their broadcasts, results are the same."""
    flags = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0) for i in range(20)], "id long, continuous_net_loss boolean, latest_full_year_loss boolean")
    names = ["continuous_net_loss", "latest_full_year_loss"]
    told = lambda: sorted(tuple(r) for r in rules.fired(flags, "id", names, rules.rule_table(spark, rules.FINANCE_RULES)).collect())
    taken = lambda: sorted(tuple(r) for r in quality.stratified(flags.select("id"), "id", F.col("id") % 7, [("even", F.col("id") % 2 == 0, 3), ("low", F.col("id") < 9, 4)], 10).collect())
    before = told(), taken()
    monkeypatch.setattr(rules, "BROADCAST_RULES", 0)
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 0)
    assert (told(), taken()) == before and len(before[0]) == 13 and len(before[1]) == 10


def test_numbers_dates_and_codes(spark):
    rows = ["(1,234.5)", "–", "N/A", "12%", "5", "", "（7）", "x"]
    out = [r.v for r in spark.createDataFrame([(x,) for x in rows], "x string").select(scalars.accounting_number(F.col("x")).alias("v")).collect()]
    assert out == [-1234.5, None, None, 12.0, 5.0, None, -7.0, None]
    days = ["20240131", "31-01-2024", "2024-1-31", "2024/1/3", "20241331", "soon", None]
    out = [r.v for r in spark.createDataFrame([(x,) for x in days], "x string").select(scalars.to_day(F.col("x")).alias("v")).collect()]
    assert out == [D(2024, 1, 31)] * 3 + [D(2024, 1, 3), None, None, None]
    assert one(spark, scalars.zfill(F.col("a"), 5), a="1234567") == "1234567" and one(spark, scalars.ticker(F.col("a")), a="00700.hk") == "0700.HK"
    assert one(spark, scalars.whole_array(F.col("a")), a='[{"a":1},{"b":') == '[{"a":1}]' and one(spark, scalars.whole_array(F.col("a")), a="[") == "[]"
    assert one(spark, scalars.json_text(F.col("a")), a='text ```json\n{"a": 1}\n``` more') == '{"a": 1}'
    assert one(spark, scalars.percentages(F.col("a")), a="12.5% of 300% and 0% and 7 ％") == [12.5, 7.0]
    assert one(spark, scalars.page_slice(F.col("a"), 2, 3), a="x\n## Page 1\none\n## Page 2\ntwo\n## Page 3\nthree") == "two\n\nthree"
    assert one(spark, scalars.decode_entities(F.col("a")), a="a&amp;lt;<br/>&lt;b&gt;") == "a&lt; <b>"
    f = one(spark, scalars.file_name_fields(F.col("a"), [r"^(\d+)_(\d{2}-\d{2}-\d{4})_(.+)_(\w+)$"]), a="/x/00700_16-06-2004_Some Co_final.pdf")
    assert (f.code, f.day, f.company, f.kind) == ("00700", D(2004, 6, 16), "Some Co", "final")


def test_html_grid_spans(spark):
    html = "<table><tr><th rowspan=2>A</th><th colspan='2'>B</th></tr><tr><td>c<td>d</tr><tr><td></td><td colspan=2 rowspan=2>e &amp; f</td></tr><tr><td>g</td></tr></table>"
    assert html_tables.grid(html) == [["A", "B", "B"], ["A", "c", "d"], ["", "e & f", "e & f"], ["g", "e & f", "e & f"]]
    pages = spark.createDataFrame([(1, html), (2, "only words here"), (3, None), (4, "")], "page_id int, html string")
    out = html_tables.cells(pages, "page_id", "html").collect()
    assert len([r for r in out if r.page_id == 1]) == 12 and [r.cell for r in out if r.page_id == 2] == ["only", "words", "here"] and not [r for r in out if r.page_id > 2]


def test_wide_grid():
    assert len(html_tables.grid(f"<table><tr>{'<td>x</td>' * 200}<td colspan=50>y</td></tr></table>")[0]) == 250


def test_substring_pairs(spark):
    """Terms of all lengths, within and across words, against a loop."""
    texts, terms = ["the cat sat", "concatenate", "日本語のテキスト", "", "ab", None, "xxcat s"], ["cat", "cat s", "the ", "a", "語の", "oncaten", "zzz", "", "ab", "日本語のテ", None]
    out = text.substring_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(t,) for t in terms], "w string"), "w").collect()
    assert sorted(map(tuple, out)) == sorted((t, w) for t in texts if t for w in terms if w and w in t)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = spark.createDataFrame([(1, "cat"), (1, "cat s"), (1, "cat"), (2, "ab"), (2, "")], "query_id int, term string")
    got = {(r.query_id, r.doc_id): r.score for r in text.grep_scores(asked, docs, "id", "t").collect()}
    assert got == {(1, 0): 2.0, (1, 1): 1.0, (1, 6): 2.0, (2, 4): 1.0}


def test_routes_gates_and_ranks(spark):
    frame = spark.createDataFrame
    requests, routes = frame([(1, "risk"), (1, "other"), (2, "risk")], "doc int, intent string"), frame([("risk", 0, "risks"), ("risk", 1, "summary")], "intent string, position int, section string")
    spans = frame([(1, "risks", 5, 9), (1, "summary", 1, 2), (2, "summary", 1, 4)], "doc int, section string, start int, end int")
    out = sorted(tuple(r) for r in documents.routed_sections(requests, routes, spans, ["business", "summary"]).collect())
    assert out == [(1, "other", 1, "summary", 1, 2), (1, "risk", 0, "risks", 5, 9), (1, "risk", 1, "summary", 1, 2), (2, "risk", 1, "summary", 1, 4)]
    queries = frame([("a", "pipeline"), ("b", "finance")], "name string, section string")
    gate = {(r.name): (r.gate, r.score_scale) for r in documents.gated_queries(queries, ["pipeline"], F.lit(False), skip=False).collect()}
    assert gate == {"a": ("downweight", 0.15), "b": ("active", 1.0)}
    assert [r.gate for r in documents.gated_queries(queries, ["pipeline"], F.lit(False), skip=True).orderBy("name").collect()] == ["skipped", "active"]
    hits = frame([(1, True, "summary", 9.0, 1), (2, True, "appendix", 1.0, 1), (3, False, "appendix", 99.0, 1), (4, True, "appendix", 1.0, 3)], "id int, body boolean, role string, score double, span int")
    ranked = documents.composite_rank(hits, [], F.col("body"), F.col("role"), "score", F.col("span"), ["id"]).orderBy("rank").collect()
    assert [r.id for r in ranked] == [4, 2, 1, 3]
    quality_rows = documents.section_map_quality(spans, frame([("risks",), ("summary",), ("business",)], "section string"), frame([(1, 10), (2, 8), (3, 0)], "doc int, n_pages int")).orderBy("doc").collect()
    assert [tuple(r) for r in quality_rows] == [(1, 2, 1, 7, 0.7), (2, 1, 2, 4, 0.5), (3, 0, 3, 0, None)]
    ratios = documents.derived_ratios(frame([("a", "total_assets", 200.0), ("a", "total_liabilities", 50.0), ("b", "revenue", 0.0), ("b", "net_profit", 1.0)], "k string, m string, v double"), ["k"], "m", "v").orderBy("k").collect()
    assert [tuple(r) for r in ratios] == [("a", 25.0, None), ("b", None, None)]


def test_joins_side_by_side_and_in_order(spark):
    frame = spark.createDataFrame
    a, b = frame([(1, "x"), (1, "y"), (2, "z")], "k int, a string"), frame([(1, "p"), (3, "q")], "k int, b string")
    out = sorted((r.k, r.place, r.a, r.b) for r in joins.side_by_side(a, b, ["k"], ["a"], ["b"]).collect())
    assert out == [(1, 0, "x", "p"), (1, 1, "y", None), (2, 0, "z", None), (3, 0, None, "q")]
    first = joins.first_of_groups([frame([(1, "late")], "k int, v string"), frame([(1, "b"), (2, "b"), (2, "a")], "k int, v string")], ["k"], ["v"]).orderBy("k").collect()
    assert [(r.k, r.v, r.group) for r in first] == [(1, "late", 0), (2, "a", 1)]
    both = joins.predictions_with_labels(frame([(1, 1), (2, 0), (3, 1)], "id int, p int"), frame([(1, 1), (2, 1), (4, 0)], "id int, y int"), "id", "p", "y").first()
    assert tuple(both) == (2, 1, 1, 1)


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("12%", "12.5"), ("abc", " ABC "), ("1", "0"), ("0", "0"), ("", "")], "p string, g string")
    assert [r.x for r in rows.select(metrics.relaxed(F.col("p"), F.col("g")).alias("x")).collect()] == [True, True, False, True, True]
    assert [round(r.x, 3) for r in rows.select(metrics.anls(F.col("p"), F.col("g")).alias("x")).collect()] == [0.5, 1.0, 0.0, 1.0, 1.0]
    none = metrics.binary(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert none.precision is None and none.recall == 0.0 and none.accuracy == 0.5
    assert one(spark, metrics.iou([F.lit(0)] * 4, [F.lit(0)] * 4)) is None
    pair = metrics.paired(spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "i int, ok boolean"), "i", "ok").first()
    assert (pair.accuracy, pair.accuracy_plus) == (0.75, 0.5)
    bleu = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "k int, c string, r string")
    assert abs(metrics.bleu4(bleu, "k", "c", "r").first().bleu4 - 1.0) < 1e-9
    assert metrics.best_of(F.lit("x"), "g", metrics.exact) is not None


def test_text_helpers(spark):
    assert one(spark, text.query_terms(F.array(F.lit("z")), F.lit("ab c ab 加盟模式"), ["加盟", "xx"])) == ["z", "ab", "加盟模式", "加盟"]
    assert one(spark, text.tokens(F.lit("Ab-1 加盟é"))) == ["ab", "1", "加", "盟"]
    assert one(spark, text.all_groups_hit(F.lit("net assets and cash"), [["cash", "x"], ["assets"]])) is True and one(spark, text.all_groups_hit(F.lit("cash"), [["cash"], ["assets"]])) is False
    assert one(spark, text.label_row(F.lit("Total assets (5)"), "Total assets")) is True and one(spark, text.label_row(F.lit("No Total assets"), "Total assets")) is False
    grades = quality.graded(spark.createDataFrame([(9.0, False), (9.0, True), (1.0, False)], "s double, bad boolean"), [(F.col("s") > 5, 10.0)], [(F.col("bad"), "C")], [(10.0, "A"), (5.0, "B")], "D")
    assert [r.grade for r in grades.collect()] == ["A", "C", "D"]


def test_documents(spark):
    from tidemark.operators import documents

    toc = spark.createDataFrame([(1, "Contents\nBusiness ........ 12\nFinancial Information……… 318\nnot an entry 7\n"), (2, None)], "doc int, text string")
    assert [tuple(r) for r in documents.toc_entries(toc, "doc", "text").collect()] == [(1, 0, "Business", 12), (1, 1, "Financial Information", 318)]
    pairs = spark.createDataFrame([(1, 21, 12), (1, 327, 318), (1, 50, 40)], "doc int, found int, printed int")
    assert documents.page_offset(pairs, "doc", "found", "printed").first().offset == 9
    anchors = spark.createDataFrame([(1, 3, "a", "header", 20), (1, 4, "a", "header", 20), (1, 4, "b", "title", 20), (1, 9, "b", "title", 20), (1, 12, "a", "title", 20), (1, 12, "c", "title", 20)], "doc int, page int, section string, kind string, last int")
    spans = {r.section: (r.start, r.end, r.pages, r.confidence) for r in documents.section_spans(anchors, "doc", "page", "section", "kind", "last").collect()}
    assert spans == {"a": (3, 8, 2, 0.95), "b": (9, 20, 1, 0.8)}
    sums = documents.complete_sum(spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, None), (3, 5.0)], "k int, v double"), ["k"], "v")
    assert {r.k: r.total for r in sums.collect()} == {1: 3.0, 2: None, 3: None}
    table = documents.report(spark.createDataFrame([(1, None), (2, "a|b")], "n int, t string").orderBy("n"), "Rows", ["n", "t"])
    assert table.splitlines()[2:] == ["| n | t |", "| --- | --- |", "| 1 | — |", "| 2 | a\\|b |"]
    assert one(spark, documents.adjusted(F.lit(1.0), [(F.lit(True), 2.0), (F.lit(None).cast("boolean"), 5.0)])) == 3.0


def test_spans_and_points(spark):
    points = spark.createDataFrame([(1, 5), (1, 200), (1, 99), (2, 5), (1, None)], "doc int, page int")
    spans = spark.createDataFrame([(1, 1, 98, "a"), (1, 100, 300, "b"), (1, 9, 8, "empty")], "doc int, start int, stop int, name string")
    out = {(r.doc, r.page): r.name for r in joins.points_in_spans(points, "page", spans, "start", "stop", ["doc"]).collect()}
    assert out == {(1, 5): "a", (1, 200): "b", (1, 99): None, (2, 5): None, (1, None): None}
    clusters = islands.interval_clusters(spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 5, 6), (1, 8, 9), (2, 1, 1)], "k int, lo int, hi int"), ["k"], "lo", "hi")
    assert sorted((r.k, r.lo, r.cluster) for r in clusters.collect()) == [(1, 1, 0), (1, 2, 0), (1, 5, 0), (1, 8, 1), (2, 1, 0)]
    names = spark.createDataFrame([(1, 0, "2024"), (1, 1, "2024"), (1, 2, "2025")], "d int, pos int, y string")
    assert [r.s for r in names.select("pos", islands.suffixed(names, ["d"], "pos", "y").alias("s")).orderBy("pos").collect()] == ["2024", "2024_i1", "2025"]


def test_vector_scores_of_many_queries(spark):
    """More queries than a block has: every query meets every vector."""
    from tidemark.operators import text

    v = spark.range(600).selectExpr("id", "array(cast(id % 7 as double), cast(id % 11 as double), 1D) AS e")
    out = text.vector_scores(v, v.where("id < 20"), "id", "id", "e").collect()
    units = {i: (i % 7, i % 11, 1) for i in range(600)}
    units = {i: [x / sum(y * y for y in u) ** 0.5 for x in u] for i, u in units.items()}
    truth = {(q, d): sum(a * b for a, b in zip(units[q], units[d], strict=True)) for q in range(600) for d in range(20)}
    assert len(out) == len(truth) and all(abs(r.score - truth[r.query_id, r.doc_id]) < 1e-9 for r in out)
