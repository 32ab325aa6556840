"""Steps that used to make a row for each pair or n-gram: the same results without those rows."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions import html_tables
from tidemark.operators import best_documents, metrics, quality, ranges, text


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_bleu_counts_alone_and_pooled_keys(spark):
    rows = [(1, "a b c d e a", "a b c d x a"), (2, "q", "q"), (3, "a b c d", None), (4, None, "a b"), (None, "a b c d", "a b c d"), (5, "", "b")]
    schema = "k int, c string, r string"

    def slow(rows):
        hit, total, keys = [0] * 5, [0] * 5, {r[0] for r in rows}
        for k in keys:
            for n in range(1, 5):
                gram = lambda i: Counter(g for r in rows if r[0] == k and r[i] is not None for g in zip(*(r[i].split(" ")[j:] for j in range(n))))  # noqa: B023, E731
                c, r = gram(1), gram(2) if k is not None else Counter()
                hit[n] += (c & r).total()
                total[n] += c.total()
        sizes = [sum(len(r[i].split(" ")) for r in rows if r[i] is not None) for i in (1, 2)]
        mean = sum(math.log(hit[n] / total[n]) for n in range(1, 5)) / 4
        return (1 if sizes[0] >= sizes[1] else math.exp(1 - sizes[1] / sizes[0])) * math.exp(mean)

    for these in (rows, [*rows, (1, "x a b c d", "q x a b c d a")]):
        assert abs(metrics.bleu4(spark.createDataFrame(these, schema), "k", "c", "r").first().bleu4 - slow(these)) < 1e-12
    alone = metrics.bleu4(spark.createDataFrame(rows, schema), "k", "c", "r")
    assert "explode" not in _plan(alone)  # no row for an n-gram
    assert metrics.bleu4(spark.createDataFrame(rows[:1], schema).limit(0), "k", "c", "r").first().bleu4 == 0


def test_range_sums_are_those_of_pairs(spark):
    points = spark.range(400).selectExpr("CAST(id * id % 997 AS BIGINT) AS t", "IF(id % 11 = 0, NULL, id % 5) AS k", "CAST(IF(id % 7 = 0, NULL, id / 4) AS DECIMAL(20, 4)) AS v").union(spark.sql("SELECT NULL, 1, 5.0"))
    intervals = spark.range(80).selectExpr("id % 70 AS i", "id * 17 % 900 - 50 AS a", "id * 17 % 900 - 50 + id * id % 300 AS b", "IF(id % 9 = 0, NULL, id % 5) AS k").union(spark.sql("SELECT 99, NULL, 5, 1"))
    for keys in ([], ["k"]):
        mine = points if keys else points.drop("k")
        met = ranges.range_join(mine, "t", intervals, "a", "b", keys).groupBy("i").agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
        got = ranges.range_sums(mine, "t", intervals, "a", "b", {"n": F.lit(1).cast("long"), "v": F.col("v")}, "i", keys)
        assert {tuple(r) for r in got.where("n > 0").collect()} == {tuple(r) for r in met.collect()}


def test_events_before_errors_makes_no_pairs(spark, tmp_path):
    from tidemark.plans.jobs import events_before_errors

    start = 1_700_000_000
    rows = [(i, 1 if i % 2 else None, "error" if i % 3 == 0 else "view", [1.25, None, float("nan"), 2.5, 0.5][i % 5] if i > 9 else 1.5, start + i * 60) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.from_event: (r.n, r.own, r.total) for r in events_before_errors(spark, str(tmp_path)).collect()}
    want = {}
    for e, user, kind, value, at in rows:
        if kind == "error" and value is not None:
            span = float("inf") if math.isnan(value) else math.floor(value * 600)
            met = [r for r in rows if at - span < r[4] <= at] if span != float("inf") else []
            if met:
                values = [r[3] for r in met if r[3] is not None]
                want[e] = (len(met), sum(user is not None and r[1] == user for r in met), round(sum(values), 4) if values else None)
    drop_nan = lambda d: {k: tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in v) for k, v in d.items() if rows[k][3] is not None and not math.isnan(rows[k][3])}
    assert drop_nan(got) == drop_nan(want)
    assert "_level" not in _plan(events_before_errors(spark, str(tmp_path)))  # the step of pairs


def test_best_documents_are_those_of_all_pairs(spark, monkeypatch):
    words = "alpha alphabet beta gam gamma delta 中 中文 x1 Alpha".split()
    docs = [(i, None if i % 13 == 0 else " ".join(words[(i * j) % 10] for j in range(1, i % 7 + 1)) + ["", "\n" + "zalphaz" * (i % 3)][i % 2]) for i in range(120)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(q, w.lower(), 1 + q % 2) for q in range(6) for w in set(map(str.lower, words[q : q + 4]))] + [(7, "none", 1)]
    asked = spark.createDataFrame(asked, "query_id int, term string, n long")
    assert best_documents.possible(asked, docs, "doc_id") and not best_documents.possible(asked.withColumn("term", F.concat("term", F.lit(" a"))), docs, "doc_id")
    assert not best_documents.possible(asked, docs.union(spark.sql("SELECT NULL, 'a'")), "doc_id")
    monkeypatch.setattr(best_documents, "CELLS", 50)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", F.round("score", 6), "rank").collect())
    for k in (1, 4, 500):
        for near, far in ((best_documents.best_documents(docs, "doc_id", "text", k, grep=asked), text.grep_scores(asked, docs, "doc_id", "text")), (best_documents.best_documents(docs, "doc_id", "text", k, bm25=asked), text.bm25_scores(asked, docs, "doc_id", "text"))):
            assert rows(text.ranked(near, k)) == rows(text.ranked(far, k))
    empty = best_documents.best_documents(docs.limit(0), "doc_id", "text", 3, grep=asked, bm25=asked)
    assert empty.count() == 0
    assert best_documents.best_documents(docs.coalesce(1), "doc_id", "text", 4, grep=asked).count() <= 7 * 4  # a task gives the best only


def test_quartiles_without_all_values_in_a_task(spark, monkeypatch):
    tables = [[], [None], [3.0], [1.0, 2.0], [5.0] * 50 + [7.0], [float(i * i % 101) for i in range(400)] + [None, 1e300, -1e300], [float("nan"), 1.0, 2.0]]
    for accuracy, margin in ((10_000, 3), (10, 0)):
        monkeypatch.setattr(quality, "ACCURACY", accuracy)
        monkeypatch.setattr(quality, "MARGIN", margin)
        for rows in tables:
            df = spark.createDataFrame([(x,) for x in rows], "x double")
            want = df.agg(*(F.round(F.percentile("x", F.lit(p)), 4) for p in (0.25, 0.5, 0.75))).first()
            assert repr(tuple(quality.describe(df, "x").select("q25", "q50", "q75").first())) == repr(tuple(want))
    assert "percentile(" not in _plan(quality.describe(df, "x"))


def test_plain_tables_are_read_as_the_parser_reads_them(monkeypatch):
    draw = random.Random(1)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<br>", "<p>", "</p>", "a", " b\n c ", ">", "\u3000", "甲", ""]
    odd = ["&amp;", "<td colspan=2>", "<!-- x -->", "<TR>", "<b>", "<br/>", "< "]
    texts = ["<table>" + "".join(draw.choice(pieces + odd * (k % 2)) for _ in range(k % 30)) for k in range(3000)]
    fast = [html_tables.rows(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(html_tables, "PLAIN", frozenset())
        m.setattr(html_tables, "_plain_rows", None)
        assert fast == [html_tables.rows(t) for t in texts]
    monkeypatch.setattr(html_tables, "_Cells", None)  # plain tables do without the parser
    assert html_tables.rows("<table><tr><td>a<br>b</td><td>c</table>") == [["a b", "c"]]


def test_members_are_counted_without_sets_of_them(spark, tmp_path):
    from tidemark.plans.market import industry_basket_daily

    sf = "/root/testdata/sf0.001"
    for name in ("nation", "region", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    s.union(s.where("s_suppkey % 2 = 0")).write.parquet(f"{tmp_path}/supplier.parquet")  # repeated suppliers are one member
    members = lambda path: {(r.date, r.industry): r.n_members for r in industry_basket_daily(spark, path).collect()}
    assert members(str(tmp_path)) == members(sf)
    assert "distinct" not in _plan(industry_basket_daily(spark, sf)).lower()


def test_flags_are_made_once(spark):
    from tidemark.plans.documents import negative_findings

    optimised = negative_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("Relation [c_custkey") == 1  # customers are read once


def test_contents_pages_read_their_elements_once(spark):
    from tidemark.operators import sections

    rows = [(1, 1, 0, "title", "目錄"), (1, 2, 1, "text", "b ..... 2"), (1, 2, 0, "table", "a ..... 1"), (1, 3, 0, "text", "a ..... 1"), (1, 3, 1, "title", "b ..... 2"), (1, 4, 0, "text", None), (1, 5, 0, "header", "目錄"), (2, 1, 0, None, "x"), (2, 7, 0, "text", "x ..... 1\ny ..... 2")]
    elements = spark.createDataFrame(rows, "doc int, page int, position int, category string, text string")
    found = sections.contents_pages(elements)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (2, 7)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_by_labels_without_pieces_of_texts(spark):
    from tidemark.operators import driver

    rng = random.Random(5)
    words = ["Cash", "Cash flow", "Net", "x", "  Net", "Total\n  assets", "Total\nassets", "Cash\r", "", "\t\x0bCash", "a Cash", "Netto", "\n", " Cash flows"]
    labels, roles = ["Cash", "Cash flow", "Net", "Total\nassets", "", None, " Net", "Netto"], ["summary", "appendix", "other", None]
    queries = [("t", True, 2, 1.0, labels, ["x"]), ("u", True, 0, 0.3, ["Net", "x"], []), ("s", False, 9, 0.5, ["Net", "Cash"], []), ("off", False, 0, 0.0, ["Net"], [])]
    rows, number = [], 0
    for doc in range(25):
        for page in range(1, 13):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                number += 1
                rows.append((doc, number, page if rng.random() < 0.9 or number % 2 else None, rng.choice(["table", "table", "text", None]), rng.choice(roles), rng.choice([None, "\n".join(rng.choices(words, k=rng.randint(1, 4)))])))
    hits = [(doc, field, n, rng.choice([0.02, 0.05, 0.2]), source) for doc, n, *_ in rows for field in "tus" for source in ("grep", "bm25") if rng.random() < 0.15]
    chunks = spark.createDataFrame(rows, "doc int, chunk int, page int, category string, role string, text string")
    asked = spark.createDataFrame([q[:5] for q in queries], "field string, whole_table boolean, min_labels int, score_scale double, labels array<string>")
    found = driver.label_hits(chunks, asked)
    optimised = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimised(found).count("Join") == 1  # texts and their pieces are joined with nothing

    def stands(text, label):  # behind a line's white space; a label of white space stands nowhere
        lines = text.split("\n")
        return any("\n".join(lines[i:]).lstrip(" \t\n\x0b\f\r").startswith(label) for i in range(len(lines)))

    hit = {(d, f, n, w) for d, n, _, c, _, t in rows if c == "table" and t is not None for f, *_, own, _ in queries for w in own if w and stands(t, w)}
    assert {w for *_, w in hit} == {"Cash", "Cash flow", "Net", "Total\nassets", "Netto", "x"}
    assert sorted(map(tuple, found.collect())) == sorted(hit)

    truth, at, order = [], {n: r for r in rows for n in [r[1]]}, {"appendix": 3, "summary": 2}
    for field, whole, least, scale, *_ in queries[:3]:
        for doc in range(25):
            tables = {r[2] for r in rows if r[0] == doc and r[3] == "table"} - {None}
            met = []
            for n in (n for n, r in at.items() if r[0] == doc):
                own, said = {w for d, f, m, w in hit if (d, f, m) == (doc, field, n)}, [h for h in hits if h[:3] == (doc, field, n)]
                if own or said:
                    met.append((at[n][2], n, max([h[3] for h in said] + [0.08 + 0.02 * len(own)] * bool(own)) * scale, {h[4] for h in said} | ({"row_label"} if own else set()), own))
            if whole:
                end = lambda p: max(p + i for i in range(4) if all(p + j in tables for j in range(i + 1)))  # noqa: B023, E731
                met = [(p, n, s, c, end(p)) for p, n, s, c, _ in met if p is not None and at[n][3] == "table"]
                count = lambda p, last: len({w for d, f, m, w in hit if (d, f) == (doc, field) and at[m][2] is not None and p <= at[m][2] <= last})  # noqa: B023, E731
                packs, reach = [], 0
                for m in sorted((m for m in met if count(m[0], m[4]) >= least), key=lambda m: (m[0], -m[2], m[1])):
                    packs = packs if packs and m[0] <= reach else [*packs, []]
                    packs[-1].append(m)
                    reach = max(reach, m[4])
                out = [(p[0][0], max(m[4] for m in p), at[p[0][1]][4], max(m[2] for m in p), set().union(*(m[3] for m in p)), max(count(m[0], m[4]) for m in p)) for p in packs]
            else:
                pages = {q[0]: sorted((m for m in met if m[0] == q[0]), key=lambda m: (-m[2], m[1])) for q in met}
                out = [(p, p, at[m[0][1]][4], m[0][2], set().union(*(x[3] for x in m)), 0) for p, m in pages.items()]
            out.sort(key=lambda e: (-order.get(e[2], 0), -e[3], e[0] is None, (e[0] or 0) - (e[1] or 0), e[0] or 0))
            truth += [(doc, field, i, p, last, role, round(score, 9), sorted(sources), n) for i, (p, last, role, score, sources, n) in enumerate(out[: 3 if whole else 5], 1)]
    evidence = driver.field_evidence(spark.createDataFrame(hits, "doc int, field string, chunk int, score double, source string"), chunks, asked)
    ours = [(*r[:6], round(r.score, 9), *r[7:]) for r in evidence.collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, truth))

    from tidemark.plans.findings import agent_evidence

    assert optimised(agent_evidence(spark, "/root/testdata/sf0.001")).count("Relation [conv_id") == 3  # for hits, labels and packs
