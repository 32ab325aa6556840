"""Statements: periods and series of odd tables, held against a loop over rows and labels."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import html_tables
from tidemark.operators import statements

LABELS = {"IS": {"REV": ["收入", "收益"], "OTHER_INCOME": ["其他收入及收益"], "COGS": ["銷售成本"], "CFO": ["經營活動所得／（所用）"]}, "BS": {"TOTAL_ASSETS": ["資產總值", "資產總值合計"], "TOTAL_LIAB": ["負債總額"], "NET_ASSETS": ["權益總額"]}}
REJECT = {"REV": ["其他收入", "其他收益"], "TOTAL_ASSETS": ["減"]}
DEFAULT = ["2021", "2022", "2023"]


def test_periods(spark):
    cases = [
        ([["千元", "2023", "2024", "2024", "2025"]], ["2023", "2024", "2024_i1", "2025_i1"]),
        ([["", "2023年", "2024年", "截至2024年8月31日止八個月", "截至2025年8月31日止八個月"]], ["2023", "2024", "2024_i1", "2025_i1"]),
        ([["附註", "於12月31日", "於8月31日"], ["", "2023年", "2024年", "2025年"]], ["2023", "2024", "2025_i1"]),
        ([["no", "years"]], []), ([], []), ([["2023", "2024"]], []),
        ([["2022", "2023", "2023", "2024", "2025"]], ["2022", "2023", "2023_i1", "2024", "2025_i1"]),
        ([["2023", "2024", "2024", "2024"]], ["2023", "2024", "2024_i1", "2024_i2"]),
        ([["2023 中期", "2023", "2024"]], ["2023_i1", "2023_i2", "2024_i1"]),
        ([[]] * 8 + [["2021", "2022", "2023"]], []),  # beyond the eighth row
    ]
    df = spark.createDataFrame(list(enumerate(r for r, _ in cases)), "i int, rows array<array<string>>")
    out = {r.i: r.p for r in df.select("i", statements.periods(F.col("rows")).alias("p")).collect()}
    assert out == {i: p for i, (_, p) in enumerate(cases)}


def loop_score(name, labels, rejected, whole):
    name = re.sub(r"[.．…⋯]+$", "", name.strip()).strip()
    if not name or any(w in whole for w in rejected):
        return 0
    return max(100 if name == x else 90 if name.replace(" ", "") == x else (80 if len(name) <= len(x) + 4 else 50) if name.startswith(x) else 0 for x in labels)


def loop_number(text):
    text = text.replace(",", "").replace(" ", "")
    try:
        return -float(text[1:-1]) if text[:1] == "(" and text[-1:] == ")" else float(text)
    except ValueError:
        return None


def loop_cells(row):
    dashes = {"–", "-", "—", "N/A", "n/a", "NA"}
    found = [(c in dashes, loop_number(c)) for c in row[1:] if c and not re.fullmatch(r"\d{1,2}", c)]
    return [None if dash else v for dash, v in found if dash or v is not None]


def loop_series(text, labels, rejected, periods):
    rows = html_tables.rows(text)
    best = (0, [])
    for i, row in enumerate(rows):
        score, numbers = loop_score(row[0], labels, rejected, row[0]), loop_cells(row)
        if score and not numbers and i + 1 < len(rows) and re.search("淨額|净额|现金净额|現金淨額", rows[i + 1][0]):
            numbers, score = loop_cells(rows[i + 1]), max(score, 85)
        if numbers and score > best[0]:
            best = (score, numbers)
    values = {p: (best[1][i] if i < len(best[1]) else None) for i, p in enumerate(periods)}
    if best[0] and any(v is not None for v in values.values()):
        return "row", values
    best = (0, [])
    for line in (x.strip() for x in text.splitlines()):
        head = re.split(r"\s{2,}|\t|(?=\d)", line, maxsplit=1)[0].strip() or line[:40]
        score = line and (loop_score(head, labels, rejected, line) or loop_score(line[:48], labels, rejected, line))
        if score:
            after = line[max(len(x) if line.startswith(x) else 0 for x in labels) :]
            found = [loop_number(n) for n in re.findall(r"\(?-?[\d,]+(?:\.\d+)?\)?", after) if not re.fullmatch(r"\d{1,2}", n)]
            found = [n for n in found if n is not None]
            total = score * 10 + len(found) + min(abs(found[0]) / 1e6, 50) if found else 0
            if len(found) >= 3 and total > best[0]:
                best = (total, found)
    return ("line", {(periods[i] if i < len(periods) else f"p{i}"): v for i, v in enumerate(best[1])}) if best[0] else None


def test_series_are_the_loop(spark):
    rng = random.Random(7)
    names = ["收入", "收 入", "收入．．．", "收益淨額", "其他收入及收益", "收入其他收益", "銷售成本", "銷售成本及其他一切開支", "經營活動所得／（所用）", "現金流量淨額", "資產總值", "資產總值合計", "資產總值減流動負債", "負債總額", "負 債總額", "非流動負債總額", "權益總額", "", "附註", "12"]
    cell = lambda: rng.choice(["", "–", "-", "N/A", "7", "12", "1,234", "(5,678.5)", "3.25", "words", "2,000", "100", "(x)", "1 000"])
    docs = []
    for i in range(120):
        rows = [[rng.choice(names), *(cell() for _ in range(rng.randrange(6)))] for _ in range(rng.randrange(14))]
        if rng.random() < 0.7:
            rows.insert(0, ["", "2022年", "2023年", "2024年"])
        if rng.random() < 0.5:
            text = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        else:
            text = "\n".join(rng.choice([" ", "  ", "\t", ""]).join(r) if rng.random() < 0.9 else "".join(r) for r in rows)
        docs.append((i, rng.choice(["IS", "BS"]), text))
    df = spark.createDataFrame([*docs, (1000, "IS", None), (1001, "XX", "收入 1,000 2,000 3,000")], "doc int, code string, text string").repartition(3)
    truth = {}
    for doc, code, text in docs:
        periods = ["2022", "2023", "2024"] if "2022年" in text and any(len([c for c in r if re.search(r"20\d\d", c)]) >= 3 for r in html_tables.rows(text)[:8]) else DEFAULT
        for metric, labels in LABELS[code].items():
            if found := loop_series(text, labels, REJECT.get(metric, ()), periods):
                truth |= {(doc, metric, p): (found[0], v) for p, v in found[1].items()}
    out = statements.metric_series(df, "doc", LABELS, REJECT, DEFAULT).collect()
    assert {(r.doc, r.metric, r.period): (r.source, r.value) for r in out} == truth and len(out) == len(truth) > 200
    assert {r.source for r in out} == {"row", "line"} and all(r.evidence and r.label for r in out)


def test_metrics_reconcile(spark):
    series = [(1, "TOTAL_LIAB", "a", 3.0), (1, "NET_ASSETS", "a", 7.0), (2, "TOTAL_ASSETS", "a", 5.0), (2, "TOTAL_LIAB", "a", 3.0), (2, "NET_ASSETS", "a", 7.0), (3, "TOTAL_ASSETS", "a", 10.5), (3, "TOTAL_LIAB", "a", 3.0), (3, "NET_ASSETS", "a", 7.0),
              (4, "TOTAL_ASSETS", "a", 20.0), (4, "TOTAL_LIAB", "a", 3.0), (4, "NET_ASSETS", "a", 7.0), (5, "TOTAL_ASSETS", "a", 4.0), (5, "NET_ASSETS", "a", 7.0), (6, "TOTAL_ASSETS", "a", 0.0), (6, "X", "a", 4.0), (6, "Y", "a", 5.0), (7, "X", "a", 4.0),
              (8, "REV", "a", 5.0), (8, "OTHER_INCOME", "a", 5.0), (8, "REV", "b", None), (9, "REV", "a", 8.0), (9, "OTHER_INCOME", "a", 5.0), (9, "GP", "a", 3.0), (10, "GP", "a", 3.0), (10, "REV", "a", 0.0)]
    df = spark.createDataFrame(series, "doc int, metric string, period string, value double")
    out = {(r.doc, r.metric): (r.value, r.origin) for r in statements.statement_metrics(df, "doc", ["X", "Y"], ["V", "W"]).collect()}
    assert {d: out.get((d, "TOTAL_ASSETS")) for d in range(1, 8)} == {1: (10.0, "reconciled"), 2: (10.0, "reconciled"), 3: (10.5, "read"), 4: (10.0, "reconciled"), 5: (4.0, "read"), 6: (9.0, "parts"), 7: None}
    assert (8, "REV") not in out and out[9, "REV"] == (8.0, "read") and out[9, "GP_MARGIN"] == (37.5, "derived") and (10, "GP_MARGIN") not in out


def test_field_pairs(spark):
    html = "<table><tr><td>Issue price：</td><td> 5.5 </td><td>Lot size</td><td>100</td></tr><tr><td>Other</td><td>x</td><td>odd</td></tr><tr><td>Issue price</td><td>7</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "Lotsize: 5"), (3, None), (4, "<table><tr><td>alone</td></tr><tr><td>Lot size</td><td></td></tr></table>")], "page int, html string")
    out = statements.field_pairs(df, "page", "html", {"price": ["Issueprice"], "lot": ["Lotsize"]}).collect()
    assert {(r.page, r.field): (r.value, r.position) for r in out} == {(1, "price"): ("5.5", 0), (1, "lot"): ("100", 0), (2, "lot"): ("5", 0)}


def test_few_labels_make_no_row_for_each_beginning(spark, monkeypatch):
    """Names are held against the labels of their code where they lie, and give what the joins on beginnings give."""
    from tidemark.plans.statements import metric_extraction

    rng = random.Random(2)
    parts = ["收入", "收 入", "收益", "其他收入及收益", " ", "…", "．", "淨額", "及其他", "　", "\xa0", "資產總值", "合計", "負 債總額", "(1,234.5)", "2,000", "-5", "12", "x", "(", "\n", "\r\n", "  ", "\t", "1 000 ", "3.5 "]
    texts = [(i, rng.choice(["IS", "BS"]), "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(150)]
    df = spark.createDataFrame([*texts, (900, "IS", None), (901, None, "收入 1,000 2,000 3,000"), (902, "IS", "收入 1,000 2,000 3,000")], "doc int, code string, text string").repartition(3)
    labels = LABELS | {"IS": LABELS["IS"] | {"BOTH": ["收 入", "收入", "收", "收"]}}
    rows = lambda: sorted(map(repr, statements.metric_series(df, "doc", labels, REJECT, DEFAULT).collect()))
    few = rows()
    assert len(few) > 90
    plan = metric_extraction(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in plan and plan.count("Aggregate [_key") == 1
    monkeypatch.setattr(statements, "FEW_LABELS", 0)
    assert rows() == few
