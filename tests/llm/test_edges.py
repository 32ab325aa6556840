"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import re
import uuid

import pytest

from tidemark.llm import exact_dedup, html_extract, language_id, license_scan, line_dedup, minhash_dedup, mixing, packing, topk_search, warc
from tidemark.llm.shared import scratch_dir

EXTRA = "row string, text_sha256 string, chunks int, key int, rep int, block int, words int, _gone int, p int, slot int, lines int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "wort um wort geht es weiter und weiter. " * 6000
TEXTS = [(1, "same text here", "en", "a"), (2, "same text here", "en", None), (None, "same text here", "en", "a"), (3, None, None, "b"), (4, "", "de", "b"), (5, LONG, "de", "c"), (5, LONG, "de", "c"), (None, None, None, None), (6, "12345 !!!", "en", "a"), (7, " \n\n ", "en", "a"), (8, "Été à la plage.\nÉté à la plage.", "fr", "a")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "y", 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t, l, s in rows], DOCS)


OPERATORS = {
    "language_id": language_id.language_id,
    "drop_rejected": language_id.drop_rejected,
    "line_dedup": line_dedup.line_dedup,
    "without_repeated_lines": line_dedup.without_repeated_lines,
    "exact_dedup": exact_dedup.exact_dedup,
    "license_scan": license_scan.license_scan,
    "packing": packing.best_fit_packing,
    "minhash_dedup": minhash_dedup.minhash_dedup,
    "one_of_each_group": minhash_dedup.one_of_each_group,
    "mixed": mixing.mixed,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](docs(spark)).collect()
    assert len(out) > 0
    if name in ("language_id", "line_dedup", "exact_dedup", "license_scan", "minhash_dedup"):
        assert len(out) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).collect() == []


def test_exact_dedup_defined_results(spark):
    out = exact_dedup.exact_dedup(docs(spark)).collect()
    same = [r for r in out if r.keep_id == 2]
    assert {r.doc_id for r in same} == {1, 2, None} and all(r.group_size == 3 for r in same) and sum(r.kept for r in same) == 1
    empty = [r for r in out if r.keep_id == 4]
    assert len(empty) == 3 and all(r.group_size == 3 for r in empty)  # "", null, and null with a null id
    assert [r.kept for r in out if r.doc_id == 5] == [True, True]  # repeated rows of the id that stays


def test_exact_dedup_digest_clashes(spark):
    from pyspark.sql import functions as F

    rows = [(1, "alpha", "en", "a"), (2, "gamma", "en", "a"), (3, "alpha", "en", "a")]
    out = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs(spark, rows), digest=lambda c: F.length(c).cast("long")).collect()}
    assert out == {1: 3, 3: 3, 2: 2}


def test_exact_dedup_chunks_join_to_the_text(spark):
    from pyspark.sql import functions as F

    text = "Ein Satz. " * 300 + "x" * 20000 + "\n" + "ende"
    row = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first()
    assert "".join(row.c) == text and max(map(len, row.c)) <= exact_dedup.MAX_CHUNK and len(row.c) > 4


def test_line_dedup_defined_results(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [
        (1, base + "\nother line", "en", "a"),
        (2, base.replace("five", "FIVE") + "\nkept line", "en", "a"),  # replaced
        (3, base.replace("five ", "") + "\n", "en", "a"),  # taken out: nine words, below the least
        (4, base + " eleven", "en", "a"),  # put in
        (5, "other line\n\nother line", "en", "a"),
        (6, base.replace("one", "uno").replace("ten", "diez"), "en", "a"),  # two edits
    ]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert out[1].clean_text == rows[0][1] and out[2].clean_text == "kept line" and out[2].n_near == 1
    assert out[3].clean_text == rows[2][1] and out[4].clean_text == "" and out[4].n_near == 1
    assert out[5].clean_text == "" and out[5].n_kept == 1 and out[6].n_kept == 1


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, None), (8, [nan, 1.0]), (9, [None, 1.0]), (None, [9.0, 9.0]), (10, [0.25]), (11, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, slot int, block int, low int")
    out = [tuple(r) for r in topk_search.top_k(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()]
    assert out[:5] == [(0, k, k, 65536) for k in range(1, 6)]
    assert out[5:] == [(50, 1, 0, 32768), *((50, k, k - 1, 32768) for k in range(2, 6))]
    few = topk_search.top_k(df.where("vec_id in (0, 10, 11)"), lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(10, 16384), (11, 0)]
    assert topk_search.top_k(df.limit(0), lambda i: i % 50 == 0).collect() == []


def test_warc_edges(spark):
    rows = [(1, "http://a", "x\r\n\r\nWARC/1.1\r\n"), (2, None, "x\r\n\r\nWARC/1.1\r\n"), (3, "http://c\n", None), (4, "http://d", ""), (None, "http://e", "ü"), (5, "http://f", "ü"), (5, "http://f", "ü"), (0, "http://g", LONG)]
    df = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows], "page_id long, url string, html string, record int, sha256 int")
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = warc.warc_dedup(df, path).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out}
    assert by_id[2].record_type == "revisit" and by_id[2].refers_to == 1 and by_id[2].payload_bytes == 15
    assert by_id[4].refers_to == 3 and by_id[3].record_type == "response" and by_id[3].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert [r.record_type for r in out if r.page_id == 5] == ["response"] * 2 and by_id[None].record_type == "response"
    back = {r.page_id: r.html for r in warc.read_archives(spark, f"{path}/raw").collect()}
    assert back[1] == rows[0][2] and back[0] == LONG
    assert all(r.record_type == "response" for r in warc.warc_dedup(df, path + "-20", least_bytes=20).collect())
    assert warc.warc_dedup(df.limit(0), path + "-none").collect() == []


def test_warc_headers(spark, monkeypatch):
    """What the deduplicated archives say of a revisit, however few bytes a file may have, and without digests in the headers."""
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 8)
    df = spark.createDataFrame([(2, "http://b/x y", "same"), (1, "http://a/", "same"), (3, "http://c/", "other")], "page_id long, url string, html string").coalesce(1)
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.warc_dedup(df, path)
    import gzip

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/dedup").collect()
    assert len(files) >= 2
    heads = {h["warc-page"]: (h, block) for f in files for h, block in warc.records(gzip.decompress(f.content))}
    revisit, first = heads["2"][0], heads["1"][0]
    assert revisit["warc-type"] == "revisit" and heads["2"][1] == b"" and revisit["warc-target-uri"] == "http://b/x%20y"
    assert revisit["warc-refers-to"] == first["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://a/" and revisit["warc-payload-digest"] == first["warc-payload-digest"]
    raw = {r.page_id: r for r in warc.read_archives(spark, f"{path}/raw").collect()}
    assert revisit["warc-refers-to-date"] == raw[1].date and raw[2].sha256 == raw[1].sha256 and "2000-01-01T00:00:00Z" < first["warc-date"]
    again = {r.page_id: r.sha256 for r in warc.read_archives(spark, f"{path}/raw", hashed=False).collect()}
    assert again == {i: r.sha256 for i, r in raw.items()}


def test_html_edges(spark):
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div><main><h1>Head</h1><p>First &amp; long paragraph with   many words in it.<br>Next<p>Second paragraph, unclosed <b>bold<script>var x='</p>'</script></main><section id=comments><p>A reader says something rather long here, too long.</section><footer>Foot</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (None, "u", "<p>one</p>"), (5, "u", "<nav>only menu</nav>")]
    out = {r.page_id: r for r in html_extract.html_extract(spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows], "page_id long, url string, html string, text int, n_chars int")).collect()}
    assert out[1].text == "Head First & long paragraph with many words in it. Next Second paragraph, unclosed bold"
    assert out[2].text == "" and out[3].text == "" and out[4].text == "plain text" and out[None].text == "one" and out[5].text == ""
    assert out[1].n_chars == len(out[1].text)


def test_html_keeps_every_content_section():
    """Shorter blocks and articles beside a longer one, and wrappers whose class only mentions a sidebar or comments."""
    long, short = "many words of a long text " * 120, "other words of a second text " * 14
    both = " ".join(f"{long}{short}".split())
    assert html_extract.main_text(f"<body><div><div>{long}</div><div>{short}</div></div></body>") == both
    assert html_extract.main_text(f"<body><article><p>{long}</article><article><p>{short}</article></body>") == both
    for name in ("main has-sidebar", "post comments-open", "with-sidebar"):
        assert html_extract.main_text(f"<body><div class='{name}'><p>{long}<p>{short}</div></body>") == both
    for name in ("sidebar", "sidebar-left", "cookie-notice", "site-footer", "ad"):
        assert html_extract.main_text(f"<body><div><p>{long}</div><div class='{name}'>{short}</div></body>") == " ".join(long.split())


def test_html_wrappers_and_broken_markup():
    """Names that only mention what they hold, a page within one form, unclosed marked paragraphs, blocks and tables on their own."""
    long = " ".join("many words of a long text".split() * 40)
    get = html_extract.main_text
    assert get(f"<body><div class='content has-sidebar'><p>{long}</p></div></body>") == long
    assert get(f"<body><div class='entry'><div class='entry-header'><h1>Title</h1></div><p>{long}</p></div></body>") == f"Title {long}"
    assert get(f"<body><form id=aspnetForm><div><h1>Title</h1><p>{long}</p></div></form><form><p>Your name</p><input></form></body>") == f"Title {long}"
    assert get(f"<body><form id=aspnetForm><div><p>{long}</p></div></form></body>") == long
    assert get(f"<body><p class=promo>Buy now<div><p>{long}</p></div></body>") == long
    cells = "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(30))
    text = " ".join(f"{i} v{i}" for i in range(30))
    assert get(f"<body><div><p>{long}</p><table>{cells}</table><p>{long}</p></div></body>") == f"{long} {text} {long}"
    blocks = "".join(f"<div>{x}</div>" for x in (long, "Yes.", "No.", "Why?", "So.", "I see.", "Go on.", "Well.", long))
    assert get(f"<body><div>{blocks}</div></body>") == f"{long} Yes. No. Why? So. I see. Go on. Well. {long}"
    assert get("<b>" * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000).startswith("x x x")
    assert get(f"<div><p>{long}</p></div>" * 2) == f"{long} {long}" and get(f"<p>{long}" * 3_000).count("many") == 120_000


def test_html_by_ratio_alone():
    """Pages without any telling element, class or id: what is a menu, a footer or a list of links is told by the ratio alone."""
    paragraph = "this is a paragraph of some length that tells the reader what the page is about and then goes on"
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(8))
    decided = 0
    for n in range(1, 6):
        for inner in ("p", "div"):
            body = "".join(f"<{inner}>{paragraph} {i}</{inner}>" for i in range(3 * n))
            page = f"<body><div>{menu}</div><div><h1>A heading</h1>{body}</div><div><span>(c)</span> <a href=/a>About</a> <a href=/b>Terms</a></div><div>{menu}</div></body>"
            text = html_extract.main_text(page)
            assert text == " ".join(["A heading", *(f"{paragraph} {i}" for i in range(3 * n))])
            decided += text != " ".join(re.sub("<[^>]*>", " ", page).split())
    assert decided == 10


def test_license_edges(spark):
    rows = [(1, "Released under the MIT License. under the mit license", "en", "a"), (2, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nCC BY-NC", "en", "a"), (3, None, "en", "a"), (4, "// SPDX-License-Identifier: MIT AND\n", "en", "a")]
    out = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels, out[1].labels) == (9, 2, 1, 5, "mit", "mit")
    assert out[2].labels == "apache-2,cc-by-nc,gpl-2.0-with-classpath-exception-2.0,mit" and out[2].permissive is False
    assert (out[3].n_words, out[3].n_base, out[3].first_word, out[3].labels, out[3].score) == (0, 0, None, "", 0.0)
    assert out[4].labels == "unparsed-expression"


@pytest.mark.parametrize(("text", "labels", "permissive"), [
    ("SPDX-License-Identifier: MIT.", "mit", True),
    ("<!-- SPDX-License-Identifier: MIT-->", "mit", True),
    ("/* SPDX-License-Identifier: GPL-2.0+ */", "gpl-2.0+", False),
    ("SPDX-License-Identifier: (Apache-2.0 OR MIT).", "apache-2,mit", True),
    ("SPDX-License-Identifier: LicenseRef-own:x-", "licenseref-own:x", False),
    ("This is free and unencumbered software released into the public domain.", "public-domain,unlicense", True),
    ("CC BY-NC-ND 4.0", "cc-by-nc,cc-by-nc-nd", False),
    ("CC BY 4.0, Creative Commons Attribution-ShareAlike", "cc-by,cc-by-sa", False),
    ("x " * 300_000 + "Boost Software License", "bsl", True),
    ("SPDX-License-Identifier: MIT and may be used by you", "mit", True),
    ("SPDX-License-Identifier: MIT and file an issue", "mit", True),
    ("SPDX-License-Identifier: MIT or (at your option) others", "mit", True),
    ('SPDX-License-Identifier: "MIT"', "mit", True),
    ('{"SPDX-License-Identifier": "Apache-2.0 OR MIT"}', "apache-2,mit", True),
    ("SPDX-License-Identifier: see the file", "unparsed-expression", None),
    ("SPDX-License-Identifier: Foo-1.1 with Foo-exception", "foo-1.1-with-foo-exception", False),
    ("GNU GPL v3", "gpl", False),
    ("under GPLv2, LGPL-2.1-only", "gpl,lgpl", False),
    ("GPL-3.0-or-later", "gpl", False),
    ("AGPL-3.0", "agpl", False),
])
def test_license_labels(text, labels, permissive):
    """Identifiers without the marks that follow them, notices of other licences, the end of a very long text."""
    found = dict(zip([c.split()[0] for c in license_scan.SCHEMA.split(", ")][1:], license_scan.scan(text, license_scan._automaton()), strict=True))
    assert (found["labels"], found["permissive"]) == (labels, permissive)


def test_shunting_yard():
    ev = lambda e: license_scan.evaluate(license_scan.postfix(e))
    assert license_scan.postfix("a or b and c") == ["a", "b", "c", "and", "or"]
    assert ev("MIT or GPL-3.0 and GPL-2.0")[1] is True and ev("(MIT or GPL-3.0) and GPL-2.0")[1] is False
    assert license_scan.postfix("mit or (bsd") is None and license_scan.postfix("") is None and license_scan.postfix("mit) more") == ["mit"]


def test_odd_rows_language_id(spark):
    out = language_id.language_id(docs(spark)).collect()
    und = [r for r in out if r.doc_id in (3, 4, 6, 7)] + [r for r in out if r.doc_id is None and r.lang_pred == "und"]
    assert len(und) == 5 and all((r.lang_pred, r.score) == ("und", 0.0) for r in und)  # null, empty, no letter; null id with null text
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in out)
    same = [(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2)]
    assert same[0] == same[1] and len({(r.lang_pred, r.score) for r in out if r.doc_id == 5}) == 1


def test_odd_rows_minhash(spark):
    out = minhash_dedup.minhash_dedup(docs(spark)).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None}
    assert by_id == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (8, 5, True), 6: (1, 6, True), 7: (0, 7, True), 8: (4, 8, True)}
    assert [r.component_id for r in out if r.doc_id == 5] == [5, 5]


def test_odd_rows_packing(spark):
    out = packing.best_fit_packing(docs(spark)).collect()
    of = lambda i: sorted((r.piece, r.start, r.length) for r in out if r.doc_id == i)
    assert of(3) == of(4) == [(0, 0, 1)] and of(1) == of(2)  # null and empty texts: the closing id alone
    twice = of(5)
    assert twice == sorted(twice[::2] * 2) and all(n == packing.CAPACITY for _, _, n in twice[:-2]) and [s for _, s, _ in twice[::2]] == [packing.CAPACITY * k for k in range(len(twice) // 2)]
    assert sum(r.doc_id is None for r in out) == 2
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_odd_rows_mixed(spark):
    given = docs(spark)
    out = mixing.mixed(given)
    assert out.columns == given.columns and not given.exceptAll(out).count()  # clashing columns stay as they were, each row once at least
