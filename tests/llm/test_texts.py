import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskfabric.llm import fingerprint, html, licenses, quality, queries
from riskfabric.llm.license_texts import LICENSES

FOLDER = "/root/testdata/sf0.001"


def _likeness(a, b):
    a, b = (set(re.findall(r"[^\n]{1,128}", t)) for t in (a, b))
    return 1.0 if not a | b else len(a & b) / len(a | b)


def _check_fingerprints(rows, docs):
    got = {r.doc_id: r for r in rows}
    keys = sorted(docs)
    for i, k in enumerate(keys):
        text, following = docs[k], docs[keys[(i + 1) % len(keys)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - _likeness(text, edited)) < 1e-12 and abs(r.near_next - _likeness(text, following)) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (_likeness(text, edited) == 1.0)


def test_op10_equals_plain_sets(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op10_fingerprints(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    _check_fingerprints(rows, docs)


def test_fingerprint_edges(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(3000))
    docs = {1: "", 2: "a\nb\na", 5: "a\nb\na", 7: "one line", 9: long, 11: "é\n" * 9}
    table = spark.createDataFrame([(k, t or None, "clash") for k, t in docs.items()], "doc_id long, text string, row string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_fingerprints(spark, str(tmp_path)).collect()
    _check_fingerprints(rows, docs)
    assert {r.doc_id: r.fingerprint for r in rows}[2] == {r.doc_id: r.fingerprint for r in rows}[5]
    table.where("doc_id = 2").union(table.where("doc_id = 2")).unionByName(table.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/twice/documents.parquet")
    assert sorted((r.doc_id or 0, r.n_chars) for r in queries.op10_fingerprints(spark, f"{tmp_path}/twice").collect()) == [(0, 0), (2, 5), (2, 5)]
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_peeling_recovers_the_digests(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], [2, 3, 4, 5]), (2, [], []), (3, list(range(500)), list(range(250, 900)))], "k long, a array<long>, b array<long>")
    got = {r.k: (sorted(r.b_alone), sorted(r.b_new)) for r in fingerprint.compare(rows, "k", "a", ["b"]).collect()}
    assert got == {1: ([1], [4, 5]), 2: ([], []), 3: (list(range(250)), list(range(500, 900)))}


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="sidebar-left">
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><div class="ad">Buy this thing, it is good. Now, really.</div>
<!-- <p>comment</p> --><article><h1>Title &amp; more</h1><p><b>First&nbsp;words<br><p>Second   one,
with lines.</p><ul><li>item a<li>item b</ul><div class="share-bar">Share</div><p>Third.</p><form><p>Your mail</p></form></article>
<section id="comments"><p>I think, dear reader, that this is long enough to be content. Surely, yes.</p></section><aside><p>Aside text, long. Very long.</p></aside>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_pages():
    assert html.main_text(PAGE) == "Title & more\nFirst words\nSecond one, with lines.\nitem a\nitem b\nThird."
    plain = PAGE.replace("<article>", '<div class="text">').replace("</article>", "</div>")
    assert html.main_text(plain) == html.main_text(PAGE)
    named = '<div id=header><a href=/>Site</a></div><div id=content><h1>Head</h1><p>One, two and three. Four.</p><p>Short</p></div><div id=sidebar><p>Other, long text here.</p></div>'
    assert html.main_text(named) == "Head\nOne, two and three. Four.\nShort"
    nested = "<article><h1>Head<p>one<section class='reader-comments'><article class=comment><p>Not this, dear.</p></article></section><p>two</article>"
    assert html.main_text(nested) == "Head\none\ntwo"
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p></p>") == "" and html.main_text("just text") == "just text"
    assert html.main_text("<p>a < b & c > d</p>") == "a < b & c > d"
    assert html.main_text("<article><p title='a>b'>kept</p>" + "<div>" * 5000 + "deep</article>").startswith("kept")


def test_names_and_links_inside_the_article_are_no_reason_to_drop_text():
    page = ("<article><h2 id='search-strategy'>Search</h2><h2 id='related-work'>Related</h2><section id='notice-of-meeting'><p>Notice</p></section><div class='post-content legal-news'>Legal</div>"
            "<p data-note='the hidden port'>Port</p><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul><!--><p>after</p><!-- x --><p>end <em class=notice>here</em></p>"
            "<div class=ad>no</div><p hidden>no</p><div style='display: none'>no</div><section id=comments><p>Not this, dear. No.</p></section></article>")
    assert html.main_text(page) == "Search\nRelated\nNotice\nLegal\nPort\none\ntwo\nafter\nend here"
    wrapped = "<form id=aspnet><div class=sidebar-left><main><p>Text, in a wrapper.</p><label>Mail</label></main></div></form>"
    assert html.main_text(wrapped) == "Text, in a wrapper."
    assert html.main_text("<div class=ad>Buy this. Now, really.</div><nav><a href=/>Home</a></nav>") == ""
    assert html.main_text("<p>kept</p><p title='never closed>rest") == "kept\nrest" and html.main_text("<p>kept</p><p title='x") == "kept"


def test_broken_and_deep_markup_takes_time_in_proportion():
    for part in ("<div>some text, here.", '<a "', "<!--", "<!-- x -->", "</script", "<script>", "<p><td><form>", "<b><hr>", "<a b='", "<ul><li>x", "<tr>", "<p>x</div>"):
        started = time.time()
        html.main_text(part * 20000)
        assert time.time() - started < 8, part
    assert html.main_text("<article>" + "<div>a, b." * 3000).count("a, b.") == 3000


def _made_page(rnd, article: bool) -> tuple[str, str]:
    """A page put together from parts that are known to be content or not, and its content."""
    sentence = lambda: " ".join("".join(rnd.choice(list("abcdeou"), rnd.integers(2, 9))) for _ in range(rnd.integers(9, 40))) + rnd.choice([".", "!", ", so."])
    short = lambda: "".join(rnd.choice(list("abcdeou"), rnd.integers(3, 9)))
    links = lambda: "<ul>" + "".join(f"<li><a href=/{short()}>{short()}</a></li>" for _ in range(rnd.integers(2, 7))) + "</ul>"
    around = [lambda: f"<nav>{links()}</nav>", lambda: f"<div class='{rnd.choice(['ad', 'ad-slot', 'cookie-banner', 'top-bar share', 'newsletter box'])}'>{sentence()}</div>",
              lambda: f"<aside><p>{sentence()}</p></aside>", lambda: f"<footer>&copy; {sentence()}</footer>", lambda: f"<header><a href=/>{short()}</a></header>",
              lambda: f"<script>var a = '<p>{sentence()}</p>';</script>", lambda: f"<div id='{rnd.choice(['sidebar', 'main-menu', 'breadcrumbs'])}'>{links()}</div>",
              lambda: f"<form><p>{sentence()}</p><input name=q></form>", lambda: f"<section id=comments><div class=comment><p>{sentence()}</p></div></section>"]
    parts, texts = [], []
    for _ in range(rnd.integers(4, 15)):
        if rnd.random() < 0.25:
            parts.append(around[rnd.integers(1, 3)]())
            continue
        text = " ".join(sentence() for _ in range(rnd.integers(1, 4)))
        texts.append(text)
        first, _, rest = text.partition(" ")
        parts.append(str(rnd.choice([f"<p>{text}</p>", f"<p>\n {first}&#32;<b>{rest}</b>", f"<p class=lead><a href=/x>{first}</a> {rest}</p>", f"<p id=note>{first}<br>{rest}</p>"])))
    head = short()
    tag = ("<article>", "</article>") if article else ("<div class='post-body'>", "</div>")
    before, after = ("".join(around[i]() for i in rnd.integers(0, len(around), 3)) for _ in range(2))
    return f"<html><head><title>{head}</title></head><body>{before}{tag[0]}<h1>{head}</h1>{''.join(parts)}{tag[1]}{after}</body></html>", "\n".join([head, *texts])


def test_content_of_made_pages_with_and_without_article():
    rnd = np.random.default_rng(8)
    for i in range(400):
        page, content = _made_page(rnd, i % 2 == 0)
        assert html.main_text(page) == content, page


def test_op8_takes_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op8_page_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    extra = spark.createDataFrame([(1, None, "old"), (1, "<p>x</p>", "old")], "page_id long, html string, text string")
    assert [r.text for r in html.extract(extra).collect()] == ["", "x"] and html.extract(extra.limit(0)).count() == 0


def test_alignment_is_ascending_and_as_long_as_it_can_be():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        a, b = rnd.integers(0, 6, rnd.integers(0, 9)).tolist(), rnd.integers(0, 6, rnd.integers(0, 9)).tolist()
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        assert len(found) <= len(licenses._common(a, b))
    words = list(range(50))
    assert licenses.align(words, words[:20] + [77, 78] + words[20:]) == [(i, i + 2 * (i >= 20)) for i in range(50)]
    assert len(licenses.align(words[25:] + words[:25], words)) == 25


def test_scan_finds_notices_and_changed_texts(spark):
    mit = LICENSES["MIT"]
    docs = [(1, "some words\nReleased under the MIT License.\nmore"), (2, mit.lower().replace("restriction", "limits")), (3, None), (4, ""), (5, "the license released a mit and under other words " * 3),
            (6, "Licensed under CC BY-NC 4.0.\n" * 4), (6, "Licensed under CC BY-NC 4.0.\n" * 4), (None, "x " * 30000 + LICENSES["Apache-2.0 header"])]
    rows = licenses.scan(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, license string"), LICENSES).collect()
    found = sorted(((r.doc_id or 0, r.license, round(r.coverage, 2)) for r in rows))
    assert found == [(0, "Apache-2.0 header", 1.0), (0, "Apache-2.0 notice", 1.0), (1, "MIT notice", 1.0), (2, "MIT", 0.99), *[(6, "CC-BY-NC-4.0 notice", 1.0)] * 8]
    assert next((r.first_word, r.end_word) for r in rows if r.doc_id == 1) == (2, 7)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), LICENSES).count() == 0


def test_op9_finds_every_notice(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = Counter((r.doc_id, r.license) for r in queries.op9_license_scan(spark, "/root/testdata/sf0.01").collect() if r.coverage == 1)
    notices = {n: t for n, t in LICENSES.items() if n.endswith("notice") and t.count(" ") < 14}
    assert Counter({(d, n): t.count(notice) for d, t in docs.items() for n, notice in notices.items() if notice in t}) == Counter({x: n for x, n in got.items() if x[1] in notices})


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_places_equal_every_window_with_its_common_subsequence():
    rnd = np.random.default_rng(9)
    several = 0
    for _ in range(250):
        template = rnd.integers(0, 12, rnd.integers(3, 11)).tolist()
        text: list[int] = []
        for _ in range(rnd.integers(1, 5)):
            copy = [int(rnd.integers(0, 30)) if rnd.random() < 0.12 else w for w in template if rnd.random() > 0.08]
            text += rnd.integers(0, 40, rnd.integers(0, 6)).tolist() + copy
        got = licenses.matches(template, np.array(text, np.uint64))
        need = int(np.ceil(0.8 * len(template) - 1e-9))
        fits = [(s, e) for s in range(len(text)) for e in range(s + need, len(text) + 1) if (n := _longest_common(template, text[s:e])) >= need and n >= 0.6 * (e - s)]
        for share, first, end, count in got:
            assert need <= count <= _longest_common(template, text[first:end]) and count >= 0.6 * (end - first) and share == count / len(template)
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
        # Every window that fits meets a place that was found.
        assert all(any(s < end and first < e for _, first, end, _ in got) for s, e in fits), (template, text, got)
        several += len(got) > 1
    assert several > 50


def test_repeated_and_shuffled_license_texts_take_time_in_proportion():
    body = licenses._hashes(LICENSES["MIT"])
    changed = [7 if i == 60 else w for i, w in enumerate(body)]
    started = time.time()
    got = licenses.matches(body, np.array(changed * 400, np.uint64))
    assert [(first, end) for _, first, end, _ in got] == [(i * len(body), (i + 1) * len(body)) for i in range(400)] and time.time() - started < 20
    mixed = np.random.default_rng(3).permutation(np.array(body * 60, np.uint64))
    assert licenses.matches(body, mixed) == [] and time.time() - started < 40
    assert licenses.matches(body, np.zeros(0, np.uint64)) == []


def test_scores_equal_plain_python_and_grades_are_learned(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    grades = quality.grades(labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, grades.where(~held))
    rows = quality.rate(docs, model).join(grades, "doc_id").where(held).collect()
    for r in rows[:20]:
        (offsets, numbers, values), = quality.features(pa.array([r.text]))
        score = sum(float(model.weights[n]) * float(v) for n, v in zip(numbers, values))
        chances = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert abs(r.expected_grade - sum(chances)) < 1e-4 and abs(r.tail - chances[-1]) < 1e-4
    low, good = [r for r in rows if r.grade == 0], [r for r in rows if r.grade == 2]
    assert sum(r.tail >= 0.6 for r in good) >= 0.9 * len(good) and sum(r.tail < 0.6 for r in low) >= 0.9 * len(low)
    assert model.thresholds[0] < model.thresholds[1]


def test_toxic_texts_are_told_apart_by_word_beginnings(spark):
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("labels", "documents"))
    grades = quality.grades(labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rows = quality.rate(docs, quality.fit(docs, grades.where(~held))).join(grades, "doc_id").where(held).collect()
    share = lambda grade, lang: np.mean([r.tail >= 0.6 for r in rows if r.grade == grade and lang in (r.lang, None)])
    assert share(1, None) < 0.25 and share(1, "de") < 0.3 and share(1, "fr") < 0.3
    assert share(2, None) > 0.98 and share(0, None) < 0.02


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "!!! ???", "x"), (3, "!!! ???", "x"), (None, "a", "x")], "doc_id long, text string, tail string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(docs, none)
    rows = quality.rate(docs, model).collect()
    assert len(rows) == 5 and all(abs(r.tail - 1 / 3) < 1e-9 and abs(r.expected_grade - 1) < 1e-9 for r in rows)
    some = spark.createDataFrame([(1, 0), (3, 2), (3, None), (None, 1), (99, 2)], "doc_id long, grade int")
    assert quality.rate(docs, quality.fit(docs, some)).count() == 5
    assert quality.rate(docs.limit(0), model).count() == 0
