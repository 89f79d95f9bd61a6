"""Learned operators: held-out accuracy, exact parts against brute force, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import html, pii, quality, topk, toxicity
from catalogspark.llm.tagger import Tagger

from .fixtures import corpus, documents

BIG = "/root/testdata/sf0.01"


# --- personal data


def brute_base(text):
    """The contract's patterns, applied as written."""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return pii.in_order(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["a", "é", "@", ".", "-", " ", "+", "(", "1", "22", "255", "256", "4111 1111 1111 1111", "me@x.org", "1.2.3.4", "+1 (705) 555-6638", "\n", "%", "00012", "@@", "..", "x@y.z@w.v.u"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([3, 10, 30])))
        assert pii.base_spans(text) == brute_base(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_windows_cover_all_anchors():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab c1@") if rng.random() < 0.1 else "x" for _ in range(rng.choice([0, 5, 300, 2000])))
        starts = pii.windows(text)
        for m in pii.ANCHOR.finditer(text):
            assert any(s <= m.start() < s + pii.WINDOW for s in starts)


def test_tagger_gradients_are_right():
    rng = np.random.default_rng(0)
    tagger = Tagger(3, hidden=4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = rng.integers(0, 6, (3, 7)), rng.integers(0, 3, (3, 7))
    _, g = tagger.gradients(x, y)
    for name in tagger.p:
        at = tuple(rng.integers(0, s) for s in tagger.p[name].shape) if name[0] != "x" else (int(x[0, 0]), 5)
        old, eps = tagger.p[name][at], 1e-3
        tagger.p[name][at] = old + eps
        up = tagger.gradients(x, y)[0]
        tagger.p[name][at] = old - eps
        down = tagger.gradients(x, y)[0]
        tagger.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=2e-4)


def test_viterbi_equals_all_paths():
    from itertools import product

    tagger = Tagger(3, hidden=2)
    e = np.random.default_rng(1).normal(size=(5, 2, 3)).astype(np.float32)
    paths = tagger.decode(e)
    for b in range(2):
        best = max(product(range(3), repeat=5), key=lambda p: sum(e[t, b, p[t]] + (tagger.p["t"][p[t - 1], p[t]] if t else 0) for t in range(5)))
        assert tuple(paths[b]) == best


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(5)
    texts = []
    for i in range(260):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"{''.join(rng.choice('abcdef') for _ in range(6))}.{rng.randrange(10, 99)}@mail{rng.randrange(9)}.example.com"
        ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        noise = f"version {rng.randrange(9)} of {rng.randrange(2000)}"
        texts.append(" ".join(f"lorem ipsum dolor {rng.choice([phone, mail, ip, noise])} sit amet" for _ in range(3)))
    return pii.train(texts)


def test_tagger_adds_what_patterns_miss(tagger):
    text = "lorem ipsum dolor (705) 555-6638 sit amet"
    assert pii.base_spans(text) == []
    assert pii.added_spans([text], [[]], tagger)[0] == [(18, 32, "phone")]
    clean = "lorem ipsum dolor version 3 of 1998 sit amet " * 20
    assert pii.added_spans([clean], [[]], tagger) == [[]]


def test_reconciled_takes_the_best_set():
    assert pii.reconciled([(0, 5, "ip", 0.9), (3, 9, "ip", 0.95), (9, 12, "card", 0.5), (0, 5, "ip", 0.9)]) == [(3, 9, "ip", 0.95), (9, 12, "card", 0.5)]


def test_personal_data_query(spark, tmp_path):
    rows = [(i, f"write to user{i}@mail.example.com or +1 (705) 555-66{i:02d}, host 10.0.0.{i}") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "é 😀 a@b.co"), (103, "4111 1111 1111 1111"), (104, "x" * 200_000 + "@"), (104, "1" * 50_000)]
    path = corpus(spark, tmp_path, documents(spark, rows))
    got = pii.op1_personal_data(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        bases = [brute_base(t or "") for i, t in rows if i == r.doc_id and len(t or "") < 1000] or [[]]
        assert r.base_sha256 in [hashlib.sha256(pii.written_out(b).encode()).hexdigest() for b in bases]
        assert all(pii.written_out([s]) in r.spans for s in bases[0])
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}[103] == (0, 0, 1, 0)
    assert {r.doc_id: r.spans for r in got}[102] == "email:4:10"


def test_personal_data_without_any(spark):
    assert pii.learn(documents(spark, [(1, "none"), (2, None)]), "text") is None
    assert pii.masked("mail a@b.co now", pii.base_spans("mail a@b.co now")) == "mail [email] now"


# --- quality and toxicity


def held_out_labels(spark, label):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    return {r[0]: r[1] for r in labels.select("doc_id", label).collect()}, docs.count()


def test_quality_separates_held_out_texts(spark):
    labels, n = held_out_labels(spark, "quality")
    rows = quality.op5_quality(spark, BIG).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    unseen = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([y == p for y, p, _ in unseen]) > 0.92
    good, bad = [s for y, _, s in unseen if y], [s for y, _, s in unseen if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_of_odd_inputs(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    text = ["calm words in a row of many kinds", "### $$$ %%% ### $$$ %%%"]
    docs = documents(spark, [(i, f"{text[1 - i % 2]} {i}" * 5) for i in range(60)] + [(None, None), (200, ""), (201, "x" * 300_000)]).withColumn("score", F.lit("clash"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(1, 60, 2)} <= ids and not ids & {i for i in range(0, 60, 2)}
    assert quality.learn(docs, labels.filter("quality = 1")) is None
    assert {r.score for r in quality.scored(docs, None).select("score").collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_held_out_fold(spark):
    import zlib

    rows = documents(spark, [(i, "") for i in range(50)]).select("doc_id", quality.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_on_held_out_texts(spark):
    labels, n = held_out_labels(spark, "toxic")
    rows = toxicity.op10_toxicity(spark, BIG).collect()
    assert len(rows) == n
    unseen = [(labels[r.doc_id], r.toxic) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p for y, p in unseen if y]) >= 0.6 and np.mean([p for y, p in unseen if not y]) <= 0.1


def test_toxicity_chain_feeds_earlier_categories(spark, tmp_path):
    rng = random.Random(3)
    calm = [f"calm{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(calm, k=30) + (["vileword", "badstem" + rng.choice("abc")] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    more = [(900, None), (901, ""), (902, "calm1 " * 50_000), (903, "calm1 VILEWORD! calm2"), (903, "calm1 VILEWORD! calm2")]
    path = corpus(spark, tmp_path, documents(spark, rows + more), labels=labels)
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, path).collect()}
    assert all(got[i].toxic == int(i % 4 == 0) for i in range(400))
    assert [got[i].toxic for i in (900, 901, 902, 903)] == [0, 0, 0, 1]
    path = corpus(spark, tmp_path, documents(spark, rows), labels=labels.filter("toxic = 0"))
    assert {r.toxic for r in toxicity.op10_toxicity(spark, path).collect()} == {0}


# --- top-k


def brute_top(rows, k=20, every=20):
    good = [(i, np.array([int(np.floor(64.0 * float(x))) for x in v], dtype=object)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in good if i % every == 0}.items():
        scores = sorted(((-int((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("rows_per_shard", [40, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, rows_per_shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", rows_per_shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(1000, None), (1020, [0.1, None] * 3), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, []), (None, [1.0] * 6), (1100, [1e7] * 6), (1120, [1.0, 2.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())
    assert got == brute_top(rows)


def test_top_k_of_little(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()] == [(0, 1, 1, 64 * 128)]


# --- web pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div>
<article><h1>Head&nbsp;line</h1><p>First <b>bold</b> para&shy;graph &amp; more<br>words.<aside class="ad"><p>Buy now, cheap cheap cheap</p></aside>
<p>Second one   with
blanks.</p><ul><li>point one<li>point two</ul><form><input name=q>Search here</form></article>
<section class="comments"><p>Nice article, I liked it very much, thanks for it.</p></section>
<footer>&copy; site &middot; words in the footer</footer></body></html>"""


def test_page_text():
    text = html.main_text(PAGE, html.learn_weights([PAGE] * 3))
    assert text == "Head line\n\nFirst bold para\xadgraph & more words.\n\nSecond one with blanks.\n\npoint one\n\npoint two"
    assert html.main_text(PAGE, {}) == text


def test_page_without_content_element():
    page = "<body><nav><a>Home</a> <a>News</a></nav><div id=content><h2>Title</h2><p>Some text here.</p><p>More text here.</p></div><div class='sidebar'><p>Side text of no interest</p></div></body>"
    assert html.main_text(page, {}) == "Title\n\nSome text here.\n\nMore text here."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"), ("<p>a<p>b", "a\n\nb"), ("<p>1 < 2 & 3", "1 < 2 & 3"),
    ("<script>alert('<p>x</p>')", ""), ("<!-- <p>no</p>", ""), ("<p>x</b></p></div>y", "x\n\ny"), ("<p title='a>b'>t</p>", "t")])
def test_odd_pages(page, text):
    assert html.main_text(page, {}) == text


@pytest.mark.parametrize("part,kept", [
    ("<div class='has-sidebar'><p>x y z</p></div>", True), ("<div class='sidebar'><p>x y z</p></div>", False), ("<div id=commentList><p>x y z</p></div>", False),
    ("<article class='comment'><p>x y z</p></article>", False), ("<p style='display: none'>x y z</p>", False), ("<p hidden>x y z</p>", False),
    ("<div role='navigation'>x y z</div>", False), ("<figure><figcaption>x y z</figcaption></figure>", True), ("<noscript>x y z</noscript>", False)])
def test_furniture_inside_content(part, kept):
    text = html.main_text(f"<main><p>one two three four five</p>{part}<p>six seven eight nine</p></main>", {})
    assert text == "one two three four five\n\n" + ("x y z\n\n" if kept else "") + "six seven eight nine"


LONG = "<p>" + "the long body of the post goes on for a while here " * 6 + "</p>"


@pytest.mark.parametrize("trained", [False, True])
@pytest.mark.parametrize("page", [
    f"<body><div class=entry-content>{LONG}</div><article class=comment-body><p>Nice post, thanks for it.</p></article></body>",
    f"<body><div>{LONG}</div><div class=related><article><p>Another story to read.</p></article></div></body>",
    f"<body><div>{LONG}</div><article><p>Another story.</p></article></body>"])
def test_a_long_body_outside_an_article_is_kept(page, trained):
    text = html.main_text(page, html.learn_weights([PAGE] * 3) if trained else {})
    assert "the long body of the post" in text and "Nice post" not in text


@pytest.mark.parametrize("trained", [False, True])
def test_unmarked_menus_are_cut(trained):
    menu = "<div><ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "Contact")) + "</ul></div>"
    page = f"<body>{menu}<div><h2>Title</h2>{LONG}{LONG}</div>{menu}</body>"
    text = html.main_text(page, html.learn_weights([PAGE] * 3) if trained else {})
    assert "the long body of the post" in text and "Home" not in text and "Contact" not in text


def test_region_is_the_maximum():
    rng = random.Random(0)
    for _ in range(300):
        s = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randrange(12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_pages_of_the_corpus(spark):
    """The article element of the generated pages, cut out by hand, is the text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{BIG}/pages.parquet").collect()}
    rows = html.op9_extract_html(spark, BIG).collect()
    assert len(rows) == len(pages)
    import html as escapes

    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = "\n\n".join(x for x in (" ".join(escapes.unescape(p).split()) for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)
