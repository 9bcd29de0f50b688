import random
import re

import numpy as np
import pytest

from apertura.llm import html_blocks, html_crf, labelled_pages, lang_cnn, quality_mil
from apertura.llm.queries import op4_quality, op7_language

from .helpers import DOCUMENTS

SMALL, MIDDLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op7_language(spark, SMALL)
    assert got.count() == docs.count()
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0


def test_language_odd_rows(spark):
    rng = random.Random(3)
    say = {"aa": "the and of to with", "bb": "der die und nicht ein"}
    rows = [(i, " ".join(rng.choices(say[k].split(), k=30)), k, "s", None) for i in range(200) for k in ("aa", "bb")]
    rows += [(900, None, "aa", None, 1), (901, "", "aa", None, 1), (902, "123 !?", None, None, 1), (None, "the and of", None, None, 1), (903, "und nicht die " * 100_000, None, None, 1), (903, "the of", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumnsRenamed({"n_chars": "lang_pred"})
    got = {(r["doc_id"], r["held_out"]): r for r in lang_cnn.identified(docs).collect()}
    assert all(got[k, h]["lang_pred"] == "und" and got[k, h]["score"] == 0 for k, h in got if k in (900, 901, 902))
    assert got[None, True]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    whole = lang_cnn.with_language(docs)
    assert whole.count() == docs.count() and {"lang_pred", "lang_score"} <= set(whole.columns)
    assert lang_cnn.identified(docs.limit(0)).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = lang_cnn.new_net(["a", "b"], rng)
    for p in net.params():
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.05
    x, y = rng.integers(1, 255, (6, lang_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss, grads = lang_cnn.gradients(net, x, y)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-3
        more = lang_cnn.gradients(net, x, y)[0]
        p[at] = old - 1e-3
        less = lang_cnn.gradients(net, x, y)[0]
        p[at] = old
        assert (more - less) / 2e-3 == pytest.approx(float(g[at]), rel=0.1, abs=2e-3)
    reader = lang_cnn.Reader(net)
    p = reader.probabilities(x)
    assert loss == pytest.approx(-np.log(p[np.arange(6), y]).mean(), rel=1e-3)


def test_quality_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = op4_quality(spark, MIDDLE)
    held = got.where("held_out").join(labels, "doc_id").where("quality is not null").toPandas()
    assert len(held) > 100
    assert (held.predicted == held.quality).mean() >= 0.95
    one, zero = held.score[held.quality == 1].values, held.score[held.quality == 0].values
    assert (one[:, None] > zero[None]).mean() + 0.5 * (one[:, None] == zero[None]).mean() >= 0.98


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good text here. " * 40, "### $$$ !!!! " * 40] * 40)] + [(None, "x"), (500, None), (501, ""), (501, "y"), (502, "word " * 300_000)], "doc_id long, text string").selectExpr("*", "'z' as score")
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(80)] + [(None, 1, 0), (3, None, 0), (7, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality_mil.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    mean = lambda odd: np.mean([r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2 == odd])
    assert mean(0) > mean(1) + 0.2
    assert quality_mil.scored(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_mil.scored(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_one_id_on_many_rows_is_learnt_from_once(spark):
    """The sample's size doesn't grow with the rows of an id, nor with the length of a text."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = [(i, "good text here. " * 40 if i % 2 else "### $$$ !!!! " * 40) for i in range(40)]
    once = spark.createDataFrame(texts, "doc_id long, text string")
    more = spark.createDataFrame([*texts, *[texts[6]] * 3000, (7, texts[7][1] + "x" * 2_000_000)], "doc_id long, text string")
    seen = []
    train = quality_mil.train
    quality_mil.train = lambda x, owner, y: seen.append((len(x), len(y))) or train(x, owner, y)
    try:
        assert all(quality_mil.fitted(d, labels) for d in (once, more))
    finally:
        quality_mil.train = train
    (rows, docs), (more_rows, more_docs) = seen
    assert docs == more_docs and more_rows <= rows + quality_mil.SAMPLE_PASSAGES


def plain_features(text):
    """The encoding of a text's passages told plainly, byte by byte."""
    out = []
    for at in range(0, max(1, len(text)), quality_mil.PASSAGE):
        part = text[at : at + quality_mil.PASSAGE]
        row = np.zeros(quality_mil.FEATURES)
        for a, b in zip(part, part[1:]):
            row[quality_mil._KIND[a] * quality_mil.KINDS + quality_mil._KIND[b]] += 1
        row[:-3] = np.sqrt(row[:-3] / max(1, len(part)))
        begun = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", text) if at <= m.start() < at + quality_mil.PASSAGE]
        row[-3] = sum(a[0].lower() == b[0].lower() for a, b in zip(begun, begun[1:])) / max(1, len(begun))
        row[-2], row[-1] = len(part) / quality_mil.PASSAGE, not part
        out.append(row)
    return np.array(out)


def test_scores_equal_a_plain_reading_of_every_passage(spark):
    """The query's scores over the smallest tables against the same model applied text by text, without batches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality_mil.fitted(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in op4_quality(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        x, p = plain_features((r["text"] or "").encode()).astype(np.float32).astype(float), model.p
        h = np.tanh(x @ p["W"] + p["b"])
        e = (np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))) @ p["w"]
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h
        assert got[r["doc_id"]] == pytest.approx(float(1 / (1 + np.exp(-(z @ p["c"] + p["c0"])))[0]), abs=1e-5)


def test_predictions_equal_a_plain_network_over_windows(spark):
    """The language query over the smallest table against plain convolutions, window by window."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = lang_cnn.fitted(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op7_language(spark, folder).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        if not re.search(r"[^\W\d_]", text):
            assert got[r["doc_id"]] == ("und", 0)
            continue
        total, data = np.zeros(len(net.langs)), text.encode()
        for at in range(0, len(data), lang_cnn.WINDOW):
            part = data[at : at + lang_cnn.WINDOW]
            x = net.embed[np.frombuffer(part.ljust(lang_cnn.WINDOW, b"\0"), np.uint8)].astype(float)
            pooled = [np.max([np.tensordot(x[j : j + w], f, axes=((0, 1), (0, 1))) for j in range(lang_cnn.WINDOW - w + 1)], axis=0) for w, f in zip(lang_cnn.WIDTHS, net.filters)]
            out = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.out_bias
            total += np.exp(out - out.max()) / np.exp(out - out.max()).sum() * len(part)
        p = total / len(data)
        lang, score = got[r["doc_id"]]
        assert score == pytest.approx(p.max(), abs=1e-4) and (lang == net.langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4)


def test_every_language_is_learnt(spark, monkeypatch):
    """More languages than the sample has documents: each has one at least, and equal rows count once."""
    monkeypatch.setattr(lang_cnn, "SAMPLE_DOCS", 3)
    rows = [(10 * k + j, f"{chr(97 + k)}" * 300, f"l{k}", None, None) for k in range(8) for j in range(6)] + [(5, "zz", "l0", None, None)] * 50
    net = lang_cnn.fitted(spark.createDataFrame(rows, DOCUMENTS))
    assert net.langs == [f"l{k}" for k in range(8)]


def test_attention_gradients():
    rng = np.random.default_rng(1)
    model = quality_mil.Model(rng)
    x, owner, y = rng.random((7, quality_mil.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, owner, 3)["score"]) + (1 - y) * np.log(1 - s))
    for k, g in model.gradients(x, owner, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        model.p[k][at] += 1e-5
        more = loss()
        model.p[k][at] -= 2e-5
        less = loss()
        model.p[k][at] += 1e-5
        assert (more - less) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept.</div>
<article><h1>The   title&amp;more</h1><p><b>First&nbsp;part <i>goes</i> on<br>and on.<p>Second &lt;part&gt; of the text, &eacute;t&eacute;.</p><div class="ad">Buy this now, it is cheap.</div>
<ul><li>One point<li>Another point</ul></article><section class="comments"><p>I liked this text a lot, thank you.</p></section>
<aside><h3>Related</h3><a href="/x">Other text</a></aside><form><label>Search</label><input></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_of_a_page():
    text = html_crf.main_text(html_crf.default_model(), PAGE)
    assert text == "The title&more\n\nFirst part goes on and on.\n\nSecond <part> of the text, été.\n\nOne point\n\nAnother point"


def test_main_text_of_unseen_layouts():
    model = html_crf.default_model()
    right = total = 0
    for page in labelled_pages.labelled_pages(300, seed=77):
        found = html_blocks.blocks(page)
        right += sum(a == b.context.main for a, b in zip(model.decode(found), found, strict=True))
        total += len(found)
    assert right >= 0.99 * total


def test_pages_with_an_article_give_its_blocks(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_crf.extracted(pages).collect()}
    for r in pages.collect():
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


def test_viterbi_finds_the_best_path():
    from itertools import product

    model = html_crf.default_model()
    page = html_blocks.blocks(PAGE)[:9]
    score, (moves, begin) = model.leanings(page), (model.moves, model.begin)
    value = lambda path: begin[path[0]] + sum(s for s, y in zip(score, path, strict=True) if y) + sum(moves[a, b] for a, b in zip(path, path[1:]))
    assert [int(x) for x in model.decode(page)] == list(max(product((0, 1), repeat=len(page)), key=value))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>In symbols, <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, which holds.</p></article>", "In symbols, x=2, which holds."),
        ('<article><p title="x>One text that follows an open quote.</p><p>And more of it.</p></article>', "One text that follows an open quote.\n\nAnd more of it."),
        ("<article><p>One <button>press</button> two <svg><text>three</text></svg> <object>four</object>.</p></article>", "One two three four."),
        ("<article><p>Some text before.</p><xmp><p>raw &amp; text</p></xmp><pre>a  b\nc</pre></article>", "Some text before.\n\n<p>raw &amp; text</p>\n\na b c"),
        ("<article><ul><li>Item one" + "<div>" * 100 + "deep text" + "</div>" * 100 + "<li>Item two</ul></article>", "Item one\n\ndeep text\n\nItem two"),
        ("<article><p>" + "Words to share and search, related to a comment. " * 30 + "</p></article>", ("Words to share and search, related to a comment. " * 30).strip()),
        ("<article><p>First paragraph of the text.</p><table><tr><td>a<td>b<tr><td>c</table></article>", "First paragraph of the text.\n\na\n\nb\n\nc"),
    ],
)
def test_no_text_of_an_article_is_lost(page, text):
    assert html_crf.main_text(html_crf.default_model(), page) == text


def test_implied_ends_in_deep_pages_take_linear_time():
    page = "<li>x<ul>" + "<div>" * 20_000 + "<li></li>" * 20_000
    assert [b.text for b in html_blocks.blocks(page)] == ["x"]


@pytest.mark.parametrize("page", ["<" * 20000, "<a " * 20000, "<p>" * 20000 + "x", "<div>" * 5000 + "text", "<!-- never closed", "<script>never closed", "<p class='x", "</p></div>text", "&#0;&bogus;&#x110000;", "a\0b"])
def test_broken_pages(page):
    assert isinstance(html_crf.main_text(html_crf.default_model(), page), str)


def test_main_text_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>Some text of a page that is long enough.</p>"), (3, "u", "<p>" + "long words here. " * 60_000 + "</p>"), (3, "u", "<p>Same id again, and more text.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_crf.extracted(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 2)] == [("", 0), ("", 0)]
    assert sorted(r["n_chars"] for r in got)[2:] == [29, 40, 1_019_999] and all(len(r["text"]) == r["n_chars"] for r in got)
    assert html_crf.extracted(pages.limit(0)).count() == 0


def test_texts_of_numerals_have_no_language(spark):
    rows = [(k, "the and of" if k % 2 else "der die und", "en" if k % 2 else "de", None, 1) for k in range(60)]
    rows += [(900 + k, t, None, None, 1) for k, t in enumerate(["½ ² Ⅷ", "１２ ٣", "_ __", "½ a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang_pred for r in lang_cnn.identified(docs).collect()}
    assert [got[900 + k] for k in range(3)] == ["und"] * 3
    assert got[903] in ("en", "de")


def test_repeated_and_foreign_labels_take_no_places_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_mil, "SAMPLE_DOCS", 40)
    good, bad = "clear careful words about rivers and hills ", "x9 zz qq !! buy now "
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) * 3, None, None, 1) for k in range(120)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(k, k % 2, 0) for k in range(120)]
    kind = "doc_id long, quality int, toxic int"
    plain = {r.doc_id: r.score for r in quality_mil.scored(docs, spark.createDataFrame(labels, kind)).collect()}
    more = [(1, 1, 0)] * 3000 + [(2, 0, 0)] * 3000 + [(k, k % 2, 0) for k in range(10_000, 13_000)]
    again = {r.doc_id: r.score for r in quality_mil.scored(docs, spark.createDataFrame(labels + more, kind)).collect()}
    assert again == pytest.approx(plain)
    assert min(plain[k] for k in plain if k % 2) > max(plain[k] for k in plain if not k % 2)
