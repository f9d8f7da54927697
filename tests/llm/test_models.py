"""Page labeller and language network: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from folioscope.llm import language, pages


def check_gradients(weights, grads, loss):
    for w, g in zip(weights, grads, strict=True):
        for k in np.argsort(-np.abs(g).ravel())[:3]:
            i = np.unravel_index(k, w.shape)
            old, e = w[i], 1e-2
            w[i] = old + e
            up = loss()
            w[i] = old - e
            down = loss()
            w[i] = old
            assert (up - down) / (2 * e) == pytest.approx(g[i], abs=2e-3, rel=0.05)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language._fresh(["a", "b", "c"], rng, 4)
    x, y, valid = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), np.ones((6, 5), np.float32)
    valid[4:, 0] = 0
    check_gradients(language._weights(net), language.gradients(net, x, y, valid)[1], lambda: language.gradients(net, x, y, valid)[0])


def test_reader_equals_plain_network():
    rng = np.random.default_rng(1)
    net = language._fresh(["a", "b"], rng)
    for b in net.bias:
        b += rng.standard_normal(b.shape).astype(np.float32)
    texts = [b"x" * 70, b"", bytes(range(200)), b"ab"]
    got, _ = language.Reader(net).read(texts)
    windows, sizes, of = language.cut(texts)
    x = windows.T
    both = np.concatenate((language._forward(net, 0, x)[0], language._forward(net, 1, x)[0]), 1)
    logits = np.einsum("lh,thn->tln", net.out, both) + net.level
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    for i, t in enumerate(texts):
        want = sum((p[: sizes[n], :, n].sum(0) for n in np.flatnonzero(of == i)), np.zeros(2)) / max(1, len(t))
        assert got[i] == pytest.approx(want, abs=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = [r for r in language.report(documents).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.recognised(documents, language.fit(documents)).count() >= len(truth) - 2


def test_language_edges(spark, documents):
    net = language.fit(documents)
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (3, "12 !? 3"), (None, "the and of with that this from " * 2000), (5, "é")]
    df = spark.createDataFrame([(*r, "fr", "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = language.identify(df, net, out="score").select("doc_id", "score.lang", "score.score").collect()
    assert [(r.doc_id, r.lang) for r in got][:5] == [(1, "und"), (2, "und"), (3, "und"), (3, "und"), (None, "en")]
    assert [r.score for r in got][:4] == [0, 0, 0, 0] and got[5].lang in net.labels
    assert {r.lang_pred for r in language.report(df.withColumn("lang", df.lang.substr(9, 1)).limit(0)).collect()} == set()
    unlabelled = df.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.report(unlabelled).collect()} == {"und"}
    kept = language.recognised(df, net)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {None, 5}


def test_language_sample_needs_no_ids(spark, documents):
    """Null or repeated ids change neither the languages nor the bound of the sample."""
    for ids in ("CAST(NULL AS LONG)", "10", "doc_id"):
        found = language.sample(documents.selectExpr(f"{ids} AS doc_id", "text", "lang"), 20)
        assert {lang for lang, _ in found} == {"en", "fr", "de", "es"}
        assert len(found) <= 4 * 20 * language.SAMPLE_WINDOWS
    copies = documents.filter("lang = 'en'").limit(1).crossJoin(spark.range(3000)).select(documents.columns)
    assert {lang for lang, _ in language.sample(documents.unionByName(copies), 20)} == {"en", "fr", "de", "es"}
    many = spark.range(2000).selectExpr("id AS doc_id", "'some text' AS text", "CAST(id AS STRING) AS lang")
    assert len({lang for lang, _ in language.sample(many, 5)}) == language.LANGUAGES


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    net = pages.Labeller(rng, 6, 3)
    rows, y = rng.standard_normal((9, 6)).astype(np.float32), (rng.random(9) > 0.5).astype(np.float32)
    check_gradients(net.weights(), net.gradients(rows, [4, 2, 3], y)[1], lambda: net.gradients(rows, [4, 2, 3], y)[0])


def test_order_of_pages_does_not_matter():
    rng = np.random.default_rng(3)
    net, rows = pages.Labeller(rng, 6, 3), rng.standard_normal((9, 6)).astype(np.float32)
    whole = net.scores(rows, [4, 2, 3])
    parts = np.concatenate([net.scores(rows[:4], [4]), net.scores(rows[4:6], [2]), net.scores(rows[6:], [3])])
    assert whole == pytest.approx(parts, abs=1e-5)


def test_held_out_specimens():
    net, rng = pages.trained(), np.random.default_rng(12345)
    right = total = 0
    for _ in range(150):
        found, y = pages.labelled(rng)
        if found:
            right += int(((net.scores(pages.vectors([found]), [len(found)]) > 0) == np.array(y)).sum())
            total += len(y)
    assert right / total > 0.98


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp; b&nbsp;&lt;c  d\n e<p>second <b>bold</b><br>line", ["a & b <c d e", "second bold line"]),
        ("<script>var t='</p>';</script><style>p{}</style><title>t</title><div>x<!-- <p>no --></div>tail", ["x", "tail"]),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", ["one", "two", "a", "b"]),
        ("a < b and c > d <unknown>e</unknown>", ["a < b and c > d e"]),
        ("<p title='a > b'>ok</p></div></p>", ["ok"]), ("<script>never closed", []), ("<!-- open", []), ("", []), ("&amp;amp;", ["&amp;"]),
    ],
)
def test_blocks(page, want):
    assert [t for _, t, _ in pages.blocks(page)] == want


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<b>", "</x><div>", "<script></script", "<aaaa", "<!--", "<a \"'>", "<p><b>", "<td>x", "&amp;", "<li><ul>"])
def test_pages_take_time_by_their_length(piece):
    import time

    def seconds(n):
        start = time.perf_counter()
        pages.blocks(piece * n)
        return time.perf_counter() - start

    unit = 30_000 // len(piece)
    assert min(seconds(8 * unit) for _ in range(2)) < 30 * max(0.02, min(seconds(unit) for _ in range(2)))


def test_page_of_very_many_blocks():
    """A long page beside short ones needs memory for its own blocks only."""
    net, long = pages.Labeller(np.random.default_rng(0)), "<p>Some words here, and more.</p>" * 60_000
    short = [f"<article><p>Page {i} says this.</p></article>" for i in range(300)]
    got = pages.extract([*short[:100], long, *short[100:]], net)
    assert got[100][1] == 60_000 and got[:100] + got[101:] == pages.extract(short, net)


def test_nothing_but_furniture_is_dropped():
    page = "<article><p>The total is <math>x + y</math> for this sentence, as was said.</p><noscript><p>A caption of the picture, in a few words.</p></noscript><p>Then the <svg><text>drawing</text></svg> follows, and more is said.</p></article>"
    text = pages.extract([page], pages.trained())[0][0]
    assert text == "The total is x + y for this sentence, as was said.\n\nA caption of the picture, in a few words.\n\nThen the drawing follows, and more is said."


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60)
    import html
    import re

    got = {r.page_id: r for r in pages.report(rows).collect()}
    for r in rows.collect():
        article = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (2, None, "", 0), (3, "u", "<nav><a href=x>home</a></nav>", 0), (4, "u", "<article><p>" + "word " * 50000 + "</p></article>", 0)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars) for r in pages.report(df).collect())
    assert got == [(1, 0), (2, 0), (2, 0), (3, 0), (4, 249999)]
    assert pages.report(df.limit(0)).count() == 0
