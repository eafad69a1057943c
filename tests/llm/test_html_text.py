import os

import numpy as np
import pytest

from tallyglass.llm import html_text as H

SF = "/root/testdata/sf0.01"


def test_blocks():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class=x><!-- c --><nav><a href="/">Home</a> x</nav>'
        '<p>a&amp;b &nbsp; <b>c</b>d<br>e<p>next < 3 <![CDATA[raw]]><ul><li>one<li>two</ul><img src="a>b">tail'
    )
    found = [(b.text, b.path[-1]) for b in H.blocks_of(page)]
    assert found == [("Home x", "nav"), ("a&b cd e", "p"), ("next < 3 raw", "p"), ("one", "li"), ("two", "li"), ("tail", ".x")]
    assert H.blocks_of("") == [] and [b.text for b in H.blocks_of("no tags at all")] == ["no tags at all"]
    assert H.blocks_of("<script>never closed <p>x") == [] and H.blocks_of("a" * 10 + "<!-- open")[0].text == "a" * 10


def test_broken_pages():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts("<p title=it's>Hello world first.</p><p>second para don't lose me</p><p>third</p>") == ["Hello world first.", "second para don't lose me", "third"]
    for tag in ("svg", "noscript", "title", "template", "iframe"):
        assert texts(f"<p>one</p><{tag}><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>E = <math><mi>m</mi><msup>c2</msup></math> holds</p>") == ["E = mc2 holds"]
    assert texts('<p>a</p><a href="x>y</a><p>b</p><p class="c">d</p>')[-1] == "d" and texts("x <! y <? z <b") == ["x <! y <? z <b"]
    assert texts("<p a=\"1>2\" b='3>4' c=5>t</p>") == ["t"] and texts("a < b <c <!-- open") == ["a < b <c"]


@pytest.mark.parametrize("piece", ["<a ", '<a href="x ', "<a href='x", '<a href=">" ', "<! ", "<!-", "</", "<svg>", "<title><p>x", '<p class="', "<p q='>"])
def test_broken_pages_take_linear_time(piece):
    import time

    start = time.perf_counter()
    H.blocks_of(piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - start < 20
    start = time.perf_counter()
    H.blocks_of(piece * (1_000_000 // len(piece)) + ">")
    assert time.perf_counter() - start < 20


def test_gradients():
    rng = np.random.default_rng(0)
    lstm = H.Lstm(rng, 4, 3)
    lstm.w, lstm.u, lstm.b = (x.astype(np.float64) for x in (lstm.w, lstm.u, lstm.b))
    x, mask, pull = rng.standard_normal((5, 2, 4)), np.ones((5, 2)), rng.standard_normal((5, 2, 3))
    mask[3:, 1] = 0
    kept = []
    lstm.forward(x, mask, kept)
    for weights, grad in zip((lstm.w, lstm.u, lstm.b), lstm.backward(x, kept, pull)):
        at = tuple(0 for _ in weights.shape)
        before, step = weights[at], 1e-3
        weights[at] = before + step
        high = (lstm.forward(x, mask) * pull).sum()
        weights[at] = before - step
        low = (lstm.forward(x, mask) * pull).sum()
        weights[at] = before
        assert abs((high - low) / (2 * step) - grad[at]) < 1e-2 * max(1, abs(grad[at]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_labeller_on_pages_and_other_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = H.train(pages)
    article = [b for b in map(H.blocks_of, (r["html"] for r in pages.collect()))]
    truth = [[any(n == "article" for n in b.path) for b in bs] for bs in article]
    guess = model.label([H.features(bs) for bs in article])
    right = [t == (p > 0.5) for ts, ps in zip(truth, guess) for t, p in zip(ts, ps)]
    assert np.mean(right) > 0.995
    other = (
        '<body><div class="sidebar"><p>Side words here are long enough to count.</p></div><main><h1>Title</h1><p>Real text of the article itself.</p>'
        '<div class="ad">Buy now this thing.</div><p>Second paragraph of the article.</p></main><section id="comments"><p>I liked it very much.</p></section></body>'
    )
    odd = [(1, "u", other), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 5000), (5, "u", other), (None, "u", "plain words only, one sentence."), (6, "u", "<article>" + "<p>Word here.</p>" * 3000)]
    rows = H.extract(spark.createDataFrame(odd, "page_id long, url string, html string"), model).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == got[5] == "Title\nReal text of the article itself.\nSecond paragraph of the article."
    assert got[2] == got[3] == got[4] == "" and got[6].count("\n") == 2999 and all(r["n_chars"] == len(r["text"]) for r in rows)
    empty = pages.limit(0)
    assert H.extract(empty, H.train(empty)).count() == 0


def test_middle_words_and_late_digits_count():
    edge, middle = [f"edge{i}" for i in range(8)], [f"middle{i}" for i in range(30)]
    path = ("div",)
    texts = [" ".join(edge + m + edge) for m in (middle, middle[::-1], ["comment"] * 30, middle[:-1] + ["2026"])]
    plain, turned, other, digits = (H.features([H.Block(t, path, 0)])[0] for t in texts)
    assert np.allclose(plain[H.PATH_SIZE : H.PATH_SIZE + H.WORD_SIZE], turned[H.PATH_SIZE : H.PATH_SIZE + H.WORD_SIZE])
    assert not np.allclose(plain[H.PATH_SIZE : H.PATH_SIZE + H.WORD_SIZE], other[H.PATH_SIZE : H.PATH_SIZE + H.WORD_SIZE])
    late = [H.features([H.Block("x" * 100 + t, path, 0)])[0] for t in ("abcd", "1234")]
    assert late[0][-2] == 0 and abs(late[1][-2] - 4 / 104) < 1e-6


def test_training_reads_all_blocks_of_a_page(spark, monkeypatch):
    page = "<article>" + "<p>Plain article text stands here.</p>" * 250 + "</article><footer>" + "<p>Late words.</p>" * 50 + "</footer>"
    seen = []
    monkeypatch.setattr(H.Labeller, "fit", lambda self, rows, labels: seen.append((rows, labels)))
    frame = spark.createDataFrame([(1, page)], "page_id long, html string")
    whole = H.features(H.blocks_of(page))
    for settings in (H.Settings(variants=0), H.Settings(variants=0, steps=70)):
        H.train(frame, settings=settings)
        rows, labels = seen.pop()
        assert np.array_equal(np.concatenate(rows), whole) and max(map(len, rows)) <= settings.steps
        assert np.concatenate(labels).tolist() == [1] * 250 + [0] * 50
