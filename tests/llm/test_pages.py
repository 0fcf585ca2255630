import numpy as np
import pytest

from forumlake.llm import html_text, neighbours
from forumlake.llm.queries import op2_nearest_neighbours

SHOP = """<!doctype html><html><head><title>T{i}</title><style>p{{}}</style></head><body class="page">
<header class="site-header"><a href="/">Logo</a><nav><ul><li><a href="/a">A{i}</a><li><a href="/b">B</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies {i}</p></div>
<div class="columns"><div class="sidebar"><h3>Related</h3><ul><li>Old {i}</li></ul></div>
<div class="main-content"><h1>Title &amp; more {i}</h1><p>First  para {i}<br>goes <b>on</b>.<p>Second&nbsp;para {i} is a bit longer than that.
{extra}<form><input><label>Your mail</label></form><div class="advert"><p>Buy {i}</p></div></div></div>
<section class="comments"><p>Nice {i}!</p></section><footer><p>(c) {i}</p></footer><script>var x = "<p>no</p>";</script></body></html>"""
LIST = "<ul><li>one {i}<li>two</ul>"
PLAIN = "<body><div class=top><a href=x>home</a> <a href=y>news</a></div><div class=t1><div class=t2>{text}</div></div><div class=bottom>imprint</div></body>"


def test_wrappers_of_templates(spark):
    rows = [(i, f"http://shop.de/{i}", SHOP.format(i=i, extra=LIST.format(i=i) if i % 2 else "")) for i in range(6)]
    rows += [(10 + i, f"https://plain.org/{i}", PLAIN.format(text="".join(f"<p>A long paragraph of the article number {i} part {k} with many words in it.</p>" for k in range(2 + i)))) for i in range(4)]
    rows += [(20, None, None), (21, "nowhere", ""), (22, "http://x.de/", "just text &lt;b&gt; here"), (23, "http://y.de", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"), (20, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for i in range(6):
        blocks = [f"Title & more {i}", f"First para {i} goes on.", f"Second para {i} is a bit longer than that."] + ([f"one {i}", "two"] if i % 2 else [])
        assert found[i] == "\n\n".join(blocks)
    for i in range(4):
        assert found[10 + i] == "\n\n".join(f"A long paragraph of the article number {i} part {k} with many words in it." for k in range(2 + i))
    assert found[20] == found[21] == "" and found[22] == "just text <b> here" and found[23] == "deep"
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).count() == 0
    wrapper = {r.host: r.wrapper for r in html_text.wrappers(pages).collect()}["shop.de"]
    assert "<ul>(<li>#</>)+</>" in wrapper and "?" in wrapper


def main_texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://host.org/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_text.extract(pages).collect(), key=lambda r: r.page_id)]


def sentence(i, k):
    return f"Sentence {k} of the article number {i} has a good many words in it, {i * k} of them."


def test_unnamed_regions(spark):
    page = "<body><div>Home News Sport Weather</div><div>{}</div><div>Subscribe to our mailing list today</div><div>Copyright of the paper, all rights reserved</div></body>"
    rows = [page.format("".join(f"<p>{sentence(i, k)}</p>" for k in range(2 + i % 3))) for i in range(4)]
    assert main_texts(spark, rows) == ["\n\n".join(sentence(i, k) for k in range(2 + i % 3)) for i in range(4)]


def test_names_break_ties_only(spark):
    page = '<article><h1 id="related-work">Title {0}</h1><div class="post related-topics"><p>{1}</p></div><section id="discussion"><p id="ad-1914">{2}</p></section><div class="social-history">{3}</div><p class="x">Subscribe to our mailing list today</p><div class="comments"><p>Nice {0}!</p></div><p data-x=it\'s title="a > b">{4}</p><div class=more>{5}</div></article>'
    rows = [page.format(i, *(sentence(i, k) for k in range(1, 5)), "".join(f"<a href=x{i}{k}>Other article {i} {k}</a> " for k in range(4))) for i in range(5)]
    assert main_texts(spark, rows) == ["\n\n".join([f"Title {i}", *(sentence(i, k) for k in range(1, 5))]) for i in range(5)]


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div class=top>Menu of the page</div><div><p>{}</p><p>{}</p></div></body>"
    rows = [page.format(sentence(1, 1), sentence(1, 2))] * 6 + [page.format(sentence(i, 1), sentence(i, 2)) for i in (2, 3)]
    assert main_texts(spark, rows) == [f"{sentence(i, 1)}\n\n{sentence(i, 2)}" for i in [1] * 6 + [2, 3]]


def test_many_layouts_of_a_host(spark, monkeypatch):
    """More shapes than fit a worker's memory, hosts joined over salts, and a layout of its own that others' decisions don't fit."""
    monkeypatch.setattr(html_text, "HELD", 5)
    monkeypatch.setattr(html_text, "BROADCAST", 0)
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>"]
    rows, truth = [], []
    for i in range(120):
        chosen = [kinds[(i // 5**k) % 5] for k in range(3)] + ["<p>{}</p>"] * (i % 7)
        said = [sentence(i, k) for k in range(len(chosen))]
        body = "".join(k.format(x) for k, x in zip(chosen, said))
        if i % 40 == 39:  # the lead where others have the whole article
            body = f"<div class=t2>{said[0]}</div><div class=t3>" + "".join(k.format(x) for k, x in zip(chosen[1:], said[1:])) + "</div>"
        else:
            body = f"<div class=t2>{body}</div>"
        rows.append(f"<body><div class=top>Home and more of it</div>{body}<div class=bottom>Imprint of the paper</div></body>")
        truth.append("\n\n".join(said))
    assert main_texts(spark, rows) == truth


def test_alignment_equals_brute_force():
    """A pattern's expression matches every page that went into it, and merging pages one by one finds what is optional and repeated."""
    import itertools
    import re

    def expression(p):
        if p[0][:1] in ("#", "="):
            body = "[#=]"
        else:
            body = "".join(map(expression, p[3]))
            body = f"<{p[0]}>" + (f"(?:{body})+" if p[5] else body) + "</>"
        return f"(?:{body})" + ("*" if p[1] and p[2] else "+" if p[1] else "?" if p[2] else "")

    def tokens(block):
        return "".join("#" if isinstance(x, html_text.Text) else f"<{x.key}>{tokens(x)}</>" for x in block.children)

    children = ["<h2>a</h2>", "<p>b</p>", "<ul><li>c</li><li>d</li></ul>", "e"]
    pages = [html_text.blocks("<div>" + "".join(x) + "</div>") for n in range(1, 4) for x in itertools.product(children, repeat=n)]
    for start in range(0, 60, 7):
        some = pages[start : start + 20 : 3]
        wrapper = None
        for page in some:
            p = html_text.pattern(page)
            wrapper = p if wrapper is None else html_text.merge(wrapper, p)
        general = html_text.pattern(some[0])
        assert re.fullmatch(expression(general), f"<>{tokens(some[0])}</>")
        for page in some:
            assert re.fullmatch(expression(wrapper), f"<>{tokens(page)}</>"), (html_text.shape(wrapper), tokens(page))


def test_tables_equal_the_article(spark, small):
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def brute(ids, vectors, queries, k=5):
    out = {}
    for i in np.flatnonzero(queries):
        scores = vectors @ vectors[i] / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors[i]))
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], scores[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    truth = brute(ids, vectors, ids % 50 == 0)
    found = op2_nearest_neighbours(spark, path).toPandas()
    hits = sum(len({j for j, _ in truth[q]} & set(g.vec_id)) for q, g in found.groupby("query_id"))
    assert hits / sum(map(len, truth.values())) >= 0.9
    for q, g in found.groupby("query_id"):
        for r in g.itertuples():
            a, b = vectors[ids == q][0], vectors[ids == r.vec_id][0]
            assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        assert g.sort_values("rank").score.is_monotonic_decreasing


@pytest.mark.parametrize("size", [700, 6000])
def test_few_are_verified(size):
    """Recall of one block, and the share of it that is verified."""
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((40, 48))
    for vectors in (rng.standard_normal((size, 48)), centres[rng.integers(0, 40, size)] + 0.3 * rng.standard_normal((size, 48))):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        projected = np.ascontiguousarray((unit @ neighbours.lines(48)).T.astype(np.float32))
        order = np.argsort(projected, axis=1)
        block = neighbours.Block(48, np.arange(size).tobytes(), vectors.tobytes(), np.take_along_axis(projected, order, axis=1).tobytes(), np.argsort(order, axis=1).astype(np.uint16).tobytes(), neighbours.first_width(projected))
        some = np.arange(0, size, size // 50)
        found = block.candidates(unit[some] @ block.lines, np.array(some))
        truth = np.argsort(-(unit[some] @ unit.T), axis=1)[:, 1:6]
        assert np.mean([len(set(t) & set(f)) / 5 for t, f in zip(truth, found)]) >= 0.9
        assert np.mean([len(f) for f in found]) <= 2.2 * max(neighbours.VERIFIED, neighbours.SHARE * size)


def test_texts_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.1]), (2, [0.1, 2.0]), (2, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(spark, vectors, vectors.filter("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 3)) for r in found] == [(1, 0.999), (2, 0.999)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (50, [0.0, 3.0]), (None, [1.0, 0.0]), (100, []), (1, [2.0, 0.0]), (9, [1e-30, 0.0]), (150, [3e30, 0.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    found = neighbours.nearest(spark, vectors, vectors.filter("vec_id % 50 = 0")).toPandas()
    assert set(found.query_id) == {0, 50, 150}
    assert found[found.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 9, 150, 50]
    assert neighbours.nearest(spark, vectors.limit(0), vectors.limit(0)).count() == 0
    assert neighbours.nearest(spark, vectors.filter("vec_id = 0"), vectors.filter("vec_id = 0")).count() == 0
