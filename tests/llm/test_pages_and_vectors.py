"""HTML extraction and vector groups."""

import math
import os
import re

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def test_main_text(spark):
    from sessionloom.llm.html_extract import main_text

    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav class="menu"><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>Head &lt;line&gt;</h1><p><b>One</b>
  two&nbsp;three<br>four<p>Fi&#118;e &copy; <a href="#">six</a></p><aside>related</aside><form><label>mail</label><input></form>
<!-- hidden --><div class="ads">buy</div><section class="comments"><p>first!</p></section></article><footer>end</footer></body></html>"""
    plain = "<html><body><div id=top>Site name</div><div class=story><p>%s</p><p>%s</p></div></body></html>"
    rows = [
        (1, "https://a.example/1", page),
        (2, "https://a.example/2", page.replace("five", "5")),
        (3, "https://b.example/1", plain % ("Unlike others", "in all its words")),
        (4, "https://b.example/2", plain % ("Another text", "of some length")),
        (5, None, "<p>no host"),
        (6, "https://a.example/3", None),
        (7, "https://a.example/4", ""),
        (7, "https://a.example/4", ""),
        (None, "not a url", "just words &amp; no tags"),
    ]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, host int")
    out = main_text(pages).collect()
    text = {r.page_id: r.text for r in out}
    assert text[1] == "Head <line>\nOne two three four\nFive © six"
    assert text[3] == "Unlike others\nin all its words" and text[4] == "Another text\nof some length"
    assert text[5] == "no host" and text[6] == "" == text[7] and text[None] == "just words & no tags"
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert main_text(pages.filter("1 = 0")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_op1_on_its_table(spark):
    import html

    from sessionloom.llm.queries import queries

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries()["op1_html_extract"](spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(filter(None, blocks))


def test_wrappers_are_union_free():
    from sessionloom.llm.html_extract import Automaton, align, expression, fold, parse

    streams = [fold([("t", t) for t in parse(x)[0]]) for x in ("<ul><li>a<li>b<li>c</ul><h1>x</h1>", "<ul><li>a</ul><h1>x</h1><p>more", "<ul><li>a<li>b</ul><h1>y</h1>")]
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    assert expression(wrapper) == "ul (li #)+ /ul h1 # (p #)?"
    machine = Automaton(wrapper)
    for tokens in ("ul li # li # /ul h1 #", "ul li # /ul h1 # p #"):
        assert machine.match(tokens.split()) == tokens.split()
    assert machine.match("ul li # form # /ul h1 # p # p #".split()) == ["ul", "li", "#", None, None, "/ul", "h1", "#", "p", "#", None, None]


def test_random_pages_match_the_wrapper_of_their_host():
    """Whatever streams are aligned, in whatever order, the wrapper foresees every token of each."""
    import random

    from sessionloom.llm.html_extract import Automaton, align, fold

    rng = random.Random(12)
    for _ in range(150):
        pages = []
        for _ in range(rng.randint(1, 6)):
            page = ["nav", "!li", "#", "/nav"]
            for _ in range(rng.randint(0, 4)):
                page += rng.choice([["p", "#"], ["h2", "#", "p", "#"], ["div", "=1", "/div"], ["ul", *["li", "#"] * rng.randint(1, 3), "/ul"], ["p", "=2"]])
            pages.append([*page, "footer", "#", "/footer"])
        wrapper = fold([("t", t) for t in pages[0]])
        for page in pages[1:]:
            wrapper = align(wrapper, fold([("t", t) for t in page]))
        machine = Automaton(wrapper)
        for page in pages:
            met = machine.match(page)
            assert all(m == t or (m == "#" and t[0] == "=") for m, t in zip(met, page, strict=True))


def _host_pages(n, notice="Read with care: this text has not been checked.", host="one.example"):
    body = "<html><body><div>%s</div><article><h1>Title %d</h1><div><p>%s</p></div><div><p>Body %d of the page</p>%s</div></article></body></html>"
    return [(i, f"https://{host}/{i}", body % ("Site", i, notice, i, "<p>more</p>" * (i % 3))) for i in range(n)]


def test_constants_of_a_host_are_template(spark):
    """A notice without any telling name goes because its place in the wrapper is a constant; where texts differ it is a slot and stays."""
    from sessionloom.llm.html_extract import host_wrappers, main_text

    rows = _host_pages(12) + _host_pages(3, host="few.example")
    mixed = [(100 + i, u.replace("one", "mixed"), h if i % 2 else h.replace("Read with care", f"Read {i}")) for i, u, h in _host_pages(12)]
    copies = [(200 + i, f"https://copies.example/{i}", rows[0][2]) for i in range(20)]
    df = spark.createDataFrame(rows + mixed + copies, "page_id long, url string, html string")
    out = {(r.page_id, r.url): r.text for r in main_text(df).collect()}
    for i, u, _ in rows[:12]:
        assert out[i, u] == "\n".join([f"Title {i}", f"Body {i} of the page", *["more"] * (i % 3)])
    assert "Read with care" in out[0, "https://few.example/0"]  # too few pages to tell
    assert all("Read" in out[i, u] for i, u, _ in mixed)
    assert all(out[i, u] == "Title 0\nRead with care: this text has not been checked.\nBody 0 of the page" for i, u, _ in copies)
    wrappers = {r.host: r.wrapper for r in host_wrappers(df).collect()}
    assert "=" in wrappers["one.example"] and "=" not in wrappers["copies.example"]


def test_wrapper_decides_what_is_content(spark, monkeypatch):
    from sessionloom.llm import html_extract as H

    rule = {"wrapper": [["t", "article"], ["t", "h1"], ["t", "#"], ["t", "p"], ["t", f"={H.text_name('always')}"], ["+", [["t", "p"], ["t", "#"]]], ["t", "/article"]], "root": "article", "menus": [], "constants": [H.text_name("always")]}
    page = "<article><h1>one</h1><p>always</p><p>two</p><p>always</p></article>"
    assert H.Extractor(rule)(page) == "one\ntwo\nalways"  # the second time the text meets a slot


@pytest.mark.parametrize("name", ["search-story", "post-tags", "post-header", "entry-footer"])
def test_names_beside_words_for_content_stay(name):
    from sessionloom.llm.html_extract import parse

    assert "!" not in parse(f"<article><div class='{name}'><p>text</p></div></article>")[1][0][1]


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "comments-list", "post-comments", "sidebarLeft", "side-bar", "nav-menu", "newsletter"])
def test_names_of_boilerplate_go(name):
    from sessionloom.llm.html_extract import parse

    assert "!" in parse(f"<article><div class='{name}'><p>text</p></div></article>")[1][0][1]


def test_scripts_and_broken_markup():
    from sessionloom.llm.html_extract import parse

    texts = lambda page: [t for _, _, t, _ in parse(page)[1]]
    assert texts('<p>a</p><script>for(i=0;i<n;i++){s="a";}</script><p>b</p>') == ["a", "b"]
    assert texts("<p>a<style>p>b{}</style><!-- <p>x --> b<svg><text>no</text><svg/></svg> c") == ["a b c"]
    assert texts("<SCRIPT>x</ScRiPt ><p>y</p><textarea><p>z</textarea>") == ["y"]
    assert texts("<p>1 < 2 &lt; 3</p><p title='a>b'>q</p><p title=it's>r</p>") == ["1 < 2 < 3", "q", "r"]
    assert texts('<p>a</p><p title="never closed>b</p><p>c</p>') == ["a", "b", "c"]
    assert texts("<script>never closed <p>x") == [] and texts("<p>x</p><!-- never closed <p>y") == ["x"]


def test_long_pages_take_time_in_proportion():
    import time

    from sessionloom.llm.html_extract import align, fold, parse

    for piece in ("<a ", "<p>x", '<p title="', "<!-- ", "<script>", "< ", "</", "<p class=a>y<i>z</i></p>\n", "&amp;<"):
        start = time.perf_counter()
        parse(piece * (2_000_000 // len(piece)))
        assert time.perf_counter() - start < 20
    start = time.perf_counter()
    x, y = (fold([("t", f"{k}{i % 5000}") for i in range(40_000)]) for k in "xy")
    align(x[:3000] + y[:20_000], x[:2000] + y[:19_000])
    assert time.perf_counter() - start < 20


def test_vector_groups(spark):
    from sessionloom.llm.vector_dedup import vector_groups

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = [(centres[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.4])).tolist() for i in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(300, vectors[0]), (301, vectors[0]), (302, None), (303, [0.0] * 16), (304, []), (305, [None] + [1.0] * 15), (306, [math.nan] + [1.0] * 15), (307, [math.inf] + [1.0] * 15), (308, [1.0, 0.0]), (308, [1.0, 0.0]), (None, vectors[1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    out = vector_groups(df).collect()
    assert len(out) == len(rows)
    sound = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    near = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    links = [[j for j, (_, b) in enumerate(sound) if j != i and near(a, b)] for i, (_, a) in enumerate(sound)]
    group = list(range(len(sound)))
    for _ in range(40):
        for i, js in enumerate(links):
            for j in js:
                group[i] = group[j] = min(group[i], group[j])
    want = []
    for i, (name, _) in enumerate(sound):
        ids = [sound[j][0] for j in range(len(sound)) if group[j] == group[i] and sound[j][0] is not None]
        want.append((str(name), len(links[i]), min(ids)))
    odd = {302, 303, 304, 305, 306, 307}
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in out if r.vec_id not in odd) == sorted(want)
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in out if r.vec_id in odd)
    assert vector_groups(df.filter("1 = 0")).count() == 0


def test_graph_recall():
    from sessionloom.llm.vector_dedup import FIRST_BEAM, Graph, _found

    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 24)).repeat(20, axis=0) + rng.normal(size=(1600, 24)) * 0.25
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = x @ x.T >= 0.9
    found = np.zeros_like(truth)
    for part, other, whole in _found(Graph(x.astype(np.float32)), x, x, 0.9, FIRST_BEAM):
        if whole:
            found[part] |= other >= 0.9
        else:
            found[part, other] = True
    assert not (found & ~truth).any()
    assert found.sum() >= 0.97 * truth.sum()


def test_the_audit_is_never_empty_and_widens_beams(monkeypatch):
    from sessionloom.llm import vector_dedup as V

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = np.arange(3000)
    graph = V.Graph(x.astype(np.float32))
    planted = V._planted(x, 0.9, V.AUDIT)
    assert len(planted) == V.AUDIT and ((planted @ x.T).max(axis=1) >= 0.9).all()
    beam, links, found = V._audit(graph, x, names, x, names, 0.9, 0.99)
    assert links >= V.AUDIT and found >= 0.99 * links  # no vector counts as its own link: only planted ones are near here
    # a graph that leads nowhere is found out: the beam grows to the whole shard
    graph.levels[-1][:] = -1
    wide, links, found = V._audit(graph, x, names, x, names, 0.9, 0.99)
    assert wide * V.SCAN_PART >= len(x) > beam * V.SCAN_PART or wide > beam
    assert found == links


@pytest.mark.parametrize("first", [16, 1])
def test_large_clusters_leave_counts_and_a_forest(spark, monkeypatch, first):
    """A cluster wider than every beam is counted exactly; few rows leave the tasks."""
    from sessionloom.llm import vector_dedup as V

    monkeypatch.setattr(V, "FIRST_BEAM", first)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * 0.02, rng.normal(size=(300, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, audit = V.audited_groups(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert all(r.n_links == want[r.vec_id] for r in out.collect())
    assert all(r.component_id == 0 for r in out.collect() if r.vec_id < 900)
    seen = audit.collect()
    assert len(seen) == V.MIN_SHARDS and all(r.found >= 0.9 * r.links > 0 for r in seen)


def test_norms_that_over_or_underflow(spark):
    from sessionloom.llm.vector_dedup import vector_groups

    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (5, [-1e300, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test data")
def test_links_of_every_hundredth_vector(spark):
    """Recall against brute force on the largest given table, with links planted beside those it has."""
    from sessionloom.llm.vector_dedup import audited_groups

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{BIG}/embeddings.parquet").collect()]
    rng = np.random.default_rng(6)
    top = max(i for i, _ in rows) + 1
    near = [(top + k, v + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * 0.3) for k, (_, v) in enumerate(r for r in rows if r[0] % 50 == 0 for _ in range(5))]
    rows += near
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    out, audit = audited_groups(df)
    got = {r.vec_id: r.n_links for r in out.collect()}
    x = np.stack([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = {i: int((x @ x[k] >= 0.9).sum()) - 1 for k, (i, _) in enumerate(rows) if i % 100 == 0}
    assert sum(truth.values()) > 50 and all(got[i] <= n for i, n in truth.items())
    assert sum(got[i] for i in truth) >= 0.9 * sum(truth.values())
    assert all(r.found >= 0.9 * r.links and r.links > 0 for r in audit.collect())


def test_components(spark):
    from sessionloom.llm._common import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (None, 7)] + [(1000, i) for i in range(1001, 1101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 == got[100] and all(got[i] == 1000 for i in range(1001, 1101))


@pytest.mark.parametrize("ids", [False, True])
def test_ids_of_single_pages_are_no_structure(spark, ids):
    """Forty pages of one host without an article element, each with a small box of its own."""
    from sessionloom.llm.html_extract import main_text

    def page(i):
        own = f'id="post-{i}" class="post post-{i}"' if ids else 'class="post"'
        return f'<html><body><div class="menu"><a href="/">Home</a></div><div {own}><div class="inner"><p>Story {i} tells of many things at length, {"word " * 30}.</p><p>Part two of story {i}, {"more " * 20}.</p></div></div><div class="box"><p>Posted on day {i} of the year</p></div></body></html>'

    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    for r in main_text(pages).collect():
        assert r.text.startswith(f"Story {r.page_id} tells") and f"Part two of story {r.page_id}" in r.text and "Posted" not in r.text


def test_an_article_keeps_its_header_and_references(spark):
    from sessionloom.llm.html_extract import main_text

    def page(i):
        links = "".join(f'<li><a href="/r{j}">Reference {i}-{j}</a></li>' for j in range(4))
        return f'<header><h1>Site</h1></header><ul><li><a href="/x{i}">Menu entry {i}</a></li></ul><article><header><h1>Title {i}</h1><p>Lead of {i}</p></header><p>Body of {i}.</p><ul>{links}</ul><header class="share">Share {i}</header></article><footer>Foot {i}</footer>'

    pages = spark.createDataFrame([(i, f"http://b.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    for r in main_text(pages).collect():
        assert r.text.split("\n") == [f"Title {r.page_id}", f"Lead of {r.page_id}", f"Body of {r.page_id}.", *(f"Reference {r.page_id}-{j}" for j in range(4))]
