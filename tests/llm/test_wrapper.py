import itertools
import random
import re
import time

import pytest

from sparkloom.llm import wrapper

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><header><h2>Site</h2></header><div class="ad">Buy {n}</div>
<article><h1>Title&nbsp;{n} &amp; more</h1><p>By the staff</p><p><b>First {n}<br><p>Second
   <i>word</i>{n}</p><div class="share">Share it</div><aside>Side</aside><form>Name<input></form><ul><li>one {n}<li>two</ul>
<section id="comments"><p>Reader says {n}</p></section></article><footer>&copy; {n}</footer></body></html>"""
TEXT = "Title {n} & more\n\nBy the staff\n\nFirst {n}\n\nSecond word{n}\n\none {n}\n\ntwo"


def one(html):
    return wrapper.extracted(html, *wrapper.induced([html]))


def test_the_varying_region_is_content_and_all_of_it_stays():
    own = wrapper.induced([PAGE.format(n=n) for n in range(6)])
    assert wrapper.extracted(PAGE.format(n=41), *own) == TEXT.format(n=41)


WORDS = [f"w{i}" for i in range(500)]


def unnamed(n, rng):
    """A page whose elements and classes say nothing; everything but two parts differs by page."""

    def words(k):
        return " ".join(rng.choices(WORDS, k=k))

    body = "".join(f"<div class='q'>{words(rng.randint(5, 30))}</div>" for _ in range(rng.randint(1, 6)))
    return (
        f"<div class='x1'><div>{words(3)}</div><div>{words(2)}</div></div><div class='x2'>Our house {n}</div><div class='x3'><h2>{words(4)}</h2>"
        f"<div class='x4'>Press this</div><div class='x5'>{body}</div></div><div class='x6'>{words(4)}</div>"
    )


def test_no_name_is_needed(monkeypatch):
    rng = random.Random(3)
    pages = [unnamed(n, rng) for n in range(20)]
    own = wrapper.induced(pages)

    def want(page):
        return "\n\n".join([re.search("<h2>(.*?)</h2>", page)[1], *re.findall("<div class='q'>(.*?)</div>", page)])

    assert [wrapper.extracted(p, *own) for p in pages] == [want(p) for p in pages]
    for name in ("ASIDE_TAGS", "ASIDE_NAMES", "MAIN_NAMES"):
        monkeypatch.setattr(wrapper, name, frozenset())
    bare = wrapper.induced(pages)
    assert [wrapper.extracted(p, *bare) for p in pages] == [want(p) for p in pages]


def test_constant_paragraphs_of_an_article_stay():
    pages = [f"<nav>menu {n}</nav><article><h1>T{n}</h1><p>Common lead paragraph.</p><p>Body {n}</p></article>" for n in range(9)]
    assert wrapper.extracted(pages[4], *wrapper.induced(pages)) == "T4\n\nCommon lead paragraph.\n\nBody 4"


@pytest.mark.parametrize("part", ['<div class="content notice">told {n}</div>', '<table class="search results"><tr><td>told {n}</table>', "<p><label>told</label> {n}</p>"])
def test_blocks_of_an_article_stay_whatever_part_of_their_name(part):
    pages = [f"<article><h1>T{n}</h1>{part.format(n=n)}<p>body {n}</p></article>" for n in range(5)]
    assert wrapper.extracted(pages[2], *wrapper.induced(pages)) == "T2\n\ntold 2\n\nbody 2"


def test_few_pages_fall_back_on_names_and_equal_pages_count_once():
    pages = [PAGE.format(n=1)] * 8
    assert wrapper.extracted(pages[0], *wrapper.induced(pages)) == TEXT.format(n=1)
    assert wrapper.induced(pages)[1] == wrapper.induced(pages[:1])[1]


def test_letters_that_change_length_lose_nothing():
    assert one("İ" * 40 + "<p>a<script>x</SCRIPT>b</p><p>c</p>") == "İ" * 40 + "\n\nab\n\nc"


def heaviest(a, b):
    """Simple tree matching by trying every way to pair children in order."""
    if a.key != b.key:
        return 0
    best = 0
    for k in range(min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, k):
            for right in itertools.combinations(b.kids, k):
                found = [heaviest(x, y) for x, y in zip(left, right, strict=True)]
                if all(found):
                    best = max(best, sum(found))
    return 1 + best


def tree(rng, depth=3):
    node = wrapper.Node(rng.choice(["div", "p", "ul"]))
    node.kids = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)]
    node.items = [*node.kids, rng.choice("xyz")]
    return node


@pytest.mark.parametrize("seed", range(40))
def test_simple_tree_matching_against_all_matchings(seed):
    rng = random.Random(seed)
    a, b = tree(rng), tree(rng)
    b.key = a.key
    m = wrapper.Matcher()
    m.intern(a), m.intern(b)
    assert m.weight(a.shape, b.shape) == heaviest(a, b) and m.weight(a.shape, a.shape) == a.size
    pairs = m.children(a.kids, b.kids)
    places = sorted((a.kids.index(x), b.kids.index(y)) for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(places)) and all(x.key == y.key for x, y in pairs)


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""), ("plain &lt;text&gt; &#233;", "plain <text> é"), ("<p>a<p>b", "a\n\nb"), ("<article><p>in</p></article><p>out</p>", "in"),
        ("<main><h1>m</h1>text</main><p>out", "m\n\ntext"), ("<p>cut &am", "cut &am"), ("<article><p>never closed <b>bold", "never closed bold"),
        ("<p>a<!-- <p>b</p> --> c</p>", "a c"), ("<p>x<script>1<2</script>y</p>", "xy"), ("<p>a</b></i> b</p>", "a b"), ("<div hidden>h</div><p>s</p>", "s"),
        ("<p>a <span> b </span>\n\n c</p>", "a b c"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p title='a>b'>t</p>", "t"),
        ("<p title='open>t</p>", "t"), ("<p>Hello <button>x</button> world</p>", "Hello world"), ("<p>a <span hidden>no</span>b<p>c", "a b\n\nc"), ("<select><option>1<option>2</select><p>t", "t"),
    ],
)
def test_parsing(html, want):
    assert one(html) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ('<div class="main-visual">Picture</div><main><p>the article</p></main>', "the article"),
        ('<div class="main-visual">Picture</div><div role="main"><p>the article</p></div>', "the article"),
        ("<main><p>one</p></main><p>out</p><main><p>two</p></main>", "one\n\ntwo"),
        ('<div id="main"><p>a</p><main><p>b</p></main></div><div class="x main"><p>c</p></div>', "a\n\nb\n\nc"),
        ("".join(f"<article><p>{i}</p></article>" for i in range(9)) + "<p>out</p>", "\n\n".join("012345678")),
    ],
)
def test_names_of_single_pages(html, want):
    assert one(html) == want


def test_deep_and_wide_pages():
    assert one("<div>" * 5000 + "deep") == "deep" and one("<b>" * 5000 + "deep") == "deep"
    started = time.time()
    pages = ["<nav>m</nav><article>" + "".join(f"<p>para {i} {n}</p><div class='k{i % 7}'>x {n}</div>" for i in range(20_000)) + "</article>" for n in range(3)]
    found = wrapper.extracted(pages[1], *wrapper.induced(pages)).split("\n\n")
    assert len(found) == 40_000 and found[:2] == ["para 0 1", "x 1"]
    left = ["".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>{i}</div>" for i in range(6000))] * 2
    assert len(wrapper.extracted(left[0], *wrapper.induced(left)).split("\n\n")) == 6000
    assert time.time() - started < 60


def test_query(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(12)] + [(100, None, "<p>no url"), (101, "http://b.example/x", None), (0, "http://a.example/0", PAGE.format(n=0)), (None, "//A.example:80/z", PAGE.format(n=99))]
    rows += [(102, "http://c.example/x", ""), (103, "http://c.example/y", "<script>x</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as wrapper", "1 as layout", "2 as copies")
    found = wrapper.extract(df).collect()
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in found}
    for i in range(12):
        assert got[i, f"http://a.example/{i}"] == (TEXT.format(n=i), len(TEXT.format(n=i)))
    assert got[100, None] == ("no url", 6) and got[101, "http://b.example/x"] == got[102, "http://c.example/x"] == got[103, "http://c.example/y"] == ("", 0)
    assert got[None, "//A.example:80/z"][0] == TEXT.format(n=99)
    assert len(found) == len(rows) and wrapper.extract(df.limit(0)).count() == 0


def test_cluster_and_one_process_agree(spark):
    """The joins, counts and the SQL that puts texts together against the same functions on one list."""
    rng = random.Random(5)
    pages = [unnamed(n, rng) for n in range(30)]
    rows = [(n, f"http://u.example/{n}", p) for n, p in enumerate(pages)] + [(100 + n, f"http://u.example/again/{n}", pages[0]) for n in range(40)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = wrapper.induced(pages)
    assert all(got[n] == wrapper.extracted(p, *own) for n, p in enumerate(pages)) and {got[100 + n] for n in range(40)} == {got[0]}


def test_layouts_of_a_host_and_pages_of_lone_hosts(spark):
    first = "<article><h1>T{n}</h1><p>Brand</p><p>body {n}</p></article>"
    second = '<div class="page"><section><h2>U{n}</h2><div class="by"><p>House</p></div><ul><li>item {n}</li></ul></section></div>'
    rows = [(n, f"http://h.example/{n}", (first if n % 3 else second).format(n=n)) for n in range(60)]
    # one story on all pages of a layout is no template
    story = "<nav>menu {n}</nav><article><h1>T</h1><p>Brand</p><p>the same story</p></article>"
    rows += [(100 + n, f"http://h.example/{n}", story.format(n=n)) for n in range(12)]
    # alike pages of many hosts, one each
    lone = "<div class='top'>top {n}</div><div class='body'><div class='t'><p>long text of page {n}</p><p>more {n}</p></div></div>"
    rows += [(200 + n, f"http://h{n}.example/", lone.format(n=n)) for n in range(9)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(60):
        assert got[n] == (f"T{n}\n\nBrand\n\nbody {n}" if n % 3 else f"U{n}\n\nitem {n}")
    assert {got[100 + n] for n in range(12)} == {"T\n\nBrand\n\nthe same story"}
    assert [got[200 + n] for n in range(9)] == [f"long text of page {n}\n\nmore {n}" for n in range(9)]


def test_few_equal_texts_stay():
    pages = [f"<nav>menu {n}</nav><article><p>{'shared' if n < 3 else f'own {n}'}</p><p>Brand</p></article>" for n in range(8)]
    assert wrapper.extracted(pages[0], *wrapper.induced(pages)) == "shared\n\nBrand"


def test_the_given_pages_need_the_wrapper_and_no_names(monkeypatch):
    """Emptying the lists changes no page; without the wrapper every page differs."""
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()
    found = [wrapper.extracted(p, *own) for own in [wrapper.induced(pages)] for p in pages]
    parse = wrapper.parse

    def unnamed_parse(text):
        root, todo = parse(text), []
        todo.append(root)
        while todo:
            node = todo.pop()
            node.leads, node.aside = "", False
            todo += node.kids
        return root

    monkeypatch.setattr(wrapper, "parse", unnamed_parse)
    assert found == [wrapper.extracted(p, *own) for own in [wrapper.induced(pages)] for p in pages]
    monkeypatch.setattr(wrapper, "parse", parse)
    for page, text in zip(pages, found, strict=True):
        pivot = wrapper.Pivot.of(parse(page))
        assert wrapper.extracted(page, pivot, wrapper.Wrapper([*range(len(pivot.nodes))], [], [], [], [])) != text
