"""Main text: boilerplate by name, broken markup, templates by counting, odd rows."""

import html as stdlib_html
import re

import pytest

from lantern.llm import html


def text(source):
    return html.main_text(html.read_page(source))


def test_boilerplate_by_name():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="single">
    <header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice">We use cookies</div>
    <div class="sidebar-left">Side</div><main><article class="post"><header><h1>Ti&amp;tle</h1></header>
    <p>One <b>two</b>\n three<br>four.</p><div class="ad-slot">Buy</div><script>var a = "</p>";</script>
    <ul><li>a<li>b</ul><form>Sign up <input></form><p>Last &eacute;&#33;<!-- no --></article>
    <section id="comments"><p>First!</p></section></main><aside>Aside</aside><footer>&copy;</footer></body></html>"""
    assert text(page) == ["Ti&tle", "One two three four.", "a", "b", "Last é!"]


def test_broken_markup():
    assert text("<p><b>One.<br><p>Two</p>") == ["One.", "Two"]
    assert text("<article><h1>A</h1><p>B</div></nav> C<p>D &am") == ["A", "B", "C", "D &am"]
    assert text("<article><p>whole <p>cut <a hr") == ["whole", "cut"]
    assert text('<p title="a>b">x</p><p title="open>y</p>') == ["x", "y"]
    assert text("a < b <p>c") == ["a < b", "c"]
    assert text("<script>x") == [] and text("<!-- x") == [] and text("") == []
    assert text("<div>no article</div><p>here</p>") == ["no article", "here"]


def test_stray_and_deep(spark):
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == ["x"]
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "http://a.b/c", long, "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "http://a.b/c", long, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.n_chars) for r in html.extract(pages).collect()}
    assert out == {(1, 999_999), (2, 0), (None, 0)}
    assert html.extract(pages).count() == 4
    assert html.extract(pages.limit(0)).count() == 0


def test_the_region_never_drops_a_headline_or_a_long_text():
    assert text("<main><h1>Head</h1><article><p>Body</p></article></main>") == ["Head", "Body"]
    assert text("<h1>Head</h1><p>Lead</p><article><p>Body of some length</p></article>") == ["Head", "Body of some length"]
    assert text("<div>A long text of the page itself.</div><article><p>Teaser</p></article>") == ["A long text of the page itself.", "Teaser"]


@pytest.mark.parametrize("in_memory", [2_000_000, 0])
def test_templates_of_a_host(spark, in_memory):
    page = lambda i, extra="": f"<body><div><span>All about us</span><p>Call now</p></div><div><h1>News {i}</h1><p>Story number {i} {'about much ' * 9}</p>{extra}</div></body>"
    rows = [(i, f"https://Site.example/{i}", page(i, "<p>Share this</p>" if i % 2 else "")) for i in range(20)]
    rows += [(100 + i, f"https://other.example/{i}", page(i)) for i in range(2)]  # too few pages
    rows += [(200 + i, "https://copies.example/1", page(7)) for i in range(30)]  # copies count once
    rows += [(300 + i, f"https://shared.example/{i}", f"<article><h1>{i}</h1><p>The same passage on every page</p><p>own {i}</p><div>Read <b>more</b></div></article>") for i in range(20)]
    rows += [(400, "https://site.example/short", "<div><span>All about us</span><p>Call now</p></div><p>x</p>")]  # most of a page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in html.extract(pages, html.Templates(in_memory=in_memory)).collect()}
    assert len(out) == len(rows)
    assert out[3].text == "News 3\n\nStory number 3 " + ("about much " * 9).strip() and out[3].n_template == 3
    assert out[400].text == "x"
    assert out[101].text.startswith("All about us") and out[201].text.startswith("All about us")
    assert out[303].text == "3\n\nThe same passage on every page\n\nown 3" and out[303].n_template == 1


def subtrees(source, host):
    """Brute force: the tree of the page by a plain parser, and the key of every element outside articles with its blocks."""
    import html.parser

    found, stack, texts = [], [], []

    class Tree(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("nav", "div", "footer", "ul", "li", "article") and not any(n == "article" for n, _ in stack):
                stack.append((tag, []))

        def handle_endtag(self, tag):
            if stack and stack[-1][0] == tag:
                name, parts = stack.pop()
                value = (name, tuple(parts))
                if name != "article":
                    found.append((host, value))
                if stack:
                    stack[-1][1].append(value)

        def handle_data(self, data):
            data = " ".join(data.split())
            if data and stack and stack[-1][0] != "article":
                stack[-1][1].append(data)
                texts.append(data)

    tree = Tree(convert_charrefs=True)
    tree.feed(source)
    tree.close()
    return found


def test_templates_of_the_tables_against_all_subtrees(spark):
    """Which blocks outside the articles recur, counted over whole subtrees; the method removes them before any name does."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.op3_html(spark, sf).collect()
    main = {r.page_id: r.text for r in rows}
    seen, held = {}, {}
    for i, row in pages.items():
        held[i] = subtrees(row.html, html.host_of(row.url))
        for s in held[i]:
            seen.setdefault(s, set()).add(main[i])

    def texts(value, recurs):
        """The texts under a subtree of which some subtree recurs."""
        out = 0
        for part in value[1]:
            if isinstance(part, tuple):
                out += texts(part, len(seen[value_host, part]) >= 3)
            else:
                out += recurs
        return out

    total = 0
    for row in rows:
        value_host = html.host_of(row.url)
        inner = {id(p) for _, v in held[row.page_id] for p in v[1] if isinstance(p, tuple)}
        outer = [v for _, v in held[row.page_id] if id(v) not in inner]
        expected = sum(texts(v, len(seen[value_host, v]) >= 3) for v in outer)
        assert row.n_template == expected, row.page_id
        total += expected
    assert total > 0


def test_query_against_a_plain_reading(spark):
    """The tables' pages have one frame; read it with plain regular expressions."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: (r.text, r.n_chars) for r in html.op3_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        body = (row.html or "").partition("<article>")[2].partition("</article>")[0]
        body = re.sub(r"<[^>]*$", "", body)
        blocks = [" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h[1-6])>", body)]
        expected = "\n\n".join(b for b in blocks if b)
        assert got[row.page_id] == (expected, len(expected)), row.page_id


def test_names_never_take_the_main_text():
    article = "<article><h1>Head</h1><p>Body</p></article>"
    assert text(f'<div class="layout has-sidebar">{article}</div>') == ["Head", "Body"]
    assert text(f'<div class="sidebar"><div class="widget-area">{article}</div></div>') == ["Head", "Body"]
    assert text(f'<form id="form">{article}<p>x</p></form><form>Sign up</form>') == ["Head", "Body"]
    assert text('<main><div class="social-science">Of society</div><section class="related-work">Others did</section><div class="social">Like us</div></main>') == ["Of society", "Others did"]
    assert text('<div class="widget"><p>One of three.</p><p>Two of three.</p><p>Three.</p></div><p>End</p>') == ["One of three.", "Two of three.", "Three.", "End"]
    assert text(f'{article}<div class="ad">{"Buy this now. " * 40}</div>') == ["Head", "Body"]
    assert text(f'{article}<section id="comments"><article><p>{"First! " * 40}</p></article></section>') == ["Head", "Body"]
    assert text('<div class="comments"><p>a.</p><p>b.</p><p>c.</p></div>') == []
    teaser = "A teaser of the next story, here"
    assert text(f"<div>The long text of this very page.</div><article><p>{teaser}</p></article>") == ["The long text of this very page.", teaser]


def test_shared_texts_stay_and_varied_menus_go(spark):
    release = "".join(f"<p>Part {i} of the release which several pages share, word for word.</p>" for i in range(4))
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
    menu = lambda i: f'<div class="x{i}"><div class="q7"><a href="/">{words[i]}</a></div><div class="q7"><a href="/">{words[i - 1]} more</a></div></div>'
    rows = [(i, "https://a.example/", f'<body>{menu(i)}<div class="content"><p>Oslo, day {words[i]}</p>{release}</div></body>') for i in range(4)]
    story = lambda i: f"<h1>Head {words[i]}</h1><p>{words[i]} happened to {words[i - 1]}, as was told at length by {words[i - 2]}.</p>"
    rows += [(100 + i, "https://b.example/", f'{menu(i)}<div class="lead">Lead {words[i]}</div><div class="text">{story(i)}</div>') for i in range(12)]
    rows += [(200 + i, "https://c.example/", f'<div class="z">Buy {words[i]}</div><article>{story(i)}<div class="note">Note {words[i]}</div></article>') for i in range(12)]
    near = "h" * 70
    rows += [(300 + i, f"https://{near}{i}.example/", f"<div>Same words</div><p>story {words[i]} is told here</p>") for i in range(4)]
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert out[i].text.split("\n\n") == [f"Oslo, day {words[i]}", *re.findall("<p>(.*?)</p>", release)], out[i].text
        assert out[i].n_shape == 2
        assert out[300 + i].text.startswith("Same words")  # four hosts, whose names begin alike
    for i in range(12):
        told = [f"Head {words[i]}", f"{words[i]} happened to {words[i - 1]}, as was told at length by {words[i - 2]}."]
        assert out[100 + i].text.split("\n\n") == [f"Lead {words[i]}", *told]
        assert out[200 + i].text.split("\n\n") == [*told, f"Note {words[i]}"] and out[200 + i].n_shape == 1


def test_templates_alone_give_the_tables_texts(spark):
    """With names switched off, pages whose article holds most of their prose have the same text, wherever the host has three pages."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    named = {r.page_id: r for r in html.op3_html(spark, sf).collect()}
    alone = {r.page_id: r for r in html.extract(pages, html.Templates(names=False)).collect()}
    asked = {r.page_id for r in pages.collect() if 2 * len(named[r.page_id].text) > len(re.sub(r"<style.*?</script>|<a .*?</a>|<[^>]*>", "", r.html or ""))}
    differ = [i for i in asked if named[i].text != alone[i].text]
    assert len(asked) > 0.8 * len(named) and not differ, (len(asked), len(named), len(differ), differ[:5])
    assert sum(r.n_shape for r in alone.values()) > 1000
