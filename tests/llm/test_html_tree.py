import math
import random
from collections import Counter, defaultdict

import pytest

from plumbline.llm import html_tree
from plumbline.llm.html_tree import main_text, parsed, stable

NONE = frozenset()


def text(page):
    return main_text(parsed(page)[0], NONE)


def test_article_without_its_surroundings():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>menu</a></ul></nav>"
        "<!-- c --><div class='ad'>buy</div><article><h1>He&amp;ad &#233;</h1><p><b>One  two<br>three<p>Four &lt;five&gt;</p><form>f</form>"
        "<section class='comments'><p>reader</p></section><aside>side</aside></article><footer>&copy; x</footer></body></html>"
    )
    assert text(page) == "He&ad é\n\nOne two three\n\nFour <five>"


def test_pages_without_a_marked_article_and_odd_markup():
    assert text("<div id=menu>x</div><div><p>Hello <b>w</b>orld<p>Second<ul><li>a<li>b</ul></div>tail") == "Hello world\n\nSecond\n\na\n\nb\n\ntail"
    assert text("<article><header><h1>T</h1></header><p>x<span class='ad'>buy</span> y</p></article>") == "T\n\nx y"
    assert text("<header>site</header><main role=main><p>in</main><p>out") == "in"
    assert text("plain < text & more") == "plain < text & more"
    assert text('<p title="a > b">q</p><div style="display: none">no</div><div hidden>no</div>') == "q"
    assert text("<p>a<![CDATA[ b ]]>c<!-- never closed <p>d") == "a b c"
    assert text("<script>never closed <p>x") == ""
    assert text(None) == "" and text("") == "" and text("<article></article>") == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text(deep) == "deep"


def pages(spark):
    rows = []
    for k in range(40):
        html = f"<div class='x1'><p>Same words on every page</p></div><div class='x2'><p>Story number {k} of this host</p><p>More of {k}</p></div>"
        rows.append((k, f"https://User@Shop.example.com:80/p/{k}", html, k))
    rows += [(100, None, None, 0), (101, "::odd", "<p>odd url", 0), (102, "http://one.example.org/", "<div class=x1><p>Same words on every page</p></div>", 0), (0, rows[0][1], rows[0][2], 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")


def test_low_importance_branches_go(spark):
    got = {}
    for r in html_tree.extracted(pages(spark)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert got[0] == ["Story number 0 of this host\n\nMore of 0"] * 2
    assert got[7] == ["Story number 7 of this host\n\nMore of 7"]
    assert got[100] == [""] and got[101] == ["odd url"]
    assert got[102] == ["Same words on every page"]  # alone on its host


def test_empty_table(spark):
    assert html_tree.extracted(pages(spark).limit(0)).collect() == []


def test_identical_articles_of_a_host_stay(spark):
    rows = [(k, "http://h.example.com/", "<article><p>all the same</p></article><footer>f</footer>") for k in range(30)]
    found = html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in found.collect()} == {"all the same"}


def test_class_words_that_do_not_name_the_element():
    page = "<article><p>story</p></article>"
    for start in ("<html class='no-cookies js'><body>", "<body class='single-post has-sidebar'>", "<body class=sidebar>", "<div class='content-with-sidebar'>", "<div id='social-science'>", "<div class='widget'><div id=menu>"):
        assert text(start + page) == "story", start
    assert text("<div id='social-science'><p>about</p></div><div class='site-footer'>f</div><div class='comment-list'>c</div>") == "about"
    assert text("<p>in</p><div class='comments'><article class='comment'>c</article></div>") == "in"
    assert text("<article class='has-comments'><p>a</p><div class='ad-free'>b</div><div class='sidebar-left'>c</div></article>") == "a\n\nb"
    assert text("<div hidden><article>no</article></div><p>yes") == "yes"


def test_articles_that_are_comments_or_stand_for_other_pages():
    story = "<p>the long story of this page goes on and on</p>"
    assert text(f"<div class=content>{story}</div><article class=teaser>read this</article>") == "the long story of this page goes on and on"
    assert text(f"<div class=post>{story}</div><article class=comment>I say</article>") == "the long story of this page goes on and on"
    assert text(f"<div class=post>{story}</div><section class=comments><article><p>{'I say ' * 40}</p></article></section>") == "the long story of this page goes on and on"
    assert text(f"<article>{story}<div class=related-posts>more</div><article class='comment'>me too</article></article>") == "the long story of this page goes on and on"
    # the larger text of a page is its article, whatever its class says; comments only where there is nothing else
    assert text(f"<p>Home</p><article class='card'>{story}</article>") == "the long story of this page goes on and on"
    assert text("<section class=comments><article>c</article></section>") == "c"
    assert text("<article class=card><p>a</p></article><article class=card><p>b</p></article>") == "a\n\nb"


def test_important_branches_beside_an_article():
    long = "a text that is much longer than the article beside it"
    assert text(f"<article><h1>T</h1></article><div>{long}</div>") == f"T\n\n{long}"
    assert text(f"<article><h1>{long}</h1></article><div>short</div>") == long
    assert text(f"<article><h1>T</h1></article><div><a href=x>{long}</a></div>") == "T"  # links
    assert text(f"<main><h1>T</h1></main><div>{long}</div>") == "T"  # a page has one main


def test_low_importance_branches_inside_marked_articles_go(spark):
    rows = []
    for k in range(20):
        body = f"<h1>Always this title</h1><p>Paragraph {k} of the story</p><p>And {k} more</p><div class=hint>Like us everywhere</div>"
        rows.append((k, "http://h.example.com/", f"<body><article>{body}</article></body>"))
    rows += [rows[3]] * 50  # copies are no template
    copies = [(100 + k, "http://copies.example.com/", "<article><p>one text</p><div class=hint>h</div></article>") for k in range(30)]
    got = {r.page_id: r.text for r in html_tree.extracted(spark.createDataFrame(rows + copies, "page_id long, url string, html string")).collect()}
    for k in range(20):
        assert got[k] == f"Always this title\n\nParagraph {k} of the story\n\nAnd {k} more"
    assert {got[100 + k] for k in range(30)} == {"one text\n\nh"}


def plain_noisy(pages, threshold, gamma):
    """The noisy branches of every host by counting page by page."""
    hosts = defaultdict(set)
    for url, page in pages:
        hosts[url.split("/")[2]].add(page)
    noisy = {}
    for host, distinct in hosts.items():
        layouts, texts, above = defaultdict(Counter), defaultdict(Counter), {}
        for page in distinct:
            blocks, shapes = parsed(page)
            for path, shape in set(shapes):
                layouts[path][shape] += 1
            for path, words in {(b.path, b.text) for b in blocks}:
                texts[path][words] += 1
            above |= {b.path: b.branches for b in blocks}
        m, best = len(distinct), {}
        for path, counts in texts.items():
            shapes, presentation, content = layouts[path], 1.0, 1.0
            if m > 1:
                total = sum(shapes.values())
                presentation = -sum(n / total * math.log(n / total, m) for n in shapes.values()) if total else 0.0
                content = 1 - sum(math.log(n, m) for n in counts.values()) / len(counts)
            fade = gamma ** len(shapes)
            for branch in above[path]:
                best[branch] = max(best.get(branch, -1), (1 - fade) * presentation + fade * content)
        low = {stable(b) for b, score in best.items() if score < threshold}
        if low:
            noisy[host] = low
    return noisy


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_counting_page_by_page(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        parts = ["<div class=c0><p>w0</div>", f"<div class=c9><p>w{rng.randrange(2)}</div>"]
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(5)  # from the same words everywhere to words of one page
            inner = "".join(f"<{t}>w{rng.randrange((1, 2, 3, 30, 900)[kind])}" for t in rng.sample(["p", "h2", "h3"], rng.randint(1, 2)))
            parts.append(f"<div class=c{kind}>{inner}</div>")
        rows.append((k, f"http://h{rng.randrange(4)}.example.com/{k}", "".join(parts)))
    rows += rng.choices(rows, k=40)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = plain_noisy([r[1:] for r in rows], 0.3, 0.9)
    got = {r.host: set(r.noisy) for r in html_tree.noisy_branches(html_tree.page_nodes(df), 0.3, 0.9).collect()}
    assert got == want and want
    texts = sorted(main_text(parsed(r[2])[0], frozenset(want.get(r[1].split("/")[2], ()))) for r in rows)
    assert sorted(r.text for r in html_tree.extracted(df).collect()) == texts
