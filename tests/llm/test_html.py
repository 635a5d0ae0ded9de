import html
import math
import random
import re
import time
from xml.etree import ElementTree

import pytest

from sparkrank.llm.html_extract import Tree, main_text, measures
from sparkrank.llm.queries import op1_html_extraction

P = "A paragraph with enough words to look like the text of an article, and then some more."


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>{P}</p></article><footer>foot</footer>", f"Head {P}"),
        (f"<article><h1>Head</h1><p><b>{P}<br><p>x&amp;y&nbsp;&eacute;</article>", f"Head {P} x&y é"),
        (f"<main><h2>Head</h2><section><p>{P}</p></section><section><p>short</p><ul><li>one<li>two</ul></section></main>", f"Head {P} short one two"),
        (f"<div id=content><h2>H</h2><p>{P}</p><div class='related-posts'><a href=x>{P}</a></div><p>{P}</p></div>", f"H {P} {P}"),
        (f"<header><p>{P}</p></header><aside>{P}</aside><div class=cookie-notice>{P}</div><form><p>{P}</p></form><div class='post-body'><p>only this</p></div><section id=comments><p>{P}{P}</p></section>", "only this"),
        (f"<div class='sidebar'><p>{P}</p></div><article>in<i>li</i>ne <a href='a>b'>link</a></article><div class=ad>{P}</div>", "inline link"),
        (f"<article><header><h1>Title</h1></header><p>{P}</p><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>", f"Title {P}"),
        (f"<div><a href=x>One</a> <a href=y>Two</a></div><div>We use small files to remember you. That is fine.</div><div><h1>Head</h1>{f'<p>{P}</p>' * 4}</div><div><p>Buy one, get one.</p></div>", f"Head {P} {P} {P} {P}"),
        (f"<div><h1>Head</h1><div>{f'<p>{P}</p>' * 4}</div><p>{P}</p><div>{f'<p>{P}</p>' * 3}</div></div>", " ".join(["Head"] + [P] * 8)),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("a < b &lt;p&gt;", "a < b <p>"),
    ],
)
def test_main_text(body, expected):
    assert main_text(page(body)) == expected


def test_class_names_on_containers_do_no_harm():
    assert main_text(f'<html><body class="with-sidebar has-comments"><main class="no-header"><p>{P}</p></main>') == P


SHORT = "The end is short."


@pytest.mark.parametrize("n", [3, 8, 60])
@pytest.mark.parametrize(
    "before,after,expected",
    [
        ("", f"<div><h2>Conclusion</h2><p>{SHORT}</p></div>", f"{{}} Conclusion {SHORT}"),
        ("", f"<div><p>{SHORT}</p></div><section>{SHORT}</section>", f"{{}} {SHORT} {SHORT}"),
        (f"<p>{SHORT}</p>", "", f"{SHORT} {{}}"),
        ("See <a href=x>this</a> or <i>that</i> first. ", "<div><a href=x>One of the links</a> <a href=y>Two</a></div>", "See this or that first. {}"),
    ],
)
def test_short_parts_beside_a_long_one_stay(n, before, after, expected):
    long = f"<div>{f'<p>{P}</p>' * n}</div>"
    assert main_text(page(f"<div id=content>{before}{long}{after}</div>")) == expected.format(" ".join([P] * n))


def test_short_parts_beside_a_long_one_stay_without_a_container():
    assert main_text(page(f"<p>{SHORT}</p><div>{f'<p>{P}</p>' * 8}</div><div><h2>Conclusion</h2><p>{SHORT}</p></div>")) == " ".join([SHORT, *[P] * 8, "Conclusion", SHORT])


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<div id=content class='sidebar-right'><p>{P}</p><p>{P}</p></div>", f"{P} {P}"),
        (f"<article class='post comments-open'><p>{P}</p></article>", P),
        (f"<article class='related'><p>{P}</p></article>", P),
        (f"<article><section id=discussion><h2 id=related-work>Work</h2><p>{P}</p></section><h2 id=cookies>Sweet</h2><p>{P}</p><h2 id=search class=search>Find</h2></article>", f"Work {P} Sweet {P} Find"),
        (f"<div class='search'><main><p>{P}</p></main></div>", P),
        (f"<div class='elementor-widget'><h1>Head</h1><p>{P}</p><p>{P}</p></div><div>{P}</div>", f"Head {P} {P} {P}"),
    ],
)
def test_names_do_not_drop_the_text_of_a_page(body, expected):
    assert main_text(page(body)) == expected


@pytest.mark.parametrize(
    "other",
    [
        f"<div class=sidebar-right><p>{P}</p></div>",
        f"<div class=comments-area><ol class=comment-list><li class=comment><article class=comment-body><p>{P}</p><p>{P}</p></article></li></ol></div>",
        f"<div id=comments><article><p>{P}</p></article></div>",
        f"<div class=cookie-notice><p>{P}</p><p>{P}</p></div>",
    ],
)
def test_names_still_drop_other_parts(other):
    for kind in ("article", "main"):
        assert main_text(page(f"<{kind}><p>{P}</p></{kind}>{other}")) == P
    assert main_text(page(f"<div class=post><p>{P}</p><p>{P}</p></div>{other}")) == f"{P} {P}"


@pytest.mark.parametrize(
    "text,expected",
    [
        (f"<html><head><title>T</title><p>{P}", P),
        (f"<html><head><title>T</title><style>p{{}}</style><noscript><img src=x></noscript><main><p>{P}</p></main>", P),
        (f"<html><head><meta charset=utf-8><div><p>{P}</p></div><body><p>more</p></body></html>", f"{P} more"),
        (f"<head><title>T</title>bare text<p>{P}", f"bare text {P}"),
        (f"<title>T</title><p>{P}<body><p>more", f"{P} more"),
        (f"<html><head></head><body><div><p>{P}</p></body><p>late</p></html><p>later</p>", f"{P} late later"),
        (f"<html><body><p>{P}<nav>menu</body>late", f"{P} late"),
        (f"<html><head><title>T</title></head> <p>{P}</p></html>", P),
    ],
)
def test_head_and_body_may_be_left_out_or_end_early(text, expected):
    assert main_text(text) == expected


@pytest.mark.parametrize("text", ["<div>" * 20000 + "x", "<p><b>x" * 20000, '<a "' * 20000, "<" * 100000, "<!--" * 20000, "</div>" * 20000, "<li>" * 20000, "<p><button>" + "<div>" * 200_000, "<div>" * 200_000, "<table><tr><td>" + "<div><tr>" * 60_000, "<p class=sidebar>" * 60_000, "<div class=sidebar>" * 60_000 + "x", "<form>" * 60_000 + "x", "<li class=author><time>" * 60_000, "<article>" + "<h2>replies</h2><ol><li class=author><time>x<li class=author><time>x</ol>" * 20_000, "<blockquote><footer>" * 60_000])
def test_hostile_pages_end(text):
    began = time.perf_counter()
    main_text(text)
    assert time.perf_counter() - began < 10


LONG = "".join(f"<p>{P}</p>" for _ in range(4))
LONG_TEXT = " ".join([P] * 4)
SAID = "".join(f"<li><span class=author>Reader {i}</span> <time>May {i}</time><p>{P}</p></li>" for i in range(1, 9))


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<form action=/page><input type=hidden name=state><nav>menu</nav><article><h1>Head</h1>{LONG}</article><footer>foot</footer></form>", f"Head {LONG_TEXT}"),
        (f"<form id=aspnetForm><main><h1>Head</h1>{LONG}</main></form>", f"Head {LONG_TEXT}"),
        (f"<form><div class=content><h1>Head</h1>{LONG}</div></form>", f"Head {LONG_TEXT}"),
        (f"<article>{LONG}<form><p>Write to us</p><input name=x></form></article>", LONG_TEXT),
        (f"<article><div class='article-header'><h1>Head</h1><p>lead</p></div>{LONG}<div class='section-header'><h2>Part</h2></div><p>x</p></article>", f"Head lead {LONG_TEXT} Part x"),
        (f"<div class=page><div class='post-header'><h1>Head</h1></div>{LONG}</div>", f"Head {LONG_TEXT}"),
        (f"<div class=site-header><h2>Site</h2></div><div class=page><h1>Head</h1>{LONG}</div>", f"Head {LONG_TEXT}"),
        (f"<article><div class=hero-banner><h1>Head</h1></div>{LONG}<div class=ad-banner><h3>Buy</h3></div></article>", f"Head {LONG_TEXT}"),
        (f"<article>{LONG}<section class=discussion><h2>Discussion</h2><p>{P}</p></section></article>", f"{LONG_TEXT} Discussion {P}"),
        (f"<article>{LONG}<section class=discussion><h2>3 comments</h2><p>{P}</p></section></article>", LONG_TEXT),
        (f"<article>{LONG}<section class=discussion><h2>Discussion</h2><div class=comment><p>{P}</p></div></section></article>", LONG_TEXT),
        (f"<article>{LONG}<p>Press <label>Start</label> now.</p></article>", f"{LONG_TEXT} Press Start now."),
        (f"<article>{LONG}<p><label>Name <input></label></p><div><label for=q>Find</label></div></article>", LONG_TEXT),
        (f"<article>{LONG}<blockquote><p>Words.</p><footer>Someone</footer></blockquote><footer>foot</footer></article>", f"{LONG_TEXT} Words. Someone"),
        (f"<div class=post><div class=a><div>{LONG}</div></div><div>closing words</div></div><div class=x>else</div>", f"{LONG_TEXT} closing words"),
        (f"<div class=wrap><nav>menu</nav><div class=a><div>{LONG}</div></div><div>We use small files.</div></div>", LONG_TEXT),
        (f"<article>{LONG}<ol class=thread><li><p>{P}</p></li></ol></article>", LONG_TEXT),
        (f"<article>{LONG}<h3>8 replies</h3><ol class=x>{SAID}</ol></article>", LONG_TEXT),
        (f"<div class=post>{LONG}<ul>{SAID}</ul></div>", LONG_TEXT),
        (f"<article>{LONG}<ol class=references><li><span class=author>A</span> 1999</li><li><span class=author>B</span> 2001</li></ol></article>", f"{LONG_TEXT} A 1999 B 2001"),
    ],
)
def test_wrapped_articles_stay_whole(body, expected):
    assert main_text(page(body)) == expected


def test_lists_of_signed_articles_are_no_thread():
    posts = "".join(f"<article><h2>Post {i}</h2><span class=author>A</span> <time>May</time><p>{P}</p></article>" for i in range(3))
    assert main_text(page(f"<main><h1>All</h1><div>{posts}</div></main>")) == " ".join(["All"] + [f"Post {i} A May {P}" for i in range(3)])


def well_formed(seed):
    """A random page without anything that is dropped."""
    r = random.Random(seed)

    def node(depth):
        inner = "".join(r.choice(["", "some words ", "x", node(depth + 1) if depth < 5 else ""]) for _ in range(r.randrange(1, 6)))
        name = r.choice(["div", "section", "a", "b", "blockquote", "span"]) if depth else "body"
        return f"<{name}>{inner}</{name}>"

    return f"<html>{node(0)}</html>"


@pytest.mark.parametrize("seed", range(40))
def test_densities_and_sums_by_definition(seed):
    page_ = well_formed(seed)
    root = ElementTree.fromstring(page_)
    size = lambda text: len("".join((text or "").split()))

    def count(e, linked=False):
        """Characters, link characters, tags and link tags of an element, itself included."""
        linked = linked or e.tag == "a"
        own = size(e.text) + sum(size(x.tail) for x in e)
        below = [count(x, linked) for x in e]
        return [sum(v) for v in zip([own, own * linked, 1, int(linked)], *below, strict=True)]

    def densities(e, body, linked=False):
        c, lc, t, lt = count(e, linked)
        share = body[1] / max(body[0], 1)
        own = 0.0 if not c else c / t * math.log(max(c * t / max(lc, 1) / max(lt, 1), 1)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        below = [densities(x, body, linked or e.tag == "a") for x in e]
        return [(e.tag, own, sum(b[0][1] for b in below)), *[d for b in below for d in b]]

    expected = densities(root, count(root[0]))
    tree = Tree(page_)
    found = measures(tree)
    assert tree.name[1:] == [x[0] for x in expected]
    assert found.density[1:] == pytest.approx([x[1] for x in expected])
    assert found.sums[1:] == pytest.approx([x[2] for x in expected])


def test_the_core_is_the_node_of_the_largest_sum():
    page_ = page(f"<div><p>One line.</p></div><div id=core><p>{P}</p><p>{P}</p><p>{P}</p></div><div><a href=x>{P}</a><a href=y>{P}</a></div>")
    found, tree = measures(Tree(page_)), Tree(page_)
    core = int(found.sums[1:].argmax()) + 1
    assert [tree.name[i] for i in range(len(tree.name)) if tree.parent[i] == core] == ["p", "p", "p"]


@pytest.mark.parametrize("landmark", ["div", "section"])
def test_tables_pages_need_no_landmark(spark, sf_dir, landmark):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = r["html"]
        for name in ("article", "main"):
            plain = plain.replace(f"<{name}>", f"<{landmark}>").replace(f"</{name}>", f"</{landmark}>")
        assert main_text(plain) == main_text(r["html"])


def test_whole_table_equals_article(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op1_html_extraction(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert r["text"] == expected and r["n_chars"] == len(expected)
