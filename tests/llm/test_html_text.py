import math
import random
import re
import time
from html import unescape

import pyarrow.parquet as pq
import pytest

from matterloom.llm import html_text as h

HEAD = "<!DOCTYPE html><html><head><title>T t</title><style>p{margin:0}</style><script>var t='</p>';</script></head>"


def test_parts_that_are_not_content_go():
    page = f"""{HEAD}<body><header><h1>Site name</h1></header><nav><ul><li><a href=/x>Menu</a><li>More</ul></nav>
    <div class="cookie-notice">We use cookies</div><div class=ad>Buy now</div>
    <div id="wrap1"><article><header><h1>Real title</h1></header><p>First &amp; <b>bold</b>er words&nbsp;here,<p>second  one<br>broken
    <form><input value=a>Subscribe</form><aside>side</aside><!-- hidden <p>no</p> --><ul><li>point a<li>point b</ul>
    <div class="commentList">reader says</div><table><tr><td>x<td>y</table><p style="display: none">ghost</p></article></div>
    <section id="comments"><p>lots of comment words that go on and on and on and on and on</p></section>
    <footer>&copy; site</footer></body></html>"""
    assert h.extract(page, []) == "Real title First & bolder words here, second one broken point a point b x y"


@pytest.mark.parametrize("page", ["", "<", "<p", "<article><p>a</p", "&am", "plain < text & more", "<b><i>x</b></i>y", "<p>" * 3000, "<div><![CDATA[a & b]]></div>", "</p></div>x<script>never"])
def test_odd_pages(page):
    assert isinstance(h.extract(page, ["/nowhere"]), str)
    if page.endswith(("y", "never")):
        assert h.extract(page, []).startswith("x")


def test_host_paths_decide(spark):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice("one two three four five".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        body = words(40 if i % 10 else 5)
        extra = words(12) if i % 10 == 0 else f"<a href=x>{words(12)}</a>"
        rows.append((i, f"http://Host.example:80/{i}", f'<body><div class="post p{i}"><p>{body}</p></div><div class="extra"><p>{extra}</p></div></body>', "clash"))
        want[i] = body
    rows += [(100, None, None, "x"), (101, "not a url", "", "x"), (None, "http://b.example", "<p>just text", "x"), (None, "http://b.example", "<p>just text", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for broadcast in (0, h.BROADCAST):
        got = h.extract_text(pages, broadcast=broadcast).collect()
        assert len(got) == len(rows)
        by = {x.page_id: x for x in got}
        # Short posts are read from the host's path, though the body of their page would score higher.
        assert {i: by[i].text for i in want} == want
        assert by[100].text == by[101].text == "" and by[None].text == "just text" and all(x.n_chars == len(x.text) for x in got)
    assert h.extract_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep words",
        "<p>some <a b'c ' " * 60_000,
        "<p title=\"abc>four " * 1 + "<b x='1" * 140_000,
        "<i>" * 50_000 + "<div>" + "</b>" * 100_000 + "x",
        "<ul><li>" + "<div>" * 20_000 + "<li>a</li></section>" * 20_000,
        "<header><h1>" * 30_000 + "x",
        "<b>" + "<div><i>" * 20_000 + "</b>" * 20_000 + "x",
    ],
)
def test_time_is_in_proportion_to_length(page):
    began = time.perf_counter()
    h.extract(page, ["/nowhere"])
    assert time.perf_counter() - began < 4


def test_nothing_but_marked_parts_go():
    page = """<body><article><section id="related-work"><p>what others did</p></section><div class="share-price">42 euros</div>
    <div class="share-buttons">Tweet</div><div id=commentList><p>reader</p></div><p title="abc>four <i>five</i></p><p class=x>six</article>"""
    assert h.extract(page, []) == "what others did 42 euros four five six"
    assert h.extract('<article><p title="abc>four', []) == "four"
    assert h.extract("<p a=\"x>y\" b='>' c=d>words", []) == "words"


def test_votes_against_a_plain_count(spark):
    """Winning paths of hosts with several templates, counted page by page with paths written out."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choice("one two three four five".split()) for _ in range(n))
    rows, votes = [], {}
    for i in range(400):
        host = r.choice(["a.example", "b.example"])
        k = r.randrange(12) if host == "a.example" else i + 100
        name = "".join(chr(97 + int(c)) for c in str(k))
        rows.append((i, f"https://{host}/{i}", f'<html><body><div class="{name} n{i}"><p>{words(30)}</p></div><div class=tail><a href=x>{words(20)}</a></div></body></html>'))
        nodes, _ = h.read_page(rows[-1][2])
        won = max((n for n in nodes if n.tag in h.CONTAINERS and n.content), key=lambda n: (h.score(n), n.level))
        path, at = [], won
        while at.parent is not None:
            path, at = [at.tag] + path, at.parent
        if won.tag == "div":
            path[-1] = f"div.{'.'.join(sorted([name, 'n']))}"
        votes.setdefault(host, {}).setdefault("".join(f">{x}" for x in path), []).append(round(1000 * math.log1p(h.score(won))))
    want = {}
    for host, by in votes.items():
        whole = sum(map(sum, by.values()))
        won = sorted((-sum(v), h.signed(h.path_key(p))) for p, v in by.items() if len(v) > 1 and sum(v) >= h.SHARE * whole)
        if won:
            want[host] = [k for _, k in won]
    pages = spark.createDataFrame([*rows, (900, None, rows[0][2]), (901, "odd", rows[0][2])], "page_id int, url string, html string")
    got = {x._host: x._paths for x in h.host_paths(pages).collect() if x._paths}
    assert got == want and any(len(p) > 8 for p in got.values()) and "" not in got


def test_what_other_pages_do_not_leave_out_stays(spark):
    """Pages with a lead beside the container of most pages keep it; text that most pages leave out goes with the path."""
    r = random.Random(4)
    words = lambda n: " ".join(r.choice("one two three four five".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(10):
        lead, text, more = words(60), words(100), words(14)
        # On most pages the last part holds links, and is no part of the page's own best container.
        tail = f"<div class=more><p>{more if i < 2 else f'<a href=x>{more}</a>'}</p></div>"
        rows.append((i, "http://d.example/x", f"<body><div class=page>{f'<div class=lead><p>{lead}</p></div>' if i < 2 else ''}<div class=text><p>{text}</p></div>{tail}</div></body>"))
        want[i] = f"{lead} {text}" if i < 2 else text
    got = {x.page_id: x.text for x in h.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == want
    assert h.extract(rows[0][2], [">body>div.page>div.text"]) == f"{want[0]} {h.extract(rows[0][2], []).split(want[0])[1].strip()}"


def test_two_templates_of_a_host(spark):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice("one two three four five".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body = words(50)
        few = f"<body><div><p>see also</p></div><section class=story><p>{body}</p></section></body>"
        rows.append((i, "http://c.example/x", few if i % 4 == 0 else f"<body><div><p>{body}</p></div></body>"))
        want[i] = body
    rows += [(50 + i, None, f'<body><div class="c{chr(97 + i)}"><p>{words(30)}</p></div></body>') for i in range(5)]
    got = {x.page_id: x.text for x in h.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    # A few words on the path of most pages do not hide the article.
    assert all(got[i].removeprefix("see also ") == want[i] for i in want) and all(len(got[50 + i].split()) == 30 for i in range(5))


def test_given_pages_against_a_plain_rule():
    """These pages have one article and close what they open around it, so its text can be cut out by patterns."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.S)[1]
        inner = re.sub(r"<[^>]*$", "", inner)
        blocks = re.sub(r"</?(?:p|h1|br|article)\b[^>]*>", "\n", inner)
        plain = " ".join(unescape(re.sub(r"<[^>]+>", "", blocks)).split())
        assert h.extract(p["html"], []) == plain, p["html"]
