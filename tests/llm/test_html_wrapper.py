"""Main texts of planted sites, the given pages against their articles, tree matching against brute force, awkward pages."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from reelframe.llm import html_wrapper, page_tree


def words(r, n):
    return " ".join("".join(r.choice("abcdeéß漢 lm") for _ in range(r.randrange(3, 9))).strip() or "x" for _ in range(n)).strip()


def sites(seed=1):
    """(url, html, main text) of pages of several hosts, each with a layout of its own."""
    r, out = random.Random(seed), []
    for k in range(12):
        title, paragraphs = words(r, 6), [" ".join(words(r, 30).split()) for _ in range(r.randrange(1, 5))]
        side, menu = words(r, 20), "".join(f'<li><a href="/{i}">{words(r, 2)}</a></li>' for i in range(r.randrange(3, 9)))
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        whole = " ".join([" ".join(title.split()), *paragraphs])
        comments = f'<section id="comments"><h3>Comments</h3><article class="comment"><p>{words(r, 25)}</p></article></section>'
        # an article with everything around it
        out.append(
            (
                f"http://a.example/{k}",
                f"<html><head><title>{title}</title><script>var x='<p>no</p>';</script></head><body><header><h1>The site</h1></header><nav><ul>{menu}</ul></nav><div class='cookie-notice'>We use {k} cookies {side}</div>"
                f"<main><article><header><h1>{title}</h1></header>{body}<div class=share>{k} shares</div><aside>{side}</aside></article>{comments}</main><form>Name {k} <input name=q></form><footer>{side}</footer></body></html>",
                whole,
            )
        )
        # no marks at all: the constant head and foot, a list of links, and the article's block
        out.append(
            (
                f"http://b.example/{k}",
                f"<title>{title}</title><div><div>Welcome to our site</div><ul>{menu}</ul></div><div><div><h1>{title}</h1>{body}<div>Read more of our site</div></div></div><div>All rights reserved</div>",
                whole,
            )
        )
        # elements that are never closed, old tables, hidden parts, comments and references
        out.append(
            (
                f"http://c.example/{k}",
                f"<TITLE>{title}</TITLE><table><tr><td class=menu>{menu}<td class=content><h1>{title}<!-- <p>no --></h1>{''.join('<p>' + html.escape(p) for p in paragraphs)}"
                f"<p style='display: none'>secret {k}</p><p>A&nbsp;B &amp; <b>c</b>d<br>e &lt;i&gt;<td>{side if k % 2 else ''}</table>",
                whole + " A B & cd e <i>",
            )
        )
    return out


def test_planted_sites(spark):
    rows = [(k, *x) for k, x in enumerate(sites())]
    pages = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(3)
    for limit in (1 << 20, 0):
        got = {x["page_id"]: x for x in html_wrapper.main_texts(pages, broadcast_bytes=limit).collect()}
        for i, url, _, text in rows:
            if not url.startswith("http://c"):
                assert got[i]["text"] == text, url
            else:
                assert got[i]["text"].startswith(text), url
            assert got[i]["n_chars"] == len(got[i]["text"])


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {x["page_id"]: x["text"] for x in html_wrapper.op12_wrapper_induction(spark, small).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for x in rows:
        article = re.search(r"<article>(.*)</article>", x["html"], re.S)[1]
        assert got[x["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())


def test_awkward(spark):
    same = "<title>t</title><article><p>one text</p></article>"
    rows = [(1, None, same), (2, None, None), (3, "http://x/", ""), (4, "http://x/1", "just text & no tag <"), (5, "http://y/1", same), (5, "http://y/1", same), (6, "http://y/2", same), (7, "http://y/3", same), (8, "http://y/4", "<article><p>one text</p></article" + "<p" * 3000)]
    rows += [(9, "http://z/", "<div>" * 3000 + "deep"), (10, "http://z/1", "<p>" + "long text " * 200_000), (11, "http://z/2", "<a '> <b \">" * 2000 + "end"), (12, "http://z/3", "<script>never closed <p>x"), (None, "http://w/", "<main>&#x41;&bogus;</main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit(1)).withColumn("host", F.lit("h")).withColumn("row", F.lit("r"))
    done = html_wrapper.main_texts(pages)
    assert done.columns == ["page_id", "url", "html", "host", "row", "text", "n_chars"]
    got = {}
    for x in done.collect():
        got.setdefault(x["page_id"], []).append(x["text"])
    assert got[1] == ["one text"] and got[2] == got[3] == [""] and got[4] == ["just text & no tag <"]
    assert got[5] == ["one text"] * 2 and got[6] == got[7] == got[8] == ["one text"]
    assert got[9] == ["deep"] and len(got[10][0]) == 1_999_999 and got[12] == [""] and got[None] == ["A&bogus;"]
    assert html_wrapper.main_texts(pages.where("false")).count() == 0


def nodes(r, depth):
    return page_tree.Shape(r.choice("abc"), kids=[nodes(r, depth - 1) for _ in range(r.randrange(4))] if depth else [])


def most(a, b):
    """Simple tree matching by trying every pairing of the siblings in order."""
    best = 0
    for n in range(1, min(len(a), len(b)) + 1):
        for x, y in itertools.product(itertools.combinations(a, n), itertools.combinations(b, n)):
            if all(p.label == q.label for p, q in zip(x, y)):
                best = max(best, sum(1 + most(p.kids, q.kids) for p, q in zip(x, y)))
    return best


def test_tree_matching():
    r = random.Random(4)
    for _ in range(60):
        a, b = nodes(r, 2).kids, nodes(r, 2).kids
        found, pairs = page_tree.matched(a, b, {})
        assert found == most(a, b) == sum(page_tree.weight(a[i], b[j], {}) for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_template_stays_small_with_random_names():
    r = random.Random(6)
    whole = None
    for k in range(400):
        name = "".join(r.choice("abcdefgh") for _ in range(8))
        shape = html_wrapper.without_nodes(html_wrapper.page_shape(f"<title>{k}</title><div class={name}><p>text {k}</p></div><div class={name}x>more {k}</div>"))
        whole = shape if whole is None else page_tree.merged(whole, shape)
    assert sum(1 for _ in page_tree.walk(whole)) < 3 * page_tree.WIDE
