"""Wrappers of web pages: alignment against brute force, marks taken out, odd markup."""

import itertools
import random
import time

from plumbline.llm import html_text

rng = random.Random(12)
word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
sentence = lambda n: " ".join(word() for _ in range(n)) + "."


def test_alignment_is_the_longest():
    for _ in range(200):
        x, y = ([{"s": rng.choice("abc"), "c": [], "t": rng.choice((0, 1))} for _ in range(rng.randrange(6))] for _ in range(2))
        got = html_text.align(x, y)
        assert all(html_text.alike(x[i], y[j]) for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(got))
        most = max(
            k for k in range(min(len(x), len(y)) + 1) for p in itertools.combinations(range(len(x)), k) for q in itertools.combinations(range(len(y)), k) if all(html_text.alike(x[i], y[j]) for i, j in zip(p, q, strict=True))
        )
        assert len(got) == most


def test_repeated_groups():
    tree = html_text.page_tree(html_text.blocks("<h1>t</h1><h2>a</h2><p>x</p><p>y</p><h2>b</h2><p>z</p><ul><li>q</ul>"))
    assert html_text.expression(tree) == "<h1>#</h1>(<h2>#</h2><p>#</p>)+<ul><li>#</li></ul>"


def pages(spark, mark):
    """Pages of two hosts, with or without words and tags that tell their parts; the texts of their articles."""
    ads, rows, want = [sentence(6) for _ in range(3)], [], {}
    for i in range(40):
        parts = [sentence(3), *(sentence(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6)))]
        want[i] = "\n".join(parts)
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("home", "news", rng.choice(("shop", "help"))))
        tag = (lambda name, words: (f"<{name} class='{words}'>", f"</{name}>")) if mark else (lambda name, words: ("<div>", "</div>"))
        around = [("nav", "menu", f"<ul>{menu}</ul>"), ("div", "ad", rng.choice(ads)), ("article", "post", body), ("div", "notice", "<p>We use cookies.</p>" if i % 2 else ""), ("footer", "foot", "All rights reserved")]
        html = "".join(a + x + b for name, words, x in around for a, b in [tag(name, words)])
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{html}</body></html>"))
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), want


def test_articles_without_any_mark(spark):
    """The wrapper finds the article where no class, id or telling tag is left, as it does with them."""
    for mark in (True, False):
        df, want = pages(spark, mark)
        assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want


def test_odd_markup_is_read_in_linear_time():
    began = time.process_time()
    for page in ("<a '" * 250_000, "<a \"'" * 200_000 + ">", '<b "x>' * 150_001, "<p>" * 200_000, "<x-a>" * 100_000 + "</y>" * 100_000, "<div>" * 100_000 + "text" + "</div>" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<" * 500_000):
        found = html_text.blocks(page)
        html_text.main_text(found, html_text.roles(html_text.page_tree(found)))
    assert time.process_time() - began < 20


def test_self_closed_and_embedded_elements():
    text = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert text("<p>a<svg/>b</p><p>c <math><mi>x</mi></math></p><object>d</object><p>5 < 6 &lt; 7</p>") == ["a", "b", "c", "x", "d", "5 < 6 < 7"]
    assert text("<p title='a > b'>x</p><iframe src=x>no</iframe><SCRIPT>var p='<p>';</script ><p>y") == ["x", "y"]
