"""Secrets, pages, media and classifiers on small fixtures."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_text, media, quality, secrets, toxicity

KEY = "AKIA" + "ABCDEFGH12345678"


def secret_texts():
    rng = random.Random(8)
    parts = ["password", "PassWord", "token", "api_key", "apikey", "secret", "=", ": ", "'", '"', "AKIA", "abcdef0123456789", "ABCDEFGH1234", "é🎉", " ", "\n", "x" * 9, ".", "=="]
    yield from [None, "", "password=hunter22", "password: token:abcdefgh", KEY + KEY, "f" * 31, "f" * 32 + "g" + "0" * 40, "🎉é token = 'abcdefgh'", "secret=" + "ab" * 40_000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "ſecret=abcdefgh1", "TOKEN=short"]
    yield from ("".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300))


def matches(text):
    out = []
    for i, r in enumerate(secrets.BASE + secrets.ADDED):
        out += [(m.start(), i, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return sorted(out)


@pytest.mark.parametrize("rows", [1_000, 0])
def test_secrets_against_scanning_everything(spark, rows):
    given = [(i, t, "x") for i, t in enumerate(secret_texts())]
    given += [(5, given[5][1], "again"), (5, "password=another1", "same key"), (None, "token=withoutkey", "x")]
    df = spark.createDataFrame(given, "doc_id bigint, text string, found_ string")
    got = secrets.scan(df, broadcast_rows=rows).collect()
    assert len(got) == len(given)
    for r in got:
        assert [tuple(x) for x in r.found] == matches(r.text), r.text


def test_secrets_where_names_clash(spark):
    names = ["candidate_key", "candidate_rules", "candidate_rules_", "spans", "_spans_", "found", "whole", "low"]
    df = spark.createDataFrame([(1, "token=abcdefgh x", *names), (2, None, *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = sorted(tuple(r) for r in secrets.redact(df).collect())
    assert got == [(1, "[SECRET] x", *names), (2, None, *names)]
    assert [c for c in secrets.scan(df).columns if c != "found"] == [c for c in df.columns if c != "found"]


def test_queries_hold_for_every_match():
    for rule in secrets.BASE + secrets.ADDED:
        query = secrets.trigram_query(rule.pattern)
        for t in secret_texts():
            if t and re.search(rule.pattern, t, re.ASCII) and query is not None:
                low = t.lower()
                assert any(all(g in low for g in clause) for clause in query)
    assert secrets.trigram_query("[0-9a-f]{32,}") is None
    assert secrets.trigram_query("abc|abd") == [["abc"], ["abd"]]


def test_secret_digest_and_plan(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh " + "0" * 32), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].spans) == (1, 0, 1, "assign:0:14,hex:15:47")
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert not re.search("Python|Arrow|Pandas", secrets.digest(df)._jdf.queryExecution().toString())
    assert secrets.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(secret_texts())], "doc_id bigint, text string")
    for r in secrets.redact(df).collect():
        text = list(secret_texts())[r.doc_id]
        merged = []
        for s, _, e in matches(text):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            text = text[:s] + "[SECRET]" + text[e:]
        assert r.text == text


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=1>menu</a></li><li>two</li></ul></nav>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>{main}<aside class=sidebar>side<p>more</aside><div id="comments"><p>first!</p></div><form><p>q</p></form><footer>foot</footer></body></html>"""
MAIN = "<article class='post'><header><h1>A &amp; B</h1><span>by me</span></header><p>One <b>bold</b><br>two.<p>Caf&eacute; &#x1F389;<!-- no --><div class=\"ad-box\">buy</div><ul><li>x<li>y</ul><section class=comments><p>nice</p></section></article>"


def test_pages(spark):
    plain = PAGE.format(main="<div class=content><p>First paragraph here.</p><p>Second one.</p></div><div class=small>tiny</div>")
    rows = [(1, "http://A.example/x", PAGE.format(main=MAIN)), (2, "http://a.example:80/y", PAGE.format(main="<article><p>only</p></article>")), (3, "http://b.example", plain), (4, None, None), (5, "x", ""), (6, "http://a.example", "<p>no article"), (6, "http://a.example", "<p>no article"), (7, "http://c.example", "<article><p>" + "long text " * 200_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {}
    for r in html_text.extract(df).collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert got[1] == "A & B\nOne bold two.\nCafé 🎉\nx\ny"
    assert got[2] == "only"
    assert got[3] == "First paragraph here.\nSecond one."
    assert got[4] == got[5] == got[6] == ""
    assert got[7] == ("long text " * 200_000).strip()
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_wrappers_align():
    a, b = (html_text.page_tree(html_text.blocks(p)) for p in ("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><div>n</div><p>x</p>"))
    assert html_text.expression(html_text.merge(a, b)) == "<ul>(<li>#</li>)+</ul>(<div>#</div>)?<p>#</p>"


def test_image_formats():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (7, 64), (4, 6, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.read_image(media.write_netpbm(x)) == x).all()
        assert (media.read_image(media.write_bmp(x)) == x).all()
    assert (media.read_netpbm(b"P5 # c\n2 1\n255\n\x01\x02") == [[1, 2]]).all()


def test_area_resize_equals_exact_means(monkeypatch):
    monkeypatch.setattr(media, "BAND", 5)
    x = np.random.default_rng(2).integers(0, 256, (17, 13)).astype(np.uint8)
    big = np.repeat(np.repeat(x, 8, 0), 9, 1).astype(float)  # 17 * 8 and 13 * 9 divide by the target
    want = big.reshape(8, 17, 9, 13).mean((1, 3))
    assert np.abs(media.area_resize(x, 8, 9) - want).max() < 1e-9


@pytest.mark.parametrize("form", ["pgm", "bmp", "both"])
def test_media_round_trip(spark, form):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 33), (4, "é" * 33), (None, "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("feature", F.lit(1))
    for r in media.text_media(df, form=form, with_media=True).collect():
        raw = (dict(rows).get(r.doc_id) or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert media.read_image(bytes(r.media)).tobytes() == payload
        assert (bytes(r.media)[:2] == b"BM") == (r.form == "bmp") and r.form == (media.form_of(payload) if form == "both" else form)
        tile = np.load(io.BytesIO(bytes(r.tile)))
        assert tile.shape == media.TILE and r.feature == f"{media.difference_hash(tile)}:{hashlib.sha256(r.tile).hexdigest()[:16]}"
    assert {media.form_of(str(i).encode()) for i in range(9)} == {"pgm", "bmp"}


def labelled(spark, n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    docs, labels = [(-1, None), (-2, "")], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 60))]
        bad, toxic = i % 7 == 0, i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scummy"])
        if i % 3 == 0:
            w[0] = rng.choice(["muslims", "jews", "christians"]) if not toxic else "jews"
        docs.append((i, " ".join(x + "!!" if bad else x for x in w)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out(spark):
    docs, labels = labelled(spark)
    got = quality.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert quality.classify(docs, labels.where("false")).count() == 402
    assert quality.filter_documents(docs, labels).columns == docs.columns


def test_toxicity_on_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.classify(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert len(got) == 402 and sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert toxicity.classify(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_counterfactuals_take_weight_off_groups():
    assert toxicity.swaps(["the", "jews"])[0] == ["the", "christians"] and toxicity.swaps(["the"]) == []
    held = [{0: 1, 1: 1}] * 20 + [{2: 1}] * 20  # feature 0 is a group that stands in toxic texts only, 1 an insult
    label, pairs = np.array([1] * 20 + [0] * 20), [({0: 1}, {2: 1})]
    with_pairs, _ = toxicity.train_rows(held, label, 3, pairs, 0.5, penalty=5.0)
    without, _ = toxicity.train_rows(held, label, 3, [], 0.5)
    assert abs(with_pairs[0] - with_pairs[2]) < 0.3 * abs(without[0] - without[2])
    assert with_pairs[1] > without[1]


def test_counterfactuals_of_a_text():
    assert toxicity.counterfactuals("") == [] and toxicity.counterfactuals("!?") == []
    named = toxicity.counterfactuals("No group. The Jews sing. A gay man reads. " * 50)
    assert len(named) == toxicity.PAIRS and all(len(a) == len(b) and a != b for a, b in named)
    (s, one), (again, other) = toxicity.counterfactuals("Plain words here. More of them there.")
    assert one == again and len(one) == len(s) + 1 and sum(x != y for x, y in zip(one, other, strict=True)) == 1


def test_the_penalty_lessens_score_changes(spark):
    """Group terms share beginnings with words that tell; held-out sentences change less with the penalty than without."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(12)] + (["blackish", "muslin"] if i % 2 else ["bread", "muffin"])) + ".", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    change = []
    for penalty in (0.0, 1.0):
        model = toxicity.train(docs, docs, lambda k: k < 150, penalty=penalty)
        change.append(sum(abs(model.logit(a) - model.logit(b)) for i, t, _ in rows if i >= 150 for a, b in toxicity.counterfactuals(t)))
        assert sum((model.score([t])[0] >= 0.3) == y for i, t, y in rows if i >= 150) >= 48
    assert change[1] < 0.2 * change[0]


def test_conflicting_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"same words {i % 3}") for i in range(60)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 = 0) as toxic", "int(doc_id % 2) as quality")
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.classify(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 4))
    assert one == two
    none = docs.where("false")
    for f in (toxicity.classify, quality.classify):
        assert f(none, labels).count() == f(none, labels.where("false")).count() == 0
    assert toxicity.filter_documents(none, labels).count() == quality.filter_documents(none, labels).count() == 0


def test_templates_of_one_host(spark):
    """A host's pages without an article, and blocks beside the one with most text, keep their text."""
    old = "<html><body><div class=menu>m</div><div class=content><h1>{0}</h1><div class=body><p>{0} one.</p><p>{0} two.</p></div><section class=more><p>{0} three.</p></section></div><div class=small>tiny</div></body></html>"
    rows = [(1, "http://a.example/1", "<html><body><article><p>new</p></article></body></html>"), (2, "http://a.example/2", old.format("A")), (3, "http://b.example/3", old.format("B" * 50)), (4, "http://b.example/4", "<html><body><div class=post><p>other template</p></div></body></html>"), (5, None, old.format("C")), (6, None, "<html><body><main><p>m</p></main></body></html>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    whole = lambda x: f"{x}\n{x} one.\n{x} two.\n{x} three."
    assert got == {1: "new", 2: whole("A"), 3: whole("B" * 50), 4: "other template", 5: whole("C"), 6: "m"}
    assert html_text.main_block([("html/body/div.text", "long " * 20), ("html/body/div.text/ul/li", "x")]) == "html/body/div.text"


def test_constant_text_is_template(spark):
    """What stands the same in each of a host's pages is its template, but not what copies of a page share."""
    page = "<html><body><article><h1>{0}</h1><p>{0} is a long enough text.</p>{1}<p>Subscribe now!</p><div>Ad</div></article></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(f"Page {i}", "<ul><li>x</ul>" if i % 2 else "")) for i in range(5)]
    rows += [(10 + i, f"http://b.example/{i}", page.format(f"Page {i % 2}", "")) for i in range(6)]
    rows += [(20 + i, f"http://c.example/{i}", "<article><p>" + "the same long text " * 5 + f"</p><p>edit {i}</p></article>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(5):
        assert got[i] == f"Page {i}\nPage {i} is a long enough text." + "\nx" * (i % 2)
    for i in range(6):
        assert got[10 + i] == f"Page {i % 2}\nPage {i % 2} is a long enough text.\nSubscribe now!\nAd"
    for i in range(4):
        assert got[20 + i] == ("the same long text " * 5).strip() + f"\nedit {i}"
