"""Text semantics on golden cases, and the alignment against a backtrace written out plainly."""

import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from plumbline.functions import canonical, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "wanted"),
    [(None, ""), ("", ""), ("<|bn|> a,b  [MUSIC] c", "a b c"), ("(a]b", "b"), ("a‍b", "ab"), ("১২", "12"), ("a\x1c b", "a b"), ("<unk>x<UNK>", "x"), ("é", "é")],
)
def test_normalize(spark, given, wanted):
    assert one(spark, given, text.normalize) == wanted


def test_tokens_of_nothing(spark):
    assert one(spark, "", text.tokens) == []
    assert one(spark, "a  b", text.tokens) == ["a", "b"]


def test_graphemes(spark):
    rng = random.Random(4)
    letters = "কখগনরলশহ়্ািীুেৈোৗাঁংঃ  ab"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", text.graphemes(F.col("x")).alias("g")).collect()
    for r in got:
        assert r.g == regex.findall(r"\X", rows[r.i].replace(" ", ""))


def backtrace(ref, hyp):
    n, m = len(ref), len(hyp)
    d = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    out, i, j = [0, 0, 0], n, m
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out[0], i, j = out[0] + 1, i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out[1], i = out[1] + 1, i - 1
        else:
            out[2], j = out[2] + 1, j - 1
    return tuple(out)


def test_edit_operations(spark):
    rng = random.Random(7)
    draw = lambda: [rng.choice("abc") for _ in range(rng.randrange(8))]
    rows = [([], []), (list("ab"), []), ([], ["a"]), (list("abc"), list("axc")), *((draw(), draw()) for _ in range(200))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    for r in df.select("i", text.edit_operations("a", "b").alias("e"), text.coded_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert tuple(r.e) == backtrace(*rows[r.i])
        assert r.d == sum(r.e)


@pytest.mark.parametrize(("words", "wanted"), [("a b a b a b", True), ("a a", False), ("a a a", True), ("", False), ("a b c a b c a b", False)])
def test_repetition_loop(spark, words, wanted):
    assert one(spark, words.split(), text.has_repetition_loop, "array<string>") is wanted


def test_compression_ratio(spark):
    assert one(spark, "", text.compression_ratio) == 0.0
    assert one(spark, "abab" * 50, text.compression_ratio) == 200 / len(zlib.compress(b"abab" * 50))


def test_signals(spark):
    df = spark.createDataFrame([(0, ["ক", "খ"], ["ক"]), (1, ["x", "y"], ["x"]), (2, ["ক"], ["খ"]), (3, ["না", "ক"], ["খ", "ক"]), (4, ["ক"], ["ক"]), (5, ["ক", "খ"], ["নেই", "না", "ক", "খ"])], "i int, a array<string>, b array<string>")
    got = {r.i: tuple(r.x) for r in df.select("i", text.described_edits("a", "b").alias("x")).collect()}
    assert got[0] == ("deleted: খ", "content_deleted")
    assert got[1][1] == "content_deleted, latin_script_leak"
    assert got[2] == ("ক -> খ", "substitution_only")
    assert got[3][1] == "negation_lost(না)"


    assert got[4] == ("(no token-level difference)", "substitution_only")
    assert got[5] == ("inserted: নেই না", "negation_added, content_inserted")


def test_distance_of_pairs_with_very_many_words(spark):
    a = [f"w{i}" for i in range(36_000)]
    df = spark.createDataFrame([(a[35_300:35_420], a[:35_420][-100:], a)], "x array<string>, y array<string>, all array<string>")
    # the words of all come first, so the pair's places reach over the surrogates
    row = df.select(text.coded_distance(F.col("x"), F.col("y")).alias("d"), text.coded_distance(F.slice("all", 35_000, 900), F.slice("all", 35_001, 900)).alias("e")).first()
    assert (row.d, row.e) == (20, 2)
    wide = spark.createDataFrame([(a, [*a[:-2], "x"])], "x array<string>, y array<string>").select(F.slice("x", 35_900, 101).alias("x"), F.slice("y", 35_900, 101).alias("y"))
    assert wide.select(text.coded_distance(F.col("x"), F.col("y"))).first()[0] == 2


MAP = {"é": "e", "ß": "ss", "qu": "k", "que": "ke", "quell": "", "a.b": "dot", "x": "y", "y": "x", "é!": "?"}


def replaced_plainly(text, mapping):
    out, i = [], 0
    while i < len(text):
        key = max((k for k in mapping if text.startswith(k, i)), key=len, default=None)
        out.append(text[i] if key is None else mapping[key])
        i += len(key or "x")
    return "".join(out)


def test_longest_key_first_in_one_pass(spark):
    rng = random.Random(5)
    parts = ["qu", "e", "ll", "é", "!", "a", ".", "b", "x", "y", "ß", " ", "\n", "🎉", "aXb"]
    texts = ["", "quell", "quelque", "a.b axb", *("".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mapping in (MAP, {"x": "y", "y": "x"}, {}, canonical.latin_map()):
        for r in df.select("t", canonical.replaced(F.col("t"), mapping).alias("r")).collect():
            assert r.r == replaced_plainly(r.t, mapping)


def test_canonical(spark):
    assert one(spark, "quéß ﬁ", lambda c: canonical.canonical(c, MAP)) == "kess fi"
    assert one(spark, None, lambda c: canonical.canonical(c, MAP)) == ""
    assert one(spark, "plain", lambda c: canonical.is_altered(c, {"a": "a", "z": "s"}), ) is False
    assert one(spark, "maze", lambda c: canonical.is_altered(c, {"a": "a", "z": "s"})) is True
    assert len(canonical.latin_map()) > 200 and canonical.latin_map()["ě"] == "e"


def test_map_from_a_file(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"char_replacements": {"U+00E9 é": "e", "U+200B z": null}, "unicode_replacements": {"qu": "k"}}')
    assert canonical.read_map(spark, str(tmp_path / "map.json")) == {"é": "e", "\u200b": "", "qu": "k"}
