"""Spelling variants of words by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so one letter more, less or
exchanged changes it by a value of one or two letters. Every word is listed under its key less each of its letters, and under
its whole key: words that differ by an exchanged letter share a key of the first kind, a longer and a shorter word
the longer one's lessened key and the shorter one's whole key. The half of the word that the letter isn't in must be the
same in both, so it is part of what is joined on; that splits large classes of anagrams. What meets is verified for letter order by its edit distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .line_dedup import ascii_lower

#: Runs of letters; least code points and occurrences of a word; how many times as frequent its form is; every so manieth (document, run) loses a letter (fixed values of the contract).
LETTERS, LEAST_CHARS, LEAST_COUNT, TIMES, EVERY = "A-Za-zÀ-ÿ", 7, 2, 10, 31
#: Keys are sums modulo this prime, so the longest run can't overflow one.
MODULUS = (1 << 61) - 1


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): lower-cased (A-Z only) runs of letters of whole texts. Where every divides the crc32 of '<key>:<run>', the run loses its letter at crc32 % length.

    Shorter runs can't give a word of least_chars, so they are never taken out of the text. Null texts have none; a null key counts as an empty one."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    low = found.select("doc", ascii_lower(F.col("run")).alias("run"))
    marked = low.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(word: Column) -> Column:
    """Sum of the fifth powers of the letters' code points, modulo MODULUS."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, x: (s + _power(x)) % MODULUS)


def listed(words: DataFrame) -> DataFrame:
    """(at, word, n): the places at which a word of words (word, n) can meet its near words, at most two for each of its different letters.

    A place hashes the longer word's length, a key, which half holds the letter, and the other half."""
    size = F.length("word")
    split = F.floor(size / 2).cast("int")
    keyed = words.select(
        "word", "n", size.alias("size"), anagram_key(F.col("word")).alias("key"), F.substring("word", F.lit(1), split).alias("left"), F.substring("word", split + 1, size).alias("right")
    )
    # a word as the shorter one is cut where the longer one would be
    cut = F.floor((F.col("size") + 1) / 2).cast("int")

    def place(length, key, half, rest):
        return F.xxhash64(length, key, F.lit(half), rest)

    def less(half, rest):
        letters = F.array_distinct(F.split(F.col(half), ""))
        return F.transform(letters, lambda x: place(F.col("size"), (F.col("key") - _power(x) + MODULUS) % MODULUS, half, F.col(rest)))

    whole = F.array(
        place(F.col("size") + 1, F.col("key"), "left", F.substring("word", cut, F.col("size"))),
        place(F.col("size") + 1, F.col("key"), "right", F.substring("word", F.lit(1), cut)),
    )
    return keyed.select(F.explode(F.concat(less("left", "right"), less("right", "left"), whole)).alias("at"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b: words that differ by exactly one inserted, deleted or replaced code point."""
    places = listed(words)
    a, b = (places.select("at", *(F.col(c).alias(f"{c}_{x}") for c in ("word", "n"))) for x in "ab")
    met = a.join(b.hint("merge"), "at").where(F.col("word_a") < F.col("word_b"))
    near = met.where(F.levenshtein("word_a", "word_b", 1) == 1)
    return near.groupBy(F.col("word_a").alias("a"), F.col("word_b").alias("b")).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def nearest(pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n_near, form, form_n): how many near words each has, and the most frequent of them (ties: the first in code-point order) where it is times as frequent."""
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("other"), F.col(f"n_{y}").alias("m"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")  # not a union, which would make the pairs twice
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    formed = -F.col("best.m") >= times * F.col("n")
    return found.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), each followed to the last. A form is more frequent than its word, so there are no cycles; each round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        discard(now)
        now = after.drop("moved")
        now._plumbline_path = after._plumbline_path
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs with the rules above; see word_counts, nearest and roots.

    An empty table, or texts without words, give no rows; rows of one key each count, repeated or not; other columns play no part."""
    words = written(word_counts(docs, key, text), "word-counts")
    near = written(nearest(near_pairs(words), times), "word-near")
    last = roots(near.where("form is not null"))
    rows = words.join(near, "word", "left").join(last, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def variants_sql() -> str:
    """DuckDB SQL for variants() over documents: crc32 by its table, near words by the strings that one deletion leaves."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    byte = "CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS BIGINT)"
    crc = f"xor(list_reduce(list_transform(range(0, length(hx) // 2), lambda i: {byte}), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INT)]), 4294967295), 4294967295)"
    return f"""WITH RECURSIVE steps(k, t) AS (SELECT 0, range(0, 256) UNION ALL SELECT k + 1, list_transform(t, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM steps WHERE k < 8),
crc AS (SELECT t AS tab FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{upper}', '{lower}') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY doc_id, run),
hexed AS (SELECT run, times, lower(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run))) AS hx FROM each),
summed AS (SELECT run, times, {crc} AS h FROM hexed, crc),
made AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM summed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cuts AS (SELECT DISTINCT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
UNION SELECT cuts.word, words.word FROM cuts JOIN words ON rest = words.word UNION SELECT words.word, cuts.word FROM cuts JOIN words ON rest = words.word),
ranked AS (SELECT x, count(*) AS n_near, first(y ORDER BY b.n DESC, encode(y)) AS y, max(b.n) AS m FROM links JOIN words b ON b.word = y GROUP BY x),
near AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * words.n THEN y END AS form, CASE WHEN m >= {TIMES} * words.n THEN m END AS form_n FROM words LEFT JOIN ranked ON x = words.word),
paths(word, top) AS (SELECT word, word FROM near UNION ALL SELECT paths.word, near.form FROM paths JOIN near ON near.word = paths.top WHERE near.form IS NOT NULL)
SELECT near.word, near.form, top AS root, near.n, CAST(near.n_near AS BIGINT) AS n_near, CAST(near.form_n AS BIGINT) AS form_n FROM near JOIN paths ON paths.word = near.word JOIN near AS last ON last.word = top WHERE last.form IS NULL"""
