"""Text functions as Column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Character sets of the frozen normal form.
ZERO_WIDTH = "​‌‍⁠﻿"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
PUNCTUATION = "।॥৽!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‐‑‒–—―‘’‚‛“”„‟…′″«»‹›·•"
WHITE = r"[\s\u001c-\u001f\u0085   -     　]+"
SPECIAL = r"<\|[^|]*\|>|<[a-zA-Z_]{1,16}>"
EVENT = r"[\[({][^\])}]{0,40}[\])}]"
NEGATIONS = ("না", "নি", "নেই", "নয়", "নাই", "কখনো", "কখনও", "কোনো", "কোন")
# Bengali clusters: consonants, what extends them, and conjuncts joined by the virama.
_CONSONANT = r"[ক-নপ-রলশ-হড়ঢ়য়ৰৱ]"
_EXTEND = r"ঁ়াু-ৄৗৢৣ৾‍"
GRAPHEME = rf"(?:{_CONSONANT}[{_EXTEND}]*্[{_EXTEND}্]*(?={_CONSONANT}))*\X"


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.str.normalize("NFC")


def normalize(text: Column, compose: bool = True) -> Column:
    """The frozen normal form; null gives ''. compose=False for texts known to be in NFC keeps the expression in the JVM."""
    text = F.coalesce(text, F.lit(""))
    out = nfc(text) if compose else text
    out = F.regexp_replace(out, SPECIAL, " ")
    out = F.regexp_replace(out, EVENT, " ")
    out = F.translate(out, ZERO_WIDTH, "")
    out = F.translate(out, BENGALI_DIGITS + PUNCTUATION, "0123456789" + " " * len(PUNCTUATION))
    return F.trim(F.regexp_replace(out, WHITE, " "))


def tokens(normalized: Column) -> Column:
    """Tokens between spaces; '' has none."""
    return F.filter(F.split(normalized, " ", -1), lambda t: t != "")


def graphemes(normalized: Column) -> Column:
    """Extended grapheme clusters without spaces, conjuncts as one."""
    return F.regexp_extract_all(F.replace(normalized, F.lit(" "), F.lit("")), F.lit(GRAPHEME), F.lit(0))


def token_key(words: Column) -> Column:
    """Sorted tokens joined by spaces: equal for equal multisets."""
    return F.array_join(F.array_sort(words), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def has_repetition_loop(words: Column, longest: int = 4, times: int = 3) -> Column:
    """Whether some n-gram, n up to longest, stands times or more often back to back."""
    n_words = F.size(words)

    def at_size(n: int) -> Column:
        starts = F.when(n_words >= n * times, F.sequence(F.lit(1), n_words - n * times + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda s: F.lit(True) if times < 2 else _all([F.slice(words, s, n) == F.slice(words, s + n * k, n) for k in range(1, times)]))

    out = at_size(1)
    for n in range(2, longest + 1):
        out = out | at_size(n)
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes over zlib bytes; 0 for an empty or null text."""
    import zlib

    return texts.map(lambda t: len(t.encode()) / len(zlib.compress(t.encode())) if t else 0.0)


#: The characters that stand for the first tokens of a pair in coded_distance.
CODES = "".join(chr(0x4E00 + i) for i in range(1, 513))


def coded_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays (substitutions, deletions and insertions together), by the built-in on coded strings.

    Every distinct token of the pair becomes one character (surrogates are left out; a million tokens fit), so words are the unit.
    The distinct tokens are bound to a name once for a pair; a character comes out of a constant while they are few."""
    place = lambda n: F.when(n < 0xD800, n).otherwise(n + 0x800)
    far = lambda n: F.decode(F.unhex(F.lpad(F.hex(place(n + 0x4E00)), 8, "0")), "UTF-32")

    def code(words: Column, known: Column) -> Column:
        at = F.transform(words, lambda t: F.array_position(known, t).cast("int"))
        return F.array_join(F.transform(at, lambda n: F.when(n <= len(CODES), F.substring(F.lit(CODES), n, F.lit(1))).otherwise(far(n))), "")

    pair = F.array(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known")))
    return F.get(F.transform(pair, lambda p: F.levenshtein(code(p["a"], p["known"]), code(p["b"], p["known"]))), F.lit(0))


def edit_operations(reference: Column | str, hypothesis: Column | str) -> Column:
    """Struct of substitutions, deletions and insertions of the alignment that prefers a match, then substitution, deletion, insertion. Null counts as empty.

    A fold over the anti-diagonals of the table of prefixes, whose cells depend on the two diagonals before and so are
    made by one transform each, in the JVM. A cell is cost * 2^32 + substitutions; as cost, substitutions and the lengths give the
    other two counts, nothing else is carried, and only three diagonals are held."""
    one, low = F.lit(1 << 32), lambda cell: cell % (1 << 32)
    none = F.array().cast("array<string>")

    def aligned(pair: Column) -> Column:
        ref, hyp = pair["r"], pair["h"]
        n, m = F.size(ref), F.size(hyp)

        def diagonal(state: Column, k: Column) -> Column:
            first = lambda back: F.greatest(F.lit(0), k - back - m)

            def cell(i: Column) -> Column:
                j = k - i
                diag, up, left = F.get(state["b"], i - 1 - first(2)), F.get(state["a"], i - 1 - first(1)), F.get(state["a"], i - first(1))
                cost = lambda x: F.floor(x / one)
                edge = F.when(i == 0, j.cast("long") * one).when(j == 0, i.cast("long") * one)
                same = edge.when(F.get(ref, i - 1).eqNullSafe(F.get(hyp, j - 1)), diag)
                return same.when(cost(diag) <= F.least(cost(up), cost(left)), diag + one + 1).when(cost(up) <= cost(left), up + one).otherwise(left + one)

            return F.struct(F.transform(F.sequence(first(0), F.least(n, k)), cell).alias("a"), state["a"].alias("b"))

        start = F.struct(F.array(F.lit(0).cast("long")).alias("a"), F.array().cast("array<bigint>").alias("b"))
        last = F.aggregate(F.when(n + m > 0, F.sequence(F.lit(1), n + m)).otherwise(F.array().cast("array<int>")), start, diagonal, lambda s: F.get(s["a"], F.lit(0)))
        return F.struct(last.alias("cell"), (n - m).alias("longer"))

    def counts(x: Column) -> Column:
        subs = low(x["cell"])
        inserted = (F.floor(x["cell"] / one) - subs - x["longer"]) / 2
        return F.struct(subs.cast("int").alias("substitutions"), (inserted + x["longer"]).cast("int").alias("deletions"), inserted.cast("int").alias("insertions"))

    as_column = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, none)
    # bound to names by transforms over one element, so that nothing is computed again for every cell
    pair = F.array(F.struct(as_column(reference).alias("r"), as_column(hypothesis).alias("h")))
    return F.get(F.transform(F.transform(pair, aligned), counts), F.lit(0))


#: How an edit is put, by the sequence matcher's name for it, and what stands where there is none.
_EDIT, _NO_EDIT = {"replace": "{0} -> {1}", "delete": "deleted: {0}", "insert": "inserted: {1}"}, "(no token-level difference)"


@pandas_udf(StructType([StructField(k, StringType()) for k in ("edits", "signals")]))
def described_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """What a sequence matcher says was replaced, deleted or inserted, and flags: lost (with the words) or added negations, fewer or more tokens, Latin letters; substitution_only without any."""
    from difflib import SequenceMatcher

    def one(pair):
        ref, hyp = map(list, pair)
        spans = [(kind, ref[a:b], hyp[c:d]) for kind, a, b, c, d in SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes() if kind in _EDIT]
        was, now = ({w for span in spans for w in span[k]} for k in (1, 2))
        lost, gained = ((x - y) & set(NEGATIONS) for x, y in ((was, now), (now, was)))
        flags = {
            f"negation_lost({'/'.join(sorted(lost))})": lost,
            "negation_added": gained,
            "content_deleted": len(hyp) < len(ref),
            "content_inserted": len(hyp) > len(ref),
            "latin_script_leak": any(c.isascii() and c.isalpha() for w in hyp for c in w),
        }
        told = "; ".join(_EDIT[kind].format(" ".join(x), " ".join(y)) for kind, x, y in spans)
        return told or _NO_EDIT, ", ".join(k for k, on in flags.items() if on) or "substitution_only"

    return pd.DataFrame(map(one, zip(reference, hypothesis, strict=True)), columns=["edits", "signals"])
