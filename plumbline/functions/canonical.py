"""Canonical spelling by a map of sequences and characters, in the JVM but for the compatibility form."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import normalize


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return texts.str.normalize("NFKC")


def read_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A map from a JSON file on any file system that Spark reads: objects unicode_replacements (sequence: replacement) and char_replacements
    ("U+XXXX c": replacement). A null replacement deletes; an entry of both is the sequence's."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    chars = {chr(int(k.split()[0][2:], 16)): v or "" for k, v in found.get("char_replacements", {}).items()}
    return {k: v for k, v in (chars | {k: v or "" for k, v in found.get("unicode_replacements", {}).items()}).items() if k}


def latin_map() -> dict[str, str]:
    """Letters up to U+024F with marks to their base letters, by their decomposition."""
    out = {}
    for i in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if base != chr(i) and base.isascii() and base:
            out[chr(i)] = base
    return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def pattern_of(keys: list[str]) -> str:
    """An expression for the longest of the keys that stands at a place: a tree of their letters, so that a place is decided by the letters read and not key by key."""
    tree: dict = {}
    for key in keys:
        at = tree
        for c in key:
            at = at.setdefault(c, {})
        at[""] = {}

    def told(at: dict) -> str:
        ends = [_quoted(c) for c, below in sorted(at.items()) if c and set(below) == {""}]
        more = [_quoted(c) + told(below) for c, below in sorted(at.items()) if c and set(below) != {""}]
        # a letter that more may follow comes before one that only ends, and both before nothing
        parts = more + (["[" + "".join(ends) + "]"] if len(ends) > 1 else ends)
        if not parts:
            return ""
        out = parts[0] if len(parts) == 1 and "" not in at else "(?:" + "|".join(parts) + ")"
        return f"{out}?" if "" in at else out

    return told(tree)


def replaced(text: Column, mapping: dict[str, str]) -> Column:
    """Every leftmost longest key of mapping replaced, in one pass: what a replacement makes is not looked at again."""
    # a letter for a letter that no other key or replacement holds can wait for a lookup letter by letter
    wide = {k: x for k, x in mapping.items() if len(k) != 1 or len(x) != 1}
    held = set("".join(wide) + "".join(wide.values()))
    loose = {k: x for k, x in mapping.items() if k not in wide and k not in held}
    rest = {k: x for k, x in mapping.items() if k not in loose}
    if rest:
        pattern = pattern_of(list(rest))
        to = F.create_map(*(F.lit(x) for pair in sorted(rest.items()) for x in pair))
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.element_at(to, h))
        # between matches stand one piece more than there are matches
        both = F.zip_with(F.split(text, pattern, -1), F.array_append(hits, F.lit("")), lambda piece, hit: F.concat(piece, hit))
        text = F.when(text.rlike(pattern), F.array_join(both, "")).otherwise(text)
    return F.translate(text, "".join(loose), "".join(loose.values())) if loose else text


def canonical(text: Column, mapping: dict[str, str], compose: bool = True) -> Column:
    """The compatibility form, then mapping, then the frozen normal form; '' for null. compose=False for texts known to be in NFKC keeps all in the JVM."""
    text = F.coalesce(text, F.lit(""))
    return normalize(replaced(nfkc(text) if compose else text, mapping), compose)


def is_altered(text: Column, mapping: dict[str, str]) -> Column:
    """Whether mapping replaces something in text by something else."""
    keys = [k for k, v in mapping.items() if k != v]
    return F.coalesce(text, F.lit("")).rlike(pattern_of(keys)) if keys else F.lit(False)
