"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over trigrams of the lower-cased text.
The index has a posting (trigram, document) for every trigram of the rules' queries that a document holds;
intersecting a query's postings gives the rule's candidates, which its expression then verifies on the whole text.
A rule without mandatory trigrams is verified on every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

#: Strings that a part of an expression may stand for before it counts as anything; candidates that are broadcast (16 bytes each); bits of a mask word.
EXACT, BROADCAST_ROWS, WORD = 24, 200_000, 62


@dataclass(frozen=True)
class Rule:
    """kind, an expression in the syntax that Java, RE2 and Python share, and the least length of a group of it (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds; {32,} and {12,} keep just the matches of + that are long enough, as a match is its whole run.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:authorization: *bearer) +[A-Za-z0-9._~+/=-]{16,}"),
)

# A query is None (anything), or a frozenset of clauses (or), each a frozenset of trigrams (and).


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    return frozenset(x for x in both if not any(y < x for y in both))


def _or(a, b):
    if a is None or b is None:
        return None
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _of_strings(strings):
    """What a text must hold that holds one of the strings; anything if one is too short to have a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class _Part:
    """exact: all strings it can match, or None; else what it begins and ends with, and its query."""

    exact: frozenset | None
    first: frozenset = frozenset({""})
    last: frozenset = frozenset({""})
    query: frozenset | None = None

    def open(self) -> _Part:
        if self.exact is None:
            return self
        short = lambda take: frozenset(map(take, self.exact))
        return _Part(None, short(lambda s: s[:8]), short(lambda s: s[-8:]), _of_strings(self.exact))


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT:
        return _Part(frozenset(x + y for x in a.exact for y in b.exact))
    firsts, lasts = a.first, b.last
    if a.exact is not None and len(a.exact) * len(b.open().first) <= EXACT:
        firsts = frozenset(x + y for x in a.exact for y in b.open().first)
    elif a.exact is not None:
        firsts = a.open().first
    if b.exact is not None and len(b.exact) * len(a.open().last) <= EXACT:
        lasts = frozenset(x + y for x in a.open().last for y in b.exact)
    elif b.exact is not None:
        lasts = b.open().last
    a, b = a.open(), b.open()
    middle = None
    if len(a.last) * len(b.first) <= EXACT:
        middle = _of_strings({x + y for x in a.last for y in b.first})
    query = _and(_and(a.query, b.query), middle)
    for ends in (firsts, lasts):
        query = _and(query, _of_strings(ends))
    cut = lambda ends, take: frozenset(map(take, ends))
    return _Part(None, cut(firsts, lambda s: s[:8]), cut(lasts, lambda s: s[-8:]), query)


def _either(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= EXACT:
        return _Part(a.exact | b.exact)
    a, b = a.open(), b.open()
    return _Part(None, a.first | b.first, a.last | b.last, _or(a.query, b.query))


_ANY = _Part(None)


def _parse(node) -> _Part:
    out = _Part(frozenset({""}))
    for op, arg in node:
        if op is sre.LITERAL:
            part = _Part(frozenset({chr(arg).lower()}))
        elif op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg):
            chars = {chr(c).lower() for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))}
            part = _Part(frozenset(chars)) if len(chars) <= 5 else _ANY
        elif op is sre.SUBPATTERN:
            part = _parse(arg[3])
        elif op is sre.BRANCH:
            part = reduce(_either, map(_parse, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            inner = _parse(inner)
            if (low, high) == (0, 1):
                part = _either(inner, _Part(frozenset({""})))
            elif low:
                part = reduce(_then, [inner] * min(low, 3))
                part = part if low == high <= 3 else part.open()
            else:
                part = _ANY
        elif op is sre.AT:
            continue
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Clauses of trigrams, one of which every lower-cased match holds in full; None if nothing is mandatory."""
    query = _parse(sre_parser.parse(pattern)).open().query
    return None if query is None else sorted(sorted(c) for c in query)


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key): gram is the position in trigrams; one for each of them that a document's lower-cased text holds."""
    low = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams))))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, trigrams: list[str], queries: list) -> DataFrame:
    """(key, rules): the postings of each rule's query intersected; bit i of rules stands for queries[i].

    Postings are merged by document, partially in the task that made them, so one row a document is shuffled
    however frequent a trigram is."""
    words = -(-max(1, len(trigrams)) // WORD)
    held = [F.bit_or(F.when(F.col("gram").between(w * WORD, w * WORD + WORD - 1), F.expr(f"shiftleft(1L, gram - {w * WORD})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    at = {g: i for i, g in enumerate(trigrams)}

    def met(query) -> Column:
        def clause(grams):
            need = [sum(1 << (at[g] % WORD) for g in grams if at[g] // WORD == w) for w in range(words)]
            return reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in enumerate(need) if n])

        return reduce(Column.__or__, map(clause, query))

    rules = reduce(Column.bitwiseOR, [F.when(met(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in enumerate(queries) if q is not None], F.lit(0))
    return index.groupBy("key").agg(*held).select("key", rules.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) in code points of the rule's matches, leftmost and without overlap.

    Splitting at the matches gives what lies between them, so lengths add up to the offsets."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("of"),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        out = F.when(x["of"].isNotNull() & (x["of"] >= rule.least), F.array_append(state["out"], one)).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    spans = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, found: str = "found") -> DataFrame:
    """Secrets of every whole text: the columns of docs and found: array of (start, kind, end), by start, then kind. A column of docs named like found gives way to it.

    kind counts base, then added rules; offsets are code points, end exclusive. A null or empty text has none.
    Rows of one key, repeated or not, share a candidate entry and are each verified on their own text; a null key is a
    key; other columns stay. The candidates are written first: as many as broadcast_rows are joined by broadcast,
    which leaves the texts where they are; beyond that the join is shuffled by key.
    """
    rules = base + added
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries if q for c in q for g in c})
    of, met = free_names([*docs.columns, found], "candidate_key", "candidate_rules")
    entry = written(candidates(build_index(docs, trigrams, key, text), trigrams, queries), "secret-candidates").withColumnsRenamed({"key": of, "rules": met})
    small = entry.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(entry) if small else entry.hint("merge")
    joined = docs.join(side, docs[key].eqNullSafe(entry[of]), "left")
    whole = F.coalesce(docs[text], F.lit(""))
    bits = F.coalesce(F.col(met), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    each = [_spans(whole, r, i) if q is None else F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, _spans(whole, r, i)).otherwise(none) for i, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return joined.select(*(docs[c] for c in docs.columns if c.lower() != found.lower()), F.array_sort(F.concat(*each)).alias(found))


def as_text(found: Column, kinds: list[str]) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """docs with every found span in text replaced by mark; overlapping spans count as one. Null stays null."""
    (spans,) = free_names(docs.columns, "spans")
    scanned = scan(docs, rules, (), key, text, found=spans)
    whole = F.col(text)

    def step(state, x):
        new = F.greatest(x["start"], state["at"])
        kept = F.substring(whole, (state["at"] + 1).cast("int"), F.greatest(new - state["at"], F.lit(0)).cast("int"))
        fresh = x["end"] > state["at"]
        touching = (x["start"] < state["at"]) | ((x["start"] == state["at"]) & (state["at"] > 0) & (F.size(state["out"]) > 0))
        add = F.when(touching, F.array(F.lit(""))).otherwise(F.array(kept, F.lit(mark)))
        return F.struct(F.when(fresh, x["end"]).otherwise(state["at"]).alias("at"), F.when(fresh, F.concat(state["out"], add)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate(F.col(spans), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(whole, (s["at"] + 1).cast("int"), F.length(whole))))
    return scanned.select(*(F.when(F.size(spans) > 0, clean).otherwise(whole).alias(c) if c == text else F.col(c) for c in docs.columns))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of scan() with the rules above."""
    found, n = F.col("found"), len(BASE)
    kinds = [r.kind for r in BASE + ADDED]
    of = lambda i: F.size(F.filter(found, lambda x: x["kind"] == i)).cast("long")
    counts = [of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter(found, lambda x: x["kind"] < n)
    rows = scan(docs.select(key, text), key=key, text=text).select(key, "found")
    return rows.select(key, *counts, F.sha2(as_text(base, kinds), 256).alias("base_sha256"), as_text(found, kinds).alias("spans"))


def digest_sql() -> str:
    """DuckDB SQL for digest() over documents: plain expressions on every text."""
    kinds, parts = [r.kind for r in BASE + ADDED], []
    for i, r in enumerate(BASE + ADDED):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS kind, g, n, len(gap) + coalesce(sum(len(gap) + len(m)) OVER (PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, len(m) AS size, len(g) AS of, {r.least} AS least FROM ("
            f"SELECT rid, generate_subscripts(ms, 1) AS n, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {r.group}) AS gs, regexp_split_to_array(t, '{p}') AS gaps FROM docs WHERE regexp_matches(t, '{p}')))"
        )
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    one = f"{names} || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return (
        "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), "
        f"spans AS ({' UNION ALL '.join(parts)}), kept AS (SELECT * FROM spans WHERE of >= least) "
        f"SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, "
        f"coalesce(string_agg({one}, ',' ORDER BY start, kind), '') AS spans FROM docs LEFT JOIN kept USING (rid) GROUP BY rid"
    )
