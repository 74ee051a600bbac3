"""Main text of web pages by wrappers inferred for each host.

A page is read as a tree of blocks with texts. Neighbours and groups of neighbours that repeat are folded, and a host's pages are
aligned with its wrapper one after the other: what lines up is merged, what one side lacks becomes optional, what occurs
more often becomes repeated, and texts become slots. The result is a union-free regular expression,
kept as a tree of nodes with a multiplicity (1, ?, + or *). Each slot knows on how many pages it is, how much text it
has, which texts all its pages have, and, from a sketch of its texts, how many of them come again on other pages.

From that the wrapper tells its slots apart. Slots whose texts come again are template, the others are data; the main part is the smallest node
that holds the paragraphs among the data, with the headings beside it. A page is then matched with the wrapper, and its blocks
in the main part are its main text. Tags that HTML keeps for menus, forms and asides, and words of class and id, only take parts out
of the main part that vary like the article does (reader comments, sidebars), and decide alone where a host has one page.
Wrappers merge like pages do, so each task makes its own and they are merged in two rounds.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, slices, trimmed, written

#: First-round merges of a host's wrappers; hosts whose wrappers are broadcast; nodes of a task's wrappers from which they are given out early.
SALTS, BROADCAST_BYTES, NODES = 32, 8_000_000, 200_000
#: Children of a wrapper node, of which the rarest go beyond that (their blocks count as unmatched then); siblings a repeated group has at most; cells of an exact alignment.
WIDEST, GROUP, CELLS = 512, 4, 250_000
#: Open blocks a path names; what is nested deeper counts to the last of them.
DEPTH = 150
#: Different pages with a slot from which its texts can be template; texts in a slot's sketch; the share of texts that come again from which a slot is template.
LEAST_PAGES, SKETCH, AGAIN_SHARE = 3, 24, 0.5
#: The share of a part's text that makes a neighbour on the same pages part of the main part; the share of all such text that articles hold where they are the main parts.
BESIDE, ARTICLES = 0.05, 0.5

#: Raw elements hold no markup; inline ones don't end a block; void ones have no end; these end an open paragraph (fixed values).
RAW = frozenset("script style noscript iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img label picture source input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("article aside body div dl footer header html main nav ol section table ul form td th blockquote figure".split())

#: What is never main text, by tag and by a word of class, id or role; and what holds an article.
BOILER_TAGS = frozenset("head nav footer aside form button select dialog menu template".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager toolbar widget search complementary contentinfo".split()
)
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article articlebody main maincontent".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that are paragraphs of what holds them.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")


def signature(name: str, attrs: str) -> str:
    """The tag with the words of its class, id and role, digits left out."""
    if not attrs or attrs.isspace():
        return name
    found = [w.lower() for m in _NAMES.finditer(attrs) for v in m.groups() if v for w in _SPLIT.split(re.sub(r"\d+", "", v)) if w]
    return name + "." + ".".join(sorted(set(found))) if found else name


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case, whether an end tag, attributes) of each tag; comments, declarations and raw elements have the name ''.

    Linear: a quote that is never closed makes quotes count for nothing in the rest of the page."""
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while 0 <= (start := page.find("<", at)):
        m = _NAME.match(page, start + 1)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                at = start + 1
                continue
            yield start, at, "", False, ""
            continue
        if m.end() > last:  # no tag ends from here on
            return
        end = _ATTRS.match(page, m.end()) if quotes else None
        if end is None:
            quotes = False
            at = page.find(">", m.end()) + 1
        else:
            at = end.end()
        name = m[2].lower()
        if name in RAW and not m[1]:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else n
            yield start, at, "", False, ""
        else:
            yield start, at, name, bool(m[1]), page[m.end() : at - 1]


Block = tuple[str, str, list[int]]


def blocks(page: str) -> list[Block]:
    """(path, text, elements) of each block with text, in page order: path is the signatures of the open blocks, joined by '/', and '/a' if all the text is links; elements are their numbers."""
    stack: list[tuple[str, str, int]] = []  # tag, signature, number
    out: list[Block] = []
    held: list[str] = []
    opened: dict[str, int] = {}
    at = 0
    link = plain = False  # inside <a>; text outside of it in this block

    def end_block() -> None:
        nonlocal plain
        text = "".join(held)
        held.clear()
        if text and not text.isspace():
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                path, own = "/".join([x for _, x, _ in stack[:DEPTH]]), [k for *_, k in stack[:DEPTH]]
                out.append((path, text, own) if plain else (path + "/a", text, [*own, -1]))
        plain = False

    def close(k: int) -> None:
        end_block()
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal plain
        held.append(text)
        if not link and not plain and not text.isspace():
            plain = True

    for start, end, name, ends, attrs in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                link = not ends
            continue
        if ends:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            else:
                end_block()
            continue
        end_block()
        if name in VOID:
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if again := AGAIN.get(name):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in again:
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if attrs.rstrip().endswith("/") and name not in ENDS_P:
            continue
        stack.append((name, signature(name, attrs), start))
        opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        add(page[at:])
    end_block()
    return out


# A wrapper node is {"s": signature, "m": multiplicity, "g": siblings of the repeated group it is in or 0, "p": pages, "c": children} and, where it has a text
# slot, "t": characters, "d": names of different pages (LEAST_PAGES at most) and "b": [name, pages] of the SKETCH texts with the least names. A page's own nodes
# also have "i": positions of their blocks. The root has "k": for each clean path, names of different pages and of the texts that all of them have there.


def _name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _node(sig: str) -> dict:
    return {"s": sig, "m": "1", "g": 0, "p": 1, "t": 0, "c": [], "i": []}


def page_tree(found: list[Block]) -> dict:
    """The page's blocks as a tree whose repeated neighbours are folded: a page is a wrapper of its own."""
    root = _node("")
    open_nodes, last = [root], []
    page = _name("\n".join(t for _, t, _ in found))
    for i, (path, text, own) in enumerate(found):
        parts = path.split("/") if path else []
        same = 0
        while same < len(own) and same < len(last) and own[same] == last[same]:
            same += 1
        del open_nodes[same + 1 :]
        for p in parts[same:]:
            node = _node(p)
            open_nodes[-1]["c"].append(node)
            open_nodes.append(node)
        node, name = open_nodes[-1], _name(text)
        node["t"] += len(text)
        node["i"].append(i)
        node["d"], node["b"] = [page], _least([*node.get("b", []), [name, 1]], max)
        last = own
    _fold(root)
    texts: dict[str, set[int]] = {}
    for path, text, _ in found:
        if clean(path):
            texts.setdefault(path, set()).add(_name(text))
    root["k"] = {p: [[page], sorted(x)] for p, x in texts.items()}
    return root


def _least(texts: list, both) -> list:
    """The SKETCH texts with the least names; both joins counts of the same text."""
    seen: dict[int, int] = {}
    for name, n in texts:
        seen[name] = both(seen[name], n) if name in seen else n
    return [list(x) for x in sorted(seen.items())[:SKETCH]]


def _shape(n: dict) -> set[str]:
    return {k["s"] for k in n["c"]} | ({"#"} if n["t"] else set())


def alike(a: dict, b: dict) -> bool:
    """Nodes that can be one: the same tag and words, and something of the same kind in it."""
    if a["s"] != b["s"]:
        return False
    x, y = _shape(a), _shape(b)
    return not x or not y or not x.isdisjoint(y)


def _fold(n: dict) -> None:
    """Merges repeated neighbours, and groups of GROUP neighbours at most, from the leaves up."""
    out: list[dict] = []
    for k in n["c"]:
        _fold(k)
        out.append(k)
        for w in range(1, GROUP + 1):
            if len(out) < 2 * w:
                break
            if all(alike(out[j - 2 * w], out[j - w]) for j in range(w)):
                for j in range(w):
                    x = out[j - 2 * w]
                    out[j - 2 * w] = merge(x, out[j - w], same_page=True) | {"m": "+", "g": w if w > 1 else x["g"]}
                del out[-w:]
                break
    n["c"] = out


_MULT = {("1", "1"): "1", ("1", "+"): "+", ("+", "+"): "+"}


def _times(a: str, b: str) -> str:
    both = _MULT.get((a, b)) or _MULT.get((b, a))
    return both or ("*" if "+" in (a, b) or "*" in (a, b) else "?")


def _optional(n: dict) -> dict:
    return n | {"m": {"1": "?", "+": "*"}.get(n["m"], n["m"])}


def align(x: list[dict], y: list[dict]) -> list[tuple[int, int]]:
    """Pairs of positions, rising in both lists, of nodes that are alike: as many as can be, or some of them where the lists are very long."""
    if len(x) == len(y) and all(map(alike, x, y)):
        return [(i, i) for i in range(len(x))]
    n, m = len(x), len(y)
    if n * m > CELLS:
        at: dict[str, list[int]] = {}
        for j, k in enumerate(y):
            at.setdefault(k["s"], []).append(j)
        pairs, nxt = [], 0
        for i, k in enumerate(x):
            places = at.get(k["s"], [])
            j = bisect_left(places, nxt)
            if j < len(places) and alike(k, y[places[j]]):
                pairs.append((i, places[j]))
                nxt = places[j] + 1
        return pairs
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if alike(x[i], y[j]) else 0)
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if best[i][j] == best[i + 1][j + 1] + 1 and alike(x[i], y[j]):
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def merge(a: dict, b: dict, same_page: bool = False) -> dict:
    """Two wrappers of a host aligned: children that are alike are merged, the rest is optional."""
    x, y = a["c"], b["c"]
    kids, i, j = [], 0, 0
    for p, q in [*align(x, y), (len(x), len(y))]:
        kids += map(_optional, [*x[i:p], *y[j:q]])
        if p < len(x):
            kids.append(merge(x[p], y[q], same_page))
        i, j = p + 1, q + 1
    if len(kids) > WIDEST:
        rare = sorted(range(len(kids)), key=lambda k: (kids[k]["p"], -k))[: len(kids) - WIDEST]
        kids = [k for i, k in enumerate(kids) if i not in {*rare}] if not same_page else kids
    out = {"s": a["s"], "m": _times(a["m"], b["m"]), "g": a["g"] or b["g"], "p": 1 if same_page else a["p"] + b["p"], "t": a["t"] + b["t"], "c": kids}
    if same_page:
        out["i"] = a["i"] + b["i"]
    if "d" in a or "d" in b:
        out["d"] = sorted({*a.get("d", ()), *b.get("d", ())})[:LEAST_PAGES]
        out["b"] = _least(a.get("b", []) + b.get("b", []), max if same_page else add)
    if "k" in a:
        out["k"] = _shared(a["k"], b["k"])
    return out


def _shared(a: dict, b: dict) -> dict:
    """The texts that all pages of two wrappers have at a path."""
    out = a | b
    for p in a.keys() & b.keys():
        (pages, x), (more, y) = a[p], b[p]
        out[p] = [sorted({*pages, *more})[:LEAST_PAGES], x if x == y else sorted({*x} & {*y})]
    return out


def expression(n: dict) -> str:
    """The wrapper as a regular expression over tags and text slots."""
    parts, kids, i = ["#" if n["t"] else ""], n["c"], 0
    while i < len(kids):
        w = kids[i]["g"] or 1
        group = kids[i : i + w]
        if w > 1 and len(group) == w and all(k["g"] == w for k in group):
            parts.append("(" + "".join(expression(k | {"m": "1", "g": 0}) for k in group) + ")" + group[0]["m"])
        else:
            w = 1
            parts.append(expression(kids[i]))
        i += w
    if not n["s"]:
        return "".join(parts)
    body = f"<{n['s']}>{''.join(parts)}</{n['s'].split('.')[0]}>"
    return body if n["m"] == "1" else f"({body}){n['m']}"


def _boiler(sig: str) -> bool:
    tag, *own = sig.split(".")
    return tag in BOILER_TAGS or not BOILER_WORDS.isdisjoint(own) and tag not in ("body", "html", "article", "main")


def _main(sig: str) -> bool:
    tag, *own = sig.split(".")
    return tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(own) and tag not in ("body", "html")


@lru_cache(100_000)
def clean(path: str) -> bool:
    """Not inside boilerplate. A header is boilerplate but for an article's own headings."""
    parts = path.split("/")
    if any(map(_boiler, parts)):
        return False
    heads = [i for i, s in enumerate(parts) if s.split(".")[0] == "header" or "header" in s.split(".")[1:]]
    return not heads or parts[-1].split(".")[0] in HEADINGS and any(map(_main, parts[: heads[0]]))


def is_template(n: dict) -> bool:
    """Whether most of the slot's texts come again on other pages."""
    return len(n["d"]) >= LEAST_PAGES and sum(c > 1 for _, c in n["b"]) >= AGAIN_SHARE * len(n["b"])


def _tag(n: dict) -> str:
    return n["s"].split(".")[0]


def roles(wrapper: dict) -> list | None:
    """The wrapper with each node's role, as a page is matched with it: [signature, kinds of content, role, template texts, children]; None if it has no main part.

    Roles: 0 outside the main part, 1 inside, 2 inside but template or boilerplate."""
    mass: dict[int, int] = {}  # of each node: characters of its data slots with paragraphs, of all its data slots, and how many have headings
    other: dict[int, int] = {}
    heads: dict[int, int] = {}

    def weigh(n: dict, path: tuple[str, ...]) -> None:
        path = (*path, n["s"]) if n["s"] else path
        good = n["t"] and _tag(n) != "a" and clean("/".join(path)) and not is_template(n)
        mass[id(n)] = n["t"] if good and _tag(n) in PARAGRAPHS else 0
        heads[id(n)] = int(bool(good) and _tag(n) in HEADINGS)
        other[id(n)] = n["t"] if good else 0
        for k in n["c"]:
            weigh(k, path)
            for d in (mass, heads, other):
                d[id(n)] += d[id(k)]

    weigh(wrapper, ())
    if 2 * mass[id(wrapper)] < other[id(wrapper)]:  # not written in paragraphs
        mass = other
    total = mass[id(wrapper)]
    if not total:
        return None

    def articles(n: dict) -> list[dict]:
        return [n] if _main(n["s"]) else [x for k in n["c"] for x in articles(k)]

    def parts(n: dict) -> list[dict]:
        """The smallest nodes that hold n's text: one, or one of each template where these are never on the same page."""
        kids = [k for k in n["c"] if mass[id(k)]]
        if not kids or mass[id(n)] > sum(mass[id(k)] for k in kids):
            return [n]
        block = lambda k: k["t"] and not k["c"]
        if sum(k["p"] for k in kids) <= n["p"]:
            found = [] if any(map(block, kids)) else [x for k in kids for x in parts(k)]
            return found or [n]
        most = max(kids, key=lambda k: mass[id(k)])
        alone = heads[id(n)] == heads[id(most)] and mass[id(n)] - mass[id(most)] < BESIDE * mass[id(n)]
        return parts(most) if alone and not block(most) else [n]

    marked = articles(wrapper)
    main = marked if sum(mass[id(n)] for n in marked) >= ARTICLES * total else parts(wrapper)
    tops = {id(n) for n in main}

    def give(n: dict, path: tuple[str, ...], inside: bool) -> list:
        path = (*path, n["s"]) if n["s"] else path
        inside = inside or id(n) in tops
        role = int(inside)
        if inside and (not clean("/".join(path)) or n["t"] and is_template(n) and 5 * n["t"] < total):
            role = 2
        pages, same = wrapper["k"].get("/".join(path), ([], []))
        same = same if n["t"] and len(pages) >= LEAST_PAGES else []
        return [n["s"], sorted(_shape(n)), role, same, [give(k, path, inside) for k in n["c"]]]

    return give(wrapper, (), False)


def placed(tree: dict, wrapper: list, found: list[Block]) -> tuple[list[int], list[int]]:
    """Positions of a page's blocks that are in the wrapper's main part, and of those among them whose texts are not template."""
    took, own = [], []

    def node(w: list) -> dict:
        return {"s": w[0], "c": [{"s": x[0]} for x in w[4]], "t": "#" in w[1]}

    def rest(n: dict) -> None:
        """What the wrapper does not know, inside the main part."""
        for i in n["i"]:
            if clean(found[i][0]):
                took.append(i)
                own.append(i)
        for k in n["c"]:
            rest(k)

    def walk(n: dict, w: list) -> None:
        if w[2] == 1:
            took.extend(n["i"])
            own.extend(i for i in n["i"] if not w[3] or _name(found[i][1]) not in w[3])
        pairs = dict(align(n["c"], [node(x) for x in w[4]]))
        for i, k in enumerate(n["c"]):
            if i in pairs:
                walk(k, w[4][pairs[i]])
            elif w[2] == 1:
                rest(k)

    walk(tree, wrapper)
    return sorted(took), sorted(own)


def _holds(block: str, path: str) -> bool:
    return not block or path == block or path.startswith(block + "/")


def main_block(good: list[tuple[str, str]]) -> str:
    """Path of the smallest block that holds all paragraphs among these clean blocks; all of them where paragraphs are not most of the text."""

    def common(split: list[list[str]]) -> str:
        least, most = min(split), max(split)
        return "/".join(least[: next((i for i, (x, y) in enumerate(zip(least, most, strict=False)) if x != y), min(len(least), len(most)))])

    split = [p.split("/") for p, _ in good]
    own = [p[:-1] for p in split if p[-1].split(".")[0] in PARAGRAPHS]
    if own:
        block = common(own)
        if 2 * sum(len(t) for p, t in good if _holds(block, p)) >= sum(len(t) for _, t in good):
            return block
    return common(split)


def main_text(found: list[Block], wrapper: list | None) -> list[str]:
    """Texts of a page's blocks in the main part of its host's wrapper; of a page with none there, the clean ones under its own main block.

    Template texts go, unless they are most of what would be there: pages that share so much are copies.
    A page that is no more than loose paragraphs, in no block at all, has no article where the host's other pages have one."""
    if wrapper is not None:
        took, own = placed(page_tree(found), wrapper, found)
        if took:
            size = lambda at: sum(len(found[i][1]) for i in at)
            return [found[i][1] for i in (own if 2 * size(own) >= size(took) else took)]
    good = [(p, t) for p, t, _ in found if clean(p)]
    if not good:
        return []
    block = main_block(good)
    if not block:
        return [] if wrapper is not None else [t for _, t in good]
    return [t for p, t in good if _holds(block, p)]


def host_of(url) -> F.Column:
    """The host of a URL in lower case, without user and port; '' for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _bare(n: dict) -> dict:
    """A wrapper without a page's own positions."""
    n.pop("i", None)
    for k in n["c"]:
        _bare(k)
    return n


def _count(n: dict) -> int:
    """Nodes and the texts they name."""
    return 1 + sum(len(x) for _, x in n.get("k", {}).values()) + sum(map(_count, n["c"]))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, slots): the wrapper of each host over all its pages, and its roles, both as JSON.

    Every task aligns its own pages and sends one wrapper for each host it has seen, or several where its wrappers have over NODES nodes together; a host's wrappers are merged in SALTS
    groups, then once more, so a hot host is no hot task."""

    def own(batches):
        hold("html_text")
        wrappers: dict[str, dict] = {}
        size = 0
        part = TaskContext.get().partitionId() % SALTS
        schema = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])

        def out():
            rows = {"host": list(wrappers), "salt": [part] * len(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()]}
            wrappers.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for batch in batches:
            for cols, texts in slices(batch, "page"):
                for host, text in zip(cols[0].to_pylist(), texts, strict=True):
                    tree = page_tree(blocks(text))
                    before = _count(wrappers[host]) if host in wrappers else 0
                    wrappers[host] = _bare(merge(wrappers[host], tree) if before else tree)
                    size += _count(wrappers[host]) - before
                    if size > NODES:
                        yield out()
                        size = 0
        yield out()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        trees = map(json.loads, sorted(rows.wrapper))
        tree = next(trees)
        for t in trees:
            tree = merge(tree, t)
        return pd.DataFrame({"host": [rows.host.iloc[0]], "wrapper": [json.dumps(tree)], "slots": [json.dumps(roles(tree))]})

    first = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).mapInArrow(trimmed(own), "host string, salt int, wrapper string")
    half = first.groupBy("host", "salt").applyInPandas(merged, "host string, wrapper string, slots string")
    return half.groupBy("host").applyInPandas(merged, "host string, wrapper string, slots string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """(key, url, text, n_chars): the blocks in the main part of the host's wrapper, or else in the page's own main block, joined by line feeds.

    Pages without host share a wrapper. A null or empty page, and one without such blocks, gives ''.
    Repeated rows, null keys and null URLs pass; other columns are not carried. The wrappers are written
    first; their roles are broadcast if they have BROADCAST_BYTES at most, else joined by host.
    """
    slots = written((wrappers if wrappers is not None else infer_wrappers(pages, url, page)).select("host", "slots"), "wrappers")
    size = slots.agg(F.sum(F.length("slots") + F.length("host") + 32)).first()[0] or 0
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"), host_of(F.col(url)).alias("host"))
    joined = rows.join(F.broadcast(slots) if size <= BROADCAST_BYTES else slots.hint("merge"), "host", "left").select("key", "url", "page", "slots")

    def run(batches):
        hold("html_text")
        known: dict[str, list | None] = {}
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for batch in batches:
            for cols, texts in slices(batch, "page"):
                out = []
                for s, text in zip(cols[3].to_pylist(), texts, strict=True):
                    s = s or "null"
                    if s not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[s] = json.loads(s)
                    out.append("\n".join(main_text(blocks(text), known[s])))
                yield pa.RecordBatch.from_arrays([cols[0].cast(pa.int64()), cols[1].cast(pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema=schema)

    return joined.mapInArrow(trimmed(run), "key bigint, url string, text string, n_chars bigint").withColumnsRenamed({"key": key, "url": url})
