"""Main text of web pages through wrappers inferred per host.

A page is a stream of block tags and texts. A text that nearly all different
pages of a host hold is a constant, any other a slot. Adjacent repeats in the
stream are folded into repeated groups. The folded streams of a host are
aligned one after another with the host's wrapper, a union-free regular
expression: tokens that match stay, a constant that meets another text becomes
a slot, tokens only one side has become optional groups, and a group on one
side that the other repeats becomes a repeated group. Equal streams are
counted first and streams are aligned in groups of at most ``GROUP``, whose
wrappers are aligned in turn, so that a host with many pages is no large group.

Each page is then matched against its host's wrapper, as an automaton over
tokens. What meets a constant of the wrapper is template; what meets a slot is
content if it lies within the article's container outside menus, forms and
the like. Where no container is marked, it is the one whose slots hold most
text. Pages meet their host's wrapper by a join.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z|["'])""", re.I)
#: Elements whose content is text up to their own end tag, whatever it looks like.
_PLAIN = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
#: Elements whose content, markup included, is no text of the page.
_RAW = {"noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
_SKIP = {"nav", "footer", "aside", "form", "header", "head", "button", "select", "menu", "dialog", "label", "input", "option"}
_CONTAINER = {"html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "center", "fieldset"} | _SKIP
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "figcaption", "caption", "hr", "summary", "address", "thead", "tbody", "tfoot", "legend"}
_VOID = {"hr", "input", "br", "img", "meta", "link"}
#: Words of a class or id that name boilerplate whatever stands beside them, and such as don't beside a word for content.
_STRONG = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo|promotions?|cookies?|consent|gdpr|side-?bar|comments?|replies|disqus|newsletter|subscribe|signup|related|recommend\w*|outbrain|taboola|popup|modal|skip-?link|breadcrumbs?)", re.I)
_WEAK = re.compile(r"(?:banner|notices?|nav\w*|menu|respond|shar\w+|social|sign-?in|login|overlay|footer|header|masthead|toolbar|widget|pagination|pager|tags?|search\w*|alert)", re.I)
_CONTENT = re.compile(r"(?:article|post|story|entry|content|body|text|main|title|headline)", re.I)
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_DIGITS = re.compile("[0-9]+")
#: A constant is on at least so many hundredths of a host's different pages, of which there are at least ``CONSTANT_PAGES``.
CONSTANT_SHARE, CONSTANT_PAGES = 90, 8
#: Streams or wrappers aligned in one group.
GROUP = 64
#: Longest period folded into a repeated group.
PERIOD = 12
#: Part of a list path's text within links from which the list is a menu, in hundredths.
LINKED = 90
#: Bytes of host tables up to which they are broadcast; beyond, an ordinary join.
BROADCAST_BYTES = 8 << 20


def _boiler(names: str) -> bool:
    """Whether class and id name boilerplate."""
    for name in names.split():
        words = re.split("[-_]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name))
        joined = name.replace("-", "").replace("_", "")
        if any(_STRONG.fullmatch(w) for w in (*words, joined)):
            return True
        if any(_WEAK.fullmatch(w) for w in (*words, joined)) and not any(_CONTENT.fullmatch(w) for w in words):
            return True
    return False


@lru_cache(4096)
def _kind(tag: str, attrs: str) -> tuple[str, bool]:
    """Token of an element, and whether it is boilerplate by its name or attributes."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    names = " ".join(filter(None, (found.get("class"), found.get("id"))))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    drop = tag in _SKIP or hidden or found.get("role", "").lower() in _ROLE or bool(names and tag not in ("html", "body", "article", "main") and _boiler(names))
    mark = "main" if found.get("role", "").lower() == "main" else tag
    own = found.get("id", "")  # one with a digit names an element of one page, such classes a kind of elements
    shown = {_DIGITS.sub("0", c) for c in found.get("class", "").split()} | set(() if _DIGITS.search(own) else own.split())
    return mark + ("." + ".".join(sorted(shown)) if shown else ""), drop


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def tags_and_texts(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(tag, whether it ends one, attributes, "") and ("", False, "", text) in one pass; comments, declarations and plain-text elements are left out."""
    pos, n, broken = 0, len(page), False
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            yield "", False, "", page[pos:]
            return
        if lt > pos:
            yield "", False, "", page[pos:lt]
        head = page[lt + 1 : lt + 3].lstrip("/")[:1]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
        elif head.isascii() and head.isalpha():
            m = None if broken else _TAG.match(page, lt)
            if m is None:  # a quote is never closed: from here on tags end at the next bracket
                broken = True
                end = page.find(">", lt)
                if end < 0:
                    return
                m = _TAG.match(page[lt : end + 1].replace('"', " ").replace("'", " "))
                pos = end + 1
                if m is None:
                    continue
            else:
                pos = m.end()
            tag = m[2].lower()
            if tag in _PLAIN and not m[1]:
                stop = _end_of(tag).search(page, pos)
                if stop is None and m[3].rstrip().endswith("/"):
                    continue
                pos = n if stop is None else stop.start()
                continue
            yield tag, bool(m[1]), m[3], ""
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
        else:
            yield "", False, "", "<"
            pos = lt + 1


def parse(page: str) -> tuple[list[str], list[tuple[int, str, str, int]]]:
    """Tokens of the page's block structure and its text blocks as (place of its token ``#``, field, text, characters within links).

    A field is the chain of open containers and the leaf; ``!`` marks a
    boilerplate element. White space within a block is one space; ``<br>`` and
    inline tags don't end a block.
    """
    tokens: list[str] = []
    blocks: list[tuple[int, str, str, int]] = []
    stack: list[tuple[str, str]] = []
    leaf, buf, raw, depth = "", [], "", 0
    link = linked = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                blocks.append((len(tokens), "/".join([x[1] for x in stack] + [leaf]), text, min(linked, len(text))))
                tokens.append("#")
        linked = 0

    for tag, ends, attrs, text in tags_and_texts(page):
        if not tag:
            if not raw:
                text = html.unescape(text) if "&" in text else text
                buf.append(text)
                if link:
                    linked += len(text.strip())
            continue
        if raw:
            if tag == raw:
                depth += -1 if ends else not attrs.rstrip().endswith("/")
                raw = raw if depth else ""
            continue
        if tag in _RAW:
            if not ends and not attrs.rstrip().endswith("/"):
                raw, depth = tag, 1
            continue
        if tag == "a":
            link = not ends
        elif tag == "br":
            buf.append(" ")
        elif tag in _CONTAINER or tag in _LEAF:
            flush()
            if ends:
                leaf = ""
                if tag in _CONTAINER:  # ends of leaves are often left out in pages, so they are no tokens
                    if any(x[0] == tag for x in stack):
                        while stack.pop()[0] != tag:
                            pass
                    tokens.append("/" + tag)
            else:
                mark, drop = _kind(tag, attrs)
                if drop and tag == "header" and any(m.split(".")[0] in ("article", "main") for _, m in stack):
                    drop = _kind("div", attrs)[1]  # an article's own header holds its title and lead
                mark = ("!" if drop else "") + mark
                tokens.append(mark)
                if tag in _CONTAINER:
                    leaf = ""
                    if tag not in _VOID:
                        stack.append((tag, mark))
                else:
                    leaf = mark
    flush()
    return tokens, blocks


def text_name(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def with_constants(tokens: list[str], blocks: list[tuple[int, str, str, int]], constants: frozenset[int]) -> list[str]:
    """``tokens`` with ``=name`` for ``#`` where the text is one of the host's constants."""
    if constants:
        tokens = tokens.copy()
        for at, _, text, _ in blocks:
            if (name := text_name(text)) in constants:
                tokens[at] = f"={name}"
    return tokens


# -- wrappers: nested tuples ("t", token), ("?", nodes), ("+", nodes) -------------


def fold(nodes: list) -> list:
    """Adjacent repeats of up to ``PERIOD`` nodes become repeated groups, shortest period first."""
    for p in range(1, PERIOD + 1):
        out, i, n = [], 0, len(nodes)
        while i < n:
            group = nodes[i : i + p]
            if len(group) == p and p == 1 and group[0][0] == "+" and out and out[-1] == group[0]:
                i += 1
                continue
            if len(group) == p and out[-1:] == [("+", tuple(group))]:  # one more of the group before
                i += p
                continue
            j = i + p
            while nodes[j : j + p] == group and len(group) == p and not (p == 1 and group[0][0] == "+"):
                j += p
            if j > i + p:
                out.append(("+", tuple(group)))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _squares(nodes: list, other: list) -> list:
    """``nodes`` with single copies of the groups that ``other`` repeats turned into such groups."""
    for group in sorted({inside for kinds, inside in map(_core, other) if "+" in kinds}, key=len, reverse=True):
        out, i, k = [], 0, len(group)
        while i < len(nodes):
            if tuple(nodes[i : i + k]) == group:
                out.append(("+", group))
                i += k
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """Wrapper that matches whatever ``a`` or ``b`` match.

    A longest common subsequence of nodes keeps its place; what lies between two matches on one side only becomes
    optional, on both sides each an optional group. A group matches the same
    group once; the result repeats. Texts match each other; different ones
    make a slot.
    """
    if a == b:
        return a
    a, b = _squares(a, b), _squares(b, a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out, i, j = [], 0, 0
    only: list[list] = [[], []]

    def optional() -> None:
        for side in only:
            if side:
                out.append(side[0] if len(side) == 1 and side[0][0] == "?" else ("?", tuple(side)))
                side.clear()

    for k, m in _common([_key(v) for v in x], [_key(v) for v in y]):
        only[0] += x[i:k]
        only[1] += y[j:m]
        optional()
        out.append(_both(x[k], y[m]))
        i, j = k + 1, m + 1
    only[0] += x[i:]
    only[1] += y[j:]
    optional()
    return fold(a[:lo] + out + a[len(a) - hi :])


def _common(x: list, y: list) -> Iterator[tuple[int, int]]:
    """Index pairs of a longest common subsequence of any two lists.

    Row i of the table of suffixes has one bit for each place j of ``y``, from
    its end on: 0 where the suffixes from (i, j) share one item more than those
    from (i, j + 1). A row follows from the next one by a few operations on
    whole numbers. One row in ``step`` is kept, those between are made again.
    """
    n, m = len(x), len(y)
    step, full = isqrt(n) + 1, (1 << m) - 1
    places: dict = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << (m - 1 - j)

    def before(row: int, i: int) -> int:
        met = row & places.get(x[i], 0)
        return ((row + met) | (row - met)) & full

    row, kept = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def shared(i: int, j: int) -> int:
        if i not in rows:
            rows.clear()
            end = min(n, (i // step + 1) * step)
            rows[end] = kept[end]
            for k in range(end - 1, i - 1, -1):
                rows[k] = before(rows[k + 1], k)
        return m - j - (rows[i] & ((1 << (m - j)) - 1)).bit_count()

    i = j = 0
    here = shared(0, 0)
    while i < n and j < m and here:
        if x[i] == y[j]:
            yield i, j
            i, j, here = i + 1, j + 1, here - 1
        elif shared(i + 1, j) == here:
            i += 1
        else:
            j += 1


def _core(node: tuple) -> tuple[set[str], tuple]:
    """Kinds of the groups around a node, and what they hold."""
    kinds = set()
    while node[0] != "t":
        kinds.add(node[0])
        if len(node[1]) > 1 or node[1][0][0] == "t":
            return kinds, node[1]
        node = node[1][0]
    return kinds, (node,)


def _key(node: tuple) -> tuple:
    """What two nodes must share to match: what their groups hold, texts as slots."""
    return tuple(("t", "#" if v[1][0] in "#=" else v[1]) if v[0] == "t" else (v[0], _key(v)) for v in _core(node)[1])


def _both(a: tuple, b: tuple) -> tuple:
    """Of two nodes with the same inside, what allows both; a slot where their texts differ."""
    if a == b:
        return a
    if a[0] == b[0] == "t":
        return ("t", "#")
    (ka, ia), (kb, ib) = _core(a), _core(b)
    out = tuple(_both(v, w) for v, w in zip(ia, ib, strict=True))
    for kind in "+?":
        if kind in ka | kb:
            out = ((kind, out),)
    return out[0]


def expression(nodes: list | tuple) -> str:
    """The wrapper as a regular expression over tokens."""
    return " ".join(n[1] if n[0] == "t" else f"({expression(n[1])}){n[0]}" for n in nodes)


class Automaton:
    """A wrapper as an automaton whose states are its tokens."""

    def __init__(self, nodes: list) -> None:
        self.labels, self.follow = [""], [{}]
        self._build(nodes, [0])

    def _build(self, nodes: list | tuple, prev: list[int]) -> list[int]:
        """Append ``nodes`` behind the states ``prev``; returns the states that may be last."""
        for kind, inside in nodes:
            if kind == "t":
                state = len(self.labels)
                self.labels.append(inside)
                self.follow.append({})
                for p in prev:
                    self.follow[p].setdefault(inside, []).append(state)
                prev = [state]
            else:
                begin = len(self.labels)
                last = self._build(inside, prev)
                if kind == "+":
                    for states in list(self.follow[prev[0]].values()):
                        for q in states:
                            if q >= begin:
                                for p in last:
                                    own = self.follow[p].setdefault(self.labels[q], [])
                                    if q not in own:
                                        own.append(q)
                    prev = last
                else:
                    prev = [*prev, *(p for p in last if p not in prev)]
        return prev

    def match(self, tokens: list[str]) -> list[str | None]:
        """The wrapper's token that each of ``tokens`` meets, None for those the wrapper doesn't foresee."""
        out: list[str | None] = [None] * len(tokens)
        pending: list[tuple[int, dict[int, int]]] = []
        active: list[int] | dict[int, int] = [0]

        def settle() -> None:
            q = next(iter(active))
            for j, came in reversed(pending):
                out[j] = self.labels[q]
                q = came[q]
            pending.clear()

        for i, t in enumerate(tokens):
            found: dict[int, int] = {}
            for p in active:
                for label in (t, "#") if t[0] == "=" else (t,):  # a slot takes any text
                    for q in self.follow[p].get(label, ()):
                        found.setdefault(q, p)
            if found:
                active = found
                pending.append((i, found))
                if len(found) == 1:
                    settle()
        if pending:
            settle()
        return out


# -- fields: {field: [texts, characters, characters within links]} ----------------


def content_root(fields: dict[str, list[int]]) -> str:
    """Where a host's content is: ``article``, ``main``, a container's chain behind ``=``, or nothing if there is no text."""
    live = {k: v for k, v in fields.items() if "!" not in k}
    for mark in ("article", "main"):
        if any(_has(k, mark) for k in live):
            return mark
    weight: dict[str, int] = {}
    for k, v in live.items():
        parent = k.rpartition("/")[0]
        weight[parent] = weight.get(parent, 0) + v[1] - v[2]
    return "=" + max(sorted(weight), key=weight.get) if weight else ""


def linked_lists(fields: dict[str, list[int]]) -> list[str]:
    """Fields of list items that are links nearly throughout: menus."""
    return sorted(k for k, v in fields.items() if k.rpartition("/")[2].split(".")[0] in ("li", "dd", "dt", "td") and 100 * v[2] >= LINKED * v[1])


def _has(field: str, mark: str) -> bool:
    return any(x == mark or x.startswith(mark + ".") for x in field.split("/"))


def _within(field: str, root: str) -> bool:
    return _has(field, root) if root in ("article", "main") else (field + "/").startswith(root[1:] + "/")


class Extractor:
    """What a host's wrapper and rule take out of a page."""

    def __init__(self, rule: dict) -> None:
        self.root, self.menus, self.constants = rule["root"], frozenset(rule["menus"]), frozenset(rule["constants"])
        self.automaton = Automaton(_nodes(rule["wrapper"]))
        self.known: dict[str, list[str | None]] = {}

    def __call__(self, page: str) -> str:
        """Blocks that meet slots of the wrapper within the root, joined by line feeds; a page without the root gives all its slots outside boilerplate."""
        tokens, blocks = parse(page)
        tokens = with_constants(tokens, blocks, self.constants)
        stream = " ".join(tokens)
        met = self.known.get(stream)
        if met is None:
            met = self.automaton.match(tokens)
            if len(stream) < 10_000 and len(self.known) < 10_000:
                self.known[stream] = met
        live = [(k, t) for at, k, t, _ in blocks if "!" not in k and (k not in self.menus or self._in_article(k)) and (met[at] or tokens[at])[0] == "#"]
        if self.root and any(_within(k, self.root) for k, _ in live):
            live = [(k, t) for k, t in live if _within(k, self.root)]
        return "\n".join(t for _, t in live)

    def _in_article(self, field: str) -> bool:
        """Lists of links within an article are its references."""
        return self.root in ("article", "main") and _has(field, self.root)


# -- jobs ----------------------------------------------------------------------


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, name of the page's texts, names of its distinct texts outside boilerplate)."""
    for batch in batches:
        names, texts = [], []
        for page in batch.column("html"):
            blocks = parse(page.as_py())[1]
            texts.append(sorted({text_name(t) for _, k, t, _ in blocks if "!" not in k}))
            names.append(text_name("\n".join(t for _, k, t, _ in blocks if "!" not in k)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(names, pa.int64()), pa.array(texts, pa.list_(pa.int64()))], ["host", "page", "texts"])


def host_constants(pages: DataFrame) -> DataFrame:
    """(host, constants): texts on nearly all different pages of a host; hosts without any have no row. ``pages`` has host and html, not null."""
    different = materialize(pages.select("host", "html").mapInArrow(_page_texts, "host string, page long, texts array<long>").groupBy("host", "page").agg(F.first("texts").alias("texts")))
    totals = different.groupBy(F.col("host").alias("t_host")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= CONSTANT_PAGES)
    counts = different.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).filter(F.col("n") * 100 >= CONSTANT_SHARE * CONSTANT_PAGES)
    frequent = counts.join(totals, F.col("host") == F.col("t_host")).filter(F.col("n") * 100 >= CONSTANT_SHARE * F.col("pages"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants"))  # at most a page's texts


def _beside(pages: DataFrame, table: DataFrame, size: str) -> DataFrame:
    """``pages`` with their host's row of ``table`` (columns renamed ``b_...``); ``size`` gives a row's bytes."""
    table = table.select(*(F.col(c).alias(f"b_{c}") for c in table.columns))
    if (table.agg(F.sum(F.expr(size) + F.octet_length("b_host") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return pages.join(table, F.col("host") == F.col("b_host"), "left").drop("b_host")


_STREAM = "host string, stream string, field string, n long, chars long, linked long"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of folded streams (``field`` null) and of fields (``stream`` null), counted within a batch."""
    for batch in batches:
        streams: dict[tuple[str, str], int] = {}
        fields: dict[tuple[str, str], list[int]] = {}
        folded: dict[str, str] = {}
        for host, page, constants in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("b_constants").to_pylist(), strict=True):
            tokens, blocks = parse(page.as_py())
            tokens = with_constants(tokens, blocks, frozenset(constants or ()))
            plain = " ".join(tokens)
            if plain not in folded:
                folded[plain] = json.dumps(fold([("t", t) for t in tokens]))
            streams[host, folded[plain]] = streams.get((host, folded[plain]), 0) + 1
            for at, field, text, linked in blocks:
                if tokens[at] == "#":
                    got = fields.setdefault((host, field), [0, 0, 0])
                    got[0] += 1
                    got[1] += len(text)
                    got[2] += linked
        rows = [(h, s, None, n, 0, 0) for (h, s), n in streams.items()] + [(h, None, f, *v) for (h, f), v in fields.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "stream", "field", "n", "chars", "linked"])


def _nodes(value: list) -> list:
    return [(k, v if k == "t" else tuple(_nodes(v))) for k, v in value]


_WRAPPER = "host string, part long, stream string, n long"


def _infer(table: pa.Table) -> pa.Table:
    """One wrapper of all streams of the group, most frequent first."""
    rows = sorted(zip(table.column("n").to_pylist(), table.column("stream").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    wrapper = _nodes(json.loads(rows[0][1]))
    for _, stream in rows[1:]:
        wrapper = align(wrapper, _nodes(json.loads(stream)))
    return pa.table({"host": table.column("host")[:1], "part": table.column("part")[:1], "stream": pa.array([json.dumps(wrapper)], pa.string()), "n": pa.array([sum(r[0] for r in rows)], pa.int64())})


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host with a text: ``host``, ``pages``, ``wrapper`` (regular expression over tokens) and ``rule`` (JSON: wrapper, root, menus, constants)."""
    plain = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).filter("html <> ''")
    return _wrappers(plain)


def _wrappers(plain: DataFrame) -> DataFrame:
    constants = materialize(host_constants(plain))
    found = materialize(_beside(plain, constants, "8 * size(b_constants)").select("host", "html", "b_constants").mapInArrow(_streams, _STREAM))
    streams = materialize(found.filter("stream IS NOT NULL").groupBy("host", "stream").agg(F.sum("n").alias("n")))
    most = streams.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    level = streams
    while True:  # groups of about ``GROUP`` streams, then of their wrappers, and so on
        parts = -(-most // GROUP)
        level = level.withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(parts))).select("host", "part", "stream", "n").groupBy("host", "part").applyInArrow(_infer, _WRAPPER)
        if parts <= 1:
            break
        most = parts
    per = found.filter("field IS NOT NULL").groupBy("host", "field").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked")))
    fields = per.groupBy("host").agg(F.collect_list(F.struct("field", "n", "chars", "linked")).alias("fields"))
    fields, constants = (t.withColumnRenamed("host", h) for t, h in ((fields, "f_host"), (constants, "c_host")))
    whole = level.join(fields, F.col("host") == F.col("f_host"), "left").join(constants, F.col("host") == F.col("c_host"), "left").select("host", "n", "stream", "fields", "constants")

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrappers, out = [], []
            for stream, rows, names in zip(*(b.column(c).to_pylist() for c in ("stream", "fields", "constants")), strict=True):
                fields = {r["field"]: [r["n"], r["chars"], r["linked"]] for r in rows or ()}
                nodes = json.loads(stream)
                wrappers.append(expression(_nodes(nodes)))
                out.append(json.dumps({"wrapper": nodes, "root": content_root(fields), "menus": linked_lists(fields), "constants": names or []}))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("n"), pa.array(wrappers, pa.string()), pa.array(out, pa.string())], ["host", "pages", "wrapper", "rule"])

    return whole.mapInArrow(rules, "host string, pages long, wrapper string, rule string")


@lru_cache(64)
def _extractor(rule: str) -> Extractor:
    return Extractor(json.loads(rule))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = batch.column("b_rule").to_pylist()
        out = [""] * len(rules)
        for i in sorted(range(len(rules)), key=lambda i: rules[i] or ""):  # host by host, so that few wrappers are open at once
            page = batch.column("html")[i].as_py()
            if page and rules[i]:
                out[i] = _extractor(rules[i])(page)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text`` (main text, empty if none) and ``n_chars`` (its code points).

    A null or empty page has an empty text. Pages without a host, url null
    included, share the host of the empty string. Repeated rows each give a
    row, and count once when a host's constants are sought. Very long pages
    and unclosed tags, quotes and scripts take time in proportion to their
    length. Other columns are not used. An empty table gives an empty result.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    rules = materialize(_wrappers(plain.select("host", "html").filter("html <> ''")).select("host", "rule"))
    joined = _beside(plain, rules, "octet_length(b_rule)")
    return joined.select("page_id", "url", "html", "b_rule").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
