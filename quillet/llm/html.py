"""Main text of web pages by union-free regular-expression inference.

A page is a token stream of tags and texts. Neighbouring runs that repeat fold into repeated groups, which makes
a page a union-free expression; expressions of one host are aligned token by token, pair by pair: what matches is
merged, what only one of them has becomes optional, what repeats on one side becomes repeated, and texts become
slots that remember whether they vary. The wrapper a host ends with says which parts are template and which hold
its articles; each page is then read through it.

Every page takes part. Pages are aligned within the task that reads them, so a host that holds a third of all
pages sends one wrapper a task to the shuffle, where wrappers are aligned in salted groups, then by host.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, slices, table

# HTML's own element kinds.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript".split())
MATH = set("math maction maligngroup malignmark menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= MATH
#: Left out with what stands in them, up to their end tag or where their parent closes. Those of ONCE don't nest.
MUTE = set("annotation annotation-xml audio button canvas object select svg template video".split())
ONCE = set("audio button canvas select video".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
BLOCKS = CLOSES_P | set(CLOSES) - {"option"} | {"body"}
CELLS = {"td", "th"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("div section td tr tbody table ul ol li center span dl fieldset".split())
NOT_MAIN = set("nav footer aside form dialog menu search figure#ad".split())
AGAINST = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|menus|sidebar|side|aside|rail|footer|foot|masthead|topbar|banner|ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|share|sharing|social|related|recommended|recommendations|trending|popular|comment|comments|commentlist|reply|replies|respond|responses|disqus|discussion|breadcrumb|breadcrumbs|pagination|pager|widget|widgets|toolbar|login|search|searchbox|skip|hidden|copyright|legal|tags|tagcloud|byline-links)(?:$|[^a-z])", re.I)
HEADER = re.compile(r"(?:^|[^a-z])(?:header|head|hero|brand|logo)(?:$|[^a-z])", re.I)
FOR = re.compile(r"(?:^|[^a-z])(?:article|articlebody|main|content|contents|post|entry|story|body|text|page-content)(?:$|[^a-z])", re.I)

# What no claimed article is looked for below, words that make an article or main one of others' making, and classes that tell a layout or a state.
SHUT = NOT_MAIN - {"form"}
OTHERS = re.compile(r"(?:^|[^a-z])(?:comment(?!ar)|reply|replies|respond|responses?(?:$|[^a-z])|related|sponsor|ads?(?:$|[^a-z]))", re.I)
LAYOUT = re.compile(r"(?:^|(?<= ))(?:(?:has|with|no|without)[-_][^ ]*|(?:category|tag)[-_](?!cloud|list)[^ ]*|[^ ]*[-_](?:open|opened|closed|enabled|disabled))(?= |$)", re.I)

_opens = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_plain = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_stop = re.compile(r"[>\"']")
#: Elements nested deeper than this become siblings, as in browsers; their text stays where it is.
DEEPEST = 200
#: So often an embedded element that nothing closes is read again from its first block on; later ones end there at once.
REREAD = 8
#: Lists of tokens with up to so many pairs are aligned by their longest common subsequence.
MOST_CELLS = 1 << 20
_end_of_xmp = re.compile(r"</xmp(?=[\s/>])", re.I)
_attribute = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_digits = re.compile(r"\d+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_invisible = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "hints", "kids", "sig")

    def __init__(self, tag: str, hints: str = ""):
        self.tag, self.hints, self.kids, self.sig = tag, hints, [], ""


class Tokens:
    """The tags of a page, found in time that is linear in its length, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.none = {'"': len(page) + 1, "'": len(page) + 1}  # from where on there is no such quote

    def _end(self, at: int) -> int:
        """The place of the '>' that ends the tag whose name ends at `at`; one in quotes counts only where quotes don't close."""
        page, k = self.page, at
        while self.quotes:
            m = _stop.search(page, k)
            if m is None:
                self.quotes = False  # the quotes of this page don't match: '>' alone decides from here on
            elif m[0] == ">":
                return m.start()
            else:
                k = page.find(m[0], m.end()) + 1 if m.end() < self.none[m[0]] else 0
                if not k:
                    self.none[m[0]] = min(self.none[m[0]], m.end())
                    break
        return page.find(">", at)

    def search(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The first tag, comment or declaration from `at` on: start, end, whether it is an end tag, name ('' without one), attributes."""
        page = self.page
        while m := _opens.search(page, at):
            if m[2] and (tag := _plain.match(page, m.start())):
                return m.start(), tag.end(), bool(m[1]), tag[2].lower(), tag[3]
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(page), False, "", ""
            if m.end() > self.last:
                return None
            end = self._end(m.end()) if m[2] else page.find(">", m.end())
            if end >= 0:
                return m.start(), end + 1, bool(m[1]), (m[2] or "").lower(), page[m.end() : end] if m[2] else ""
            at = m.end()
        return None


def _hints(attributes: str) -> str:
    """Classes, ids and roles, without digits; '!' for what isn't shown."""
    if not attributes or attributes.isspace():
        return ""
    out = []
    for name, a, b, c in _attribute.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _invisible.search(value):
            out.append("!")
        elif name in ("class", "id", "role", "itemprop"):
            out.append(_digits.sub("0", _camel.sub("-", value)).lower())
    return " ".join(" ".join(out).split())


def parse(page: str) -> Node:
    """The page's blocks as a tree: elements, and [text, characters inside links] between them. Inline tags leave no trace.

    Formulas are text like others. Of a button, menu of choices, player, canvas or object without an end tag, only
    what stands before the first block goes.
    """
    root = Node("#root")
    stack, parts, linked, anchor, at = [root], [], 0, 0, 0
    mute: list[str] = []  # the open elements from one of MUTE on
    block = None  # where the first block in it starts
    tokens, reread = Tokens(page), 0

    def flush():
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                stack[-1].kids.append([text, min(linked, len(text))])
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if anchor:
            linked += len(raw)

    while True:
        m = tokens.search(at)
        if m is None and mute and block is not None:
            at, mute, reread = block, [], reread + 1
            continue
        if m is None:
            if not mute:
                add(page[at:])
            break
        start, end, closing, name, attributes = m
        if start > at and not mute:
            add(page[at:start])
        at = end
        closed = attributes.endswith("/") or not attributes and page.endswith("/>", start, end)
        if not name:
            continue
        if mute:
            if closing:
                if name in mute:
                    del mute[len(mute) - 1 - mute[::-1].index(name) :]
                    continue
                if name in ("math", "semantics") and mute[0].startswith("annotation"):
                    mute = []
                    continue
                if name in INLINE or not any(n.tag == name for n in stack):
                    continue
                mute = []
                if block is not None:
                    at, reread = block, reread + 1
                    continue
            elif name in VOID or name in INLINE or closed and "svg" in mute:
                continue
            elif name in BLOCKS and mute[0] == "svg" and "foreignobject" not in mute:
                mute = []
            elif name == mute[0] and name in ONCE:
                at, mute, reread = (at, [name], reread) if block is None else (block, [], reread + 1)
                continue
            elif name in BLOCKS and reread >= REREAD:
                mute = []
            elif name not in RAW:
                if block is None and name in BLOCKS and mute[0] != "template":
                    block = start
                mute.append(name)
                continue
        if closing:
            if name in INLINE:
                anchor = max(0, anchor - (name == "a"))
            elif name == "p" or name not in VOID:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        del stack[k:]
                        break
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            parts.append(" ")
            continue
        if name in MUTE:
            if not (name == "svg" and closed):
                mute, block = [name], None
            parts.append(" ")
            continue
        if name in INLINE:
            anchor += name == "a"
            if name in ("mtr", "mtd"):
                parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        flush()
        anchor = 0
        if name in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if name in CLOSES:
            own, bounds = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in own:
                    del stack[k:]
                    break
        node = Node(name, _hints(attributes))
        stack[-1].kids.append(node)
        if len(stack) <= DEEPEST:
            stack.append(node)
        if name == "xmp":  # raw text that is shown
            end = _end_of_xmp.search(page, at)
            parts.append(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    flush()
    _sign(root)
    return root


def _sign(root: Node) -> None:
    """Tokens by which elements are told apart: tag and hints, and for plain containers also what stands in them."""
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        node.sig = f"{node.tag}.{node.hints}" if node.hints else node.tag
        if not node.hints and node.tag in CONTAINERS:
            node.sig += "{" + ",".join(sorted({k.sig.split("{")[0] if isinstance(k, Node) else "#" for k in node.kids})) + "}"


# An expression is a list of items. An item is a dict: s (token, '#' for a text slot), o (optional), r (repeated), n (pages that
# have it), c (its expression); a slot also has x (characters), l (of them in links), k (the texts that all its pages have: their
# lengths by digest) and v (whether its pages have others too).


def _digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "replace"))


def expression(node: Node) -> list[dict]:
    """The union-free expression of one page's children."""
    items: list[dict] = []
    for kid in node.kids:
        if isinstance(kid, Node):
            item = {"s": kid.sig, "o": 0, "r": 0, "n": 1, "c": expression(kid)}
        else:
            item = {"s": "#", "o": 0, "r": 0, "n": 1, "c": [], "x": len(kid[0]), "l": kid[1], "k": {_digest(kid[0]): len(kid[0])}, "v": 0}
        items.append(item)
    return fold(items)


def _shape(item: dict) -> str:
    return item["s"]


def fold(items: list[dict], longest: int = 4) -> list[dict]:
    """Neighbouring repetitions of up to `longest` items become one repeated group (a single item: a repeated item)."""
    width = 1
    while width <= min(longest, len(items) // 2):
        out, i, folded = [], 0, False
        while i < len(items):
            group = items[i : i + width]
            key = [_shape(x) for x in group]
            j = i + width
            while len(group) == width and [_shape(x) for x in items[j : j + width]] == key:
                group = [merge_item(a, b, same_page=True) for a, b in zip(group, items[j : j + width], strict=True)]
                j += width
            if j > i + width:
                folded = True
                if width == 1:
                    out.append(group[0] | {"r": 1})
                else:
                    out.append({"s": "(" + " ".join(key) + ")", "o": 0, "r": 1, "n": max(x["n"] for x in group), "c": group})
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
        width = 1 if folded and width > 1 else width + 1
    return items


def merge_item(a: dict, b: dict, same_page: bool = False) -> dict:
    out = {"s": a["s"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "n": max(a["n"], b["n"]) if same_page else a["n"] + b["n"], "c": a["c"] if not b["c"] else b["c"] if not a["c"] else align(a["c"], b["c"], same_page)}
    if not same_page and bool(a["c"]) != bool(b["c"]):
        out["c"] = [x | {"o": 1} for x in out["c"]]
    if "x" in a:
        if same_page:
            a["k"].update(b["k"])  # of the page's own expression
        k = a["k"] if same_page else {d: n for d, n in a["k"].items() if d in b["k"]}
        out |= {"x": a["x"] + b["x"], "l": a["l"] + b["l"], "k": k, "v": a["v"] | b["v"] | int(not same_page and a["k"].keys() != b["k"].keys())}
    return out


def _matches(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Places of tokens in a common subsequence: the longest one, or of very long lists the longest of tokens that each has once."""
    n, m = len(a), len(b)
    if n * m > MOST_CELLS:
        once = [{s: k for s, (k, c) in _places(x).items() if c == 1} for x in (a, b)]
        pairs = sorted((k, once[1][s]) for s, k in once[0].items() if s in once[1])
        ends: list[int] = []  # of increasing runs, by length
        chain: list[tuple] = []
        last: list[tuple] = []
        for i, j in pairs:
            k = bisect.bisect_left(ends, j)
            link = (i, j, last[k - 1] if k else None)
            ends[k : k + 1], last[k : k + 1] = [j], [link]
        link = last[-1] if last else None
        while link:
            chain.append(link[:2])
            link = link[2]
        return chain[::-1]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for x in range(n - 1, -1, -1):
        for y in range(m - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if a[x]["s"] == b[y]["s"] else max(best[x + 1][y], best[x][y + 1])
    out, x, y = [], 0, 0
    while x < n and y < m:
        if a[x]["s"] == b[y]["s"]:
            out.append((x, y))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _places(items: list[dict]) -> dict[str, tuple[int, int]]:
    """Each token's last place and how often it occurs."""
    out: dict[str, tuple[int, int]] = {}
    for k, i in enumerate(items):
        out[i["s"]] = (k, out.get(i["s"], (0, 0))[1] + 1)
    return out


def align(a: list[dict], b: list[dict], same_page: bool = False) -> list[dict]:
    """The expression of what a and b stand for: matched tokens merge, others become optional; then repetitions fold again."""
    out, i = [], 0
    while i < len(a) and i < len(b) and a[i]["s"] == b[i]["s"]:
        out.append(merge_item(a[i], b[i], same_page))
        i += 1
    a, b = a[i:], b[i:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail]["s"] == b[-1 - tail]["s"]:
        tail += 1
    ends = [merge_item(x, y, same_page) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    x = y = 0
    for x1, y1 in [*_matches(a, b), (len(a), len(b))]:
        out += [k | {"o": 1} for k in a[x:x1]] + [k | {"o": 1} for k in b[y:y1]]
        if x1 < len(a):
            out.append(merge_item(a[x1], b[y1], same_page))
        x, y = x1 + 1, y1 + 1
    return fold(out + ends) if a or b else out + ends


def text_of(items: list[dict]) -> tuple[int, int]:
    """Characters below, and of them in links."""
    x = l = 0
    for item in items:
        a, b = (item["x"], item["l"]) if "x" in item else text_of(item["c"])
        x, l = x + a, l + b
    return x, l


def _text_of(node: Node) -> tuple[int, int]:
    """The same of a page's element."""
    x = l = 0
    for kid in node.kids:
        a, b = _text_of(kid) if isinstance(kid, Node) else (len(kid[0]), kid[1])
        x, l = x + a, l + b
    return x, l


def show(items: list[dict]) -> str:
    """The wrapper as a regular expression over tokens."""
    out = []
    for i in items:
        own = ("#text" if i["v"] or i["r"] else "#same") if i["s"] == "#" else "(" + show(i["c"]) + ")" if i["s"].startswith("(") else f"<{i['s'].split('{')[0]}>" + show(i["c"]) + "</>"
        mark = ")*" if i["o"] and i["r"] else ")+" if i["r"] else ")?" if i["o"] else ""
        out.append(f"({own}{mark}" if mark else own)
    return " ".join(out)


# Labels: a host's wrapper says for every element whether it holds main text.


def _split(sig: str) -> tuple[str, str]:
    tag, _, hints = sig.split("{")[0].partition(".")
    return tag, hints


def _hidden(hints: str) -> bool:
    return hints.startswith("!") or " !" in hints


def _shut(sig: str) -> bool:
    """Nothing below the element can be the main text."""
    tag, hints = _split(sig)
    return tag in SHUT or _hidden(hints) and tag not in ("body", "html")


def _template(sig: str, inside: bool) -> bool:
    """By its tag and hints the element isn't main text; inside: within an article."""
    tag, hints = _split(sig)
    if tag in ("body", "html"):
        return False
    if tag in NOT_MAIN or _hidden(hints):
        return True
    if tag == "header" and not inside:
        return True
    hints = LAYOUT.sub("", hints)
    if not hints or tag in ("article", "main") and not OTHERS.search(hints):
        return False
    if AGAINST.search(hints):
        return not (FOR.search(hints) and not OTHERS.search(hints) and not re.search(r"nav|menu|sidebar|advert|footer|share|cookie|notice", hints))
    return bool(HEADER.search(hints)) and not inside


def _is_main(sig: str) -> int:
    """How openly the element claims to be the main text: 3 article, 2 main, 1 by its class or id."""
    tag, hints = _split(sig)
    if tag == "article" or "articlebody" in hints.replace("-", ""):
        return 3
    if tag == "main" or hints == "main" or re.search(r"(?:^| )main(?:$| )", hints):
        return 2
    return 1 if tag in ("div", "section", "td") and FOR.search(hints) else 0


def label(items: list[dict]) -> dict:
    """The wrapper's labels as a nested map: token -> [keep, labels below, most]. '#' is the element's own text, whose labels
    below are the texts that the host's pages share.

    Items of one parent and token share a label. Where the wrapper has a list of links among them, most is the share
    of links above which an element (or text) of a page goes; it is None elsewhere.
    """

    total = text_of(items)[0] or 1

    def template(i, inside):
        """A form that holds most of the text is a container like others."""
        tag, hints = _split(i["s"])
        if tag == "form" and text_of(i["c"])[0] > 0.5 * total:
            return _template("div." + hints, inside)
        return _template(i["s"], inside)

    def texts(i):
        """The element's own slots."""
        for k in i["c"]:
            if k["s"] == "#":
                yield k
            elif k["s"].startswith("("):
                yield from texts(k)

    def elements(expr, inside, path, behind):
        """Claim, path, item, and whether it stands below template."""
        for i in expr:
            if i["s"].startswith("("):
                yield from elements(i["c"], inside, path, behind)
            elif i["s"] != "#" and not _shut(i["s"]):
                here, off = path + (i["s"],), template(i, inside)
                claim = 0 if off else _is_main(i["s"])
                yield claim, here, i, behind or off
                yield from elements(i["c"], inside or claim >= 2, here, behind or off)

    found = list(elements(items, False, (), False))

    def claims(below, levels):
        for claim in levels:
            claimed = [(path, text_of(i["c"])[0]) for c, path, i, behind in found if c == claim and behind is below]
            paths = {p for p, _ in claimed}
            top = [(p, x) for p, x in claimed if not any(p[:k] in paths for k in range(1, len(p)))]
            if sum(x for _, x in top) >= (0.02 if claim > 1 else 0.25) * total:
                return top
        return []

    shown = claims(False, (3, 2, 1))
    under = [(p, x) for p, x in claims(True, (3, 2)) if not any(p[: len(q)] == q for q, _ in shown)]
    # Articles below template (lists of related ones, say) count where they hold more than all that would stay without them.
    plain = sum(x for _, x in shown) if shown else sum(k["x"] for i in [{"c": items}, *(i for _, _, i, behind in found if not behind)] for k in texts(i))
    roots = [p for p, _ in (shown + under if sum(x for _, x in under) > plain else shown)]

    def slots(expr):
        for i in expr:
            if i["s"] == "#":
                yield i
            else:
                yield from slots(i["c"])

    # Texts that nearly all of several pages have in the same place are template, also in an article, whose own texts vary. Pages
    # that share much of their articles are versions of one.
    pages = max((i["n"] for i in items), default=0)
    own = [k for c, path, i, _ in found if path in roots for k in slots(i["c"])]
    shares = lambda i: i["n"] >= max(4, 0.8 * pages)
    versions = sum(sum(i["k"].values()) for i in own if shares(i)) > 0.2 * sum(i["x"] for i in own) / max(1, pages)

    def shared(i, inside, tag):
        if not roots:
            return i["k"] if i["n"] >= 3 and not i["v"] else {}
        return {d: n for d, n in i["k"].items() if n >= 25} if inside and not versions and shares(i) and tag not in HEADINGS else {}

    def walk(expr, path, inside, out):
        for i in expr:
            sig = i["s"]
            if sig.startswith("("):
                walk(i["c"], path, inside, out)
                continue
            if sig == "#":
                menu = not roots and i["x"] and i["l"] > 0.6 * i["x"]
                keep = bool(inside or not roots)
                entry = out.setdefault("#", [keep, {}, 0.6 if keep and menu else None])
                if keep and not menu:
                    entry[0], entry[2] = True, None
                entry[1].update(shared(i, inside, _split(path[-1])[0] if path else ""))
                continue
            here = path + (sig,)
            leads = any(r[: len(here)] == here for r in roots)
            if template(i, inside) and not leads:
                out.setdefault(sig, [False, {}, None])
                continue
            now = inside or here in roots
            x, l = text_of(i["c"])
            tag = _split(sig)[0]
            most = 0.8 if now else 0.5
            entry = out.setdefault(sig, [True, {}, None])
            entry[0] = True
            if x and l > most * x and tag in ("ul", "ol", "table", "div", "section", "dl") and not leads:
                entry[2] = most
            walk(i["c"], here, now, entry[1])

    labels: dict = {}
    walk(items, (), False, labels)
    return labels


def main_text(root: Node, labels: dict | None = None) -> str:
    """The blocks that the labels keep, joined by two line ends. Elements the labels don't know are labelled by the page alone."""
    if labels is None:
        labels = label(expression(root))
    blocks: list[str] = []

    def walk(node: Node, known: dict, inside: bool):
        start, cells = len(blocks), []
        for kid in node.kids:
            at = len(blocks)
            if not isinstance(kid, Node):
                keep, template, most = known.get("#", (inside, {}, None))
                if keep and (most is None or kid[1] <= most * len(kid[0])) and not (template and _digest(kid[0]) in template):
                    blocks.append(kid[0])
                continue
            keep, below, most = known.get(kid.sig, (inside and not _template(kid.sig, True), {}, None))
            if keep and most is not None:
                x, l = _text_of(kid)
                keep = l <= most * x
            if keep:
                walk(kid, below, inside or _is_main(kid.sig) > 1)
            cells.append(len(blocks) - at if kid.tag in CELLS else 2)
        if node.tag == "tr" and len(cells) > 1 and max(cells) < 2:  # a row of plain cells is one block
            blocks[start:] = [" ".join(blocks[start:])] if blocks[start:] else []

    walk(root, labels, False)
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def induce(pages: DataFrame, salts: int = 32, hosts_at_once: int = 5000) -> DataFrame:
    """host, wrapper (an expression as JSON) from pages (url, html), over all of them."""
    prepare(pages.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, list] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([json.dumps(w) for w in wrappers.values()], pa.string())], ["host", "wrapper"])
            wrappers.clear()
            return batch

        for batch in slices(batches):
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    host, own = host_of(url), expression(parse(page))
                    wrappers[host] = align(wrappers[host], own) if host in wrappers else own
                    if len(wrappers) >= hosts_at_once:
                        yield out()
        yield out()

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *rest = sorted(pdf["wrapper"])
        if not rest:
            return pdf[["host", "wrapper"]]
        found = json.loads(first)
        for w in rest:
            found = align(found, json.loads(w))
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "wrapper": [json.dumps(found)]})

    partial = pages.select("url", "html").mapInArrow(local, "host string, wrapper string")
    salted = partial.withColumn("salt", F.spark_partition_id() % salts).groupBy("host", "salt").applyInPandas(together, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(together, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars, host of every page, from its whole html.

    A null or empty page, and one without main text, has an empty text; a page that has nothing where its host's
    wrapper looks for main text is labelled by itself. Pages without a usable url share the
    wrapper of the empty host. Repeated rows get equal results. Wrappers are broadcast up to broadcast_bytes in
    all and joined by host beyond that. Other columns are neither read nor returned.
    """
    wrappers = cut(induce(pages), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[str, dict] = {}
        for batch in slices(batches):
            ids, urls, pages_, hosts, wraps = (batch.column(i).to_pylist() for i in range(5))
            texts = []
            for page, name, wrap in zip(pages_, hosts, wraps, strict=True):
                if not page:
                    texts.append("")
                    continue
                if name not in labels:
                    if len(labels) > 2000:
                        labels.clear()
                    labels[name] = label(json.loads(wrap))
                tree = parse(page)
                texts.append(main_text(tree, labels[name]) or main_text(tree))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(hosts, pa.string())], ["page_id", "url", "text", "n_chars", "host"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", "html").withColumn("host", host("url"))
    joined = rows.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")
    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long, host string")


def op1_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLE = {}
