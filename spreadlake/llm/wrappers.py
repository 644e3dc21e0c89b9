"""HTML extraction by wrappers: union-free regular expressions over the token streams of a host.

A page is cut into tags and texts, and missing end tags are put in.  Tandem
repeats among the parts of an element become repeated groups, which leaves the
page's *skeleton*.  The skeletons of a host are aligned one after another: parts
that match are merged, parts that do not become optional, runs against single
parts become repeated, and differing texts leave text slots.  The result is one
expression that accepts every page of the host, with figures on each slot.

Wrappers merge like skeletons, so a host of any number of pages is aligned in
bounded groups and their results again; only one row per host and distinct
skeleton is ever shuffled.  Each page is then aligned with its host's wrapper,
which tells the slots of the article from those of the frame around it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlake.llm.common import fresh, staged

# --- tokens ---------------------------------------------------------------------------------------

#: Comments, declarations and tags; a quoted attribute may hold any character.  Unclosed ones run to the end.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TELLING = re.compile("class|id|role|itemprop|hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"[0-9]+")

# Element names of HTML by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
PHRASE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEAD_ONLY = set("base link meta script style title template noscript".split())
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
#: Never text of an article, and nothing inside them needs a structure of its own.
SEALED = set("head form button select datalist label input svg iframe object canvas audio video noscript template dialog map applet".split())
#: Never text of an article.
OUTER = SEALED | {"nav", "footer", "aside", "menu", "search"}

#: Words of class, id or role that mark a part of the frame; the second list also counts as beginnings of words.
FRAME = set("ad ads adsense adslot adbox promo promotion banner menu menubar nav navbar navigation related share sharing social consent gdpr notice notices notification alert popup modal overlay login signin signup search pager pagination toolbar topbar masthead header footer respond reply replies widget complementary contentinfo copyright discussion responses reactions".split())
FRAME_START = ("advert", "sponsor", "breadcrumb", "sidebar", "cookie", "newsletter", "subscri", "comment", "disqus", "recommend", "footer")
#: Words that mark the main part where a page has neither ``article`` nor ``main``.
MAIN = {"article", "articlebody", "post", "entry", "story", "content", "main", "maincontent"}

#: A repeated group has at most this many parts; longer lists of unlike parts become one repeated group of optional parts.
PERIOD, LONG, DEPTH = 8, 48, 60
#: Share of a host's free text that a part needs to be its main part where nothing names one.
MASS = 0.6


class Node:
    """A part of an expression: element, text slot (``#``), group (``()``) or group of optional parts (``(*)``)."""

    __slots__ = ("key", "opt", "rep", "kids", "stat", "into")

    def __init__(self, key: str, kids: list | None = None):
        self.key, self.kids = key, [] if kids is None else kids
        self.opt = self.rep = False
        self.stat: list | None = None  # chars, chars in links, least and greatest text hash, pages
        self.into: Node | None = None

    def found(self) -> "Node":
        node = self
        while node.into is not None:
            node = node.into
        return node


@lru_cache(maxsize=16_384)
def marks(attributes: str) -> tuple[str, bool]:
    """Class names and the words of class, id and role that say what an element is for; whether one of them frames it."""
    words, classes = set(), set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            words.add("hidden")
            continue
        for w in (w.lower() for w in WORD.findall(value)):
            if w in FRAME or w in MAIN or w.startswith(FRAME_START) and not w.startswith("commentar"):
                words.add(w)
        if name == "class":
            classes |= {DIGITS.sub("0", c.lower()) for c in value.split()}
    return "".join("." + c.replace("!", "") for c in sorted(classes)) + "".join("!" + w for w in sorted(words)), bool(words - MAIN)


def parse(html: str) -> tuple[Node, list[list[tuple[Node, str]]]]:
    """The tree of a page, and its blocks: pieces of text with the slot each came from."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    blocks: list[list[tuple[Node, str]]] = []
    block: list[tuple[Node, str]] = []
    sealed = links = 0  # size of the stack when a sealed element was opened, links that are open
    at, size, search = 0, len(html), TOKEN.search

    while at < size:
        m = search(html, at)
        start, end = m.span() if m else (size, size)
        close, name, attributes = (m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)) if m else ("", None, "")
        tag = name.lower() if name else ""
        br = tag == "br"
        if start > at or br:
            kids = stack[-1][1].kids
            if kids and kids[-1].key == "#":
                slot = kids[-1]
            else:
                slot = Node("#")
                slot.stat = [0, 0, 0, 0, 1]
                kids.append(slot)
            text = html[at:start] + " " if br else html[at:start]
            block.append((slot, text))
            held = len(text) - text.count(" ")
            slot.stat[0] += held
            if links:
                slot.stat[1] += held
        at = end
        if not tag or br:
            continue
        phrase = tag in PHRASE
        if not phrase and block:
            blocks.append(block)
            block = []
        if close:
            if tag == "a" and links:
                links -= 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag or tag in HEADING and stack[i][0] in HEADING:
                    del stack[i:]
                    break
                if phrase and stack[i][0] not in PHRASE:
                    break  # the end of a phrase closes nothing around it
            if sealed > len(stack):
                sealed = 0
            continue
        if tag in RAW:
            over = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = over.start() if over else size
            continue
        if tag in ("html", "body"):
            # the tags may be missing or repeated, so they open nothing; a body ends the head
            if tag == "body" and len(stack) > 1 and stack[1][0] == "head":
                del stack[1:]
                sealed = 0
            continue
        said, frames = marks(attributes) if attributes and TELLING.search(attributes) else ("", False)
        if phrase:
            if tag in VOID:
                continue
            links += tag == "a"
            if not frames and stack[-1][0] not in PHRASE:
                continue
        else:
            if stack[-1][0] == "head" and tag not in HEAD_ONLY or tag in HEADING and stack[-1][0] in HEADING:
                del stack[-1:]
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in ("td", "th", "caption", "button", "object"):
                        break
            elif tag in SIBLING:
                ends, scope = SIBLING[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
                        if tag not in ("tr", "tbody"):
                            break
            if sealed > len(stack):
                sealed = 0
            if tag in VOID:
                continue
        parent = stack[-1][1]
        if sealed or phrase and not frames or len(stack) > DEPTH and not frames and tag not in OUTER:
            stack.append((tag, parent))  # no structure of its own: its text is its parent's
            continue
        node = Node(tag + said)
        parent.kids.append(node)
        stack.append((tag, node))
        if tag in SEALED or len(stack) > DEPTH + 1:
            sealed = len(stack)
    if block:
        blocks.append(block)
    return root, blocks


# --- alignment ------------------------------------------------------------------------------------


def shape(node: Node) -> str:
    return node.key if node.key not in ("()", "(*)") else "(" + " ".join(shape(k) for k in node.kids) + ")"


def merge(a: Node, b: Node) -> Node:
    """``a`` made to accept all that ``b`` accepts."""
    b.into = a
    a.opt, a.rep = a.opt or b.opt, a.rep or b.rep
    if a.stat is not None:
        if b.stat is not None:
            a.stat = [a.stat[0] + b.stat[0], a.stat[1] + b.stat[1], min(a.stat[2], b.stat[2]), max(a.stat[3], b.stat[3]), a.stat[4] + b.stat[4]]
    elif len(a.kids) == 1 == len(b.kids) and a.kids[0].key == b.kids[0].key:
        merge(a.kids[0], b.kids[0])
    else:
        a.kids = align(a.kids, b.kids)
    return a


def folded(items: list[Node]) -> list[Node]:
    """Tandem repeats become repeated parts or groups; what stays long becomes a group of optional parts."""
    out: list[Node] = []
    for item in items:
        out.append(item)
        while len(out) > 1 and _square(out):
            pass
    return looped(out) if len(out) > LONG else out


def _square(out: list[Node]) -> bool:
    """Fold the end of ``out`` if it repeats what stands before it."""
    a, b = out[-2], out[-1]
    if a.key == b.key and b.key not in ("()", "(*)"):
        merge(a, b).rep = b.key != "#" or a.rep
        out.pop()
        return True
    if a.key == "()" and a.kids[-1].key == b.key:  # the run at a group's end goes on
        merge(a.kids[-1], b).rep = True
        out.pop()
        return True
    for k in range(2, min(PERIOD, len(out)) + 1):
        last = [n.key for n in out[-k:]]
        if "#" == last[0] and len(set(last)) == 1:
            continue
        before = out[-k - 1] if len(out) > k else None
        if before is not None and before.key == "()" and [n.key for n in before.kids] == last:
            for x, y in zip(before.kids, out[-k:]):
                merge(x, y)
            del out[-k:]
            return True
        if len(out) >= 2 * k and [n.key for n in out[-2 * k : -k]] == last:
            group = Node("()", out[-2 * k : -k])
            group.rep = True
            for x, y in zip(group.kids, out[-k:]):
                merge(x, y)
            del out[-2 * k :]
            out.append(group)
            return True
    return False


def looped(items: list[Node]) -> list[Node]:
    """One repeated group of all unlike parts, each optional: it accepts any order of them."""
    kids: dict[str, Node] = {}
    todo = list(reversed(items))
    many = len({n.key for n in items}) > LONG
    while todo:
        n = todo.pop()
        if n.key in ("()", "(*)"):
            todo.extend(reversed(n.kids))
            continue
        if many and n.key != "#":  # too many class names to tell apart: the marks stay
            n.key = n.key.split(".")[0].split("!")[0] + "".join("!" + w for w in n.key.split("!")[1:])
        n.opt = True
        if n.key in kids:
            merge(kids[n.key], n)
        else:
            kids[n.key] = n
    group = Node("(*)", list(kids.values()))
    group.opt = group.rep = True
    return [group]


def _grouped(items: list[Node], groups: list[Node]) -> list[Node]:
    """``items`` with a run that reads like one of ``groups`` put into a group."""
    for g in groups:
        keys = [k.key for k in g.kids]
        i = 0
        while i + len(keys) <= len(items):
            if [n.key for n in items[i : i + len(keys)]] == keys:
                items = items[:i] + [Node("()", items[i : i + len(keys)])] + items[i + len(keys) :]
            i += 1
    return items


def align(xs: list[Node], ys: list[Node]) -> list[Node]:
    """The parts of both, in order: matches merged, the rest optional."""
    if len(xs) == 1 and xs[0].key == "(*)" or len(ys) == 1 and ys[0].key == "(*)":
        return looped(xs + ys)
    xs, ys = _grouped(xs, [y for y in ys if y.key == "()"]), _grouped(ys, [x for x in xs if x.key == "()"])
    a, b = [shape(x) for x in xs], [shape(y) for y in ys]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out: list[Node] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(merge(xs[i], ys[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            xs[i].opt = True
            out.append(xs[i])
            i += 1
        else:
            ys[j].opt = True
            out.append(ys[j])
            j += 1
    return looped(out) if len(out) > LONG else out


def skeleton(root: Node) -> Node:
    """The tree with the repeats of every element folded, from the leaves up."""
    for kid in root.kids:
        if kid.kids:
            skeleton(kid)
    if len(root.kids) > 1:
        root.kids = folded(root.kids)
    return root


def slots(root: Node) -> list[Node]:
    """The text slots in order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.key == "#":
            out.append(n)
        else:
            todo.extend(reversed(n.kids))
    return out


def written(n: Node, figures: bool) -> list:
    flags = (1 if n.opt else 0) + (2 if n.rep else 0)
    if n.key == "#":
        return ["#", flags, *n.stat] if figures else ["#", flags]
    return [n.key, flags, *[written(k, figures) for k in n.kids]]


def read(rows: list) -> Node:
    n = Node(rows[0])
    n.opt, n.rep = bool(rows[1] & 1), bool(rows[1] & 2)
    if n.key == "#":
        n.stat = list(rows[2:]) or [0, 0, 0, 0, 0]
    else:
        n.kids = [read(k) for k in rows[2:]]
    return n


def expression(n: Node) -> str:
    """The wrapper as text: ``?`` optional, ``+`` repeated, ``*`` both, ``#`` a text slot."""
    inner = "#" if n.key == "#" else " ".join(expression(k) for k in n.kids)
    said = inner if n.key == "#" else f"({inner})" if n.key in ("()", "(*)") else f"<{n.key}>{' ' + inner if inner else ''} </>"
    quantity = "*" if n.opt and n.rep else "?" if n.opt else "+" if n.rep else ""
    return f"({said}){quantity}" if quantity and n.key not in ("#", "()", "(*)") else said + quantity


# --- the article's slots --------------------------------------------------------------------------


def tag_of(key: str) -> str:
    return re.split(r"[.!]", key, maxsplit=1)[0]


def words_of_key(key: str) -> set[str]:
    return set(key.split("!")[1:])


def framed(key: str, inside: bool) -> bool:
    """Whether an element belongs to the frame; inside an article its own header is part of it."""
    tag, said = tag_of(key), words_of_key(key)
    if tag in OUTER or "hidden" in said:
        return True
    said -= MAIN
    if tag in ("article", "main"):
        said -= {"header", "footer", "banner", "nav", "menu", "search", "notice", "promo"}
    if inside:
        said -= {"header"}
    elif tag == "header":
        return True
    return bool(said)


def _collect(n: Node, test, inside: bool, guarded: bool) -> list[Node]:
    """Outermost elements that pass ``test``, outside the frame if ``guarded``."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if x.key == "#":
            continue
        group = x.key in ("()", "(*)")
        if not group and x is not n:
            if guarded and framed(x.key, inside):
                continue
            if test(x):
                out.append(x)
                continue
        todo.extend(reversed(x.kids))
    return out


def _kept(n: Node, inside: bool, into: set[int], skip=None) -> None:
    """Slots under ``n`` that are not in the frame."""
    for k in n.kids:
        if k.key == "#":
            if skip is None or not skip(k):
                into.add(id(k))
        elif k.key in ("()", "(*)") or not framed(k.key, inside):
            _kept(k, inside, into, skip)


def article_slots(page: Node, figure) -> set[int]:
    """Ids of the page's slots that hold the article.

    ``figure`` gives the host's figures of a slot.  ``article`` elements outside
    the frame are the article; else a ``main`` element, else an element whose
    name says so, else the part with most of the free text on the whole host,
    without slots that are links or read the same on all pages.
    """
    kept: set[int] = set()
    for test in (lambda x: tag_of(x.key) == "article", lambda x: tag_of(x.key) == "main" or "main" in words_of_key(x.key), lambda x: bool(words_of_key(x.key) & MAIN)):
        for guarded in (True, False):
            found = [x for x in _collect(page, test, False, guarded) if not framed(x.key, True)]
            for x in found:
                _kept(x, True, kept)
            if found:
                return kept
    # nothing names it: follow the mass of free text
    free = lambda s: max(0, figure(s)[0] - figure(s)[1])

    def mass(n: Node) -> int:
        return sum(free(k) if k.key == "#" else mass(k) if k.key in ("()", "(*)") or not framed(k.key, False) else 0 for k in n.kids)

    node, whole = page, mass(page)
    while True:
        inner = [k for k in node.kids if k.key != "#" and not (k.key not in ("()", "(*)") and framed(k.key, False))]
        heavy = max(inner, key=mass, default=None)
        if heavy is None or heavy.rep or heavy.key in ("()", "(*)") or tag_of(heavy.key) not in ("div", "section", "table", "tbody", "tr", "td", "center") or mass(heavy) < MASS * whole:
            break
        node = heavy

    differ = any(figure(s)[2] != figure(s)[3] for s in slots(node))  # else all pages are copies

    def same(s: Node) -> bool:
        chars, linked, low, high, pages = figure(s)
        return 2 * linked > chars or differ and pages > 2 and low == high

    _kept(node, False, kept, same if whole else None)
    return kept


def matched(page: Node, wrapper: Node) -> dict[int, Node]:
    """The wrapper's slot of every slot of a page that it accepts."""
    mine = slots(page)
    merge(wrapper, page)
    return {id(s): s.found() for s in mine}


# --- Spark ----------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _folded_page(html: str | None) -> tuple[Node, list[list[tuple[Node, str]]]]:
    root, blocks = parse(html or "")
    return skeleton(root), blocks


FIGURES = "host string, skeleton string, slot int, chars long, linked long, low long, high long, pages long"
#: Skeletons that a task holds before it gives them on.
HELD = 4096


def _figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Figures of the slots of each host and skeleton, added up inside the task."""
    held: dict[tuple[str, str], list[list[int]]] = {}

    def flush() -> pd.DataFrame:
        rows = [(h, s, i, *f) for (h, s), figures in held.items() for i, f in enumerate(figures or [[0, 0, 0, 0, 1]])]
        held.clear()
        return pd.DataFrame(rows, columns=["host", "skeleton", "slot", "chars", "linked", "low", "high", "pages"])

    for frame in frames:
        for host, html in zip(frame["host"], frame["html"]):
            root, blocks = _folded_page(html)
            texts: dict[int, list[str]] = {}
            for block in blocks:
                for slot, text in block:
                    texts.setdefault(id(slot.found()), []).append(text)
            figures = []
            for s in slots(root):
                code = _text_code("".join(texts.get(id(s), [])))
                figures.append([s.stat[0], s.stat[1], code, code, 1])
            key = (host, json.dumps(written(root, False), separators=(",", ":")))
            known = held.get(key)
            if known is None:
                held[key] = figures
            else:
                for a, b in zip(known, figures):
                    a[0] += b[0]
                    a[1] += b[1]
                    a[2] = min(a[2], b[2])
                    a[3] = max(a[3], b[3])
                    a[4] += 1
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def _text_code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(text.split())) >> 1


#: Skeletons or wrappers that one task aligns.
ALIGNED = 32


def _inferred(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper that accepts all of a group's skeletons, aligned in order of their pages."""
    rows = rows.sort_values(["pages", "wrapper"], ascending=[False, True], kind="stable")
    whole = None
    for said in rows["wrapper"]:
        node = read(json.loads(said))
        whole = node if whole is None else merge(whole, node)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(written(whole, True), separators=(",", ":"))], "pages": [int(rows["pages"].sum())]})


def _with_figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        said = []
        for text, figures in zip(frame["skeleton"], frame["figures"]):
            node = read(json.loads(text))
            for s, f in zip(slots(node), figures):
                s.stat = [int(f[c]) for c in ("chars", "linked", "low", "high", "pages")]
            said.append(json.dumps(written(node, True), separators=(",", ":")))
        yield pd.DataFrame({"host": frame["host"], "wrapper": said, "pages": frame["pages"]})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: ``host, wrapper, pages``; ``wrapper`` is the expression with the figures of its slots as JSON.

    All pages count.  Pages of equal skeleton are one before anything is
    shuffled; a host's skeletons are aligned in groups of about ``ALIGNED`` and
    the wrappers again, until each host has one.
    """
    raw = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    seen = raw.mapInPandas(_figures, FIGURES)
    added = [F.sum(c).alias(c) for c in ("chars", "linked")] + [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages")]
    each = seen.groupBy("host", "skeleton", "slot").agg(*added)
    figure = F.struct("slot", "chars", "linked", "low", "high", "pages")
    whole = each.groupBy("host", "skeleton").agg(F.array_sort(F.collect_list(figure)).alias("figures"), F.max("pages").alias("pages"))
    level = staged(whole.mapInPandas(_with_figures, "host string, wrapper string, pages long"))
    counted = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    level = level.join(counted, "host")
    while most > 1:
        groups = F.ceil(F.col("n") / ALIGNED).cast("int")
        dealt = level.withColumn("groups", groups).withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        merged = dealt.groupBy("host", "bucket").applyInPandas(lambda rows: _inferred(rows), "host string, wrapper string, pages long")
        most = -(-most // ALIGNED)
        level = staged(merged)
        if most > 1:
            level = level.join(counted.select("host", F.ceil(F.col("n") / ALIGNED).alias("n")), "host")
            counted = counted.select("host", F.ceil(F.col("n") / ALIGNED).alias("n"))
    return level.select("host", "wrapper", "pages")


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of the pages; what a wrapper says about a skeleton is worked out once per task."""
    said: dict[tuple[str, str], list[bool]] = {}
    for frame in frames:
        texts = []
        for html, wrapper in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
            root, blocks = _folded_page(html)
            order = slots(root)
            key = (wrapper, json.dumps(written(root, False), separators=(",", ":")))
            keep = said.get(key)
            if keep is None:
                keep = said[key] = labels(root, wrapper)
                if len(said) > HELD:
                    said.clear()
            kept = {id(s) for s, k in zip(order, keep) if k}
            texts.append(joined(blocks, kept))
        yield pd.Series(texts, dtype=object)


def labels(page: Node, wrapper: str) -> list[bool]:
    """For each slot of a page's skeleton whether it holds the article, by the host's wrapper."""
    copy = read(json.loads(json.dumps(written(page, True))))
    theirs = slots(copy)
    # a second copy is aligned with the wrapper: alignment changes what it aligns
    figures = matched_figures(page, wrapper)
    by_id = {id(s): f for s, f in zip(theirs, figures)}
    kept = article_slots(copy, lambda s: by_id[id(s)])
    return [id(s) in kept for s in theirs]


def matched_figures(page: Node, wrapper: str) -> list[list[int]]:
    """The host's figures of each slot of a page."""
    copy = read(json.loads(json.dumps(written(page, True))))
    mine = slots(copy)
    whole = read(json.loads(wrapper))
    known = {id(s): list(s.stat) for s in slots(whole)}
    where = matched(copy, whole)
    return [known.get(id(where[id(s)]), [0, 0, 0, 0, 0]) for s in mine]


def joined(blocks: list[list[tuple[Node, str]]], kept: set[int]) -> str:
    """Kept pieces of each block with references decoded and white space made single; a line per block with text."""
    out = []
    for block in blocks:
        line = " ".join("".join(unescape(text) for slot, text in block if id(slot.found()) in kept).split())
        if line:
            out.append(line)
    return "\n".join(out)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``pages`` with the article's text of every page and its number of code points.

    A null html is an empty page and gives an empty text.  Pages without a host
    (null or odd urls) are a host together.  Plain text without tags is a block
    of its own.  Repeated pages give their text each time.  Elements nested more
    than ``DEPTH`` deep count as part of the one above them, without loss of
    text; texts of any length are read whole.  Line breaks (``br``) are white
    space inside a block.  Columns called like the two results are replaced,
    others stay, whatever their names.  An empty table gives no rows.

    The wrappers are staged, and their size decides between a broadcast and a
    shuffled join, whose skewed hosts adaptive execution splits.
    """
    wrappers = infer(pages, url_col, html_col)
    base = pages.drop(*[c for c in pages.columns if c.lower() in (out_col.lower(), chars_col.lower())])
    host, said = fresh(base, "page_host"), fresh(base, "page_wrapper")
    known = staged(wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(said)))
    read_text = F.pandas_udf(_texts, "string")
    told = base.withColumn(host, host_of(F.col(f"`{url_col}`"))).join(known, host, "left")
    done = told.withColumn(out_col, read_text(F.col(f"`{html_col}`").cast("string"), F.col(said))).drop(host, said)
    return done.withColumn(chars_col, F.length(out_col).cast("long"))


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    return _extracted(pd.DataFrame({"html": html, "wrapper": wrapper}) for html, wrapper in batches)


_texts.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
