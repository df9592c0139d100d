"""Main text of web pages by composite text density.

Every DOM node gets the characters, tags, link characters and link tags below
it and from them its composite density: characters for each tag, damped where
much of the text stands in links.  The density sum of a node adds up its
children's densities; the node with the largest sum is the core of the page.
The least density on the path from body to the core is the threshold.  The
region grows from the core to the article or main element that holds it, or,
without one, by those neighbours along the body path that reach the
threshold.  Elements that are boilerplate by their tag or role are taken out
beforehand, and so are lists of links.  A boilerplate word in a class or id,
and the tags form, dialog and object, are hints only: see ``_settle``.

Edge cases: a null or empty page, or one without text, gives ''; unclosed and
misplaced tags, broken comments and quotes are read leniently; a page without
any body is its own body; very deep pages need no recursion; repeated pages
are read each for itself; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, slices, text_or_empty

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|title|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
# What a start tag closes if it is open nearer than the tags in the second set.
SCOPE = frozenset("html body table td th div article section main aside nav form ul ol dl blockquote header footer fieldset".split())
ENDS = {
    "li": ({"li"}, frozenset({"ul", "ol", "menu"})),
    "dt": ({"dt", "dd"}, frozenset({"dl"})),
    "dd": ({"dt", "dd"}, frozenset({"dl"})),
    "tr": ({"tr", "td", "th"}, frozenset({"table"})),
    "td": ({"td", "th"}, frozenset({"tr", "table"})),
    "th": ({"td", "th"}, frozenset({"tr", "table"})),
    "option": ({"option"}, frozenset({"select"})),
}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside button select input menu head canvas audio video datalist".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar toolbar".split())
# Hints: a page may stand in one form, and a layout may be named by what stands beside the text.
WEAK, STRONG = 1, 2
HINT_TAGS = {"form": WEAK, "dialog": STRONG, "object": STRONG}
HINT_ROLES = {"form": WEAK, "dialog": STRONG}
LAYOUT_NAMES = frozenset("layout page site content container wrap wrapper inner outer main body row col column columns grid elementor".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations widget widgets "
    "pagination pager masthead topbar toolbar banner alert skip hidden".split()
)
KEPT_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset({"h1"})
# Strong hints are asked again where less than this share of a page's text stands outside of hints.
LEAST_LEFT = 0.1


class Page:
    """Nodes in page order (a parent before its children) and pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped = ["#"], [-1], [False]
        self.role = [""]
        #: 0, WEAK or STRONG, and the names that gave the hint
        self.hint: list[int] = [0]
        self.names: list[frozenset[str]] = [frozenset()]
        #: (node, text) in page order; a node of -1 is a border between blocks
        self.pieces: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, rest: str) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        role, dropped = "", self.dropped[parent] or tag in BOILERPLATE_TAGS
        hint, names = HINT_TAGS.get(tag, 0), {f"<{tag}>"} if tag in HINT_TAGS else set()
        if rest and not dropped:
            for name, *values in ATTRIBUTE.findall(rest):
                name, value = name.lower(), "".join(values).lower()
                if name == "role":
                    role = value.strip()
                    dropped |= role in BOILERPLATE_ROLES
                    if role in HINT_ROLES:
                        hint = max(hint, HINT_ROLES[role])
                        names.add(f"<{role}>")
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    dropped = True
                elif name == "style":
                    dropped |= "display:none" in value.replace(" ", "")
                elif name in ("class", "id") and tag not in KEPT_TAGS:
                    for x in value.split():
                        if found := self._names_boilerplate(x, parent):
                            hint = max(hint, found)
                            names.add(x)
        if tag == "header" and not dropped:
            dropped = not self._within_article(parent)
        self.dropped.append(dropped)
        self.role.append(role)
        self.hint.append(hint)
        self.names.append(frozenset(names))
        return node

    def _names_boilerplate(self, name: str, parent: int) -> int:
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        # what a layout has or lacks is not what it is
        parts = parts[: next((i for i, x in enumerate(parts) if x in ("has", "no", "with", "without")), None)]
        if not parts or (BOILERPLATE_NAMES.isdisjoint(parts) and (parts[-1] != "header" or self._within_article(parent))):
            return 0
        return STRONG if LAYOUT_NAMES.isdisjoint(parts) else WEAK

    def _within_article(self, node: int) -> bool:
        while node > 0:
            if self.tag[node] in ("article", "main") or self.role[node] == "main":
                return True
            node = self.parent[node]
        return False

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.pieces.append((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                self.pieces.append((-1, ""))
            if m["close"] or m["close2"]:
                self._close(tag, stack)
                continue
            self._make_room(tag, stack)
            node = self._open(tag, stack[-1], m["rest"] or m["rest2"] or "")
            if tag not in VOID:
                stack.append(node)
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))

    def _close(self, tag: str, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                del stack[i:]
                return
            if tag in INLINE | {"p"} and self.tag[stack[i]] in SCOPE:
                return

    def _make_room(self, tag: str, stack: list[int]) -> None:
        if tag in PARAGRAPH_ENDS:
            ends, scope = {"p"}, SCOPE
        elif tag in ENDS:
            ends, scope = ENDS[tag]
        else:
            return
        outermost = None
        for i in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[i]]
            if name in scope:
                break
            if name in ends:
                outermost = i
        if outermost is not None:
            del stack[outermost:]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    pieces = [(n, html.unescape(t) if "&" in t else t) for n, t in page.pieces if n < 0 or not page.dropped[n]]
    if any(page.hint):
        _settle(page, pieces)
        pieces = [(n, t) for n, t in pieces if n < 0 or not page.dropped[n]]
    region = _region(page, pieces)
    out = []
    for node, text in pieces:
        if node < 0:
            out.append(" ")
        elif region[node]:
            out.append(text)
    return " ".join("".join(out).split())


def _settle(page: Page, pieces: list[tuple[int, str]]) -> None:
    """Drop the nodes with a hint, and all below them, unless they hold the main text.

    They hold it if a main element stands in them; if an h1 does and the core
    of the page too, sought among all that hold either or have no hint (a node
    beside the core is not saved by its h1); or if an article does, unless
    they stand in an article themselves or a longer one stands outside of
    hints; and if the core of the page stands in them.  This core is sought
    with the weak hints ignored, and with all ignored where too little text
    stands outside of hints; then the parts of the core that reach the
    threshold count too.  A name that holds the core is a hint no more.
    """
    n, parent, tag, hint = len(page.tag), page.parent, page.tag, page.hint
    hard, kept = page.dropped, [not h for h in hint]

    def settled(kept: list[bool]) -> list[bool]:
        out = list(hard)
        for i in range(1, n):
            out[i] = out[i] or not kept[i] or out[parent[i]]
        return out

    size, longest, holds, headed, in_article, plain = [0] * n, [0] * n, [False] * n, [False] * n, [False] * n, [True] * n
    for i in range(1, n):
        in_article[i] = in_article[parent[i]] or tag[parent[i]] == "article"
        plain[i] = plain[parent[i]] and tag[i] != "a" and tag[i] not in HEADINGS
    for node, text in pieces:
        if node >= 0:
            size[node] += len(text.strip())
    own = list(size)
    for i in range(n - 1, 0, -1):
        if not hard[i]:
            holds[i] = holds[i] or tag[i] == "main" or page.role[i] == "main"
            holds[parent[i]] = holds[parent[i]] or holds[i]
            headed[i] = headed[i] or tag[i] in HEADINGS
            headed[parent[i]] = headed[parent[i]] or headed[i]
            kept[i] = kept[i] or holds[i]
            if tag[i] == "article":
                longest[i] = max(longest[i], size[i])
            longest[parent[i]] = max(longest[parent[i]], longest[i])
            size[parent[i]] += size[i]
    if any(headed[i] and not kept[i] for i in range(n)):
        page.dropped = settled([k or x for k, x in zip(kept, headed)])
        core = _measure(page, [(i, t) for i, t in pieces if i < 0 or not page.dropped[i]])[3]
        for i in [core, *_above(parent, core)]:
            kept[i] = kept[i] or headed[i]
    page.dropped = settled(kept)
    outside = max((size[i] for i in range(n) if tag[i] == "article" and not page.dropped[i]), default=0)
    for i in range(1, n):
        kept[i] = kept[i] or (longest[i] > outside and not in_article[i])

    for least in (WEAK, STRONG):
        page.dropped = settled(kept)
        if least == STRONG:
            whole, left = (sum(own[i] for i in range(n) if plain[i] and not out[i]) for out in (hard, page.dropped))
            if left >= LEAST_LEFT * whole:
                break
        page.dropped = settled([k or h <= least for k, h in zip(kept, hint)])
        chars, of, bare, core = _measure(page, [(i, t) for i, t in pieces if i < 0 or not page.dropped[i]])
        path = [core, *_above(parent, core)]
        cores = [i for i in path if not kept[i]]
        if least == STRONG and not cores:
            threshold = min(of[i] for i in path)
            below = [False] * n
            for i in of:
                below[i] = i > 0 and (parent[i] == core or below[parent[i]])
            cores = [i for i in of if not kept[i] and below[i] and chars[i] and not bare[i] and of[i] >= threshold]
        names = {x for i in cores for x in page.names[i] if x[0] != "<"}
        for i in cores:
            kept[i] = True
        for i in range(1, n):
            kept[i] = kept[i] or page.names[i] <= names
    page.dropped = settled(kept)


def _measure(page: Page, pieces: list[tuple[int, str]]) -> tuple[list[int], dict[int, float], list[bool], int]:
    """Characters by node, density of what is not dropped, which nodes are bare links, and the core."""
    n, parent, tag = len(page.tag), page.parent, page.tag
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for node, text in pieces:
        if node >= 0:
            size = len(text.strip())
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        p = parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tag[i] == "a")
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])

    def density(i: int) -> float:
        c, lc = chars[i], link_chars[i]
        if not c:
            return 0.0
        base = log(c / max(1, c - lc) * lc + share * c + e)
        spread = c / max(1, lc) * max(1, tags[i]) / max(1, link_tags[i])
        return c / max(1, tags[i]) * log(max(spread, 1.0)) / base

    live = [i for i in range(n) if not page.dropped[i]]
    of = {i: density(i) for i in live}
    sums = dict.fromkeys(live, 0.0)
    for i in live:
        if i and tag[i] not in INLINE:
            sums[parent[i]] += of[i]
    # links alone, such as lists of them, are no text
    bare = [False] * n
    for i in live:
        bare[i] = i > 0 and (bare[parent[i]] or (tag[i] in ("ul", "ol", "dl", "p", "div", "section", "table") and link_tags[i] > 1 and link_chars[i] > 0.8 * chars[i]))
    core = max((i for i in live if tag[i] not in INLINE and not bare[i]), key=lambda i: (sums[i], of[i], -i), default=0)
    return chars, of, bare, core


def _region(page: Page, pieces: list[tuple[int, str]]) -> list[bool]:
    """Which nodes' own text belongs to the main text."""
    n, parent, tag = len(page.tag), page.parent, page.tag
    chars, of, bare, core = _measure(page, pieces)
    live = list(of)
    body = next((i for i in range(n) if tag[i] == "body"), 0)

    def semantic(i: int) -> bool:
        return tag[i] in ("article", "main") or page.role[i] == "main"

    path = []
    i = core
    while i >= 0:
        path.append(i)
        i = parent[i]
    articles = [i for i in path if tag[i] == "article"]
    mains = [i for i in path if semantic(i)]
    chosen = [articles[-1]] if articles else mains[:1]
    if not chosen:
        inside = [i for i in live if semantic(i) and not bare[i] and core in _above(parent, i)]
        inside = [i for i in inside if not any(semantic(j) for j in _above(parent, i))]
        if sum(chars[i] for i in inside) * 2 > chars[core]:
            chosen = inside
    if not chosen:
        to_body = path[: path.index(body) + 1] if body in path else path
        threshold = min(of[i] for i in to_body)
        chosen = [core]
        on_path = set(path)
        for i in live:
            if i and parent[i] in on_path and i not in on_path and parent[i] != core and (of[i] >= threshold or tag[i] in HEADINGS):
                chosen.append(i)
    region, marked = [False] * n, set(chosen)
    for i in range(n):
        region[i] = not page.dropped[i] and not bare[i] and (i in marked or (i > 0 and region[parent[i]]))
    return region


def _above(parent: list[int], i: int) -> set[int]:
    found = set()
    while (i := parent[i]) >= 0:
        found.add(i)
    return found


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], ["text", *names])

    names = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(text_or_empty(html).alias("text"), *(F.col(k).alias(a) for k, a in zip(keep, names)))
    kinds = ", ".join(f"{a} {rows.schema[a].dataType.simpleString()}" for a in names)
    return map_arrow(rows, run, f"text string, {kinds}").select(*(F.col(a).alias(k) for k, a in zip(keep, names)), "text")
