"""Main text of web pages by tree scoring.

A page becomes a tree. Every text block passes points (one, one for each comma, up to three for its
length) to its ancestors, in full to the parent, halved to the grandparent and less above; a
container's points are discounted by the share of its text inside links. The best container tells where the article is. The article is then taken whole, short sections with it: the best container's
``article`` or ``main``, else the container around it whose name says that it holds the content, else the widest one below the body to which each step up adds text rather than links. Only what a margin was told by, and
lists of links inside such a container, stay out. Beside a container found in the last way those of its siblings that score alike are kept. All blocks stand in page order.

Tags and names only make an element suspect. Suspects leave before the scoring where other text carries the page; where little or nothing else is there, the suspect that holds the
text is the page's frame and stays. A part of an article with a weak name stays if it holds prose. A name is judged by its head: "related-posts" are margin, "related-work" is not.

Defined results: null or empty html, or a page without text, gives an empty text; html that breaks off is
read as if all open elements were closed; unknown tags are containers; repeated rows stay repeated;
extra columns are not looked at; nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_DROPPED = {"head", "button", "select", "svg", "canvas", "object", "audio", "video", "math", "datalist"} | _RAW
#: Tags of margins; those of the second set often frame whole pages as well.
_MARGIN, _FRAME = {"nav", "footer", "menu"}, {"aside", "form", "dialog", "fieldset", "header"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_SCOPE = {"html", "body", "div", "article", "section", "main", "table", "td", "th", "li", "ul", "ol", "dl", "dd", "blockquote", "aside", "nav", "footer", "header", "form"}
#: Heads of class, id or role names that mark what is not the article: surely, and perhaps.
_STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "adslot", "adbox", "adunit", "sponsor", "sponsored", "promoted", "promo", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "replies", "responses",
    "consent", "cookie", "cookies", "gdpr", "footer", "colophon", "contentinfo", "menu", "nav", "navbar", "navigation", "pagination", "sidebar", "newsletter", "popup", "skip",
}
_WEAK = {
    "banner", "header", "masthead", "modal", "feedback", "discussion", "rail", "aside", "topbar", "notice", "notices", "promotion", "recommended", "related", "reply", "respond", "search", "share", "sharing", "social", "subscribe", "toolbar", "widget",
    "complementary", "alert", "form", "alertdialog", "dialog", "copyright", "disclaimer",
}
#: Words behind the head of a name that say nothing of what it is.
_TAIL = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "count", "group", "icons", "inner", "item", "items", "left", "links", "list", "outer", "panel", "posts", "right", "row", "section", "signup", "slot", "stories", "text",
    "thread", "top", "unit", "widgets", "wrap", "wrapper",
}
#: Heads of class, id or role names of what holds the article.
_CONTENT = {"article", "content", "contents", "entry", "main", "maincontent", "post", "story", "text", "body", "page"}
#: Long words that count at either end of a name written as one.
_GLUED = ("sidebar", "advert", "cookie", "breadcrumb", "newsletter")
_WORDS = re.compile(r"[a-z]+")
#: Words of layout names ("with-sidebar", "no-comments"), which say nothing of the element itself.
_LAYOUT = {"has", "with", "no", "without", "layout", "enabled", "open", "closed"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "inside", "named", "score", "chars", "linked", "prose")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, suspect: int = 0, inside: bool = False, named: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.suspect, self.inside, self.named = tag, parent, dropped, suspect, inside, named
        self.children: list = []
        self.score, self.chars, self.linked, self.prose = 0.0, 0, 0, 0


def _name_mark(name: str) -> int:
    """2 for a name that surely marks a margin, 1 for one that may, else 0."""
    parts = _WORDS.findall(name)
    if not parts or _LAYOUT & set(parts):
        return 0
    while len(parts) > 1 and parts[-1] in _TAIL and not (parts[-1] in _STRONG or parts[-1] in _WEAK):
        parts.pop()
    head = parts[-1]
    if head in _STRONG or any(head.startswith(w) or head.endswith(w) for w in _GLUED):
        return 2
    return int(head in _WEAK)


def _judge(tag: str, attrs: str, inside: bool) -> tuple[bool, int, bool]:
    """(never text, how suspect, named as content); inside: of an article, whose own header holds its title."""
    if tag in _DROPPED:
        return True, 0, False
    mark = 2 if tag in _MARGIN else 1 if tag in _FRAME and not (tag == "header" and inside) else 0
    if not attrs or attrs.isspace() or tag in ("html", "body", "main"):
        return False, mark, False
    found = {}
    for name, double, single, bare in _ATTR.findall(attrs):
        found.setdefault(name.lower(), (double or single or bare).lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True, mark, False
    named = False
    for name in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split():
        if not (name == "header" and inside):
            mark = max(mark, _name_mark(name))
        parts = _WORDS.findall(name)
        named |= bool(parts) and parts[-1] in _CONTENT and not _LAYOUT & set(parts)
    return False, 2 * (mark == 2) if tag == "article" else mark, named and not mark


def _tree(page: str) -> _Node:
    root = node = _Node("", None, False)
    at, find = 0, _MARKUP.search
    while m := find(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.children.append(html.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        if m[1] or m[4]:
            up = node
            while up.parent and up.tag != tag and not (tag in _INLINE and up.tag in _SCOPE):
                up = up.parent
            if up.parent and up.tag == tag:
                node = up.parent
            continue
        attrs = m[3] or m[6] or ""
        if tag in _VOID:
            if tag in ("br", "hr", "img", "input", "embed"):
                node.children.append(" " if tag != "hr" else _Node("hr", node, False))
            continue
        if tag not in _INLINE:
            up = node  # a block ends an open paragraph
            while up.parent and up.tag != "p" and up.tag not in _SCOPE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                up = node
                while up.parent and up.tag not in ends and up.tag not in stops:
                    up = up.parent
                if up.parent and up.tag in ends:
                    node = up.parent
        dropped, suspect, named = _judge(tag, attrs, node.inside)
        new = _Node(tag, node, node.dropped or dropped, suspect, node.inside or tag in ("article", "main"), named)
        node.children.append(new)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not attrs.endswith("/") or tag not in ("svg", "path"):
            node = new
    if at < len(page):
        node.children.append(page[at:])
    return root


def _blocks(root: _Node) -> list[tuple[_Node, str, int]]:
    """(container, text, characters in links) of each run of inline content, in page order."""
    out: list[tuple[_Node, str, int]] = []
    run: list[str] = []
    linked = 0

    def flush(owner: _Node) -> None:
        nonlocal linked
        if run and (text := " ".join(html.unescape("".join(run)).split())):
            out.append((owner, text, min(linked, len(text))))
        run.clear()
        linked = 0

    # walks without recursion: pages may nest deeply
    stack: list[tuple[_Node, int, _Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, i, owner, link = stack.pop()
        if i == len(node.children):
            if node is owner:
                flush(owner)
            continue
        stack.append((node, i + 1, owner, link))
        child = node.children[i]
        if isinstance(child, str):
            run.append(child)
            if link:
                linked += len(child.strip())
        elif child.dropped:
            if child.tag not in _INLINE:
                flush(owner)
            else:
                run.append(" ")
        elif child.tag in _INLINE:
            stack.append((child, 0, owner, link or child.tag == "a"))
        else:
            flush(owner)
            stack.append((child, 0, child, link))
    return out


def _suspects(root: _Node) -> list[_Node]:
    """Suspects that no other suspect holds."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.suspect and not node.dropped:
            out.append(node)
        elif not node.dropped:
            stack += [c for c in node.children if not isinstance(c, str)]
    return out


def _settle(root: _Node) -> None:
    """Decides which suspects leave: all but parts of an article with a weak name that hold prose, and the frame of a page that has hardly any other text."""
    blocks = _blocks(root)
    whole = sum(len(text) for _, text, _ in blocks)
    for owner, text, linked in blocks:
        while owner is not None:
            owner.chars += len(text)
            owner.linked += linked
            owner.prose += len(text) >= 200 and linked < 0.1 * len(text)
            owner = owner.parent
    stack = [root]
    while stack:
        node = stack.pop()
        if node.suspect == 1 and node.parent and node.parent.inside and node.prose >= 2:
            node.suspect = 0
        stack += [c for c in node.children if not isinstance(c, str)]
    while suspects := _suspects(root):
        rest = whole - sum(n.chars for n in suspects)
        frames = [n for n in suspects if n.chars > n.linked and (n.suspect == 1 or not rest)]
        best = max(frames, key=lambda n: (n.chars - n.linked, -n.suspect), default=None)
        if best is None or rest > 0.1 * (best.chars - best.linked) or best.suspect == 1 and rest and best.prose < 1:
            break
        best.suspect = 0  # its own parts are judged next
    stack = [(root, False)]
    while stack:
        node, gone = stack.pop()
        node.dropped = node.dropped or gone or node.suspect > 0
        stack += [(c, node.dropped) for c in node.children if not isinstance(c, str)]
        node.chars = node.linked = 0


def _whole(best: _Node) -> tuple[bool, _Node]:
    """(whether it is surely the article's frame, the container to be taken whole) around the best one."""
    above = []
    up: _Node | None = best
    while up is not None:
        above.append(up)
        up = up.parent
    for tag in ("article", "main"):
        if found := next((n for n in above if n.tag == tag), None):
            return True, found
    for node in reversed(above):
        if node.named and node.tag not in ("html", "body"):
            return True, node
    top = best
    for node in above[1:]:
        # what a step up adds must be text: a menu among it tells of a frame that holds margins as well
        if node.tag in ("", "html", "body") or node.linked - top.linked > 0.25 * (node.chars - top.chars):
            break
        top = node
    return False, top


def _link_lists(frame: _Node) -> set[int]:
    """Blocks of an article's frame that are little but links and stand apart from its text."""
    out, stack = set(), [frame]
    while stack:
        node = stack.pop()
        for c in node.children:
            if not isinstance(c, str) and not c.dropped and c.chars:
                if c.tag in ("div", "section", "ul", "ol", "dl", "table") and c.linked > 0.8 * c.chars:
                    out.add(id(c))
                elif c.tag not in ("article",):
                    stack.append(c)
    return out if frame.tag != "article" else set()


def extract(page: str | None) -> str:
    """The article's blocks joined by one line feed."""
    if not page:
        return ""
    root = _tree(page)
    _settle(root)
    blocks = _blocks(root)
    if not blocks:
        return ""
    scored: dict[int, _Node] = {}
    for owner, text, linked in blocks:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up = owner.parent if owner.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "td", "blockquote", "dd", "dt", "figcaption") and owner.parent else owner
        level = 0
        while up is not None:
            if level < 5:
                up.score += points / (1, 2, 6, 9, 12)[level]
            scored[id(up)] = up
            up.chars += len(text)
            up.linked += linked
            up, level = up.parent, level + 1
    worth = {k: n.score * (1 - n.linked / max(1, n.chars)) + (50 if n.tag in ("article", "main") else 0) for k, n in scored.items()}
    best = max(scored.values(), key=lambda n: worth[id(n)])
    whole, best = _whole(best)
    kept, lists = {id(best)}, set()
    if whole:
        lists = _link_lists(best)
    elif best.parent:
        enough = max(10.0, 0.2 * worth[id(best)])
        for near in best.parent.children:
            if not isinstance(near, str) and near is not best and not near.dropped:
                kin = near.tag == best.tag and near.linked < 0.25 * near.chars
                alike = worth.get(id(near), 0.0) >= (max(3.0, 0.25 * enough) if kin else enough)
                if alike or near.tag in ("p", "h1", "h2", "h3", "h4"):
                    kept.add(id(near))
    inside: dict[int, bool] = {}

    def keeps(node: _Node | None) -> bool:
        path = []
        while node is not None and id(node) not in inside and id(node) not in kept and id(node) not in lists:
            path.append(id(node))
            node = node.parent
        value = node is not None and id(node) not in lists and (id(node) in kept or inside[id(node)])
        inside.update(dict.fromkeys(path, value))
        return value

    return "\n".join(text for owner, text, _ in blocks if keeps(owner))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
