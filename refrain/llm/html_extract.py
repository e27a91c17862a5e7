"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements; scripts, styles and other parts that are never shown aren't read, and boilerplate
subtrees are cut by element (navigation, page headers and footers, asides, forms ...) or by the words of their
class, id and role (menus, adverts, notices, comments ...; not of headings and paragraphs). Such a subtree is read all
the same when it holds most of the page's paragraph points and what is outside has less than a third as many, when it
holds the page's largest article or main element and no more points are outside, or when it is a section of an article
whose id only repeats its heading. If no text is left, words and forms cut nothing. Every paragraph-like block then gives points to its
ancestors: one, one per comma, and one per 100 code points up to three; the parent gets all of them, the
grandparent half, the next ones a sixth, a ninth and so on. Wrappers, which hold no more text than one child, count as one
with that child, however many there are. A container's score is discounted by its link density (share of
its text inside links). The container with the best score is taken, or a larger one around it that has over twice as many
paragraph points and few links (an article whose paragraphs lie apart); it is kept, and so are those of its siblings that score at
least a fifth as much or are paragraphs of text with few links. The kept blocks are joined in page order.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by two line feeds; nothing is cut off. A line break is white space.

Defined cases: null or empty html, and a page without text, give an empty text; broken or unclosed markup is read as
browsers do (a new block ends an open paragraph, unknown end tags are ignored); pages of any length and depth are read
without recursion; repeated rows give equal results; an empty table gives an empty table. The result has the id, the
url if there is one and the operator's own columns only.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import slices

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg annotation annotation-xml canvas audio video textarea title".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CUT = set("nav header footer aside form fieldset button select option dialog menu label input output datalist head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 li dt th".split())
PLAIN = set("html body article main p h1 h2 h3 h4 h5 h6".split())  # not cut by words
HOLDERS = set("article main section div body td center".split())
#: An open element of the value is ended by a start tag of the key.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_AWAY = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|rail|footer\w*|foot|masthead|"
    r"(?:page|site|top|global)[-_]?header\w*|header|comment\w*|disqus\w*|respond|repl(?:y|ies)|discussion|cookie\w*|consent\w*|gdpr\w*|notice\w*|"
    r"popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|"
    r"toolbar\w*|pagination|pager|skip\w*|copyright|legal|disclaimer\w*|hidden|complementary|contentinfo|navigation|search\w*|alert\w*)(?![a-z])"
)
_MAIN = re.compile(r"article|main|content|story|post|entry|body|text")
#: A quote opens a value only after the equals sign; anywhere else it is part of a name, as browsers read it.
_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?"""
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*" + _VALUE + r")?)*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(" + _VALUE + "))?")
_OWN_HEADER = re.compile(r"(?<!page)(?<!site)(?<!top)(?<!global)(?:^|[-_\s])header")
_SPACE = re.compile(r"\s+")
_SLUG = re.compile(r"[\W_]+")
_TALK = re.compile(r"comment|disqus|respond|repl")
HIDDEN, ELEMENT, WORD, TITLE = 1, 2, 3, 4  # why a subtree is cut; TITLE: a section by its id alone
LEVELS = 64  # ancestors with text of their own that a block gives points to: the last ones get less than a hundredth


class Node:
    __slots__ = ("name", "parent", "marks", "parts", "children", "points", "chars", "linked", "cut", "kept", "ident", "free", "dark", "top")

    def __init__(self, name: str, parent: Node | None, marks: str = "", cut: int = 0, ident: str = ""):
        self.name, self.parent, self.marks, self.cut, self.ident = name, parent, marks, cut, ident
        self.parts: list[str | Node] = []
        self.children: list[Node] = []
        self.points, self.kept = 0.0, False
        self.chars = self.linked = 0
        self.free, self.dark = 0.0, False
        self.top: Node | None = None  # the outermost wrapper of this node alone


def _marks(raw: str) -> tuple[str, str, bool]:
    """Class, id and role in lower case; the id alone; whether the element is hidden."""
    if not raw.strip("/ \t\r\n"):
        return "", "", False
    words, ident, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), unescape((m[2] or "").strip("\"'")).lower()
        if name in ("class", "id", "role", "aria-label"):
            words.append(value)
            ident = value if name == "id" else ident
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
    return " ".join(words), ident, hidden


def _away(words: str) -> bool:
    return bool(words) and _AWAY.search(words.replace("_", "-")) is not None


def _why_cut(name: str, marks: str, ident: str, hidden: bool, inside: bool) -> int:
    """Why the subtree of an element is cut, 0 if it isn't; ``inside`` an article or main."""
    if hidden:
        return HIDDEN
    if name == "header" and inside:  # the article's own heading
        return WORD if _away(marks.replace("header", " ")) else 0
    if name in CUT:
        return ELEMENT
    if name in PLAIN or not _away(_OWN_HEADER.sub(" ", marks) if inside else marks):
        return 0
    return TITLE if name == "section" and inside and not _away(marks.replace(ident, " ") if ident else marks) else WORD


def parse(html: str) -> list[Node]:
    """Tree of a page, parents before children; boilerplate subtrees are marked, parts that are never shown are left out."""
    root = node = Node("#root", None)
    nodes = [root]
    at, n = 0, len(html)
    for_open: dict[str, int] = {}

    def close(until: Node) -> Node:
        nonlocal node
        while node is not until:
            for_open[node.name] -= 1
            node = node.parent
        return node

    while at < n:
        m = _PART.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            node.parts.append(unescape(text))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            node.parts.append(m[0][9:].removesuffix("]]>"))
        if not m[1]:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            if for_open.get(name):
                if name not in BLOCKS and _blocks_between(node, name):
                    continue  # an inline end tag doesn't close the blocks opened since
                found = node
                while found.name != name:
                    found = found.parent
                close(found.parent)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name in BLOCKS and for_open.get("p"):
            found = node
            while found is not root and found.name not in ("p", "td", "th", "button"):
                found = found.parent
            if found.name == "p":
                close(found.parent)
        if name in ENDS:
            found = node
            while found is not root and found.name not in SCOPE[name]:
                if found.name in ENDS[name]:
                    close(found.parent)
                    break
                found = found.parent
        if name in VOID:
            node.parts.append("\n" if name == "br" else " " if name != "hr" else Node("hr", node))
            continue
        marks, ident, hidden = _marks(m[2])
        child = Node(name, node, marks, _why_cut(name, marks, ident, hidden, bool(for_open.get("article") or for_open.get("main"))), ident)
        node.parts.append(child)
        if not m[0].endswith("/>") or name in BLOCKS:
            for_open[name] = for_open.get(name, 0) + 1
            node.children.append(child)
            nodes.append(child)
            node = child
    return nodes


def _blocks_between(node: Node, name: str) -> bool:
    while node.name != name:
        if node.name in BLOCKS:
            return True
        node = node.parent
    return False


def _blocks(root: Node, least: int = HIDDEN, most: int = TITLE) -> list[tuple[Node, str, int]]:
    """Text blocks outside the parts cut for these reasons, in page order: innermost block element, text, code points inside links."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    links = 0
    owner = root

    def flush():
        nonlocal links
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append((owner, text, min(links, len(text))))
        held.clear()
        links = 0

    stack: list[tuple[Node, int, int]] = [(root, 0, 0)]
    while stack:
        node, i, in_link = stack.pop()
        if i == len(node.parts):
            if node.name in BLOCKS or node.parent is None:
                flush()
                owner = node.parent or root
                while owner.parent is not None and owner.name not in BLOCKS:
                    owner = owner.parent
            continue
        stack.append((node, i + 1, in_link))
        part = node.parts[i]
        if isinstance(part, str):
            held.append(part)
            links += len(_SPACE.sub(" ", part).strip()) if in_link else 0
        elif not least <= part.cut <= most:
            if part.name in BLOCKS:
                flush()
                owner = part
            stack.append((part, 0, in_link + (part.name == "a")))
        elif part.name in BLOCKS or part.name in CUT:
            flush()
        else:
            held.append(" ")
    flush()
    return out


def _worth(node: Node, text: str, linked: int) -> float | None:
    """Points that a block gives; none if it isn't like a paragraph."""
    if node.name in HEADINGS or len(text) < 25 and node.name != "p":
        return None
    return (1 + text.count(",") + text.count("，") + min(len(text) // 100, 3)) * (1 - linked / len(text))


def _heads_itself(node: Node) -> bool:
    """Whether a section's id is its first heading, as text tools write it, and no more than a quarter of it is links."""
    head = next((c for c in node.children if c.name in HEADINGS), None)
    if head is None or _TALK.search(node.ident) or 4 * node.linked > node.chars:
        return False
    text, stack = [], [head]
    while stack:
        part = stack.pop()
        text.append(part) if isinstance(part, str) else stack.extend(reversed(part.parts))
    slug = lambda t: _SLUG.sub("-", t.lower()).strip("-")
    return slug("".join(text)) == slug(node.ident)


def _spare(nodes: list[Node]) -> None:
    """Undo the cuts, but of hidden parts, that hold the article."""
    if not any(n.cut > HIDDEN for n in nodes):
        return
    for node, text, linked in _blocks(nodes[0], HIDDEN, HIDDEN):
        worth = _worth(node, text, linked) or 0.0
        node.points += worth
        node.free += worth
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += node.points
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.free += 0 if node.cut else node.free  # what is read as soon as the parent is
    total, outside = nodes[0].points, nodes[0].free
    articles = [n for n in nodes if n.name in ("article", "main") and n.points > 0 and not _away(n.marks)]
    best = max(articles, key=lambda n: n.points, default=None)
    holders, up = set(), best
    while up is not None:
        holders.add(up)
        up = up.parent
    for node in nodes:
        node.dark = node.parent is not None and node.parent.dark
        if node.dark or node.cut <= HIDDEN:
            node.dark |= node.cut > 0
        elif (
            2 * node.points > total and 3 * outside < node.points
            or node in holders and best.points >= outside
            or node.cut == TITLE and node.points > 0 and _heads_itself(node)
        ):
            node.cut = 0
            outside += node.free
        else:
            node.dark = True
    for node in nodes:
        node.points, node.chars, node.linked = 0.0, 0, 0


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    nodes = parse(html)
    _spare(nodes)
    blocks = _blocks(nodes[0])
    if not blocks:
        for node in nodes:
            if node.cut in (WORD, TITLE) or node.cut == ELEMENT and node.name in ("form", "fieldset"):
                node.cut = 0
        blocks = _blocks(nodes[0])
    return _best_text(nodes, blocks) if blocks else ""


def _best_text(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> str:
    """Text of the best container and its like."""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:  # parents first
        up = node.parent
        if up is not None and up.parent is not None and up.chars == node.chars and up.name not in ("article", "main", "body", "html"):
            node.top = up.top or up
        node.free = 0.0
    scored: list[Node] = []
    for node, text, linked in blocks:
        points = _worth(node, text, linked)
        if points is None:
            continue
        up = node if node.name in HOLDERS or node.parent is None else node.parent
        up.free += points
        for level in range(LEVELS):
            up = up.top or up
            if not up.points:
                scored.append(up)
                up.points = 1e-9 + _prior(up)
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            if up.parent is None:
                break
            up = up.parent
    if not scored:  # no paragraph at all: the largest container of the remaining text
        max((b[0] for b in blocks), key=lambda x: (x.chars - x.linked, -x.linked)).kept = True
        return _kept(nodes, blocks)
    value = lambda x: x.points * (1 - x.linked / max(x.chars, 1))
    best = max(scored, key=value)
    while best.parent is not None and best.parent.name == "article":
        best = best.parent  # parts of one article belong together
    for node in reversed(nodes):  # all paragraph points inside a node
        if node.parent is not None:
            node.parent.free += node.free
    up = best.parent
    while up is not None and up.parent is not None:
        if up.free > 2 * best.free and 4 * up.linked <= up.chars:
            best = up
        up = up.parent
    best.kept = True
    for other in best.parent.children if best.parent is not None else ():
        if other is best or other.cut:
            continue
        density = other.linked / max(other.chars, 1)
        if other.points and value(other) >= max(10.0, value(best) / 5) or other.name == "p" and other.chars > 80 and density < 0.25:
            other.kept = True
    return _kept(nodes, blocks)


def _kept(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> str:
    """Text of the blocks inside kept nodes."""
    for node in nodes:
        if node.parent is not None and node.parent.kept:
            node.kept = True
    return "\n\n".join(text for node, text, _ in blocks if node.kept)


def _prior(node: Node) -> float:
    own = 25.0 if node.name in ("article", "main") else 5.0 if node.name in ("div", "section", "td", "blockquote") else 0.0
    return own + (5.0 if node.marks and _MAIN.search(node.marks) else 0.0)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """``id, url, text, n_chars`` of every page."""

    @F.arrow_udf("string")
    def read(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for some in slices(html, 64) for h in some], pa.string())

    shown = [c for c in (id_col, url_col) if c]
    out = pages.select(*shown, read(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
