"""HTML extraction by tree scoring.

Method: a tolerant reader builds the tree of a page and drops what cannot be part of the article
(menus, headers and footers of the site, asides, forms, notices, adverts, reader comments, scripts, hidden
parts). A part that only its class or id speaks against stays if another class names it content, if the name tells
of the layout (has-sidebar, share-enabled), or if the page's article, main element or heading stands in it. Every block of text passes points for its length and commas to itself, if it is a container, and
to its ancestors, less the further away they are. Scores are discounted by link density. The
best container is kept with those of its siblings that score like it or read like paragraphs; if it stands in an article
element, that article is kept with the other text parts of the main element around it, if there is one. Headings, and
paragraphs and the like unless a class of theirs says nothing else, are not judged by name inside an article; an id that repeats
the first words of its element is an anchor. An article named a comment or an advert is one, unless it is all there is.
Text is given block by block in page order; of equal scores the container reached first in page order is the best.

Null and empty html, and pages without text of their own, give an empty text. Rows are independent, so
repeated rows give repeated results and an empty table an empty one. Unclosed and
misnested tags are closed where a browser would close them, a tag that never ends is text; depth and
length are not limited. All input columns are kept; one named like an output is replaced.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.grams import slices

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
FORM_END = re.compile(r"</form", re.I)
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Element names of HTML by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    caption option""".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option legend".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog embed footer head iframe input link map menu meta nav noembed noframes
    noscript object option script select style svg template textarea title video xmp""".split())
CONTAINER = frozenset("article main section div td html body blockquote form".split())
# What an element of one of these names closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
# Words of class and id names, chosen for this module.
UNLIKELY = frozenset("""ad ads adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion
    banner cookie cookies consent gdpr notice notices alert popup popover modal overlay lightbox paywall sidebar sidebars aside rail widget widgets
    menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead footer foot header comment comments commentlist disqus
    discussion respond reply replies share sharing shares social related recommended recommendations newsletter subscribe
    subscription signup login register search searchbox pagination pager skip hidden copyright disclaimer""".split())
LIKELY = frozenset("article content entry story post text body main".split())
PARTS = frozenset("p ul ol dl blockquote pre table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p li dt dd blockquote pre td th figure figcaption span em strong b i code".split())
# Words after which, and before which, a name tells what a layout has or lacks.
MODIFIERS = frozenset("has no with without".split())
STATES = frozenset("enabled disabled open closed".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "parent", "items", "likely", "named", "slug", "chars", "linked", "score", "size", "longest", "holds")

    def __init__(self, tag: str, parent: Node | None, likely: bool = False, named: str = ""):
        self.tag, self.parent, self.likely, self.named = tag, parent, likely, named
        self.slug: list[str] = []  # words of an id that alone speaks against the element
        self.items: list[Node | str] = []
        self.chars = self.linked = 0
        self.score = 0.0
        self.size = self.longest = 0  # unlinked characters, also of the longest article inside
        self.holds = tag in ("main", "h1") and {tag} or set()


def names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for key in ("class", "id") for w in NAME.findall(attributes.get(key, ""))}


def attributes_of(text: str) -> dict[str, str]:
    return {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(text)} if text.strip("/ \t\r\n") else {}


def unwanted(tag: str, attributes: dict[str, str], within: bool) -> bool:
    """``within``: inside an article or main element."""
    if tag in DROPPED or tag == "header" and not within:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    return False


def judged(tag: str, attributes: dict[str, str], within: bool) -> str:
    """What the names say: "" nothing, "named" not of the article, "doubtful" both in one name, "id" not of the article by
    the id alone.  ``within``: inside an article or main element."""
    if tag in ("html", "body", "main") or tag in HEADINGS and within or not names(attributes) & UNLIKELY:
        return ""
    if within and tag in TEXTUAL:  # part of a text unless a class says nothing else
        said = [[w.lower() for w in NAME.findall(c)] for c in attributes.get("class", "").split()]
        return "named" if any(words and UNLIKELY.issuperset(words) for words in said) else ""
    bad, likely, apart, by_class = set(), False, False, False
    for key in ("class", "id"):
        for name in attributes.get(key, "").split():
            words = [w.lower() for w in NAME.findall(name)]
            words = words[:next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
            if words and words[-1] in STATES:
                continue
            bad |= UNLIKELY.intersection(words)
            by_class = by_class or key == "class" and bool(UNLIKELY.intersection(words))
            if LIKELY.intersection(words):
                likely = True
                apart = apart or not UNLIKELY.intersection(words)
    if not bad or apart or bad <= {"header", "alert"} and likely:
        return ""
    return "doubtful" if likely else "named" if by_class else "id"


def tree(page: str) -> Node:
    root = here = Node("html", None)
    open_tags = {"html": 1}  # how often each name is open
    named = False
    pos, end = 0, len(page)

    def leave(upto: Node) -> Node:
        """Closes ``here`` up to and including ``upto``."""
        node = here
        while True:
            open_tags[node.tag] -= 1
            if node is upto:
                return node.parent or root
            node = node.parent

    def holder(tags: set[str], stop: set[str] | frozenset[str]) -> Node | None:
        """The outermost of the open elements of these names before one of ``stop``."""
        found, node = None, here
        while node is not root and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        return found

    while pos < end:
        at = page.find("<", pos)
        at = end if at < 0 else at
        if at > pos:
            here.items.append(page[pos:at])
        if at == end:
            break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            pos = end if stop < 0 else stop + 3
            continue
        if page[at + 1:at + 2] in ("!", "?"):
            stop = page.find(">", at)
            pos = end if stop < 0 else stop + 1
            continue
        m = TAG.match(page, at) or LOOSE.match(page, at)
        if m is None:
            here.items.append("<")
            pos = at + 1
            continue
        pos, closing, tag = m.end(), m[1], m[2].lower()
        if closing:
            if open_tags.get(tag) and tag not in ("html", "body"):
                node, inline = here, tag not in BLOCK and tag not in DROPPED
                while node is not root and node.tag != tag and not (inline and node.tag in BLOCK):
                    node = node.parent
                if node is not root and node.tag == tag:
                    here = leave(node)
            continue
        if tag in RAW:  # its content is no markup
            stop = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, pos)
            pos = end if stop is None else stop.end()
            continue
        alone = tag in VOID or m[3].endswith("/") and tag not in BLOCK
        if here.tag == "head" and tag not in HEAD:
            here = leave(here)
        if tag in ("html", "body") or alone and tag != "br":
            if tag == "hr":
                here.items.append(Node("hr", here))
            continue
        if tag == "br":
            here.items.append(" ")
            continue
        if tag in ENDS_P and open_tags.get("p") and (p := holder({"p"}, {"td", "th", "table", "button"})):
            here = leave(p)
        if tag in CLOSES and (old := holder(*CLOSES[tag])):
            here = leave(old)
        attributes = attributes_of(m[3])
        within = bool(open_tags.get("article") or open_tags.get("main"))
        drop = unwanted(tag, attributes, within)
        if tag == "form" and not drop:  # some sites put the whole page into one
            stop = FORM_END.search(page, pos)
            drop = not re.search(r"<(?:article|main|h1)[\s>]", page[pos:stop.start() if stop else end], re.I)
        node = Node(tag, here, bool(attributes) and bool(names(attributes) & LIKELY), judged(tag, attributes, within) if attributes else "")
        if node.named == "id":
            node.slug = [w.lower() for w in NAME.findall(attributes["id"])]
        if not drop:
            here.items.append(node)
            named = named or bool(node.named)
        elif tag in BLOCK:
            here.items.append(Node("hr", here))  # text on both sides is not one block
        here = node
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if named:
        settle(root)
    return root


def settle(root: Node) -> None:
    """Empties the elements that their names speak against, unless the article must be in them. Outer ones are
    settled first; what of the page stands in none that is left unsettled, is free."""
    links, waiting = 0, []
    for node, begins, text in in_order(root):
        if text is not None:
            node.size += 0 if links else len(text.strip())
            if waiting and text.strip():  # an id that repeats the first words of its element is an anchor
                words = [w.lower() for w in NAME.findall(text)]
                for x in waiting:
                    if words[:len(x.slug)] == x.slug:
                        x.named = ""
                waiting.clear()
            continue
        links += (1 if begins else -1) * (node.tag == "a")
        if begins and node.slug:
            waiting.append(node)
        if not begins and node.parent is not None:
            up = node.parent
            up.size += node.size
            up.longest = max(up.longest, node.longest, node.size if node.tag == "article" and not node.named else 0)
            up.holds |= node.holds
    longest, headed, level = 0, False, [root]
    while level:
        outer, stack = [], level
        while stack:
            for x in stack.pop().items:
                if isinstance(x, str):
                    continue
                if x.named:
                    outer.append(x)
                    continue
                longest = max(longest, x.size if x.tag == "article" else 0)
                headed = headed or x.tag == "h1"
                stack.append(x)
        level = []
        for x in outer:
            most = 2 * x.size > root.size
            if "main" in x.holds or x.longest > longest or x.tag == "article" and not longest and most or "h1" in x.holds and (most or not headed) or x.named == "doubtful" and most:
                level.append(x)
            else:
                x.items, x.tag = [], "hr" if x.tag in BLOCK else x.tag
        for x in level:
            x.named = ""
            headed = headed or x.tag == "h1"


def in_order(root: Node) -> Iterator[tuple[Node, bool, str | None]]:
    """Element starts (node, True), element ends (node, False) and texts, without recursion."""
    stack: list[tuple[Node, Iterator]] = [(root, iter(root.items))]
    yield root, True, None
    while stack:
        node, items = stack[-1]
        for x in items:
            if isinstance(x, str):
                yield node, True, x
            else:
                yield x, True, None
                stack.append((x, iter(x.items)))
                break
        else:
            stack.pop()
            yield node, False, None


def blocks(root: Node) -> list[tuple[Node, str]]:
    """Texts of the blocks under a node in page order, each with the block element it stands in."""
    out, parts, owner = [], [], [root]

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((owner[-1], text))

    for node, begins, text in in_order(root):
        if text is not None:
            parts.append(text)
        elif node.tag in BLOCK:
            flush()
            if begins:
                owner.append(node)
            else:
                owner.pop()
    flush()
    return out


def lineage(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def score(root: Node) -> Node | None:
    """Passes the points up; the best container."""
    links = 0
    for node, begins, text in in_order(root):
        if text is None:
            links += (1 if begins else -1) * (node.tag == "a")
        else:
            n = len(text) - text.count(" ")
            node.chars += n
            node.linked += n if links else 0
        if not begins and node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    reached: list[Node] = []
    for owner, text in blocks(root):
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        for level, node in enumerate(lineage(owner)):
            if level == 0 and node.tag not in CONTAINER:
                continue
            if not node.score:
                reached.append(node)
                node.score = {"article": 10.0, "main": 8.0}.get(node.tag, 0.0) + 5.0 * node.likely
            node.score += points if level < 2 else points / 2 if level == 2 else points / (3 * level)
    if not reached:
        return None
    return max(reached, key=lambda x: x.score * (1 - x.linked / max(x.chars, 1)))


def widened(article: Node) -> list[Node]:
    """The article with the other text parts of the main element around it, if there is one, in page order."""
    above = [x for x in lineage(article) if x.tag == "main"]
    parts, node = [article], article
    while above and node is not above[-1]:
        level = []
        for x in node.parent.items:
            if x is node:
                level += parts
            elif isinstance(x, Node) and x.tag != "article" and (x.tag in CONTAINER or x.tag in HEADINGS or x.tag in PARTS) and x.linked < 0.25 * x.chars:
                level.append(x)
        parts, node = level, node.parent
    return parts


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    best = score(root)
    if best is None:
        return ""
    articles, mains = ([x for x in lineage(best) if x.tag == tag] for tag in ("article", "main"))
    if articles:
        return "\n".join(t for x in widened(articles[-1]) for _, t in blocks(x))
    if mains or best.parent is None:
        return "\n".join(t for _, t in blocks(mains[-1] if mains else best))
    least = max(5.0, 0.2 * best.score)
    keep = []
    for x in best.parent.items:
        if x is best:
            keep.append(x)
        elif isinstance(x, Node):
            density, text = x.linked / max(x.chars, 1), None
            if x.tag in ("p", "h1", "blockquote", "pre", "ul", "ol"):
                text = " ".join(t for _, t in blocks(x))
            if x.tag in CONTAINER and x.score >= least and density < 0.25 or text and (
                    x.tag == "h1" or len(text) > 80 and density < 0.25 or density == 0 and re.search(r"[.!?]($|\s)", text)):
                keep.append(x)
    return "\n".join(t for x in keep for _, t in blocks(x))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``, the main text of every page, and n_chars, its code points."""
    fields = [f for f in pages.schema.fields if f.name not in (out, "n_chars")]
    kept = [f.name for f in fields] + [out, "n_chars"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column(html)):
                b = whole.slice(lo, hi - lo)
                texts = [main_text(t.as_py()) for t in b.column(html)]
                cols = {c: b.column(c) for c in b.schema.names} | {out: pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in kept], names=kept)

    return pages.mapInArrow(run, schema)
