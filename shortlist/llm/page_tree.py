"""Pages as trees of block elements, for the main-text model (operator 7)."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"\s+")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and never text of a page; without an end tag they go on to the end of the page.
RAW = frozenset("script style textarea title".split())
#: Elements whose content is markup, but never text of a page; they end with their parent at the latest.
HIDDEN = frozenset("noscript template iframe svg select object audio video canvas button option optgroup annotation annotation-xml".split())
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr br img picture source map area "
                   "math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable "
                   "mtr mtd mstyle mpadded mphantom merror menclose mfenced mmultiscripts mprescripts none".split())
#: A start tag of the first ends open elements of the second, down to one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


@dataclass
class Page:
    """Nodes in page order (0 is the page itself) and the text blocks that stand directly in them."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    marks: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(text: str) -> Page:
    """Lenient: paragraphs, items and cells end where the next begins, stray end tags are passed over.

    A hidden element goes with all in it if it has its end tag. One that ends with its parent or the page hides only its
    own words: the elements in it are those of the parent.
    """
    page = Page()
    stack: list[tuple[str, int, tuple | None]] = [("#page", 0, None)]       # name, node, what stood before a hidden element
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def block(node: int) -> list[tuple[int, str, int]]:
        words = BLANKS.sub(" ", html.unescape("".join(parts))).strip()
        return [(node, words, min(linked, len(words)))] if words else []

    def flush() -> None:
        nonlocal linked
        if parts:
            if stack[-1][2] is None:
                page.blocks.extend(block(stack[-1][1]))
            parts.clear()
        linked = 0

    def end(names, until, own=False) -> None:
        nonlocal linked, in_link
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                break
            if stack[k][0] in until:
                return
        else:
            return
        flush()
        close(k + own * (stack[k][2] is not None))
        if len(stack) > k:
            _, _, (n_tags, n_blocks, before, linked, in_link) = stack.pop()
            for column in (page.tags, page.marks, page.parents, page.depths):
                del column[n_tags:]
            del page.blocks[n_blocks:]
            parts[:] = before

    def close(k: int) -> None:
        """Ends the elements from the k-th on; what stood before an unclosed hidden one is a block of its parent."""
        nonlocal linked
        while len(stack) > k:
            _, node, state = stack.pop()
            if state is not None:
                parts[:], linked = state[2], state[3]
                if stack[-1][2] is None:
                    page.blocks[state[1]:state[1]] = block(node)
                parts.clear()
        linked = 0

    while True:
        found = TOKEN.search(text, at)
        piece = text[at:found.start()] if found else text[at:]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                done = RAW_END[name].search(text, at)
                at = done.end() if done else len(text)
            continue
        if name in HIDDEN:
            if closing:
                end({name}, (), own=True)
            elif not attributes.endswith("/"):
                stack.append((name, stack[-1][1], (len(page.tags), len(page.blocks), parts[:], linked, in_link)))
                parts.clear()
                linked = 0
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
            continue
        if closing:
            end({name}, ())
            continue
        flush()
        in_link = False
        if name in VOID:
            continue
        end({"p"}, {"td", "th", "#page"} | HIDDEN)
        if name in ENDS:
            end(ENDS[name][0], ENDS[name][1] | (HIDDEN if name != "body" else set()))
        page.tags.append(name)
        page.marks.append(attributes)
        page.parents.append(stack[-1][1])
        page.depths.append(page.depths[stack[-1][1]] + 1)
        stack.append((name, len(page.tags) - 1, None))
    flush()
    close(1)
    return page


def names_of(attributes: str) -> tuple[list[str], dict[str, str]]:
    """Words of class, id and role, and all attributes."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    words = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()) if w], found
