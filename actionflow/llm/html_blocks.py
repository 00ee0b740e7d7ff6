"""HTML as a sequence of leaf blocks: runs of text inside one innermost block element."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Fixed values, from the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes textarea".split())  # text up to their end tag, whatever it looks like; none of it is shown
SHOWN_RAW = "xmp"  # its text is shown as it stands
NESTED = frozenset(["template", "svg"])  # inert or drawn, and may hold one another
TRACKED_INLINE = frozenset("a button label noscript".split())
CLOSED_BY_BLOCK = frozenset(BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()))
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

MARK = re.compile(r"<(?:!--(?:(?s:.)*?--!?>|>|->|(?s:.)*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))")
NAMES = re.compile(r"(?:^|[\s'\"/])(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
CACHED_CHARS = 300  # of an element's attributes


@dataclass(frozen=True)
class Element:
    tag: str
    words: tuple[str, ...]  # of class, id, role


class Node:
    """An element on the way from the root: all blocks inside it share it, so deep pages take no more memory than they have tags."""

    __slots__ = ("element", "parent", "state")

    def __init__(self, element: Element, parent: Node | None) -> None:
        self.element, self.parent, self.state = element, parent, None


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost element
    linked: float  # share of the characters that are in links

    @property
    def path(self) -> tuple[Element, ...]:
        """The elements around it, outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append(node.element)
            node = node.parent
        return tuple(reversed(out))


def _read(tag: str, attributes: str) -> Element:
    words: list[str] = []
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            words += [w.lower() for w in PIECES.findall(unescape(m[2] or m[3] or m[4] or ""))]
    return Element(tag, tuple(dict.fromkeys(words)))


_read_short = lru_cache(maxsize=20_000)(_read)


def _element(tag: str, attributes: str) -> Element:
    return _read_short(tag, attributes) if len(attributes) <= CACHED_CHARS else _read(tag, attributes)


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


@lru_cache(maxsize=8)
def _edges_of(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?=[\s/>])((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.I)


def _behind(html: str, at: int, tag: str) -> int:
    """Where a nested element that starts before ``at`` ends."""
    depth = 1
    for m in _edges_of(tag).finditer(html, at):
        if m[1]:
            depth -= 1
        elif not m[2].endswith("/") or tag == "template":  # <svg/> is closed at once
            depth += 1
        if not depth:
            return m.end()
    return len(html)


def leaf_blocks(html: str) -> list[Block]:
    """In page order, without blank ones; references decoded, white space single, markup gone.

    Only what browsers never show as text is left out: scripts, styles, frames, inert
    templates, drawings and what is typed into a form. Formulas, listings and the
    fallback inside objects and media are text like any other.
    """
    out: list[Block] = []
    stack: list[Node] = []
    open_ = Counter()  # elements on the stack by tag
    held: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal held, linked
        if held:
            whole = "".join(held)
            text = " ".join((unescape(whole) if "&" in whole else whole).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(1.0, linked / max(1, len(whole)))))
            held, linked = [], 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if open_["a"]:
            linked += len(text)

    def close(k: int) -> None:
        end_block()
        for node in stack[k:]:
            open_[node.element.tag] -= 1
        del stack[k:]

    def push(tag: str, attributes: str) -> None:
        open_[tag] += 1
        stack.append(Node(_element(tag, attributes), stack[-1] if stack else None))

    def innermost(tag: str) -> int:
        """Its place on the stack, -1 if it isn't there."""
        if not open_[tag]:
            return -1
        k = len(stack) - 1
        while stack[k].element.tag != tag:
            k -= 1
        return k

    at = 0
    while (m := MARK.search(html, at)) is not None:
        if m.start() > at:
            hold(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCKS:
                k = innermost(tag)
                if k >= 0:
                    close(k)
                elif tag == "p":  # makes an empty paragraph
                    end_block()
            elif tag in TRACKED_INLINE and open_[tag]:
                k = len(stack) - 1
                while stack[k].element.tag != tag and stack[k].element.tag not in BLOCKS:
                    k -= 1
                if stack[k].element.tag == tag:
                    if tag in ("button", "noscript"):
                        end_block()
                    rest = [n.element for n in stack[k + 1 :]]
                    del stack[k:]
                    open_[tag] -= 1
                    for e in rest:  # stay open, now without it around them
                        stack.append(Node(e, stack[-1] if stack else None))
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW or tag == SHOWN_RAW:
            end = _end_of(tag).search(html, at)
            if tag == SHOWN_RAW:
                end_block()
                hold(html[at : end.start() if end else len(html)].replace("&", "&amp;"))  # no references in it
                end_block()
            at = end.end() if end else len(html)
            continue
        if tag in NESTED:
            if tag == "template" or not attributes.endswith("/"):
                at = _behind(html, at, tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag in BLOCKS:
            end_block()
            if stack and stack[-1].element.tag in TRACKED_INLINE - {"noscript"}:
                k = len(stack)
                while k and stack[k - 1].element.tag in TRACKED_INLINE - {"noscript"}:
                    k -= 1
                if k and stack[k - 1].element.tag == "p" and tag in CLOSED_BY_BLOCK:
                    close(k)
            if tag in CLOSED_BY_BLOCK and stack and stack[-1].element.tag == "p":
                close(len(stack) - 1)
            elif tag in SAME_LEVEL:
                if any(open_[t] for t in SAME_LEVEL[tag]):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].element.tag in SAME_LEVEL[tag]:
                            close(i)
                            break
                        if stack[i].element.tag in SCOPES[tag]:
                            break
            elif tag == "body":
                k = innermost("head")
                if k >= 0:
                    close(k)
            push(tag, attributes)
        elif tag in TRACKED_INLINE:
            if tag in ("button", "noscript"):
                end_block()
            push(tag, attributes)
    if at < len(html):
        hold(html[at:])
    end_block()
    return out
