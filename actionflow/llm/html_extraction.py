"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is its leaf blocks in order. Each block has features of its ancestors (tags,
and the groups that words of their class, id and role belong to) and of its text;
a block is content or not. The field is trained on labelled pages and decoded by
Viterbi. No labelled pages come with the tables, so ``labelled_pages`` writes some:
invented pages in many layouts whose parts are known, ``TRAINING_PAGES`` of them,
from a fixed seed. Training takes seconds on the driver; the weights travel with
the tasks.

How well it does on layouts of real sites isn't known: it was held only against pages
of the kind it was trained on and against the articles of the ``pages`` tables.

Defined results: a null or empty page has an empty text; a page without content
blocks too; equal rows get equal texts; an empty table gives no rows; a page may
be nested as deep as it likes; other columns stay, one called like the result gives way.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionflow.llm.html_blocks import Block, Element, Node, leaf_blocks

TRAINING_PAGES = 500
STEPS = 250

# Words in class, id and role attributes by what they say of a part of a page.
GROUPS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager tabs skip hamburger",
    "ad": "ad ads adv advert adverts advertisement advertising adbox adslot banner promo promotion sponsor sponsored dfp commercial",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay warning paywall disclaimer toast announcement privacy",
    "signup": "newsletter subscribe subscription signup optin mailing",
    "side": "sidebar side rail aside widget widgets related recommended recommendations trending popular more complementary teaser teasers",
    "foot": "footer foot copyright legal colophon contentinfo bottom imprint",
    "head": "header masthead topbar logo branding top tagline banner hero",
    "comment": "comment comments commentlist disqus reply replies respond responses discussion thread reader readers feedback review reviews",
    "form": "form search searchbox login signin register contact input poll survey",
    "social": "share sharing social follow tweet facebook twitter likes buttons",
    "meta": "tags tag byline author meta date timestamp categories",
    "content": "content article articlebody post entry story main body text prose page maincontent blogpost copy",
}
GROUP_OF: dict[str, list[str]] = {}
for _group, _words in GROUPS.items():
    for _word in _words.split():
        GROUP_OF.setdefault(_word, []).append(_group)

TAGS = "article main section div p h1 h2 h3 h4 h5 h6 li ul ol table td th blockquote pre figure figcaption aside nav header footer form a button label noscript head title fieldset option dialog dl address".split()
TEXT = ("bias", "linked", "all_linked", "short", "medium", "long", "stops", "commas", "copyright", "one_word")
NAMES = [*(f"in:{t}" for t in TAGS), *(f"own:{t}" for t in TAGS), *(f"like:{g}" for g in GROUPS), "article_outside", "inside_article", "inside_main", *TEXT]
INDEX = {n: i for i, n in enumerate(NAMES)}
OUTSIDE = frozenset(["nav", "aside", "footer", "form", "dialog", "noscript", "head", "button", "option"])


#: Of a path: its features but that of its own tag, if it has an article or something outside of one, and its features in all.
State = tuple[frozenset, bool, bool, tuple[int, ...]]
START: State = (frozenset(), False, False, ())


@lru_cache(maxsize=50_000)
def _inside(state: State, e: Element) -> State:
    """The state of a path with one more element."""
    found, article, outside = state[0] | {f"in:{e.tag}"}, state[1], state[2]
    if e.tag not in ("html", "body"):  # what they are called says little of their parts
        found |= {f"like:{g}" for w in e.words for g in GROUP_OF.get(w, ())}
    if e.tag == "article" and not article:
        article = True
        found |= {"article_outside" if outside else "inside_article"}
    if e.tag == "main":
        found |= {"inside_main"}
    return found, article, outside or e.tag in OUTSIDE, tuple(sorted(INDEX[f] for f in {*found, f"own:{e.tag}"} if f in INDEX))


def path_features(node: Node | None) -> tuple[int, ...]:
    """The features of a node's path, from its parent's; each node is worked out once."""
    waiting = []
    while node is not None and node.state is None:
        waiting.append(node)
        node = node.parent
    state = START if node is None else node.state
    for n in reversed(waiting):
        state = n.state = _inside(state, n.element)
    return state[3]


def text_features(block: Block) -> dict[str, float]:
    t = block.text
    n = t.count(" ") + 1
    return {
        "bias": 1.0, "linked": block.linked, "all_linked": float(block.linked > 0.9), "short": float(n < 6), "medium": float(6 <= n < 20), "long": float(n >= 20),
        "stops": float(t[-1] in ".!?"), "commas": float("," in t), "copyright": float("©" in t), "one_word": float(n == 1),
    }


class Field:
    """Weights of a chain with two labels: 1 is content."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray, first: np.ndarray) -> None:
        self.unary, self.pair, self.first = unary, pair, first

    def scores(self, blocks: list[Block]) -> list[float]:
        """Of label 1 against 0, by block alone."""
        w = self.unary
        out = []
        for b in blocks:
            s = sum(w[i] for i in path_features(b.node))
            for name, value in text_features(b).items():
                if value:
                    s += value * w[INDEX[name]]
            out.append(float(s))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        scores = self.scores(blocks)
        v0, v1 = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for s in scores[1:]:
            a0, b0, a1, b1 = v0 + p00, v1 + p10, v0 + p01, v1 + p11
            back.append((b0 > a0, b1 > a1))
            v0, v1 = max(a0, b0), max(a1, b1) + s
        label = v1 > v0
        out = [label]
        for from0, from1 in reversed(back):
            label = from1 if label else from0
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, penalty: float = 0.0004) -> Field:
    """Maximum likelihood with forward-backward over all pages at once, by Adam steps."""
    pages = [(b, y) for b, y in pages if b]
    n, longest, k = len(pages), max(len(b) for b, _ in pages), len(NAMES)
    x = np.zeros((n, longest, k))
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest))
    for i, (blocks, labels) in enumerate(pages):
        for j, b in enumerate(blocks):
            x[i, j, list(path_features(b.node))] = 1
            for name, value in text_features(b).items():
                x[i, j, INDEX[name]] = value
        y[i, : len(labels)] = labels
        live[i, : len(labels)] = 1
    used = np.flatnonzero(live.ravel())
    flat = x.reshape(-1, k)[used].astype(np.float32)
    size = k + 6
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        pair, first = w[k : k + 4].reshape(2, 2), w[k + 4 :]
        emit = np.zeros((n, longest, 2))
        emit.reshape(-1, 2)[used, 1] = flat @ w[:k].astype(np.float32)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + pair[0], ahead[:, t - 1, 1, None] + pair[1]) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None] > 0, new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, longest, 2))
        grad = np.zeros(size)
        for t in range(longest - 2, -1, -1):
            on = live[:, t + 1, None] > 0
            nxt = emit[:, t + 1] + behind[:, t + 1]
            new = np.logaddexp(pair[:, 0][None] + nxt[:, 0, None], pair[:, 1][None] + nxt[:, 1, None])
            joint = np.exp(np.clip(ahead[:, t, :, None] + pair[None] + nxt[:, None, :] - total[:, None, None], -700, 0)) * on[:, :, None]
            seen = np.zeros((n, 2, 2))
            seen[rows, y[:, t], y[:, t + 1]] = 1
            grad[k : k + 4] += ((seen * on[:, :, None]) - joint).sum(0).ravel()
            behind[:, t] = np.where(on, new, 0)
        prob = np.exp(np.clip(ahead + behind - total[:, None, None], -700, 0))
        grad[:k] = (y - prob[:, :, 1]).ravel()[used].astype(np.float32) @ flat
        grad[k + 4 :] = np.stack([1 - y[:, 0], y[:, 0]], 1).sum(0) - prob[:, 0].sum(0)
        grad = grad / n - penalty * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w[:k].copy(), w[k : k + 4].reshape(2, 2).copy(), w[k + 4 :].copy())


class _Page:
    """Writes an invented page; content texts carry a mark, by which its blocks are labelled."""

    MARK = "⁠"

    def __init__(self, r: random.Random) -> None:
        self.r = r

    def words(self, least: int, most: int) -> str:
        r = self.r
        style = r.random()
        out = ["".join(r.choice("ka lo mi ten ra vu sel po ri ano".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        if style < 0.1:
            out = [w + r.choice(["###", "%%%", "$$$", "&amp;&amp;"]) for w in out]
        elif style < 0.17:
            return " | ".join(out)
        elif style < 0.24:
            return " ".join(w.upper() + "!!" for w in out)
        text = " ".join(w + ("," if r.random() < 0.1 else "") for w in out)
        return text.capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def names(self, *options: str) -> str:
        pick = self.r.choice(options)
        return f' {self.r.choice(["class", "class", "id"])}="{pick}"' if pick else ""

    def wrap(self, tag: str, inside: str, names: str = "") -> str:
        return f"<{tag}{names}>{inside}</{tag}>"

    def paragraph(self, own: bool) -> str:
        r, mark = self.r, self.MARK if own else ""
        text = mark + self.words(1, r.choice([3, 8, 25, 80]))
        if r.random() < 0.15:
            text += " " + self.link(self.words(1, 4)) + " " + self.words(1, 8)
        if r.random() < 0.03:
            text = mark + self.link(self.words(1, 6))
        if r.random() < 0.1:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f"<em>{text}</em>"
        return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = self.wrap("h1", self.MARK + self.words(2, 10))
            out.append(self.wrap("header", title) if r.random() < 0.12 else title)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                out.append(self.paragraph(True))
            elif kind < 0.8:
                out.append(self.wrap(r.choice(["h2", "h3", "h4"]), self.MARK + self.words(1, 7)))
            elif kind < 0.86:
                out.append(self.wrap(r.choice(["ul", "ol"]), "".join(self.wrap("li", self.MARK + self.words(1, 15)) for _ in range(r.randint(1, 5)))))
            elif kind < 0.9:
                out.append(self.wrap("blockquote", self.paragraph(True)))
            elif kind < 0.93:
                out.append(self.wrap("table", "".join(self.wrap("tr", self.wrap("td", self.MARK + self.words(1, 3)) * 2) for _ in range(r.randint(1, 4)))))
            elif kind < 0.95:
                out.append(self.wrap(r.choice(["pre", "figcaption", "div"]), self.MARK + self.words(2, 20)))
            else:
                out.append(self.other(inside=True))
        return "".join(out)

    def other(self, inside: bool = False) -> str:
        """A part that isn't content."""
        r = self.r
        some = lambda least, most: "".join(self.paragraph(False) for _ in range(r.randint(least, most)))
        text = lambda: r.choice([self.words(1, 6), self.words(5, 40), some(1, 3)])
        div = lambda *names: self.wrap(r.choice(["div", "div", "section"]), text(), self.names(*names))
        menu = self.wrap("ul", "".join(self.wrap("li", self.link(self.words(1, 2))) for _ in range(r.randint(2, 8))))
        comment = lambda: self.wrap(r.choice(["div", "li", "article", "p"]), text(), self.names("comment", "reply", "comment-body", "comment"))
        kinds = [
            lambda: self.wrap("nav", r.choice([menu, self.link(self.words(1, 3)) * 2, some(1, 2)])),
            lambda: self.wrap("div", r.choice([menu, text()]), self.names("menu", "main-menu", "navbar", "breadcrumbs", "nav-links", "page-nav", "pagination")),
            lambda: div("ad", "ads", "advert", "ad-slot", "banner-ad", "sponsored", "promo", "content-ad", "advertisement"),
            lambda: div("cookie-notice", "cookie-banner", "notice", "gdpr", "consent", "alert", "popup", "site-notice", "paywall"),
            lambda: self.wrap("div", text(), r.choice([' role="alert"', ' role="dialog" class="modal"'])),
            lambda: div("newsletter", "subscribe-box", "signup"),
            lambda: self.wrap("aside", r.choice([text(), menu, self.wrap("article", some(1, 2)), self.wrap("h3", self.words(1, 4)) + text()]), self.names("", "sidebar", "related")),
            lambda: div("sidebar", "related-posts", "right-rail", "widget", "recommended", "trending"),
            lambda: self.wrap(r.choice(["div", "section"]), self.wrap("h3", self.words(1, 3)) + "".join(comment() for _ in range(r.randint(1, 6))), self.names("comments", "comment-list", "post-comments", "discussion", "reader-comments", "responses")),
            lambda: self.wrap("form", r.choice([self.wrap("label", self.words(1, 3)) + "<input><button>Go</button>", text(), self.wrap("p", self.words(2, 10)) + "<textarea>x</textarea>"])),
            lambda: div("search-form", "login", "contact-form", "poll"),
            lambda: self.wrap("div", r.choice([self.link(self.words(1, 2)) * 3, text()]), self.names("share", "social-links", "share-buttons")),
            lambda: self.wrap("noscript", self.words(3, 9)),
            lambda: f"<script>var t='<p>{self.words(1, 4)}</p>';</script><style>p{{margin:0}}</style><!-- {self.words(1, 4)} -->",
        ]
        edge = [
            lambda: self.wrap("header", r.choice([self.words(1, 8), self.wrap("h2", self.words(1, 4)) + menu, self.link(self.words(1, 3)), self.wrap("h1", self.link(self.words(1, 3))), text()]), self.names("", "site-header", "masthead")),
            lambda: self.wrap("footer", r.choice([f"&copy; {self.words(2, 12)}", menu, some(1, 3), text()]), self.names("", "site-footer")),
            lambda: div("footer", "site-footer", "copyright", "header", "masthead", "topbar", "page-header", "page-footer"),
        ]
        if inside:
            edge = [lambda: self.wrap("footer", r.choice([self.words(2, 12), text()]))]
        return r.choice(kinds + edge * 2)()

    def html(self) -> str:
        r = self.r
        inner = self.content()
        kind = r.random()
        if kind < 0.55:
            inner = self.wrap("article", inner, self.names("", "", "post", "story", "article"))
            if r.random() < 0.3:
                inner = self.wrap("main", inner)
        elif kind < 0.7:
            inner = self.wrap("main", inner, self.names("", "content", "main"))
        elif kind < 0.9:
            inner = self.wrap("div", inner, self.names("content", "post", "entry-content", "article-body", "main-content", "story-text", "post-body", "page-content"))
        else:
            inner = self.wrap("div", "".join(self.wrap("p", self.MARK + self.words(20, 80)) for _ in range(r.randint(2, 8))))
        before = "".join(self.other() for _ in range(r.randint(0, 4)))
        after = "".join(self.other() for _ in range(r.randint(0, 4)))
        body = before + inner + after
        if r.random() < 0.3:
            body = self.wrap("div", body, self.names("", "page", "wrapper", "container"))
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled_pages(many: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    page = _Page(random.Random(seed))
    out = []
    for _ in range(many):
        blocks = leaf_blocks(page.html())
        labels = [_Page.MARK in b.text for b in blocks]
        out.append(([Block(b.text.replace(_Page.MARK, ""), b.node, b.linked) for b in blocks], labels))
    return [([b for b in bs if b.text], [y for b, y in zip(bs, ys, strict=True) if b.text]) for bs, ys in out]


@lru_cache(maxsize=2)
def trained(many: int = TRAINING_PAGES, steps: int = STEPS) -> Field:
    return train(labelled_pages(many), steps)


def main_text(field: Field, html: str) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, own in zip(blocks, field.decode(blocks), strict=True) if own)


def extracted(html: Column, field: Field | None = None) -> Column:
    field = field or trained()

    @F.arrow_udf(T.StringType())
    def text_of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(field, x.as_py() or "") for x in html], pa.string())

    return text_of(html)


def labelled_blocks(html: Column, field: Field | None = None) -> Column:
    """Every block of a page with its label, for looking into a result."""
    field = field or trained()
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.BooleanType())]))

    @F.arrow_udf(kind)
    def blocks_of(html: pa.Array) -> pa.Array:
        out = []
        for x in html:
            blocks = leaf_blocks(x.as_py() or "")
            out.append([{"path": "/".join(e.tag for e in b.path), "text": b.text, "content": own} for b, own in zip(blocks, field.decode(blocks), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("content", pa.bool_())])))

    return blocks_of(html)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    return pages.withColumn(text, extracted(F.col(f"`{html}`")))
