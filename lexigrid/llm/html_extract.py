"""Main-text extraction by a tree-structured graphical model (operator 7).

Every element of the parsed page is a node with two states, content or not. A node has unary weights by
its tag, its class words and its text, and each parent-child pair a two-by-two potential by the kind of
child. The unary weight of a child that nothing marks is divided by the number of such children of its
parent, so that they say together what one says and many short paragraphs don't outvote their article.
Sum-product messages pass upward, then downward, and give each node's content marginal. Weights are
trained on labelled pages by the exact likelihood gradient (expected minus observed features).
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import text_function

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of these closes an open p; others close an open tag of their own group.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
LISTS = frozenset("ul ol dl table select menu".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=\"'/>]+)")
SPACE = re.compile(r"\s+")

GROUPS = {
    "article": "article main", "section": "section div center", "p": "p", "h": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd",
    "quote": "blockquote pre q figure figcaption table tbody thead tr td th caption details summary", "link": "a", "inline": " ".join(sorted(INLINE - {"a", "label"})),
    "nav": "nav menu", "header": "header", "footer": "footer address", "aside": "aside dialog", "form": "form input button select option label textarea fieldset legend",
    "raw": "script style noscript template iframe svg canvas object embed xmp noembed noframes", "head": "head title meta link base", "root": "html body",
}
GROUP = {t: g for g, tags in GROUPS.items() for t in tags.split()}
HINTS = {
    "h_main": "article content post entry main story text body prose", "h_nav": "nav menu navigation breadcrumb breadcrumbs toc pagination pager skip", "h_head": "header masthead topbar banner logo",
    "h_foot": "footer foot copyright legal", "h_side": "sidebar side aside widget related recommended rail more trending popular", "h_ad": "ad ads advert advertisement adverts sponsor sponsored promo promoted adsense",
    "h_comment": "comment comments reply replies discussion disqus respond feedback", "h_notice": "notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription paywall",
    "h_share": "share social sharing tags meta byline", "h_form": "form search login signup contact",
}
HINT = {w: g for g, words in HINTS.items() for w in words.split()}
FEATURES = ["bias", *(f"t_{g}" for g in GROUPS), "t_other", *HINTS, "hidden", "text0", "text_short", "text_long", "links"]
AT = {f: k for k, f in enumerate(FEATURES)}
EDGES = 4  # kinds of child: block, inline, what opens content, what closes it
OPENS = frozenset(AT[f] for f in ("t_article", "h_main"))
CLOSES_IT = frozenset(AT[f] for f in ("t_nav", "t_header", "t_footer", "t_aside", "t_form", "t_raw", "t_head", "hidden", *HINTS) if f != "h_main")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "own", "linked")

    def __init__(self, tag: str, attrs: str, parent: int) -> None:
        self.tag, self.attrs, self.parent, self.children, self.own, self.linked = tag, attrs, parent, [], 0, 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in order of their start tags (0 is the root), and the page's parts: (node, text), or None for a start or end of a block."""
    nodes, parts = [Node("html", "", -1)], []
    stack, at, n = [0], 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    opened: Counter = Counter()  # elements on the stack by name

    def text(raw: str) -> None:
        if raw:
            parts.append((stack[-1], html.unescape(raw)))

    def pop(to: int) -> None:
        for k in stack[to:]:
            opened[nodes[k].tag] -= 1
            if nodes[k].tag not in INLINE:
                parts.append((k, None))
        del stack[to:]

    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        if m is None:
            comment = page.find("<!--", at)
            text(page[at : comment if comment >= 0 else n])
            break
        text(page[at : m.start()])
        at = m.end()
        if at == last and page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
            break  # a comment that doesn't end
        close, tag, attrs = m[1], m[2] or m[4], m[3] if m[2] else m[5]
        if close:
            close = close.lower()
            for k in () if not opened[close] else range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == close:
                    pop(k)
                    break
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "html":
            nodes[0].attrs = attrs or ""
            continue
        closing = CLOSES.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if closing and any(opened[t] for t in closing):
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in closing:
                    pop(k)
                    break
                if t in LISTS or t in CLOSES_P and t != "p" and "p" in closing:
                    break
        if tag not in INLINE:
            parts.append((stack[-1], None))
        nodes.append(Node(tag, attrs or "", stack[-1]))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag == "br":
            parts.append((stack[-1], " "))
        if tag in VOID or (attrs or "").endswith("/"):
            continue
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text(page[at : end.start() if end else n])
            at = end.end() if end else n
            pop(len(stack) - 1)
    pop(0)
    for k, piece in parts:
        if piece:
            size = len(piece.strip())
            nodes[k].own += size
            if nodes[k].tag == "a":
                nodes[k].linked += size
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag in INLINE:  # a block's text holds that of its inline parts
            nodes[nodes[k].parent].own += nodes[k].own
        nodes[nodes[k].parent].linked += nodes[k].linked
    return nodes, parts


def features(node: Node) -> list[int]:
    """Indices of a node's features."""
    out = [0, AT[f"t_{GROUP.get(node.tag, 'other')}"] if node.tag in GROUP else AT["t_other"]]
    if node.attrs:
        for m in ATTRIBUTE.finditer(node.attrs):
            name, value = (m[1] or m[3]).lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
                out += {AT[HINT[w]] for w in re.split(r"[^a-z]+", value) if w in HINT}
            elif name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append(AT["hidden"])
    out.append(AT["text0" if not node.own else "text_short" if node.own < 25 else "text_long"])
    if node.own and node.linked > node.own / 2:
        out.append(AT["links"])
    return out


def kind(node: Node, own: list[int]) -> int:
    """The kind of child that a node with these features is."""
    if not CLOSES_IT.isdisjoint(own):
        return 3
    return 2 if not OPENS.isdisjoint(own) else 1 if node.tag in INLINE else 0


def shares(nodes: list[Node], kinds: list[int]) -> list[float]:
    """Of each node the factor of its unary weight: one, but for children that nothing marks one divided by their number."""
    count = Counter(x.parent for x, kind in zip(nodes, kinds, strict=True) if kind < 2)
    return [1.0 / count[x.parent] if kind < 2 else 1.0 for x, kind in zip(nodes, kinds, strict=True)]


class Model:
    """Weights of content against other, (features,), and log potentials of pairs, (kinds, parent, child)."""

    def __init__(self) -> None:
        self.w, self.e = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))

    def marginals(self, nodes: list[Node], unary: list[float], kinds: list[int]) -> tuple[list[float], list]:
        """Content marginals, and for each node but the root the 2x2 marginal of (parent, node)."""
        n = len(nodes)
        f = [[[float(x) for x in row] for row in np.exp(kind)] for kind in self.e]
        own = [(1.0, float(np.exp(min(30.0, max(-30.0, u))))) for u in unary]
        below = [list(x) for x in own]  # node's potential times its children's messages
        up: list = [None] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            b, g = below[k], f[kinds[k]]
            m0, m1 = g[0][0] * b[0] + g[0][1] * b[1], g[1][0] * b[0] + g[1][1] * b[1]
            s = m0 + m1
            up[k] = (m0 / s, m1 / s)
            p = below[nodes[k].parent]
            p[0] *= up[k][0]
            p[1] *= up[k][1]
            if p[0] + p[1] < 1e-200:
                p[0] *= 1e200
                p[1] *= 1e200
        belief, pairs = [list(b) for b in below], [None] * n
        for k in range(1, n):
            p, g, b = belief[nodes[k].parent], f[kinds[k]], below[k]
            c0, c1 = p[0] / max(up[k][0], 1e-300), p[1] / max(up[k][1], 1e-300)  # all that reaches the parent but from k
            q = [[c0 * g[0][0] * b[0], c0 * g[0][1] * b[1]], [c1 * g[1][0] * b[0], c1 * g[1][1] * b[1]]]
            s = q[0][0] + q[0][1] + q[1][0] + q[1][1]
            pairs[k] = [[x / s for x in row] for row in q]
            belief[k] = [pairs[k][0][0] + pairs[k][1][0], pairs[k][0][1] + pairs[k][1][1]]
        return [b[1] / (b[0] + b[1]) for b in belief], pairs

    def of_page(self, page: str) -> tuple[list[float], list[tuple[int, str | None]]]:
        nodes, parts = parse(page)
        rows = [features(x) for x in nodes]
        kinds = [kind(x, r) for x, r in zip(nodes, rows, strict=True)]
        marginal, _ = self.marginals(nodes, [float(self.w[r].sum()) * s for r, s in zip(rows, shares(nodes, kinds), strict=True)], kinds)
        return marginal, parts

    def extract(self, page: str | None) -> str:
        """Blocks of content text in page order, joined by line ends."""
        if not page:
            return ""
        marginal, parts = self.of_page(page)
        blocks, now = [], []
        for k, piece in [*parts, (0, None)]:
            if piece is None:
                if block := SPACE.sub(" ", "".join(now)).strip():
                    blocks.append(block)
                now = []
            elif marginal[k] >= 0.5:
                now.append(piece)
        return "\n".join(blocks)


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Training pages made by rule. Elements with the attribute data-y are content, with data-n they are not; others inherit."""
    r = random.Random(seed)
    say = lambda a, b: " ".join(r.choice("alder birch cedar dogwood elm fir gorse hazel ivy juniper larch maple oak pine rowan".split()) for _ in range(r.randint(a, b)))
    links = lambda: "".join(f"<li><a href='/x'>{say(1, 2)}</a></li>" for _ in range(r.randint(2, 6)))

    def paragraph() -> str:
        body = say(1, 60)
        if r.random() < 0.3:
            body += f" <a href='/y'>{say(1, 3)}</a> <b>{say(1, 4)}</b> <em>{say(1, 2)}</em>" + say(0, 9)
        return f"<p>{body}</p>" if r.random() < 0.8 else f"<p><b>{body}<br>"

    def inside() -> str:
        out = [f"<h{r.randint(1, 2)}>{say(2, 8)}</h1>"] if r.random() < 0.7 else []
        if r.random() < 0.15:  # many short paragraphs
            out += [f"<p>{say(1, 4)}</p>" for _ in range(r.choice([5, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            out.append(r.choice([paragraph] * 8 + [lambda: f"<ul><li>{say(2, 12)}<li>{say(2, 12)}</ul>", lambda: f"<blockquote>{say(4, 30)}</blockquote>", lambda: f"<pre>{say(4, 20)}</pre>", lambda: f"<h3>{say(1, 5)}</h3>", lambda: f"<table><tr><td>{say(1, 4)}<td>{say(1, 4)}</table>", lambda: f"<figure><img src=a><figcaption>{say(2, 6)}</figcaption></figure>", lambda: f"<div>{say(5, 40)}</div>", lambda: f"<section>{paragraph()}</section>"])())
            if r.random() < 0.4:
                out.append(other())
        return "".join(out)

    def other() -> str:
        name = r.choice(["ad", "ads", "sponsored", "promo", "sidebar", "related", "widget", "comments", "comment", "reply", "cookie-notice", "notice", "newsletter", "popup", "share", "social", "breadcrumb", "menu", "footer", "header"])
        body = r.choice([lambda: say(1, 40), lambda: f"<p>{say(2, 40)}</p>", lambda: f"<ul>{links()}</ul>", lambda: f"<h3>{say(1, 3)}</h3><p>{say(3, 30)}</p><p>{say(3, 30)}</p>", lambda: f"<p>{say(3, 20)} <b>{say(1, 2)}</b> <a href=z>{say(1, 2)}</a></p>"])()
        tag = r.choice(["div", "div", "div", "section", "aside", "p", "ul" if body.startswith("<li") else "div"])
        return r.choice([
            f"<{tag} data-n class='{name}'>{body}</{tag}>", f"<div data-n id='{name}'>{body}</div>", f"<nav data-n><ul>{links()}</ul></nav>", f"<aside data-n>{body}</aside>",
            f"<form data-n action=s><label>{say(1, 3)}</label><input name=q><button>{say(1, 1)}</button></form>", f"<header data-n><p>{say(1, 6)}</p></header>", f"<footer data-n>&copy; {say(2, 12)}</footer>",
            f"<script>var t='{say(1, 3)}';</script>", f"<div data-n style='display:none'>{body}</div>", f"<dialog data-n>{body}</dialog>",
        ])

    pages = []
    for _ in range(n):
        shell = r.choice(["<article data-y>%s</article>"] * 5 + ["<main data-y>%s</main>", "<main data-y><article>%s</article></main>", "<div data-y class=content>%s</div>", "<div data-y id='post-body'>%s</div>", "<div><div data-y class='entry'>%s</div></div>", "<div data-y>%s</div>"])
        body = "".join(other() for _ in range(r.randint(1, 4))) + shell % inside() + "".join(other() for _ in range(r.randint(1, 4)))
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{say(2, 6)}</title><style>p{{}}</style></head><body data-n>{body}</body></html>")
    return pages


@cache
def train(pages: tuple[str, ...] | None = None, steps: int = 300, rate: float = 0.7, decay: float = 0.0001) -> Model:
    """Weights that maximise the likelihood of labelled pages; by default of ``labelled_pages()``."""
    model = Model()
    data = []
    for page in pages or labelled_pages():
        nodes, _ = parse(page)
        y = []
        for x in nodes:
            mark = 1 if re.search(r"\bdata-y\b", x.attrs) else 0 if re.search(r"\bdata-n\b", x.attrs) or GROUP.get(x.tag) in ("raw", "head") else None
            y.append(mark if mark is not None else y[x.parent] if x.parent >= 0 else 0)
        rows = [features(x) for x in nodes]
        kinds = [kind(x, r) for x, r in zip(nodes, rows, strict=True)]
        hot = np.zeros((len(nodes), len(FEATURES)))
        for k, (row, share) in enumerate(zip(rows, shares(nodes, kinds), strict=True)):
            hot[k, row] = share
        data.append((nodes, hot, np.array(y, float), kinds))
    total = sum(len(d[0]) for d in data)
    fw, fe = np.full(len(FEATURES), 1e-8), np.full((EDGES, 2, 2), 1e-8)
    for _ in range(steps):
        gw, ge = -decay * model.w * total, -decay * model.e * total
        for nodes, hot, y, kinds in data:
            m, pairs = model.marginals(nodes, (hot @ model.w).tolist(), kinds)
            gw += hot.T @ (y - np.array(m))
            for k in range(1, len(nodes)):
                ge[kinds[k]] -= pairs[k]
                ge[kinds[k], int(y[nodes[k].parent]), int(y[k])] += 1
        fw, fe = fw + (gw / total) ** 2, fe + (ge / total) ** 2
        model.w, model.e = model.w + rate * gw / total / np.sqrt(fw), model.e + rate * ge / total / np.sqrt(fe)
    return model


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """(the ``keep`` columns, text, n_chars) of every row, from the whole page.

    A null or empty page, and one without content, give the empty text. Unclosed and stray tags are
    mended as browsers do for paragraphs, list items and cells; text is never cut. Repeated rows and null ids stay;
    blocks whose marginals tie with the threshold are kept; an empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or train())

    def setup():
        extract = shared.value.extract

        def f(pages: list) -> tuple:
            texts = [extract(p) for p in pages]
            return texts, list(map(len, texts))

        return f

    return df.select(*keep, text_function("text string, n_chars long", setup)(F.col(html_col)).alias("x")).select(*keep, "x.*")
