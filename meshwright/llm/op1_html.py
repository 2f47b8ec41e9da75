"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into its element tree; each block of text is a leaf. Every node has a hidden state (content or not).
A node's own potential comes from its tag, its class, id and role words, and for leaves from length, punctuation and
link share; each edge has a parent-child potential by kind of child. Sum-product message passing, upward and then
downward, gives exact marginals on the tree, and a leaf whose marginal of content is at least one half is kept. All
potentials are learnt together by gradient steps on the likelihood of labelled pages (expected minus observed counts,
the expectations by the same message passing). The labelled pages come from :func:`labelled_pages`, a generator that
arranges articles with menus, headers, sidebars, notices, adverts, forms, comments and footers in many layouts.

Defined results: a null or empty page, or one without content, gives the empty text; a page cut off in the middle is
read as far as it goes, and an unfinished tag at its end is markup; a very long page is read whole; repeated rows give
repeated results; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import per_text, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.I | re.S,
)
_WORD = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of these names ends, up to the nearest of the bounds.
_ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody blockquote pre figure figcaption nav header footer aside form fieldset label button select option a address details summary menu".split()
_HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "head": "header masthead topbar banner branding logo sitehead",
    "foot": "fusszeile pied pie footer foot copyright legal colophon bottom",
    "side": "seitenleiste lateral sidebar side aside widget rail related recommended trending popular complementary",
    "note": "cookie cookies consent notice alert popup modal gdpr warning announcement dialog overlay",
    "ad": "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promoted promotion",
    "form": "form search newsletter subscribe subscription signup login contact",
    "talk": "remark remarks opinions kommentar kommentare comentarios commentaires commenti comment comments reply replies discussion disqus respond thread responses feedback",
    "share": "share sharing social follow tags meta byline",
    "good": "article content main post entry story text body page articlebody",
}
_HINT = {w: k for k, ws in enumerate(_HINTS.values()) for w in ws.split()}
_TAG = {t: k for k, t in enumerate(_TAGS)}
_ELEMENT, _LEAF = len(_TAGS) + 1 + len(_HINTS) + 1, 20
N_FEATURES = _ELEMENT + _LEAF + len(_TAGS) + 1


class Tree:
    """The nodes of one page, parents first: parent, depth, kind of edge, features, and the texts of the leaves."""

    def __init__(self, html: str):
        self.parent, self.depth, self.kind, self.features = [-1], [0], [2], [[len(_TAGS), _ELEMENT - 1]]
        self.leaves: list[int] = []
        self.texts: list[str] = []
        self.marks: list[str] = [""]
        stack, run, linked = [("", 0)], [], [0, 0]
        opened: Counter = Counter()  # names on the stack, so that no tag without a partner is looked for through all of it

        def close(k: int) -> None:
            opened.subtract(t for t, _ in stack[k:])
            del stack[k:]

        def flush() -> None:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE)
                self._leaf(stack[k][1], stack[k][0], text, linked[0] / max(1, linked[1]))
            linked[:] = [0, 0]

        def take(text: str) -> None:
            run.append(text)
            n = len(text.strip())
            linked[1] += n
            if any(t == "a" for t, _ in stack[-3:]):
                linked[0] += n

        end = 0
        for m in _TOKEN.finditer(html):
            if m.start() > end:
                take(html[end : m.start()])
            end = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            closing = m[2] if m[3] else m[5]
            if tag == "br":
                run.append(" ")
                continue
            if tag not in _INLINE:
                flush()
            if closing:
                if opened[tag] > 0:
                    k = len(stack) - 1
                    while stack[k][0] != tag and not (tag in _INLINE and stack[k][0] not in _INLINE):
                        k -= 1
                    if stack[k][0] == tag:
                        close(k)
                continue
            if tag not in _INLINE:
                k = len(stack) - 1
                while k and stack[k][0] in _INLINE:
                    k -= 1
                if k and stack[k][0] == "p":  # a block ends the paragraph it stands in
                    close(k)
                names, bounds = (x.split() for x in _ENDS.get(tag, ("", "")))
                if any(opened[n] > 0 for n in names):
                    k = len(stack) - 1
                    while k and stack[k][0] not in bounds and stack[k][0] not in names:
                        k -= 1
                    if stack[k][0] in names:
                        close(k)
            if tag in _VOID:
                continue
            opened[tag] += 1
            stack.append((tag, stack[-1][1] if tag in _INLINE else self._element(stack[-1][1], tag, (m[4] if m[3] else m[7]) or "")))
        if end < len(html):
            take(html[end:])
        flush()

    def _node(self, parent: int, kind: int, features: list[int], mark: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.features.append(features)
        self.marks.append(mark or self.marks[parent])
        return len(self.parent) - 1

    def _element(self, parent: int, tag: str, attributes: str) -> int:
        found = {len(_TAGS) + 1 + _HINT[w] for m in _WORD.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w in _HINT}
        mark = re.search(r'data-truth="(\w+)"', attributes)
        return self._node(parent, 2 if tag in ("div", "section", "body", "html", "main", "article") else 1, [_TAG.get(tag, len(_TAGS)), _ELEMENT - 1, *found], mark[1] if mark else "")

    def _leaf(self, parent: int, tag: str, text: str, links: float) -> None:
        n, base = text.count(" ") + 1, _ELEMENT
        f = [base, base + 1 + sum(n > b for b in (1, 2, 4, 8, 15, 30, 60)), base + 10 + sum(links > b for b in (0, 0.25, 0.6, 0.9)), base + _LEAF + _TAG.get(tag, len(_TAGS))]
        if text[-1] in ".!?\"':;)":
            f.append(base + 16)
        if text.count(",") + text.count(".") >= 3:
            f.append(base + 17)
        if "©" in text[:40]:
            f.append(base + 18)
        self.leaves.append(self._node(parent, 0, f, ""))
        self.texts.append(text)


class Forest:
    """Trees side by side, for message passing level by level."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.array(t.parent) + o for t, o in zip(trees, self.first, strict=False)])
        depth = np.concatenate([t.depth for t in trees])
        self.kind = np.concatenate([t.kind for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])[1:]
        flat = [f for t in trees for f in t.features]
        self.row = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.column = np.fromiter((c for f in flat for c in f), np.int64, len(self.row))

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint of (parent, child) for each node but roots. unary: one weight each feature; edge: [kind, parent, child]."""
        own = np.zeros((len(self.parent), 2))
        own[:, 1] = np.bincount(self.row, unary[self.column], len(own))
        up = np.zeros_like(own)  # from a node to its parent
        for at in reversed(self.levels):
            up[at] = np.logaddexp.reduce(own[at][:, None, :] + edge[self.kind[at]], 2)
            np.add.at(own, self.parent[at], up[at])
        joint = np.full((len(own), 2, 2), 0.25)
        belief = own  # becomes the full belief from the roots down
        for at in self.levels:
            rest = belief[self.parent[at]] - up[at]
            pair = rest[:, :, None] + edge[self.kind[at]] + own[at][:, None, :]
            pair -= np.logaddexp.reduce(pair.reshape(len(at), 4), 1)[:, None, None]
            joint[at] = np.exp(pair)
            belief[at] = np.log(np.maximum(joint[at].sum(1), 1e-300))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def fit(trees: list[Tree], steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Potentials that make the labelled states likely. An element is content if most of the text below it is."""
    forest = Forest(trees)
    weight = np.zeros((len(forest.parent), 2))
    for t, o in zip(trees, forest.first, strict=False):
        for leaf, text in zip(t.leaves, t.texts, strict=True):
            weight[o + leaf, int(t.marks[leaf] == "content")] = len(text)
    for at in reversed(forest.levels):
        np.add.at(weight, forest.parent[at], weight[at])
    state = (weight[:, 1] > weight[:, 0]).astype(int)
    inner = forest.parent >= np.repeat(forest.first[:-1], np.diff(forest.first))
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (forest.kind[inner], state[forest.parent[inner]], state[inner]), 1)
    observed = np.bincount(forest.column, state[forest.row], N_FEATURES)
    theta, m1, m2 = np.zeros(N_FEATURES + 12), 0.0, 0.0
    for t in range(1, steps + 1):
        p, joint = forest.marginals(theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2))
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, forest.kind[inner], joint[inner])
        g = np.concatenate([np.bincount(forest.column, p[forest.row], N_FEATURES) - observed, (expected - seen).ravel()]) / len(trees) + 3e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2)


def labelled_pages(n: int = 800, seed: int = 5) -> list[str]:
    """Pages whose elements carry ``data-truth`` (content or other), inherited by what is inside."""
    r = random.Random(seed)
    syllables = "an be co da el fo gi ha in jo ka lu me no or pa qui re su ta un vi we yo ze tion ment able".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    plain = [False]  # whether the page's texts have no punctuation

    def sentence(a: int, b: int) -> str:
        if plain[0]:
            return " ".join([word()] * r.randint(1, 8) + [word() for _ in range(r.randint(a, b))]).capitalize()
        ws = [word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b))]
        return (" ".join(ws)).strip(",").capitalize() + r.choice("....!?")

    def prose(k: int) -> str:
        return " ".join(sentence(3, 18) for _ in range(k))

    def name(*choices: str) -> str:
        c = r.choice(choices)
        return r.choice((f' class="{c}"', f' id="{c}"', f' class="{word()} {c}"', f' class="{c}-{word()}"')) if c else ""

    def links(k: int) -> str:
        item = lambda: f'<a href="/{word()}">{word().capitalize()}{" " + word() if r.random() < 0.4 else ""}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(k)) + "</ul>" if r.random() < 0.7 else " ".join(item() for _ in range(k))

    def other(tag: str, attributes: str, inside: str) -> str:
        return f'<{tag}{attributes} data-truth="other">{inside}</{tag}>'

    def menu() -> str:
        return other(*r.choice((("nav", ""), ("nav", name("menu", "navbar")), ("div", name("menu", "navigation", "breadcrumb")), ("ul", name("menu", "nav")))), links(r.randint(2, 9)))

    def advert() -> str:
        return other(r.choice(("div", "div", "aside", "ins", "section")), name("ad", "ads", "advert", "sponsored", "promo", "advertisement"), r.choice((prose(1), f"<p>{prose(2)}</p>", f'<a href="/x">{sentence(3, 8)}</a>')))

    def notice() -> str:
        return other("div", r.choice((name("notice", "cookie-consent", "alert", "cookie", "popup", "modal"), ' role="alert"', ' role="dialog"')), r.choice((prose(1), f"<p>{prose(2)}</p><button>{word()}</button>")))

    def sidebar() -> str:
        return other(*r.choice((("aside", ""), ("aside", name("sidebar", "widget")), ("div", name("sidebar", "related", "side", "widget")), ("section", name("related", "sidebar")))), f"<h{(h := r.choice('234'))}>{word()}</h{h}>" + r.choice((links(4), f"<p>{prose(2)}</p>", prose(1))))

    def form() -> str:
        return other("form", r.choice(("", name("search", "newsletter", "signup"))), f"<label>{word()}</label><input name='q'>{r.choice(('', f'<p>{prose(1)}</p>', f'<select><option>{word()}<option>{word()}</select>'))}<button>{word()}</button>")

    def comments() -> str:
        one = lambda: r.choice((f"<p>{prose(r.randint(1, 3))}</p>", f'<div class="comment"><b>{word()}</b><p>{prose(2)}</p></div>', f"<li>{prose(1)}</li>"))
        return other(r.choice(("section", "div", "ol", "div")), name("comments", "comment-list", "discussion", "replies", "responses", "remarks", "kommentare", "comentarios", "commentaires"), r.choice(("", f"<h3>{word()}</h3>")) + "".join(one() for _ in range(r.randint(1, 5))))

    def header() -> str:
        return other(*r.choice((("header", ""), ("header", name("header", "masthead")), ("div", name("header", "masthead", "topbar", "banner")))), r.choice((f"<h1>{word()}</h1>", f"<div>{sentence(1, 4)}</div>", f"<p>{sentence(2, 8)}</p>", f'<a href="/">{word()}</a>')) + r.choice(("", links(3))))

    def footer() -> str:
        return other(*r.choice((("footer", ""), ("footer", name("footer", "site-footer")), ("div", name("footer", "copyright", "bottom", "pied", "fusszeile")))), r.choice(("&copy; ", "", "© ")) + r.choice((prose(1), f"<p>{prose(2)}</p>", links(4))))

    def block() -> str:
        x = r.random()
        if x < 0.1:
            return f"<p>{sentence(1, 3)}</p>"
        if x < 0.7:
            return "<p>" + r.choice(("", "", "", "<b>", "<em>")) + prose(r.randint(1, 7)) + r.choice(("</p>", "</p>", "</p>", "", "<br>"))
        if x < 0.78:
            return f"<h{(h := r.choice('1234'))}>{sentence(1, 9).strip('.')}</h{h}>"
        if x < 0.84:
            return "<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.88:
            return f"<blockquote><p>{prose(2)}</p></blockquote>"
        if x < 0.91:
            return f"<pre>{prose(1)}</pre>"
        if x < 0.925:
            return "<dl>" + "".join(f"<dt>{sentence(1, 3).strip('.!?')}</dt><dd>{sentence(2, 12)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        if x < 0.945:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if x < 0.97:
            return f'<p>{prose(2)} <a href="/y">{sentence(1, 3)}</a> {prose(1)}</p>'
        return f"<div>{prose(r.randint(1, 4))}</div>"

    def page() -> str:
        plain[0] = r.random() < 0.2
        inside = [f"<h1>{sentence(2, 10)}</h1>"] if r.random() < 0.7 else []
        short = r.random() < 0.45
        for _ in range(r.randint(1, 3) if short else r.randint(1, 14)):
            inside.append(block())
            if r.random() < 0.1:
                inside.append(r.choice((advert, notice, form, sidebar))())
        if r.random() < 0.15:
            inside.append(comments())
        tag, attributes = r.choice((("article", ""), ("article", name("post", "story")), ("main", ""), ("div", name("content", "article", "main", "post", "entry")), ("section", name("content", "story")), ("div", ' role="main"')))
        body = f'<{tag}{attributes} data-truth="content">' + "".join(inside) + f"</{tag}>"
        alone = r.random() < 0.25
        before = [f() for f in (header, menu, notice, advert, form, sidebar) if r.random() < 0.4]
        after = [f() for f in (comments, sidebar, advert, form, notice, footer, footer, menu) if r.random() < 0.35]
        r.shuffle(before)
        if alone:
            return body
        if r.random() < 0.3:
            body, after = f"<div{name('', 'page', 'wrapper', 'container')}>{body}{''.join(after[:2])}</div>", after[2:]
        whole = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join([*before, body, *after])
        return whole + ("</body></html>" if r.random() < 0.9 else "")

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def potentials() -> tuple[np.ndarray, np.ndarray]:
    """The learnt potentials; learning is deterministic and independent of any input table."""
    return fit([Tree(p) for p in labelled_pages()])


def extract(pages: list[str], learnt: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    trees = [Tree(p) for p in pages]
    forest = Forest(trees) if trees else None
    content = forest.marginals(*learnt)[0] if trees else None
    return ["\n".join(x for k, x in zip(t.leaves, t.texts, strict=True) if content[o + k] >= 0.5) for t, o in zip(trees, forest.first, strict=False)] if trees else []


def main_text(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page; null pages and pages without content have the empty text."""
    learnt = potentials()

    def step(keys: list, pages: list[bytes]) -> dict:
        texts = extract([p.decode("utf-8", "replace") for p in pages], learnt)
        return {"page": keys, "text": texts, "n_chars": list(map(len, texts))}

    kinds = dict(df.select(key, "url").dtypes)
    keys = F.struct(F.col(key).alias("id"), F.col("url").alias("url"))
    packed = df.select(keys.alias("page"), F.col(html).alias("html"))
    out = per_text(packed, "page", "html", f"page struct<id:{kinds[key]},url:{kinds['url']}>, text string, n_chars long", step)
    return out.select(F.col("page.id").alias(key), F.col("page.url").alias("url"), "text", "n_chars")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
