"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is read as a sequence of leaf blocks, the text between two block-level tags, each with its open ancestors; other
elements, those unknown included, stand within a block. A block
is described by its ancestors' tags and class, id and role words, and by its text; the CRF labels blocks main text or
not, with weights for features and for neighbouring labels, and Viterbi decodes the best labelling of the page.

The weights are trained here by stochastic gradient on the conditional log-likelihood (forward-backward), over labelled
pages that `labelled_pages` lays out from a seed, with and without semantic tags; `pages` bounds their number. They
depend on no input, so extraction reads each whole page once where it lies, without a shuffle.

Defined cases: null or empty html, and pages without a main block, give an empty text; a cut-off page is read as far
as it goes, without a cut-off tag. Equal pages give equal texts. The result is a column, so names cannot clash.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?P<close>>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Without text of the page: scripts, styles, controls of forms; none of them ends a block.
RAW = frozenset("script style noscript template textarea title iframe select datalist button".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table div article section main body html aside nav header footer form td th".split())


@dataclass(slots=True)
class Block:
    text: str
    path: tuple
    linked: int
    talk: bool = False


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's non-empty leaf blocks in order; references decoded, white space joined."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = at = 0
    page = page or ""

    path: tuple | None = ()
    in_head = in_link = False

    def flush() -> None:
        nonlocal linked, path
        if parts:
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                if path is None:
                    path = tuple(x for x in stack if x[0] in BLOCK)
                blocks.append(Block(text, path, linked))
            parts.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not in_head:
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def moved() -> None:
        nonlocal path, in_head, in_link
        path = None
        in_head = in_link = False
        for x in stack:
            in_head |= x[0] == "head"
            in_link |= x[0] == "a"

    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["close"]:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if not m["end"] and not m["attrs"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                # a control that is never closed holds no more than its tag
                at = close.end() if close else at if tag in ("button", "select", "datalist", "noscript") else len(page)
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    moved()
                    break
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, frozenset()) | {"p"} if tag in BLOCK else CLOSES.get(tag, frozenset())
        for i in range(len(stack) - 1, -1, -1) if shut else ():
            if stack[i][0] in shut:
                del stack[i:]
                break
            if stack[i][0] in SCOPE and not (tag == "body" or stack[i][0] in CLOSES.get(tag, ())):
                break
        names = " ".join(x for a in ATTRIBUTE.findall(m["attrs"]) for x in a[1:] if x).lower() if m["attrs"] else ""
        stack.append((tag, names))
        moved()
    put(page[at:])
    flush()
    return marked_talk(blocks)


# What stands alone over the comments of readers.
TALK_HEADING = re.compile(
    r"(?:\d+ )?(?:reader |leave (?:a |your )?)?(?:comments?|replies|reply|responses|leserkommentare|kommentare?|antworten|commentaires?|r[ée]ponses|comentarios?|respuestas)(?: ?\(\d+\))?:?", re.I
)


def marked_talk(blocks: list[Block]) -> list[Block]:
    """Marks a heading of comments, and what follows it inside its parent."""
    inside: tuple | None = None
    for b in blocks:
        if inside is not None and b.path[: len(inside)] != inside:
            inside = None
        if inside is None and b.path and b.path[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6", "legend", "summary") and TALK_HEADING.fullmatch(b.text):
            inside = b.path[:-1]
        b.talk = inside is not None
    return blocks


def path_features(path: tuple) -> list[str]:
    """Of the ancestors: each tag, the innermost tag, and each word of class, id and role."""
    out = {f"tag:{t}" for t, _ in path} | {f"name:{w}" for _, names in path for w in re.split(r"[^a-z]+", names) if w}
    return sorted(out | {f"in:{path[-1][0] if path else ''}"} | ({"no_names"} if not any(n for _, n in path) else set()))


def text_features(b: Block) -> list[str]:
    words = b.text.split()
    n, share = len(words), b.linked / len(b.text)
    out = [f"words:{min(6, n.bit_length())}", f"links:{min(4, int(share * 4.01))}", f"ends:{'stop' if b.text[-1] in '.!?:;…' else 'else'}"]
    if b.talk:
        out.append("talk")
    if "©" in b.text:
        out.append("copyright")
    if n and sum(w[:1].isupper() for w in words) / n > 0.6 and n > 1:
        out.append("titled")
    return out


@dataclass
class Crf:
    """Binary chain: weights of features for label 1 against 0, and of the labels of neighbours."""

    weights: dict[str, float]
    step: list[list[float]]
    start: list[float]

    def emission(self, b: Block, known: dict) -> float:
        if b.path not in known:
            known[b.path] = sum(self.weights.get(f, 0.0) for f in path_features(b.path))
        total, get = known[b.path], self.weights.get
        for f in text_features(b):
            total += get(f, 0.0)
        return total

    def decode(self, emissions: list[float]) -> list[int]:
        """The best labels, by Viterbi."""
        if not emissions:
            return []
        (s00, s01), (s10, s11) = self.step
        off, on, back = self.start[0], self.start[1] + emissions[0], []
        for e in emissions[1:]:
            back.append((on + s10 > off + s00, on + s11 > off + s01))
            off, on = max(off + s00, on + s10), max(off + s01, on + s11) + e
        out = [int(on > off)]
        for came in reversed(back):
            out.append(int(came[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4, seed: int = 5) -> Crf:
    """AdaGrad on the conditional log-likelihood of the pages' labels."""
    index: dict[str, int] = {}
    rows = [([[index.setdefault(f, len(index)) for f in path_features(b.path) + text_features(b)] for b in blocks], labels) for blocks, labels in pages if blocks]
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-6)
    t, t2 = np.zeros((3, 2)), np.full((3, 2), 1e-6)  # rows 0 and 1: steps from that label; row 2: start
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            feats, y = rows[k]
            n = len(y)
            e = np.array([w[f].sum() for f in feats])
            psi = np.exp(t[:2])
            a, b = np.zeros((n, 2)), np.ones((n, 2))
            odds = np.stack([1 / (1 + np.exp(np.clip(e, -30, 30))), 1 / (1 + np.exp(-np.clip(e, -30, 30)))], 1)
            for i in range(n):
                a[i] = odds[i] * (np.exp(t[2]) if i == 0 else a[i - 1] @ psi)
                a[i] /= a[i].sum()
            for i in range(n - 2, -1, -1):
                b[i] = psi @ (odds[i + 1] * b[i + 1])
                b[i] /= b[i].sum()
            p = a * b
            p /= p.sum(1, keepdims=True)
            d = np.array(y) - p[:, 1]
            grad_t = np.zeros((3, 2))
            grad_t[2, y[0]] += 1
            grad_t[2] -= p[0]
            for i in range(1, n):
                joint = a[i - 1][:, None] * psi * (odds[i] * b[i])[None]
                grad_t[y[i - 1], y[i]] += 1
                grad_t[:2] -= joint / joint.sum()
            t2 += grad_t**2
            t += rate * (grad_t - ridge * t) / np.sqrt(t2)
            flat = np.concatenate([np.array(f) for f in feats])
            grad = np.bincount(flat, np.repeat(d, [len(f) for f in feats]), minlength=len(w))
            used = np.unique(flat)
            g2[used] += grad[used] ** 2
            w[used] += rate * (grad[used] - ridge * w[used]) / np.sqrt(g2[used])
    return Crf({f: float(w[i]) for f, i in index.items()}, t[:2].tolist(), t[2].tolist())


# Names that sites commonly give to parts of a page.
MAIN_NAMES = ("content", "main", "post", "entry", "story", "text", "body", "article", "post-content", "entry-content", "article-body")
MENU_NAMES = ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "tabs", "toc", "pagination", "pager", "skip")
HEAD_NAMES = ("header", "masthead", "site-header", "logo", "branding", "title-bar")
FOOT_NAMES = ("footer", "site-footer", "copyright", "legal", "colophon", "credits")
SIDE_NAMES = ("sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "tags", "share", "social", "author-box", "more")
NOTE_NAMES = ("cookie", "cookies", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "subscribe", "newsletter", "disclaimer", "paywall")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsbox")
TALK_NAMES = ("comments", "comment", "comment-list", "replies", "reply", "responses", "discussion", "disqus", "reviews")
TALK_HEADINGS = ("Comments", "3 Comments", "Comments (12)", "Replies", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "Responses")
SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qu re si ta un ve wo ya zu ment tion sch ou".split()


def labelled_pages(count: int = 400, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Pages laid out at random from common parts, with each leaf block's label."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    made = []
    for _ in range(count):
        truth: list[str] = []
        serial = [0]

        def phrase(lo: int, hi: int, main: bool, truth=truth, serial=serial, stop: float = 0.8) -> str:
            serial[0] += 1
            words = ["".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi + 1)))]
            words[0] = words[0].capitalize()
            if chance(0.1):
                words = [w + pick(["%%%", "***", "###", "!!"]) for w in words]
            out = f"{' '.join(words)} z{serial[0]}z" + ("." if chance(stop) else "")
            if main:
                truth.append(f"z{serial[0]}z")
            return out

        def named(tags: tuple[str, ...], names: tuple[str, ...], inner: str, bare: float = 0.5) -> str:
            tag = pick(tags)
            name = f" {pick(['class', 'id'])}=\"{pick(names)}\"" if tag in ("div", "section", "ul", "p", "span") or not chance(bare) else ""
            return f"<{tag}{name}>{inner}</{tag}>"

        links = lambda n: "".join(f'<li><a href="/x">{phrase(1, 3, False, stop=0.1)}</a></li>' for _ in range(n))
        menu = lambda: named(("nav", "nav", "div", "ul"), MENU_NAMES, f"<ul>{links(int(rng.integers(2, 8)))}</ul>")
        advert = lambda: named(("div", "div", "aside"), AD_NAMES, f"<p>{phrase(3, 30, False)}</p>" if chance(0.5) else phrase(2, 25, False), 0.0)
        note = lambda: named(("div", "section", "div"), NOTE_NAMES, f"<p>{phrase(4, 30, False)}</p><button>{phrase(1, 2, False, stop=0)}</button>" if chance(0.5) else phrase(4, 30, False))
        form = lambda: f"<form{pick(['', ' class="search"', ' id="login"'])}><label>{phrase(1, 3, False, stop=0)}</label><input name='q'><p>{phrase(2, 12, False)}</p><button>{phrase(1, 2, False, stop=0)}</button></form>"
        side = lambda: named(("aside", "aside", "div", "section"), SIDE_NAMES, (f"<h3>{phrase(1, 4, False, stop=0)}</h3>" if chance(0.6) else "") + (f"<ul>{links(3)}</ul>" if chance(0.5) else f"<p>{phrase(5, 40, False)}</p>"))

        def talk() -> str:
            one = lambda: named(("div", "li", "article"), ("comment", "reply", "comment-body", "review"), f"<p>{phrase(2, 40, False)}</p>", 0.0)
            return named(("div", "section", "ul"), TALK_NAMES, f"<h3>{phrase(1, 3, False, stop=0)}</h3>" + "".join(one() for _ in range(int(rng.integers(1, 5)))))

        def bare_talk() -> str:
            """Comments without a name, told by their heading alone."""
            tag, level = pick(("section", "div", "section", "")), pick(("h2", "h3", "h4"))
            said = "".join(pick(("<p>{}</p>", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>")).format(phrase(2, 60, False)) for _ in range(int(rng.integers(1, 5))))
            inner = f"<{level}>{pick(TALK_HEADINGS)}</{level}>{said}"
            return f"<{tag}>{inner}</{tag}>" if tag else inner

        def main() -> str:
            title = f"<h1>{phrase(1, 12, True, stop=0.5)}</h1>"
            out = [f"<header>{title}</header>" if chance(0.1) else title] if chance(0.9) else []
            for _ in range(int(rng.integers(1, 16))):
                x = rng.random()
                lo, hi = (1, 4) if chance(0.2) else (5, 120)
                if x < 0.72:
                    bold = "<b>" if chance(0.15) else ""
                    out.append(f"<p>{bold}{phrase(lo, hi, True)}" + ("<br>" if bold else "</p>"))
                elif x < 0.78:
                    out.append(f"<h2>{phrase(1, 8, True, stop=0.2)}</h2>")
                elif x < 0.83:
                    out.append("<ul>" + "".join(f"<li>{phrase(2, 20, True, stop=0.5)}</li>" for _ in range(3)) + "</ul>")
                elif x < 0.86:
                    out.append(f"<blockquote>{phrase(5, 40, True)}</blockquote>")
                elif x < 0.88:
                    out.append(f"<table><tr><td>{phrase(1, 3, True, stop=0)}</td><td>{phrase(1, 3, True, stop=0)}</td></tr></table>")
                elif x < 0.90:
                    out.append(f"<pre>{phrase(3, 20, True, stop=0)}</pre>")
                elif x < 0.92:
                    out.append(f'<p><a href="/y">{phrase(2, 6, True, stop=0.3)}</a></p>')
                elif x < 0.95:
                    out.append(advert())
                elif x < 0.965:
                    out.append(note())
                elif x < 0.98:
                    out.append(side())
                else:
                    out.append(pick([form, side])())
            if talks:
                out.append(bare_talk())
            return "".join(out)

        kind, talks = rng.random(), chance(0.15)
        bare = not talks and chance(0.2)  # no more on the page than its main part, or even one block
        inner = f"<p>{phrase(1, 6, True, stop=0.5)}</p>" if bare and chance(0.4) else main()
        article = f"<article>{inner}</article>" if kind < 0.5 else f"<main>{inner}</main>" if kind < 0.65 else f'<div class="{pick(MAIN_NAMES)}">{inner}</div>' if kind < 0.9 else f"<div>{inner}</div>"
        head = [f for f, p in ((menu, 0.8), (note, 0.3), (advert, 0.5), (form, 0.2)) if not bare and chance(p)]
        top = named(("header", "header", "div"), HEAD_NAMES, f"<a href='/'>{phrase(1, 3, False, stop=0)}</a>" + (menu() if chance(0.5) else f"<p>{phrase(1, 10, False)}</p>")) if not bare and chance(0.5) else ""
        tail = [f for f, p in ((side, 0.5), (talk, 0.4), (advert, 0.3), (form, 0.2), (note, 0.15), (menu, 0.2)) if not (bare and chance(0.7)) and chance(p)]
        foot = named(("footer", "footer", "div"), FOOT_NAMES, f"&copy; {phrase(1, 12, False)}" if chance(0.6) else f"<p>{phrase(2, 20, False)}</p>") if chance(0.9) else ""
        page = f"<html><head><title>x</title><style>p{{}}</style></head><body>{top}{''.join(f() for f in head)}{article}{''.join(f() for f in tail)}{foot}</body></html>"
        blocks = leaf_blocks(page[: int(len(page) * rng.uniform(0.6, 1))] if chance(0.1) else page)
        mine = set(truth)
        made.append((blocks, [int(any(z in mine for z in re.findall(r"z\d+z", b.text))) for b in blocks]))
    for blocks, _ in made:
        for b in blocks:
            b.text = re.sub(r" ?z\d+z", "", b.text) or "x"
    return made


@cache
def default_model(pages: int = 400) -> Crf:
    return train(labelled_pages(pages))


def main_text(model: Crf, page: str | None, known: dict) -> str:
    blocks = leaf_blocks(page)
    labels = model.decode([model.emission(b, known) for b in blocks])
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(html: Column, model: Crf | None = None) -> Column:
    """The main text of each page."""
    crf = model or default_model()

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p in pages:
            if len(known) > 100_000:
                known.clear()
            out.append(main_text(crf, p, known))
        return pd.Series(out, dtype=object)

    return texts(html)
