"""Main-text extraction by a maximum-scoring subsequence of a page's words and tags.

A page becomes a sequence of tags and text runs. What stands open around a run gives its features: element names, words of class and
id, roles, whether the page has an element for its main part and the run lies beside it, and, outside of one, whether it speaks of rights. Logistic
regression on labelled pages gives the log-odds z that a run is content, from which words and tags score:
- each word of a run that is rather content (z above 0) scores z,
- a run that rather isn't scores z once, as its length says nothing: an advert amid an article is passed over, and left out,
- a tag scores minus the share of its kind that lies outside the content in the labelled pages.
So words of content are positive, and tags negative. A linear scan finds the contiguous stretch with the largest sum, which is
the content region; its runs with z above 0 are the text.

The labelled pages are made by `labelled`, a grammar of layouts whose parts are known to be content or not. All weights come from
there; the module has no other list of words that mark boilerplate.

Blocks (paragraphs, headings, list items, table rows and so on) are joined by one line feed. Character
references are decoded; white space within a block becomes one space, and `br` counts as white space.

A null page, or one without a positive stretch, gives an empty text. Tags that don't close, stray `<`, unclosed
comments and unclosed scripts are read as browsers do. Any rows with equal ids are extracted each.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pick, slices

RESULT = "page_id long, url string, text string, n_chars long"

#: Fixed values of HTML: elements whose content is raw text, elements without an end tag, elements that begin a block, formatting
#: elements, and elements that hold no text of a page.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
)
INLINE = ("a", "abbr", "b", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "tt", "u")
NO_TEXT = ("head", "template", "svg", "canvas", "object", "audio", "video", "map", "datalist", "select", "button", "math")
_ENDS_ITSELF = ("li", "dt", "dd", "tr", "td", "th")
_ENDS_P = tuple(b for b in BLOCK if b not in ("body", "head", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr"))
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|</[^a-zA-Z>][^>]*>|</>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BLANK = re.compile(r"\s+")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RIGHTS = re.compile(r"©|&copy;|copyright|\(c\)|rights reserved", re.I)
#: An article in a list of these isn't the page's main part.
_REPLIES = ("comment", "comments", "reply", "replies")
_NAMED = {f"h{k}": "heading" for k in range(1, 7)} | {n: n for n in ("article", "main", "nav", "aside", "footer", "header", "form", "menu", "dialog", "p", "li", "a", "td", "th", "pre", "blockquote", "figure", "section", "label", "fieldset", "address")}


#: Feature of an element that isn't shown.
UNSEEN = "hidden"


class Token(NamedTuple):
    kind: str  #: `<name` of a tag, `text`, or `none` for text that nobody sees
    text: str
    begins: bool  #: a tag that begins or ends a block
    features: frozenset[str]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _class_words(value: str) -> list[str]:
    """The names in a class or id, and the words that they consist of."""
    return [*dict.fromkeys([*value.lower().split(), *(w.lower() for w in _CLASS_WORD.findall(value))])]


def element_features(name: str, attributes: str, inside_main: bool) -> list[str]:
    """Features of an open element. The header of an article is not one of the page."""
    found = [f"<{_NAMED[name]}"] if name in _NAMED and not (name == "header" and inside_main) else []
    if "=" not in attributes and "hidden" not in attributes:
        return found
    given = _attributes(attributes)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
        found.append(UNSEEN)
    if "role" in given:
        found.append(f"role {given['role'].lower()}")
    return found + [f".{w}" for a in ("class", "id") if a in given for w in _class_words(given[a])]


def _has_main(page: str) -> bool:
    """Whether an element says that it is the page's main part."""
    for m in re.finditer(r"<(?:article|main)(?=[\s/>])([^>]*)", page, re.I):
        if not any(f".{w}" in element_features("div", m[1], False) for w in _REPLIES):
            return True
    return False


def tokens(page: str) -> Iterator[Token]:
    """A page's tags and text runs, in order."""
    open_: list[tuple[str, list[str]]] = []
    names: Counter[str] = Counter()
    active: Counter[str] = Counter()
    has_main = _has_main(page)
    held: frozenset[str] | None = None  # features of what is open, until it changes

    def pop_to(name: str) -> None:
        nonlocal held
        while open_:
            last, features = open_.pop()
            names[last] -= 1
            for f in features:
                active[f] -= 1
            if features:
                held = None
            if last == name:
                return

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            if held is None:
                held = frozenset(f for f, n in active.items() if n > 0)
            text, own = page[at:end], held
            if not open_:
                own = own | {"nothing open"}
            if "<article" not in held and "<main" not in held:
                own = own | {f for f, holds in (("beside", has_main), ("rights", _RIGHTS.search(text))) if holds}
            yield Token("none" if UNSEEN in held or any(names[n] for n in NO_TEXT) else "text", text, False, own)
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        yield Token(f"<{name}", "", name in BLOCK, frozenset())
        if m[1]:
            if names[name] > 0:
                pop_to(name)
        elif name in RAW:
            stop = _RAW_END[name].search(page, at)
            yield Token("none", page[at : stop.start() if stop else len(page)], False, frozenset())
            at = stop.start() if stop else len(page)
        elif name not in VOID:
            if names["p"] > 0 and name in _ENDS_P:
                k = len(open_) - 1
                while k >= 0 and open_[k][0] in INLINE:
                    k -= 1
                if k >= 0 and open_[k][0] == "p":
                    pop_to("p")
            if open_ and open_[-1][0] == name and name in _ENDS_ITSELF:
                pop_to(name)
            features = element_features(name, m[3], active["<article"] > 0 or active["<main"] > 0)
            if any(f".{w}" in features for w in _REPLIES):
                features = [f for f in features if f not in ("<article", "<main")]
            open_.append((name, features))
            names[name] += 1
            for f in features:
                active[f] += 1
            if features:
                held = None


# -- labelled pages -----------------------------------------------------------------------------------------------------

#: Begins each text run of the content in a labelled page.
MARK = "\ue000"
_WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out".split()
#: Class words for each kind of part, as sites use them; a part may also have a class that says nothing, or none.
_CLASSES = {
    "header": "header site-header page-header masthead topbar top-bar banner branding global-header",
    "nav": "nav navbar navigation menu main-menu site-nav topnav mainnav",
    "crumbs": "breadcrumb breadcrumbs crumbs path",
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall skip",
    "ad": "ad ads advert advertisement adslot ad-slot ad-banner adsense sponsor sponsored promo promotion",
    "side": "sidebar side-bar side widget widgets rail trending popular latest",
    "related": "related recommended recommendations read-more also-like more-stories teaser",
    "share": "share sharing social social-links share-buttons toolbar follow",
    "comments": "comments comment-list commentlist comment respond disqus replies reply discussion",
    "footer": "footer site-footer foot page-footer colophon bottom legal copyright disclaimer imprint",
    "pager": "pagination pager page-numbers prev-next tags tag-list meta post-meta",
    "content": "content post entry story article article-body post-body entry-content text main-content page-content body",
    "lead": "lead intro summary note first legal notice meta dropcap side-by-side highlight",
    "title": "post-header entry-header article-header story-header post-title headline title",
    "none": "wrap wrapper container row col inner box block grid layout css ftr hdr blk sec item group unit cell panel",
}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def some(self, low: int, high: int) -> str:
        words = [self.rng.choice(_WORDS) for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize()

    def named(self, kind: str, always: bool = False) -> str:
        """A class or id attribute of this kind, of one that says nothing, or none."""
        roll = self.rng.random()
        if not always and roll < 0.15:
            return ""
        word = self.rng.choice(_CLASSES["none" if not always and roll < 0.35 else kind].split())
        return f' {self.rng.choice(["class", "id"])}="{word}"'

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href=/{i}>{self.some(1, 4)}</a></{tag}>" for i in range(n))

    def within(self, names: list[str], kind: str, inner: str, sure: float = 0.5) -> str:
        """A part in an element that names it, or in a div that has its class."""
        if names and self.rng.random() < sure:
            name = self.rng.choice(names)
            return f"<{name}{self.named(kind)}>{inner}</{name}>"
        name = self.rng.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"])
        return f"<{name}{self.named(kind, always=self.rng.random() < 0.85)}>{inner}</{name}>"

    def text(self, inner: str) -> str:
        """A run of content, perhaps with formatting or a link inside."""
        roll = self.rng.random()
        if roll < 0.15:
            return f"{MARK}{inner} <{(t := self.rng.choice('bi'))}>{MARK}{self.some(1, 3)}</{t}>{MARK} {self.some(2, 6)}."
        if roll < 0.3:
            return f"{MARK}{inner} <a href=/x>{MARK}{self.some(1, 4)}</a>{MARK} {self.some(2, 6)}."
        return f"{MARK}{inner}."

    def content_block(self) -> str:
        rng, roll = self.rng, self.rng.random()
        if roll < 0.6:
            return f"<p{self.named('lead', True) if rng.random() < 0.15 else ''}>{self.text(self.some(3, 60))}</p>"
        if roll < 0.68:
            return f"<h{(k := rng.randint(2, 4))}>{MARK}{self.some(1, 7)}</h{k}>"
        if roll < 0.78:
            return "<ul>" + "".join(f"<li>{self.text(self.some(1, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if roll < 0.84:
            return f"<blockquote><p>{self.text(self.some(5, 30))}</p></blockquote>"
        if roll < 0.9:
            return "<table>" + "".join("<tr>" + "".join(f"<{t}>{MARK}{self.some(1, 4)}</{t}>" for _ in range(3)) + "</tr>" for t in ("th", "td", "td")) + "</table>"
        if roll < 0.93:
            return f"<pre>{MARK}{self.some(4, 20)}</pre>"
        if roll < 0.94:
            return f"<p>{MARK}{rng.choice(['Copyright ', '', '© '])}{self.some(1, 5)}{rng.choice([', all rights reserved', ''])}.</p>"
        if roll < 0.97:
            return f"<figure><img src=x><figcaption>{MARK}{self.some(3, 12)}</figcaption></figure>"
        return f"<div{self.named('lead', True)}>{self.text(self.some(5, 40))}</div>"

    def foreign(self, kind: str) -> str:
        rng = self.rng
        prose = lambda: f"<p>{self.some(4, 40)}.</p>"
        if kind == "header":
            return self.within(["header"], kind, rng.choice([f"<h1>{self.some(1, 4)}</h1>", f"<div>{self.some(1, 4)}</div>", f"<a href=/>{self.some(1, 3)}</a>"]) + (f"<p>{self.some(3, 8)}</p>" if rng.random() < 0.4 else ""))
        if kind == "nav":
            return self.within(["nav", "nav", "menu"], kind, rng.choice([f"<ul>{self.links(rng.randint(3, 8))}</ul>", self.links(rng.randint(3, 8), "span")]), 0.6)
        if kind == "crumbs":
            return self.within(["nav"], kind, self.links(3, "span"), 0.3)
        if kind == "notice":
            return self.within(["dialog", "aside"], kind, rng.choice([f"{self.some(5, 25)}.", prose() + f"<a href=/ok>{self.some(1, 2)}</a>"]), 0.15)
        if kind == "ad":
            return f"<div{self.named('ad', True)}>{rng.choice([self.some(3, 25) + '.', prose(), f'<a href=/b>{self.some(2, 9)}</a>'])}</div>"
        if kind == "side":
            return self.within(["aside"], kind, f"<h3>{self.some(1, 4)}</h3>" + rng.choice([f"<ul>{self.links(4)}</ul>", prose(), prose() + prose()]), 0.6)
        if kind == "related":
            return self.within(["aside", "section"], kind, f"<h3>{self.some(1, 3)}</h3><ul>{self.links(rng.randint(2, 5))}</ul>", 0.3)
        if kind == "comments":
            one = lambda: rng.choice([f"<div{self.named('comments', True)}><b>{self.some(1, 2)}</b>{prose()}</div>", f"<article class=\"comment\">{prose()}</article>", prose(), f"<li>{self.some(3, 20)}.</li>"])
            return f"<{(t := rng.choice(['div', 'section', 'ol', 'aside']))}{self.named('comments', True)}><h3>{self.some(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind == "form":
            return f"<form{self.named('none')}><label>{self.some(1, 4)}</label><input><p>{self.some(2, 9)}</p><button>{self.some(1, 2)}</button></form>"
        if kind == "footer":
            rights = rng.choice(["&copy; ", "Copyright 2020 ", "© 2019 ", ""]) + self.some(1, 6) + rng.choice([" all rights reserved by " + self.some(1, 3), ". All rights reserved.", ""])
            if "ights" not in rights and "opy" not in rights and "©" not in rights:
                return self.within(["footer"], kind, rng.choice([prose(), rights, f"<ul>{self.links(4)}</ul>"]), 0.8)
            return self.within(["footer"], kind, rng.choice([rights, f"<p>{rights}</p>", f"<div>{rights}</div><ul>{self.links(4)}</ul>"]), 0.5)
        return self.within([], kind, rng.choice([self.links(4, "span"), f"<ul>{self.links(3)}</ul>"]))

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.03:  # a page that is only text
            return f"{MARK}{self.some(1, 60)}."
        blocks = [self.content_block() for _ in range(rng.randint(2, 14))]
        for kind in ("ad", "ad", "share", "notice", "related"):
            if rng.random() < 0.25:
                blocks.insert(rng.randint(0, len(blocks)), self.foreign(kind))
        title = f"<h1>{MARK}{self.some(2, 9)}</h1>" if rng.random() < 0.8 else ""
        if title and rng.random() < 0.2:
            title = f"<header>{title}<p>{MARK}{self.some(3, 12)}</p></header>"
        elif title and rng.random() < 0.2:
            title = f"<div{self.named('title', True)}>{title}</div>"
        body, kind = title + "".join(blocks), rng.random()
        if kind < 0.4:
            inner = f"<article{self.named('content')}>{body}</article>"
        elif kind < 0.55:
            inner = f"<main>{title}<article>{''.join(blocks)}</article></main>" if not title.startswith("<header") and rng.random() < 0.5 else f"<main>{body}</main>"
        elif kind < 0.65:
            half = len(blocks) // 2
            inner = f"<main><article>{title}{''.join(blocks[:half])}</article><article>{''.join(blocks[half:])}</article></main>"
        else:
            inner = f"<div{self.named('content')}>{body.replace('<header>', '<div>').replace('</header>', '</div>')}</div>"
        if rng.random() < 0.3:
            inner = f"<div{self.named('none')}>{inner}{self.foreign('side')}</div>"
        before = [self.foreign(k) for k in ("notice", "header", "nav", "crumbs", "ad", "side") if rng.random() < 0.5]
        after = [self.foreign(k) for k in ("share", "pager", "related", "comments", "side", "ad", "form", "footer", "notice") if rng.random() < 0.5]
        return f"<html><head><title>{self.some(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def labelled(n: int, seed: int = 1) -> list[str]:
    """Labelled pages; MARK begins each text run that is content."""
    return [_Maker(1000 * seed + k).page() for k in range(n)]


# -- weights ------------------------------------------------------------------------------------------------------------

#: Labelled pages that the weights are learnt from, and the ridge penalty.
PAGES, RIDGE = 400, 1.0


class Weights(NamedTuple):
    bias: float
    feature: dict[str, float]
    tag: dict[str, float]
    other_tag: float

    def odds(self, features: frozenset[str]) -> float:
        """Log-odds that a run with these features is content."""
        return self.bias + sum(self.feature.get(f, 0.0) for f in sorted(features))


def learn(pages: list[str]) -> Weights:
    """Logistic regression of runs by iterated least squares; runs count by the square root of their words."""
    rows: list[frozenset[str]] = []
    truth: list[bool] = []
    size: list[int] = []
    inside: Counter[str] = Counter()
    total: Counter[str] = Counter()
    for page in pages:
        found = list(tokens(page))
        runs = [k for k, t in enumerate(found) if MARK in t.text]
        for k, t in enumerate(found):
            if t.kind == "text" and (words := t.text.replace(MARK, "").split()):
                rows.append(t.features)
                truth.append(MARK in t.text)
                size.append(len(words))
            elif t.kind[0] == "<":
                total[t.kind] += 1
                inside[t.kind] += bool(runs) and runs[0] <= k <= runs[-1]
    names = sorted(f for f, n in Counter(f for r in rows for f in r).items() if n >= 5)
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r if f in place]] = 1
    y, n, w = np.array(truth, float), np.sqrt(size), np.zeros(len(names) + 1)
    penalty = RIDGE * np.append(np.ones(len(names)), 0)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6) * n
        w = w + np.linalg.solve((x * weight[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ ((y - p) * n) - penalty * w)
    tag = {t: -(c - inside[t] + 0.5) / (c + 1) for t, c in total.items()}
    return Weights(float(w[-1]), {f: float(w[i]) for f, i in place.items()}, tag, -(total.total() - inside.total()) / total.total())


@lru_cache(1)
def weights() -> Weights:
    return learn(labelled(PAGES))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, from first to before last; of equal sums the first found. Empty if no sum is positive."""
    best = total = 0.0
    start = first = last = 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, last = total, start, k + 1
    return first, last


def extract(page: str) -> str:
    """The page's main text."""
    known = weights()
    parts = list(tokens(page))
    cache: dict[frozenset[str], float] = {}
    scores: list[float] = []
    shown: list[bool] = []
    for kind, text, _, features in parts:
        show = False
        if kind[0] == "<":
            scores.append(known.tag.get(kind, known.other_tag))
        elif kind == "text" and (n := len(text.split())):
            z = cache.get(features)
            if z is None:
                z = cache[features] = known.odds(features)
            show = z > 0
            scores.append(z * n if show else z)
        else:
            show = kind == "text"
            scores.append(0.0)
        shown.append(show)
    first, last = best_stretch(scores)
    blocks: list[str] = []
    run: list[str] = []
    for k in range(first, last + 1):
        kind, text, begins, _ = parts[k] if k < last else Token("<p", "", True, frozenset())
        if begins:
            if block := _BLANK.sub(" ", _html.unescape("".join(run))).strip():
                blocks.append(block)
            run = []
        elif kind[0] == "<":
            if kind in ("<br", "<td", "<th"):
                run.append(" ")
        elif shown[k]:
            run.append(text)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in slices(batches, "html"):
        texts = [extract(p.decode()) for p in pages.to_pylist()]
        yield pa.RecordBatch.from_arrays([*keep(batch, ["page_id", "url"]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars. No shuffle."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, RESULT)
