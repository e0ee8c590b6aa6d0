"""Main-text extraction: a linear-chain CRF labels the leaf blocks of a page as article or not.

A page is cut into leaf blocks: runs of text between block-level tags. Features of a block are the tags, class
and id words of its ancestors, its own shape (length, links, punctuation) and that of its neighbours. The chain
is trained on labelled pages (``labelled_pages``: pages put together by rule, each block with its label) and
decoded by Viterbi.

Null and empty html has no blocks and gives an empty text. Rows never meet: repeated rows get equal texts and
null ids pass through; extra columns are ignored; an empty table gives an empty result. Time and memory are linear in
the page, however deep its tags nest.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from boxlake.llm import crf
from boxlake.llm.common import slices

# tag sets of HTML: fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select option datalist canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre "
                  "section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"button", "label", "body", "html", "head"}
OWN_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSERS = frozenset(OWN_CLOSERS)
SCOPE = frozenset("ul ol table td th dl article section div body html blockquote aside nav main footer header form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
#: a tag with a quote that nothing closes ends at its first ``>``
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
DIGIT = re.compile(r"\d")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")

# words in class, id and role that speak for or against the article
GOOD_NAMES = frozenset("article post entry content body main text story page prose markdown".split())
BAD_NAMES = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb "
                      "breadcrumbs header masthead footer sidebar side aside widget related recommended comment comments reply replies "
                      "discussion respond cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search "
                      "share sharing social toolbar pagination pager tags meta byline skip copyright legal disclaimer form".split())
ANCESTORS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "section", "button", "label", "a",
             "blockquote", "figure", "details", "dialog", "menu", "address", "head")
LEAVES = ("p", "h1", "h2", "h3", "h4", "li", "td", "th", "div", "pre", "dd", "figcaption", "span", "blockquote")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    ancestors: frozenset[str] = frozenset()
    leaf: str = "span"
    depth: int = 0
    good: bool = False
    bad: bool = False
    linked: int = 0
    text: str = ""


class Open:
    """Open tags of a page, with counts by kind, so that a text or tag costs the same at every depth."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.count: Counter[str] = Counter()
        self.good = self.bad = 0
        self.leaves: list[str] = []  # block-level tags
        self.marks: list[str] = []  # tags that close their like, and tags that bound them

    def push(self, name: str, names: frozenset[str]) -> None:
        good, bad = bool(names & GOOD_NAMES), bool(names & BAD_NAMES)
        self.stack.append((name, good, bad))
        self.count[name] += 1
        self.good += good
        self.bad += bad
        if name in BLOCK:
            self.leaves.append(name)
        if name in CLOSERS or name in SCOPE:
            self.marks.append(name)

    def close(self, name: str) -> None:
        while self.count[name]:
            last, good, bad = self.stack.pop()
            self.count[last] -= 1
            self.good -= good
            self.bad -= bad
            if last in BLOCK:
                self.leaves.pop()
            if last in CLOSERS or last in SCOPE:
                self.marks.pop()
            if last == name:
                break

    def block(self) -> Block:
        return Block(ancestors=frozenset(t for t in ANCESTORS if self.count[t]), leaf=self.leaves[-1] if self.leaves else "span",
                     depth=len(self.stack), good=self.good > 0, bad=self.bad > 0)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Content of scripts, styles and the like is no text."""
    tags = Open()
    blocks, now, pos = [], None, 0

    def text(s: str) -> None:
        nonlocal now
        if not s or (now is None and s.isspace()):
            return
        if now is None:
            now = tags.block()
            blocks.append(now)
        now.parts.append(s)
        if tags.count["a"]:
            now.linked += len(s)

    while True:
        at = page.find("<", pos)
        m = (TOKEN.match(page, at) or BROKEN.match(page, at)) if at >= 0 else None
        if at < 0:
            text(page[pos:])
            break
        if m is None:
            text(page[pos:at + 1])
            pos = at + 1
            continue
        text(page[pos:at])
        pos = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                now = None
            tags.close(name)
            continue
        if name == "br":
            text(" ") if now else None
            continue
        if name in BLOCK:
            now = None
            if name in CLOSES_P:
                tags.close("p")
            for t in reversed(tags.marks if name in CLOSERS else ()):
                if t in OWN_CLOSERS[name]:
                    tags.close(t)
                    break
                if t in SCOPE:
                    break
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        names = frozenset(w for a in ATTRIBUTE.finditer(m[3]) for w in SPLIT_NAME.split((a[2] or a[3] or a[4] or "").lower()) if w)
        tags.push(name, names)
    for b in blocks:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
    return [b for b in blocks if b.text]


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: ancestors, own shape, place, and the shape of both neighbours."""
    if not blocks:
        return np.zeros((0, len(ANCESTORS) + len(LEAVES) + 4 + 3 * 9))
    where, shape = [], []
    for k, b in enumerate(blocks):
        text = b.text
        where.append([t in b.ancestors for t in ANCESTORS] + [b.leaf == t for t in LEAVES]
                     + [b.good, b.bad, k / len(blocks), b.depth / 10])
        n, words = len(text), text.count(" ") + 1
        shape.append([np.log1p(n), np.log1p(words), min(1.0, b.linked / n), sum(map(text.count, ".,;:!?")) / words,
                      text[-1] in ".!?…\"'»”", text[0].isupper(), "©" in text or "·" in text or "|" in text,
                      len(DIGIT.findall(text)) / n, b.bad])
    s = np.array(shape, float)
    zero = np.zeros((1, s.shape[1]))
    return np.column_stack([np.array(where, float), s, np.vstack([zero, s[:-1]]), np.vstack([s[1:], zero])])


def _words(r: random.Random, n: int, capital: bool = True) -> str:
    ws = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(ws).capitalize() if capital else " ".join(ws)


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(1, 25)) + r.choice([".", ".", ".", "!", "?", ""]) for _ in range(n))


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page put together by rule, with the label of each of its leaf blocks."""
    out, labels = [], []

    def add(markup: str, label: int, blocks: int = 1) -> None:
        out.append(markup)
        labels.extend([label] * blocks)

    def attr(*names: str) -> str:
        return r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="x-{r.choice(names)} w{r.randint(0, 9)}"'])

    def links(tag: str = "ul") -> None:
        n = r.randint(2, 7)
        add(f"<{tag}>" + "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n)) + f"</{tag}>", 0, n)

    def junk(kind: str) -> None:
        if kind == "nav":
            out.append(r.choice(["<nav>", "<nav><ul>", f"<div{attr('nav', 'menu', 'navbar', 'breadcrumbs')}>"]))
            links()
            out.append("</nav>" if out[-2].startswith("<nav") else "</div>")
        elif kind == "header":
            add(f"<header{attr('masthead', 'header', 'top')}><a href='/'>{_words(r, 2)}</a></header>", 0)
        elif kind == "aside":
            out.append(r.choice(["<aside>", f"<aside{attr('sidebar', 'related')}>"]))
            add(f"<h3>{_words(r, 2)}</h3>", 0)
            links()
            if r.random() < 0.5:
                add(f"<p>{_sentences(r, r.randint(1, 4))}</p>", 0)
            out.append("</aside>")
        elif kind == "side":
            add(f"<div{attr('sidebar', 'related', 'widget', 'recommended')}><h4>{_words(r, 2)}</h4><p>{_sentences(r, r.randint(1, 5))}</p></div>", 0, 2)
        elif kind == "ad":
            add(f"<div{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{_sentences(r, r.randint(1, 3))}</div>", 0)
        elif kind == "notice":
            add(f"<div{attr('cookie', 'consent', 'notice', 'alert', 'popup', 'newsletter')}><p>{_sentences(r, r.randint(1, 3))}</p><button>{_words(r, 1)}</button></div>", 0, 2)
        elif kind == "form":
            add(f"<form action='/s'><label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button></form>", 0, 2)
        elif kind == "share":
            add(f"<div{attr('share', 'social', 'tags', 'pagination', 'meta', 'byline')}><a href='#'>{_words(r, 1)}</a> <a href='#'>{_words(r, 1)}</a></div>", 0)
        elif kind == "comments":
            n = r.randint(1, 5)
            add(f"<{(t := r.choice(['section', 'div']))}{attr('comments', 'discussion', 'replies')}><h3>{_words(r, 2)}</h3>"
                + "".join(f"<{(u := r.choice(['p', 'div']))}{attr('comment', 'reply')}>{_sentences(r, r.randint(1, 6))}</{u}>" for _ in range(n)) + f"</{t}>", 0, n + 1)
        elif kind == "footer":
            add(r.choice([f"<footer>&copy; {_words(r, 1)}.example &middot; {_sentences(r, r.randint(1, 3))}</footer>",
                          f"<footer><p>{_sentences(r, r.randint(1, 3))}</p></footer>", f"<div{attr('footer', 'copyright', 'legal')}>&copy; {_words(r, 3)}</div>"]), 0)

    def article() -> None:
        open_, close = r.choice([("<article>", "</article>")] * 4 + [("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{attr('content', 'post', 'entry', 'article', 'story')}>", "</div>")])
        out.append(open_)
        add(f"<h1>{_words(r, r.randint(1, 9))}{r.choice(['', '.'])}</h1>", 1)
        for _ in range(r.choice([1, 2, 3, 5, 8, 15])):
            x = r.random()
            if x < 0.7:
                add(r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(_sentences(r, r.choice([1, 1, 2, 4, 8]))), 1)
            elif x < 0.78:
                add(f"<h2>{_words(r, r.randint(1, 5))}</h2>", 1)
            elif x < 0.84:
                n = r.randint(2, 4)
                add("<ul>" + "".join(f"<li>{_sentences(r, 1)}</li>" for _ in range(n)) + "</ul>", 1, n)
            elif x < 0.88:
                add(f"<blockquote>{_sentences(r, 2)}</blockquote>", 1)
            elif x < 0.91:
                add(f"<table><tr><td>{_words(r, 2)}</td><td>{_words(r, 2)}</td></tr></table>", 1, 2)
            elif x < 0.94:
                add(f"<figure><figcaption>{_sentences(r, 1)}</figcaption></figure>", 1)
            elif x < 0.97:
                add(f"<pre>{_words(r, 6, False)}</pre>", 1)
            else:
                junk(r.choice(["ad", "share", "aside", "form", "side"]))
        if r.random() < 0.15:
            junk("comments")
        out.append(close)

    for kind in ("notice", "header", "nav", "ad", "side", "form"):
        if r.random() < (0.75 if kind in ("nav", "ad") else 0.3):
            junk(kind)
    article()
    for kind in ("share", "ad", "comments", "aside", "notice", "nav", "footer"):
        if r.random() < (0.85 if kind == "footer" else 0.25):
            junk(kind)
    return "<html><body>" + "".join(out) + "</body></html>", labels


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]


@cache
def trained(n: int = 400, seed: int = 11) -> crf.Chain:
    """The chain fitted to ``n`` labelled pages (under half a second of work per hundred)."""
    rows, lengths, labels = [], [], []
    for page, own in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(own):
            raise ValueError("labels do not fit the blocks")
        rows.append(features(blocks))
        lengths.append(len(own))
        labels += own
    return crf.fit(np.vstack(rows), np.array(lengths), np.array(labels))


def extract_texts(chain: crf.Chain, pages: list[str]) -> list[list[str]]:
    """Texts of the article blocks of each page."""
    blocks = [leaf_blocks(p) for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    if not lengths.sum():
        return [[] for _ in pages]
    label = crf.viterbi(chain, np.vstack([features(b) for b in blocks if b]), lengths)
    ends = np.cumsum(lengths)
    return [[b.text for b, y in zip(bs, label[e - len(bs):e], strict=True) if y] for bs, e in zip(blocks, ends, strict=True)]


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            chain: crf.Chain | None = None) -> DataFrame:
    """Columns ``keep`` with text, n_chars and n_blocks (article blocks)."""
    chain = chain or trained()
    chosen = pages.select(*keep, F.col(html).alias("_html"))
    schema = (StructType([chosen.schema[i] for i in range(len(keep))])
              .add("text", StringType()).add("n_chars", LongType()).add("n_blocks", LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html", 2 << 20):
            found = extract_texts(chain, [h or "" for h in b.column("_html").to_pylist()])
            texts = [" ".join(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(x) for x in found], pa.int64())], [*keep, "text", "n_chars", "n_blocks"])

    return chosen.mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", "n_chars")
