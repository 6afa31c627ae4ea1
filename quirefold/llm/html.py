"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 1).

A page is read into leaf blocks: runs of text between block-level tags, with the tags, classes and ids above them.
Each block has binary features (ancestor tags, ancestor class words, its own tag, length, link share, punctuation,
place in the page); a linear-chain conditional random field with two labels (main text or not) scores the sequence,
and Viterbi decoding labels it. The weights are fitted by gradient ascent on the penalised log likelihood of
labelled pages: ``labelled_pages`` builds them from templates in which every block's label is known, a bounded
number of pages that does not depend on the input.

Defined results: null or empty html -> empty text; a page without a main block -> empty text; cut-off pages, open
tags and unknown references are read as far as they go; a tag of more than 65,536 characters ends at its first '>', also
in quotes; a block whose labels score alike is not main text; repeated rows are each answered; input columns named like the results are replaced; an empty
table gives no rows; no shuffle. Time and memory follow a page's length, however deep or unclosed it is: what stands
above a block is shared with its parent, and names that the model doesn't know aren't kept.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's elements without content, those whose text is not shown, and those that don't break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object textarea select button head title canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
#: The elements that give a page its structure.
STRUCTURE = frozenset("article aside footer form header main nav section".split())
#: Which open element a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*'){0,65536}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I | re.A)


def _raw_end(page: str, at: int, tag: str) -> int:
    """Where the end tag of a raw element stands whose text begins at ``at``; the page's end if there is none.

    Nothing else in the text counts, but for a script start tag after ``<!--`` in a script: its end tag is text.
    """
    if tag != "script":
        m = _RAW_END[tag].search(page, at)
        return m.start() if m else len(page)
    comment = inner = False
    while m := _SCRIPT.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            comment, at = True, at if comment else at - 2  # '<!-->' is a whole comment
        elif m[0] == "-->":
            comment = inner = False
        elif m[1] and not inner:
            return m.start()
        else:
            inner = comment and not m[1]
    return len(page)


@dataclass(frozen=True)
class Above:
    """What stands above a block: different features in order, the nearest name or structural element, the nearest tag that
    breaks blocks, whether there is an article or main element."""

    features: tuple[str, ...] = ()
    near: str = "none"
    own: str = "tag:none"
    main: bool = False

    def below(self, tag: str, names: list[str], known: frozenset[str] | None) -> "Above":
        """The same with one more element; shared if that adds nothing."""
        new = [f for f in dict.fromkeys(names) if (known is None or f in known) and f not in self.features]
        near = next((f for f in reversed(names) if f.startswith("name:") or f[4:] in STRUCTURE), self.near)
        own = self.own if tag in INLINE else f"tag:{tag}"
        main = self.main or tag in ("article", "main")
        if not new and (near, own, main) == (self.near, self.own, self.main):
            return self
        return Above((*self.features, *new) if new else self.features, near, own, main)


@dataclass
class Block:
    """A leaf block: its text, how many of its characters are in links, and what stands above it."""

    text: str
    link: int
    above: Above
    features: list[str] = field(default_factory=list)


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The shown leaf blocks in page order, white space collapsed, references decoded.

    ``known``: the features of elements that are kept above a block, all if not given.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, Above, bool, int]] = []  # tag, what it and those above it give, hidden, nearest place that isn't inline
    places: dict[str, list[int]] = {}  # of open elements by tag
    parts: list[str] = []
    page, at = page or "", 0
    link, hidden = 0, 0
    top = above = Above()

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, link, above))
            parts.clear()
            link = 0

    def pop(k: int) -> None:
        nonlocal hidden
        for tag, _, hides, _ in stack[k:]:
            hidden -= hides
            places[tag].pop()
        del stack[k:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at, tag = m.end(), m[2] or m[5]
        if not tag:
            token = m[0]
            if hidden or token.startswith(("<!", "<?")):
                continue
            if not parts:
                above = stack[-1][1] if stack else top
            parts.append(token)
            if places.get("a"):
                link += len(token.strip())
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag not in INLINE:
            flush()
        elif tag == "br":
            if parts:
                parts.append(" ")
            continue
        if closing:
            k, shut = (places.get(t, [-1])[-1] if places.get(t) else -1 for t in (tag, "template"))
            if k >= shut and k >= 0:  # what is in a template ends nothing outside
                pop(k)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and stack:  # a block-level start ends an open paragraph, and its like
            k = stack[-1][3]
            if k >= 0 and (stack[k][0] == "p" or stack[k][0] in ENDS.get(tag, ())):
                pop(k)
        names, hides = [f"tag:{tag}"], tag in HIDDEN
        if attrs:
            for a in _ATTR.finditer(attrs):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id", "role"):
                    names += [f"name:{w}" for w in _WORD.findall(value.lower())]
                elif name == "hidden" or name == "style" and _NONE.search(value) or name == "aria-hidden" and value.lower() == "true":
                    hides = True
        block = len(stack) if tag not in INLINE else stack[-1][3] if stack else -1
        stack.append((tag, (stack[-1][1] if stack else top).below(tag, names, known), hides, block))
        places.setdefault(tag, []).append(len(stack) - 1)
        hidden += hides
        if tag in RAW:
            at = _raw_end(page, at, tag)
    flush()
    return blocks


def add_features(blocks: list[Block]) -> list[Block]:
    """Binary features by name; text is described by its shape, never by its words."""
    for k, b in enumerate(blocks):
        n, marks = len(b.text), sum(b.text.count(c) for c in ".,;!?")
        size = min(6, n.bit_length() // 2 if n < 4096 else 6)
        share = min(3, 3 * b.link // n) if n else 0
        near, own = b.above.near, b.above.own
        b.features = [
            "bias",
            *[f"above:{x}" for x in b.above.features],
            f"own:{own}",
            f"own:{own} in main:{b.above.main}",
            f"near:{near}",
            f"own:{own} near:{near}",
            f"size:{size}",
            f"links:{share}",
            f"marks:{min(3, marks)}",
            f"ends:{b.text[-1] in '.!?:…'}",
            f"sign:{'©' in b.text}",
            f"place:{0 if k == 0 else 2 if k == len(blocks) - 1 else 1}",
        ]
    return blocks


class Crf:
    """Two labels; weights per feature (for label 1 against 0) and between neighbouring labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.by_name = {name: float(weights[k]) for name, k in index.items()}
        self.known = frozenset(name[6:] for name in index if name.startswith("above:"))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best label sequence (Viterbi)."""
        get, m, back = self.by_name.get, self.moves.tolist(), []
        zero = one = 0.0
        for k, b in enumerate(blocks):
            gain = sum(get(f, 0.0) for f in b.features)
            if k:
                from_one = (one + m[1][0] > zero + m[0][0], one + m[1][1] > zero + m[0][1])
                zero, one = max(zero + m[0][0], one + m[1][0]), max(zero + m[0][1], one + m[1][1]) + gain
                back.append(from_one)
            else:
                one = gain
        labels = [int(one > zero)] if blocks else []
        for from_one in reversed(back):
            labels.append(int(from_one[labels[-1]]))
        return labels[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]], epochs: int = 15, rate: float = 0.3, penalty: float = 1e-4) -> "Crf":
        """AdaGrad on the log likelihood; forward-backward gives the expected features of each page."""
        index: dict[str, int] = {}
        data = []
        for blocks, labels in pages:
            at = [np.array([index.setdefault(f, len(index)) for f in b.features]) for b in blocks]
            data.append((np.concatenate(at), np.repeat(np.arange(len(at)), [len(x) for x in at]), np.array(labels)))
        w, moves = np.zeros(len(index)), np.zeros((2, 2))
        gw, gm = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
        for epoch in range(epochs):
            for p in np.random.default_rng([5, epoch]).permutation(len(data)):
                at, row, y = data[p]
                n = len(y)
                gain = np.bincount(row, weights=w[at], minlength=n)
                emit = np.stack([np.zeros(n), gain], axis=1)
                step = np.exp(moves)
                e = np.exp(emit - emit.max(axis=1, keepdims=True))
                f, b = np.zeros((n, 2)), np.ones((n, 2))
                f[0] = e[0] / e[0].sum()
                for k in range(1, n):
                    f[k] = (f[k - 1] @ step) * e[k]
                    f[k] /= f[k].sum()
                for k in range(n - 2, -1, -1):
                    b[k] = step @ (e[k + 1] * b[k + 1])
                    b[k] /= b[k].sum()
                p1 = f * b
                p1 = p1[:, 1] / p1.sum(axis=1)
                grad = np.zeros_like(w)
                np.add.at(grad, at, (y - p1)[row])
                grad -= penalty * w
                both = f[:-1, :, None] * step[None] * (e[1:] * b[1:])[:, None, :]
                both = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                gw += grad * grad
                w += rate * grad / np.sqrt(gw)
                dm = seen - both - penalty * moves
                gm += dm * dm
                moves += rate * dm / np.sqrt(gm)
        return cls(index, w, moves)


#: Names that pages give to their parts, for the labelled pages.
MAIN_NAMES = "content post entry story article body main text single page blog prose markdown reader".split()
SIDE_NAMES = (
    "ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert newsletter subscribe signup social share sharing related recommended "
    "breadcrumb breadcrumbs comment comments reply respond disqus sidebar widget menu nav navigation navbar toolbar header masthead topbar footer bottom copyright "
    "legal tags meta pagination pager popup modal login search"
).split()


def labelled_pages(pages: int = 600, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Pages from templates, read by ``leaf_blocks``; a block's label is known by a mark in its text."""
    rng = random.Random(seed)
    mark = "⁠"  # main text carries this invisible mark until the label is read off

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        return words(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "?", "", " &amp;&amp;&amp;", "###"])

    def paragraph() -> str:
        if rng.random() < 0.2:
            return words(1, 2) + rng.choice(["", ".", ":"])
        return rng.choice([" ", " ", " ", " | ", "!! "]).join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))

    def link(n: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(1, n)}</a>'

    def names(pool: list[str]) -> str:
        own = [rng.choice(pool)] + ([rng.choice(["box", "wrap", "inner", "left", "right", "x"])] if rng.random() < 0.4 else [])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(own)}"'

    def menu() -> str:
        items = [link() for _ in range(rng.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def heading() -> str:
        level = rng.randint(2, 4)
        return f"<h{level}>{words(1, 4)}</h{level}>"

    def filler() -> str:
        return rng.choice([lambda: f"<p>{paragraph()}</p>", sentence, menu, lambda: heading() + menu(), lambda: heading() + f"<p>{paragraph()}</p>", lambda: f"<p>{sentence()} {link()}</p>", lambda: f"<span>{words(1, 5)}</span>", paragraph])()

    def side() -> str:
        kind = rng.random()
        if kind < 0.25:
            tag = rng.choice(["nav", "header", "footer", "aside"])
            start = rng.choice(["", "&copy; ", "&copy; 2020 "]) if tag == "footer" else ""
            start = f"<h1>{words(1, 3)}</h1>" if tag == "header" and rng.random() < 0.6 else start
            return f"<{tag}{names(SIDE_NAMES) if rng.random() < 0.3 else ''}>{start}{menu() if tag == 'nav' else filler()}{filler() if rng.random() < 0.4 else ''}</{tag}>"
        if kind < 0.33:
            return f"<form{names(SIDE_NAMES) if rng.random() < 0.3 else ''}><label>{words(1, 3)}</label><input name=q><p>{paragraph()}</p><button>{words(1, 2)}</button></form>"
        if kind < 0.5:
            tag = rng.choice(["section", "div", "ol"])
            return f"<{tag}{names(['comment', 'comments', 'respond', 'reply', 'disqus'])}>{heading()}" + "".join(f"<{'li' if tag == 'ol' else 'div'}><p>{paragraph()}</p></{'li' if tag == 'ol' else 'div'}>" for _ in range(rng.randint(1, 4))) + f"</{tag}>"
        return f"<div{names(SIDE_NAMES)}>{''.join(filler() for _ in range(rng.randint(1, 2)))}</div>"

    def main_block() -> str:
        kind, text = rng.random(), mark + paragraph()
        if kind < 0.62:
            return f"<p>{text}{'' if rng.random() < 0.2 else '</p>'}"
        if kind < 0.68:
            return f"<p><b>{text}<br>"
        if kind < 0.74:
            return f"<h2>{mark}{words(1, 7)}</h2>"
        if kind < 0.80:
            return "<ul>" + "".join(f"<li>{mark}{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.88:
            return f"<p>{mark}{sentence()} {link()} {sentence()} {link(6)}</p>"
        if kind < 0.91:
            return f"<pre>{text}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{mark}{words(1, 3)}</td><td>{mark}{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{mark}{sentence()}</figcaption></figure>"
        return f"<div>{text}</div>"

    found = []
    for _ in range(pages):
        title = f"<h1>{mark}{words(2, 9)}</h1>"
        inside = [f"<header>{title}</header>" if rng.random() < 0.15 else title] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 8, 14])):
            inside.append(main_block())
            if rng.random() < 0.12:
                inside.append(side())
        if rng.random() < 0.25:
            inside.append(side())
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section", ""])
        start = f"<{tag}{names(MAIN_NAMES) if tag in ('div', 'section') or rng.random() < 0.3 else ''}>" if tag else ""
        body = start + "".join(inside) + (f"</{tag}>" if tag else "")
        if tag == "article" and rng.random() < 0.3:
            body = f"<main>{body}</main>"
        before, after = [side() for _ in range(rng.randint(0, 4))], [side() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            body, before, after = f"<div{names(['wrap', 'container', 'layout', 'site'])}>{''.join(before)}{body}{''.join(after)}</div>", [], []
        blocks = leaf_blocks(f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "").strip()
        if blocks:
            found.append((add_features(blocks), labels))
    return found


@lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 11) -> Crf:
    """The model; the same for every input."""
    return Crf.fit(labelled_pages(pages, seed))


def main_text(page: str | None, model: Crf) -> str:
    blocks = add_features(leaf_blocks(page, model.known))
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def extract(pages: DataFrame, html: str = "html", model: Crf | None = None) -> DataFrame:
    """All other columns of ``pages``, then text and n_chars (replaced if the input has them)."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or trained())
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_qf_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(x, shipped.value) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = source.drop("_qf_html").schema.add("text", "string")
    return source.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
