"""Main text of web pages: boosted trees over elements' features, decoded from the root down.

Features are an element's tag and attribute tokens, its depth and place among its siblings, and the text, links and
tags of its subtree. Each element's log odds of being main text are then decoded together: outside the main text an
element may hold main text further down; inside, it may hold what is left out; what is left out holds nothing. The
labelling of greatest sum is found by one pass up and one down, so that no decision contradicts an ancestor's.

The trees are fitted here on pages that a generator makes, whose main text is known.
"""

from __future__ import annotations

import functools
import html as entities
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import boosting
from tidemill.llm.html_tree import INLINE, RAW, Tree, attributes, parse
from tidemill.llm.store import bounded_batches

#: Groups of tags, and of words in class, id, role and similar attributes.
TAGS = {
    "article": "article main", "section": "section div td center", "text": "p blockquote pre figcaption dd dt", "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl table tbody thead tr th",
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form button input select option textarea label fieldset", "code": "script style noscript template iframe object svg canvas head title meta link",
    "line": " ".join(sorted(INLINE - {"a", "label", "img"})), "link": "a", "page": "html body",
}
WORDS = {
    "main": "article content main post entry story body text maincontent prose", "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs", "header": "header masthead topbar banner logo branding hero",
    "footer": "footer copyright legal colophon bottom contentinfo", "side": "sidebar side aside rail widget widgets related recommended trending popular complementary secondary", "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted outbrain taboola dfp", "comment": "comment comments commentlist reply replies respond responses disqus discussion thread", "share": "share sharing social tweet facebook follow buttons tools meta byline tags",
    "hidden": "hidden none invisible offscreen",
}
_TAG_BIT = {t: 1 << i for i, group in enumerate(TAGS.values()) for t in group.split()}
_WORD_BIT = {w: 1 << (len(TAGS) + i) for i, group in enumerate(WORDS.values()) for w in group.split()}
BITS = len(TAGS) + len(WORDS)
_ALWAYS_OUT = RAW | {"noscript", "template", "svg", "head", "select", "button", "object", "canvas"}
#: What it costs to begin main text below an element outside, and to leave an element out inside it, where none of its own
#: attributes says what it is and where one does; the weight of an element without text of its own, to which a hundredth
#: for each character is added.
ENTER, LEAVE, LEAVE_MARKED, LEAST = 1.0, 0.8, 0.2, 0.9


#: Attributes shorter than this are remembered, so that what is remembered stays small.
SHORT = 400
#: Beyond the features' bits: the element isn't shown.
UNSEEN = 1 << BITS


def _bits(tag: str, raw: str) -> int:
    out = _TAG_BIT.get(tag, 0)
    if raw:
        a = attributes(raw)
        tokens = " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower()
        for sep in "-_:/.":
            tokens = tokens.replace(sep, " ")
        unseen = "hidden" in a or "display:none" in "".join(a.get("style", "").split()).lower()
        if unseen or a.get("aria-hidden") == "true":
            tokens += " hidden"
        out |= UNSEEN * unseen
        for w in tokens.split():
            out |= _WORD_BIT.get(w, 0)
    return out


_short_bits = functools.lru_cache(65536)(_bits)


def bits_of(tag: str, raw: str) -> int:
    return (_short_bits if len(raw) < SHORT else _bits)(tag, raw)


def features(trees: list[Tree]) -> np.ndarray:
    """A row for each element of each tree, in order."""
    own, above, parent, last, depth, base, sibling, siblings = [], [], [], [], [], [], [], []
    text, link, ends = [], [], []
    at = 0
    for t in trees:
        n = len(t.tag)
        bits = [bits_of(tag, raw) for tag, raw in zip(t.tag, t.attrs, strict=True)]
        up = [0] * n
        children = [0] * n
        place = [0] * n
        for i in range(1, n):
            p = t.parent[i]
            up[i] = up[p] | bits[p]
            place[i] = children[p]
            children[p] += 1
        length, linked, marks = [0] * n, [0] * n, [0] * n
        for i, piece in t.pieces:
            if i >= 0 and t.tag[i] not in RAW:
                size = len(piece.strip())
                length[i] += size
                if (bits[i] | up[i]) & _TAG_BIT["a"]:
                    linked[i] += size
                marks[i] += piece.count(".") + piece.count(",")
        own += bits
        above += up
        parent += [p + at if p >= 0 else at for p in t.parent]
        last += [x + at for x in t.last]
        depth += t.depth
        base += [at] * n
        sibling += place
        siblings += [children[p] if p >= 0 else 1 for p in t.parent]
        text += length
        link += linked
        ends += marks
        at += n
    own, above, parent, last, base = (np.array(x, np.int64) for x in (own, above, parent, last, base))
    every = np.arange(at)
    flags = np.arange(BITS)

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(v)])
        return total[last + 1] - total[every]

    text, link, ends = (np.array(x, float) for x in (text, link, ends))
    all_text, all_link, all_ends, tags = below(text), below(link), below(ends), (last - every + 1).astype(float)
    is_text = ((own >> list(TAGS).index("text")) & 1).astype(float)
    paragraphs = below(is_text)
    near = np.maximum(all_text, 1)
    wide = np.maximum(all_text[parent], 1)
    numbers = [
        np.array(depth), np.array(sibling), np.array(sibling) / np.maximum(np.array(siblings), 1), np.array(siblings),
        np.log1p(text), np.log1p(all_text), all_link / near, np.log1p(all_text / tags), all_ends / near, np.log1p(all_text / np.maximum(paragraphs, 1)), np.log1p(paragraphs),
        all_text / np.maximum(all_text[base], 1), np.log1p(wide), all_link[parent] / wide, all_text / wide,
    ]
    return np.concatenate([np.stack(numbers, axis=1).astype(np.float32), ((own[:, None] >> flags) & 1).astype(np.float32), ((above[:, None] >> flags) & 1).astype(np.float32)], axis=1)


def decode(t: Tree, odds: list[float]) -> list[bool]:
    """Which elements are main text."""
    n = len(t.tag)
    length = [0] * n
    for i, piece in t.pieces:
        if i >= 0:
            length[i] += len(piece)
    bits = [bits_of(tag, raw) for tag, raw in zip(t.tag, t.attrs, strict=True)]
    leave = [LEAVE_MARKED if b >> len(TAGS) else LEAVE for b in bits]
    outside, inside = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        inside[i] += -1e9 if t.tag[i] in _ALWAYS_OUT or bits[i] & UNSEEN else max(-6.0, min(6.0, odds[i])) * (LEAST + min(length[i], 400) / 100)
        p = t.parent[i]
        if p >= 0:
            outside[p] += max(outside[i], inside[i] - ENTER)
            inside[p] += max(inside[i], -leave[i])
    state = [False] * n
    dead = [False] * n
    for i in range(1, n):
        p = t.parent[i]
        if dead[p]:
            dead[i] = True
        elif state[p]:
            state[i] = inside[i] >= -leave[i]
            dead[i] = not state[i]
        else:
            state[i] = inside[i] - ENTER > outside[i]
    return state


def text_of(t: Tree, state: list[bool]) -> str:
    """Main text: references of each piece decoded, blocks' white space as one space, blocks joined by one space."""
    return " ".join("".join(" " if i < 0 else entities.unescape(piece) if "&" in piece else piece for i, piece in t.pieces if i < 0 or state[i]).split())


def _page(r: random.Random) -> tuple[str, str]:
    """A made page; in it, main text is between \\x01 and \\x02 marks."""
    letters = "etaoinshrdlucmfwgypbvk"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 10)))
    few = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: few(4, 22).capitalize() + r.choice([".", ".", ".", "?", ", " + few(3, 9) + "."])
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    semantic, classes = r.random() < 0.65, r.random() < 0.75

    def box(tag: str, names: str, inner: str, plain: str = "div") -> str:
        use = tag if semantic else plain
        name = r.choice(names.split())
        attr = f' {r.choice(["class", "id"])}="{name}{r.choice(["", "-" + word(), " " + word()])}"' if (classes or use == "div") and r.random() < (0.6 if use == tag and semantic else 0.93) else ""
        return f"<{use}{attr}>{inner}</{use}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">{few(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
    name = lambda names: r.choice(names.split()) + r.choice(["", "", "-" + word(), " " + word(), "-box", "-container", "-wrapper", "-area"])
    inside = lambda: r.choice([few(3, 20), few(3, 20) + ".", f"<p>{prose(1, 2)}</p>", f"<span>{few(1, 3)}</span><p>{prose(1, 2)}</p>", f"<h3>{few(1, 4)}</h3><p>{prose(1, 3)}</p>"])
    advert = lambda: f'<div {r.choice(["class", "class", "id"])}="{name("ad ads advert advertisement sponsored promo")}">{inside()}</div>'
    signup = lambda: f'<div class="{name("newsletter signup subscribe")}"><p>{prose(1, 2)}</p><form><input><button>{word()}</button></form></div>'
    widgets = lambda: f'<div {r.choice(["class", "id"])}="{name("sidebar widgets secondary rail")}">' + "".join(f'<div class="{name("widget related popular")}"><h4>{few(1, 3)}</h4>{r.choice([links(r.randint(2, 6)), f"<p>{prose(1, 3)}</p>"])}</div>' for _ in range(r.randint(1, 3))) + "</div>"
    end = lambda tag: f"</{tag}>" if r.random() < 0.9 else ""

    unseen = lambda inner: r.choice([f"<p hidden>{inner}</p>", f'<div style="display: none">{inner}</div>', f'<p class="hidden">{inner}</p>'])
    in_line = lambda: r.choice([f'<span class="{r.choice(["ad", "advert", "sponsored", "promo-box"])}">{few(1, 6)}</span>', f'<a class="{r.choice(["share", "comment-reply", "ad-link"])}" href="/{word()}">{few(1, 3)}</a>'])

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.04:
            return f"<p>\x01{prose(1, 3)}\x02{in_line()}\x01{r.choice(['', sentence()])}\x02{end('p')}"
        if kind < 0.07:
            return unseen(prose(1, 2))
        if kind < 0.62:
            return f"<p>\x01{prose(1, 7)}{r.choice(['', f' <a href=/{word()}>{few(1, 4)}</a> ' + sentence(), f' <b>{few(1, 3)}</b> ' + sentence()])}\x02{end('p')}"
        if kind < 0.72:
            return f"<h{(k := r.randint(2, 4))}>\x01{few(2, 7)}\x02</h{k}>"
        if kind < 0.79:
            return "<ul>" + "".join(f"<li>\x01{few(3, 14)}\x02{end('li')}" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.84:
            return f"<blockquote>\x01{prose(1, 3)}\x02</blockquote>"
        if kind < 0.88:
            return f"<p><b>\x01{sentence()}\x02<br>"
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>\x01{few(1, 3)}\x02</td><td>\x01{few(1, 5)}\x02</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind < 0.94:
            return f"<pre>\x01{few(4, 20)}\x02</pre>"
        return r.choice([advert(), advert(), signup(), f'<div class="share">{few(2, 5)}</div>', box("aside", "related newsletter promo", few(2, 6) + links(3)), f"<script>{word()}()</script>", f"<form class=signup><label>{few(2, 5)}</label><input><button>{word()}</button></form>"])

    title = few(2, 10)
    if r.random() < 0.09:  # text that nothing, or hardly anything, holds
        parts = [f"\x01{few(2, 8) if r.random() < 0.3 else prose(1, 6)}\x02" for _ in range(r.choice([1, 1, 2, 3, 5, 8]))]
        return r.choice(["<br><br>", "<br>\n", "\n\n", "<p>"]).join(parts), title
    heading = f"<h1>\x01{title}\x02</h1>" if r.random() < 0.92 else ""
    if r.random() < 0.25:
        heading += box("div", "byline meta share", few(2, 6))
    if r.random() < 0.2:  # hardly anything
        heading = heading or f"<h1>\x01{title}\x02</h1>"
        body = heading + "".join(f"<p>\x01{few(2, 12)}{r.choice(['.', ''])}\x02{end('p')}" for _ in range(r.randint(0, 2)))
    else:
        body = heading + "".join(paragraph() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 18])))
    comments = box("section", "comments comment-list discussion replies", f"<h3>{few(1, 3)}</h3>" + "".join(f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><b>{word()}</b><p>{prose(1, 4)}</p></div>' for _ in range(r.randint(1, 5)))) if r.random() < 0.35 else ""
    inner_comments = r.random() < 0.3
    article = box("article", "article post content entry story main-content", body + comments * inner_comments)
    if r.random() < 0.35:
        article = box("main", "main content page-content", article)
    if not inner_comments:
        article += comments
    header = box("header", "header masthead site-header topbar", f"<a href=/>{few(1, 3)}</a>" + (f"<p>{few(3, 10)}</p>" if r.random() < 0.4 else "")) if r.random() < 0.6 else ""
    nav = box("nav", "nav menu navbar navigation breadcrumb", links(r.randint(2, 9))) if r.random() < 0.85 else ""
    side = box("aside", "sidebar side rail widget related", f"<h3>{few(1, 3)}</h3>" + links(r.randint(2, 7)) + (f"<p>{prose(1, 2)}</p>" if r.random() < 0.5 else "")) if r.random() < 0.4 else widgets() if r.random() < 0.6 else ""
    notice = box("div", "cookie-notice consent notice alert popup gdpr", f"<p>{prose(1, 2)}</p><button>{word()}</button>") if r.random() < 0.35 else ""
    footer = box("footer", "footer site-footer copyright legal", r.choice([f"&copy; {few(1, 8)}", f"<p>&copy; {few(1, 4)} &middot; {prose(1, 2)}</p>" + links(3), links(4)])) if r.random() < 0.9 else ""
    parts = [notice, header, nav, advert() if r.random() < 0.5 else "", side if r.random() < 0.5 else "", article, side if r.random() < 0.5 else "", box("form", "newsletter signup login", f"<label>{few(2, 8)}</label><input>", "form") if r.random() < 0.2 else "", footer]
    page = "".join(parts)
    if r.random() < 0.3:
        page = f'<div class="{r.choice(["wrapper", "page", "container", word()])}">{page}</div>'
    if r.random() < 0.9:
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{page}' + ("</body></html>" if r.random() < 0.9 else "")
    return page, title


def training_set(pages: int, seed: int) -> tuple[list[Tree], list[list[float]]]:
    """Parsed made pages, and each element's label: 1 or 0 if all its text is main text or none is, else NaN."""
    r = random.Random(seed)
    trees, labels = [], []
    for _ in range(pages):
        t = parse(_page(r)[0])
        main, other, inside = [0] * len(t.tag), [0] * len(t.tag), False
        cleaned = []
        for i, piece in t.pieces:
            for part in piece.replace("\x01", "\x00\x01").replace("\x02", "\x02\x00").split("\x00") if i >= 0 else ():
                inside = inside or part.startswith("\x01")
                size = len(part.strip("\x01\x02 "))
                (main if inside else other)[i] += size
                inside = inside and not part.endswith("\x02")
            cleaned.append((i, piece.replace("\x01", "").replace("\x02", "")))
        t.pieces[:] = cleaned
        for i in range(len(t.tag) - 1, 0, -1):
            main[t.parent[i]] += main[i]
            other[t.parent[i]] += other[i]
        trees.append(t)
        labels.append([float("nan") if m and o or not m and not o else float(m > 0) for m, o in zip(main, other, strict=True)])
    return trees, labels


@functools.lru_cache(1)
def default_model() -> boosting.Trees:
    """Fitted on 1400 made pages; the same in every process."""
    trees, labels = training_set(1400, 17)
    x, y = features(trees), np.array([v for one in labels for v in one])
    known = ~np.isnan(y)
    return boosting.fit(x[known], y[known])


def extract_texts(pages: list[str | None], model: boosting.Trees) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    odds = model.log_odds(features(trees)).tolist()
    out, at = [], 0
    for t in trees:
        n = len(t.tag)
        out.append(text_of(t, decode(t, odds[at : at + n])))
        at += n
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                texts = extract_texts(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: boosting.Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages; text is the main text of the whole html.

    Character references are decoded. White space, also of references, inside a block becomes one space; blocks are
    trimmed and joined in page order by one space. Null or empty html, and pages without main text, give "". Broken
    markup is read as far as it goes. Null ids and urls stay null, repeated rows give equal rows, other columns aren't
    read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(spark.sparkContext.broadcast(model or default_model())), "page_id long, url string, text string, n_chars long")
