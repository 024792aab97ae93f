"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

Features of a block are its ancestors' tags and class words and its text; two labels (article or not) form the
chain. It is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

#: Bound of the fitted model: pages that it learns from, and times that each is laid out anew.
SAMPLE_PAGES = 300
LAYOUTS = 3

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
#: Of these, the ones that hold markup: where they are not closed, the page goes on after their start.
LOOSE = frozenset("noscript template svg object select".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that end an open one of the same kind.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


TELLING = frozenset("article main nav header footer aside form dialog fieldset section figure".split())


def class_words(attributes: str) -> tuple[str, ...]:
    return tuple(w.lower() for m in ATTRIBUTE.finditer(attributes) for w in PART.findall(m[1] or m[2] or m[3] or ""))


def leaf_blocks(page: str | None) -> list[tuple[tuple[tuple[str, tuple[str, ...]], ...], str, int]]:
    """(ancestors, text, characters inside links) of the stretches of text between block boundaries, in page order.

    Character references are decoded, white space is one space, ends are trimmed, empty blocks are left out. Scripts,
    styles and other text that is not shown are no blocks; damaged markup is read as browsers do, roughly.
    """
    if not page:
        return []
    stack: list[tuple[str, tuple[str, ...]]] = []
    out, buffer, linked = [], [], 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                out.append((tuple(x for x in stack if x[0] not in INLINE or x[1]), text, linked))
            buffer.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            shown = html.unescape(piece)
            buffer.append(shown)
            linked += len(shown) if links else 0
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
                continue
            names = [x[0] for x in stack]
            if tag in names:
                if tag not in INLINE:
                    flush()
                cut = len(names) - 1 - names[::-1].index(tag)
                # the end of an inline element leaves blocks that were opened inside it
                if tag in INLINE and any(x not in INLINE for x in names[cut + 1 :]):
                    del stack[cut]
                else:
                    del stack[cut:]
                links = sum(x[0] == "a" for x in stack)
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else at if tag in LOOSE else size
            if tag not in ("svg",):
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
            names = [x[0] for x in stack]
            if tag in CLOSES_P and "p" in names:
                del stack[len(names) - 1 - names[::-1].index("p") :]
            elif tag in SAME:
                for k in range(len(names) - 1, -1, -1):
                    if names[k] in SAME[tag]:
                        del stack[k:]
                        break
                    if names[k] in ("ul", "ol", "dl", "table"):
                        break
        if tag not in VOID:
            stack.append((tag, class_words(m[3])))
            links += tag == "a"
    flush()
    return out


def block_features(path: tuple, text: str, linked: int, place: float) -> list[str]:
    out = ["bias"]
    for tag, words in path:
        if tag not in ("html", "body", "div", "span"):
            out.append("in:" + tag)
        out.extend("word:" + w for w in words)
    if path:
        out.append("leaf:" + path[-1][0])
    near = next((x for x in reversed(path) if x[1] or x[0] in TELLING), None)
    if near:
        out.append("near:" + near[0])
        out.extend("near:" + w for w in near[1])
    n = len(text)
    words = text.count(" ") + 1
    out.append(f"words:{min(6, words.bit_length())}")
    out.append(f"links:{min(3, 4 * linked // max(1, n))}")
    out.append("stop" if text[-1] in ".!?…\"'”" else "open")
    out.append(f"marks:{min(4, sum(map(text.count, '.,;:!?')))}")
    if text[0] in "©®" or "©" in text:
        out.append("copyright")
    if any(c in text for c in "|›»·•"):
        out.append("separators")
    out.append(f"place:{int(4 * place)}")
    return list(dict.fromkeys(out))


def page_features(blocks: list) -> list[list[str]]:
    n = len(blocks)
    return [block_features(path, text, linked, k / n) for k, (path, text, linked) in enumerate(blocks)]


#: The ways in which pages mark their parts, as (tag, class words).
PARTS = {
    "article": [("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post content"), ("div", "entry content"), ("section", "story"), ("div", "main content"), ("div", "text"), ("div", "post"), ("article", "post")],
    "menu": [("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navigation"), ("nav", "navbar"), ("div", "breadcrumb"), ("ul", "menu"), ("div", "topnav")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site header"), ("div", "top bar"), ("div", "logo")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "site footer"), ("div", "bottom"), ("div", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("aside", "sidebar"), ("div", "recommended"), ("div", "trending"), ("div", "share"), ("div", "social"), ("div", "tags")],
    "notice": [("div", "cookie"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "cookie banner"), ("div", "popup"), ("div", "modal"), ("div", "newsletter"), ("div", "gdpr"), ("dialog", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("div", "promotion"), ("div", "banner ad"), ("div", "sponsor")],
    "form": [("form", ""), ("form", "search"), ("div", "login"), ("form", "subscribe"), ("div", "signup"), ("fieldset", ""), ("div", "search")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment list"), ("ol", "commentlist"), ("div", "comment"), ("div", "replies"), ("div", "reviews"), ("div", "discussion")],
}
ASIDE = {x[0] for k, v in PARTS.items() if k not in ("article",) for x in v} - {"div", "ul", "ol", "section"}
WORDS = {w for k, v in PARTS.items() if k != "article" for _, x in v for w in x.split()} - {"site", "list", "bar", "body", "top", "bottom", "banner"}


def label_by_markup(path: tuple) -> int:
    """1 for a block whose nearest telling ancestor is an article or main element, 0 otherwise."""
    for tag, words in reversed(path):
        if tag in ASIDE or WORDS & set(words):
            return 0
        if tag in ("article", "main"):
            return 1
    return 0


def laid_out_anew(blocks: list, labels: list[int], rng: random.Random) -> tuple[list, list[int]]:
    """A labelled page with the same texts in other containers, with parts that the page lacks among them."""
    inside = [(path[-1][0] if path and path[-1][0] not in ("article", "main") else "p", text, linked) for (path, text, linked), y in zip(blocks, labels, strict=True) if y]
    around = [(text, linked) for (_, text, linked), y in zip(blocks, labels, strict=True) if not y]
    if not inside:
        return [], []
    frame = (("html", ()), ("body", ()), *([("div", (rng.choice(["page", "wrapper", "container", "site"]),))] if rng.random() < 0.6 else []))

    def part(kind: str, inner: tuple = ()) -> list:
        tag, words = rng.choice(PARTS[kind])
        path = (*frame, *inner, (tag, tuple(words.split())))
        made = []
        if kind in ("header", "sidebar", "comments", "footer") and rng.random() < 0.4:
            made.append(((*path, (rng.choice(["h1", "h2", "h3", "p"]), ())), " ".join(rng.choice(inside)[1].split()[: rng.randint(1, 6)]), 0))
        for _ in range(rng.randint(1, 6 if kind in ("menu", "comments") else 2)):
            if kind in ("menu", "sidebar", "header") and around:
                text, _ = rng.choice(around)
                text = " ".join(text.split()[: rng.randint(1, 5)])
                made.append(((*path, ("ul", ()), ("li", ())) if rng.random() < 0.6 else path, text, len(text) if rng.random() < 0.7 else 0))
            else:
                text = rng.choice(inside)[1]
                words_ = text.split()
                lo = rng.randrange(len(words_))
                text = " ".join(words_[lo : lo + (rng.randint(2, 40) if kind in ("comments", "notice", "advert") else rng.randint(1, 6))])
                tag = {"form": rng.choice(["label", "button", "p"]), "comments": rng.choice(["p", "li", "div"])}.get(kind, rng.choice(["p", "div", ""]))
                made.append(((*path, (tag, ())) if tag else path, text, 0))
        return made

    tag, words = rng.choice(PARTS["article"])
    body = (tag, tuple(words.split()))
    out: list[tuple[tuple, str, int]] = []
    y: list[int] = []
    for kind in ("header", "menu", "notice", "advert", "form"):
        if rng.random() < 0.5:
            some = part(kind)
            out += some
            y += [0] * len(some)
    for leaf, text, linked in inside:
        kind = rng.random()
        if leaf == "p" and kind < 0.2:
            inner = rng.choice([(("ul", ()), ("li", ())), (("blockquote", ()),), (("blockquote", ()), ("p", ())), (("h2", ()),), (("ol", ()), ("li", ())), (("table", ()), ("tr", ()), ("td", ())), (("div", ()),), (("pre", ()),), (("section", ()), ("p", ()))])
            short = text.split()
            some = [" ".join(short[i : i + 8]) for i in range(0, min(len(short), 24), 8)] if kind < 0.12 else [text]
            out += [((*frame, body, *inner), t, 0) for t in some]
            y += [1] * len(some)
        else:
            out.append(((*frame, body, (leaf, ())), text, linked))
            y.append(1)
        if rng.random() < 0.06:
            some = part(rng.choice(["advert", "sidebar", "form", "notice"]), (body,))
            out += some
            y += [0] * len(some)
    for kind in ("sidebar", "comments", "notice", "form", "menu", "footer"):
        if rng.random() < 0.5:
            some = part(kind, (body,) if kind in ("comments", "sidebar") and rng.random() < 0.4 else ())
            out += some
            y += [0] * len(some)
    return out, y


def fit_crf(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 10, rate: float = 0.1, ridge: float = 1e-4, seed: int = 3) -> dict:
    """Weights {feature: log-odds of article} and moves[i][j] from label i to j, by stochastic gradient of the
    conditional likelihood; step sizes adapt to each weight."""
    names = sorted({f for xs, _ in pages for x in xs for f in x})
    number = {f: k for k, f in enumerate(names)}
    data = [([np.array([number[f] for f in x]) for x in xs], np.array(y)) for xs, y in pages if xs]
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    moves, seen_moves = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            xs, y = data[k]
            n = len(y)
            score = np.zeros((n, 2))
            score[:, 1] = [w[x].sum() for x in xs]
            ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0]
            for t in range(1, n):
                ahead[t] = score[t] + np.logaddexp(ahead[t - 1, 0] + moves[0], ahead[t - 1, 1] + moves[1])
            for t in range(n - 2, -1, -1):
                v = back[t + 1] + score[t + 1]
                back[t] = np.logaddexp(moves[:, 0] + v[0], moves[:, 1] + v[1])
            total = np.logaddexp(*ahead[-1])
            g = np.exp(ahead[:, 1] + back[:, 1] - total) - y
            flat, values = np.concatenate(xs), np.repeat(g, [len(x) for x in xs])
            places, inverse = np.unique(flat, return_inverse=True)
            step = np.bincount(inverse, values) + ridge * w[places]
            seen[places] += step**2
            w[places] -= rate * step / np.sqrt(seen[places])
            if n > 1:
                both = np.exp(ahead[:-1, :, None] + moves + (back[1:] + score[1:])[:, None, :] - total).sum(0)
                both -= np.bincount(y[:-1] * 2 + y[1:], minlength=4).reshape(2, 2)
                seen_moves += both**2
                moves -= rate * both / np.sqrt(seen_moves)
    return {"weights": {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, "moves": moves.tolist()}


def decode(model: dict, xs: list[list[str]]) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi); ties go to 0."""
    if not xs:
        return []
    get = model["weights"].get
    (a, b), (c, d) = model["moves"]
    zero, one = 0.0, sum(get(f, 0.0) for f in xs[0])
    came = []
    for x in xs[1:]:
        s = sum(get(f, 0.0) for f in x)
        to0, to1 = one + c > zero + a, one + d > zero + b
        came.append((to0, to1))
        zero, one = (one + c if to0 else zero + a), (one + d if to1 else zero + b) + s
    label = int(one > zero)
    out = [label]
    for pair in reversed(came):
        label = int(pair[label])
        out.append(label)
    return out[::-1]


def fit_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> dict:
    """A model from at most about `sample` pages, chosen by a hash of the id, that mark their article: each as it is
    and laid out anew. Without such pages it has no weights and every block is boilerplate."""
    rows = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]"))
    n = rows.count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(place < min(1.0, 1.5 * sample / n if n else 1.0)).select(F.col(id_col), F.col(html_col)).limit(2 * sample)
    found = sorted(((str(r[0]), r[1]) for r in some.collect()))[:sample]
    rng = random.Random(11)
    data = []
    for _, page in found:
        blocks = leaf_blocks(page)
        labels = [label_by_markup(path) for path, _, _ in blocks]
        data.append((page_features(blocks), labels))
        for _ in range(layouts):
            other, y = laid_out_anew(blocks, labels, rng)
            data.append((page_features(other), y))
    return fit_crf(data) if any(xs for xs, _ in data) else {"weights": {}, "moves": [[0.0, 0.0], [0.0, 0.0]]}


def extract(pages: DataFrame, model: dict, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the html unless told) with text and blocks, an array of (path, text, main).

    text joins the article's blocks in page order by one newline; null and empty pages and pages without an article
    give the empty text. Repeated rows are read alike; columns named text or blocks are replaced.
    """
    names = [c for c in (keep or pages.columns) if c not in (html_col, "text", "blocks")]
    rows = pages.select(*names, F.col(html_col).alias("_html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, parts = [], []
            for page in batch["_html"]:
                blocks = leaf_blocks(page)
                labels = decode(model, page_features(blocks))
                texts.append("\n".join(t for (_, t, _), y in zip(blocks, labels, strict=True) if y))
                parts.append([{"path": "/".join(tag for tag, _ in path), "text": t, "main": bool(y)} for (path, t, _), y in zip(blocks, labels, strict=True)])
            yield batch.drop(columns="_html").assign(text=texts, blocks=parts)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields)
    return rows.mapInPandas(read, f"{fields}, text string, blocks array<struct<path:string,text:string,main:boolean>>")


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, fit_extractor(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.size("blocks").alias("n_blocks"))
