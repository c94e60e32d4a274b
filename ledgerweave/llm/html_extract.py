"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, each with the tags, classes and ids above it and features of its text.
The field is trained by maximum likelihood (forward-backward) on labelled pages - generated here from a grammar of
page layouts, as the tables hold none - and pages are decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_blocks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^<>]*>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: fixed values: tags that end a block, that hold no content, whose content is no text, that don't end a head, and that one of their kind ends
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul button label textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("noscript template svg select iframe object canvas math".split())
_HEAD = frozenset("title base link meta".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

Block = tuple[tuple[str, ...], str, float, bool]  # (marks from the root down, text, share of linked text, after a heading)


def hidden(tokens: list[re.Match]) -> dict[int, int]:
    """Index of the end tag of every start tag that hides its content and has one; starts and ends pair as brackets do."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        if m[1] or not (tag := _TAG.match(m[0])) or (name := tag[2].lower()) not in _HIDDEN and name != "title":
            continue
        if not tag[1]:
            if not m[0].endswith("/>"):
                opened.setdefault(name, []).append(i)
        elif opened.get(name):
            out[opened[name].pop()] = i
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order. Broken markup is read leniently; comments, heads and scripts hold no blocks.

    Only comments, scripts and styles may run to the page's end. Other elements that hide their content do so up to their
    end tag; those that are closed at once or never are tags like any other. A head ends at </head> or, as in browsers,
    at the first text or tag that it can't hold.
    """
    out: list[Block] = []
    names: list[str] = []
    marks: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = total = links = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                out.append((tuple(m for above in marks for m in above), said, linked / max(1, total), bool(out) and out[-1][0][-1:] in (("h1",), ("h2",), ("h3",))))
            text.clear()
        linked = total = 0

    def close(to: int) -> None:
        nonlocal links
        links -= names[to:].count("a")
        del names[to:], marks[to:]

    tokens = list(_TOKEN.finditer(page))
    ends_at = hidden(tokens)
    skip = -1  # last token of the hidden element
    in_head = titled = False
    for i, m in enumerate(tokens):
        if i <= skip:
            continue
        s = m[0]
        if s[0] != "<" or len(s) == 1:
            if titled or in_head and not s.strip():
                continue
            in_head = False
            text.append(s)
            total += len(s)
            linked += len(s) if links > 0 else 0
            continue
        tag = _TAG.match(s)
        if tag is None or m[1]:
            if m[1]:
                text.append(" ")
            continue
        ends, name = tag[1], tag[2].lower()
        if i in ends_at and (in_head or name != "title"):
            skip = ends_at[i]
            text.append(" ")
            continue
        titled = in_head and not ends and name == "title"
        if name == "head":
            in_head = not ends
            continue
        if in_head:
            if ends or name in _HEAD or name in _HIDDEN:
                continue
            in_head = False
        if name == "br":
            text.append(" ")
        if name in _BLOCK:
            flush()
        if ends:
            if name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in _BLOCK and "p" in names and name not in ("button", "label"):
            close(len(names) - 1 - names[::-1].index("p"))
        if name in _SELF:
            for k in range(len(names) - 1, -1, -1):
                if names[k] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
                if names[k] in _SELF[name]:
                    close(k)
                    break
        if name in _VOID or s.endswith("/>"):
            continue
        found = [w for g in _MARKS.findall(s) for w in _SPLIT.split("".join(g).lower()) if len(w) > 1] if " " in s or "=" in s else []
        names.append(name)
        marks.append((*(f".{w}" for w in found), name) if name in _BLOCK or found else ())
        links += name == "a"
    flush()
    return out


def text_marks(block: Block, at: int, n: int) -> list[str]:
    """Features of a block's text and place."""
    _, said, linked, headed = block
    size = len(said)
    return [
        f"len{min(6, size.bit_length() // 2)}",
        f"link{0 if linked < 0.1 else 1 if linked < 0.6 else 2}",
        "stop" if said[-1] in ".!?:;\"»”…" else "open",
        "mark" if "©" in said or "®" in said else "-",
        "first" if at == 0 else "last" if at == n - 1 else "-",
        "headed" if headed else "-",
        "bias",
    ]


def path_marks(above: tuple[str, ...]) -> list[str]:
    return [f"own:{above[-1]}" if above else "own:", *{f"in:{m}" for m in above}]


class Field:
    """Linear-chain CRF with two labels (1 = main text): a weight a feature for label 1, and four transition weights."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.paths: dict[tuple[str, ...], float] = {}

    def unary(self, page: list[Block]) -> list[float]:
        get, out = self.weights.get, []
        if len(self.paths) > 50_000:
            self.paths.clear()
        for i, b in enumerate(page):
            above = self.paths.get(b[0])
            if above is None:
                above = self.paths[b[0]] = sum(get(f, 0.0) for f in path_marks(b[0]))
            out.append(above + sum(get(f, 0.0) for f in text_marks(b, i, len(page))))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi path; ties keep a block."""
        (a, b), (c, d) = self.steps.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, u in enumerate(self.unary(page)):
            if i == 0:
                zero, one = 0.0, u
                continue
            to0, to1 = (zero + a, one + c), (zero + b, one + d)
            back.append((int(to0[1] >= to0[0]), int(to1[1] >= to1[0])))
            zero, one = max(to0), max(to1) + u
        if not page:
            return []
        labels = [int(one >= zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]], rounds: int = 10, rate: float = 0.4, ridge: float = 1e-3) -> Field:
        """Maximum likelihood with adaptive gradient steps, a page at a time; marginals by forward-backward."""
        names: dict[str, int] = {}
        data = []
        for page, labels in pages:
            rows = [[names.setdefault(f, len(names)) for f in path_marks(b[0]) + text_marks(b, i, len(page))] for i, b in enumerate(page)]
            data.append((np.concatenate([np.asarray(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.asarray(labels)))
        w, sw, t, st = np.zeros(len(names)), np.full(len(names), 1e-3), np.zeros((2, 2)), np.full((2, 2), 1e-3)
        order = np.random.default_rng(5)
        for _ in range(rounds):
            for k in order.permutation(len(data)):
                cols, rows, y = data[k]
                n = len(y)
                u = np.bincount(rows, w[cols], n)
                fore, rear = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = (0, u[0])
                for i in range(1, n):
                    fore[i] = np.logaddexp(fore[i - 1, 0] + t[0], fore[i - 1, 1] + t[1]) + (0, u[i])
                for i in range(n - 2, -1, -1):
                    nxt = rear[i + 1] + (0, u[i + 1])
                    rear[i] = np.logaddexp(t[:, 0] + nxt[0], t[:, 1] + nxt[1])
                z = np.logaddexp(*fore[-1])
                p = np.exp(fore[:, 1] + rear[:, 1] - z)
                g = np.bincount(cols, (p - y)[rows], len(names)) + ridge * w
                gt = ridge * t
                for i in range(1, n):
                    both = fore[i - 1][:, None] + t + (rear[i] + (0, u[i]))[None] - z
                    gt = gt + np.exp(both)
                    gt[y[i - 1], y[i]] -= 1
                sw += g * g
                st += gt * gt
                w -= rate * g / np.sqrt(sw)
                t -= rate * gt / np.sqrt(st)
        return cls({f: float(w[i]) for f, i in names.items()}, t)


# ------------------------------------------------------------------ labelled pages

_LETTERS = "aeioubcdfglmnprstv"
_WORDS = ["".join(_LETTERS[(i * i * 7 + j * (i + 3)) % 18] for j in range(1 + (i * 5 + i // 7) % 8)) for i in range(4000)]


def labelled_page(rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page from the grammar; main blocks are marked in their text, and the mark is taken off again."""

    def say(low: int, high: int) -> str:
        at, n = int(rng.integers(len(_WORDS) - 100)), int(rng.integers(low, high + 1))
        return " ".join(_WORDS[at : at + n]).capitalize()

    pick = lambda *options: options[int(rng.integers(len(options)))]
    maybe = lambda p: rng.random() < p
    many = lambda f, low, high: "".join(f() for _ in range(int(rng.integers(low, high + 1))))

    def box(names: tuple[str, ...], tags: tuple[str, ...], inner: str) -> str:
        tag = pick(*tags)
        if tag in ("div", "section", "ul"):
            return f'<{tag} {pick("class", "id")}="{pick(*names)}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    link = lambda: f'<a href="/x">{say(1, 4)}</a>'
    prose = lambda: pick(say(1, 4), say(8, 60), say(20, 90)) + pick(".", ".", ".", "", "!")
    para = lambda: pick("p", "div", "p")
    menu = lambda: box(("menu", "nav", "navbar", "navigation", "breadcrumb", "topnav"), ("nav", "nav", "div", "ul"), "<ul>" + many(lambda: f"<li>{link()}</li>", 2, 8) + "</ul>")
    advert = lambda: box(("ad", "ads", "advert", "sponsored", "promo", "banner"), ("div",), pick("", "<p>") + prose())
    notice = lambda: box(("cookie-notice", "notice", "consent", "alert", "newsletter", "popup", "modal"), ("div", "section"), f"<p>{prose()}</p>")
    head = lambda: box(("header", "masthead", "site-header", "topbar"), ("header", "div"), pick("<h1>", "<p>", "<div>") + say(1, 8) + many(lambda: f"<p>{say(3, 12)}</p>", 0, 1))
    side = lambda: box(("sidebar", "side", "related", "widget", "share", "social", "tags"), ("aside", "div"), f"<h3>{say(1, 4)}</h3>" + pick("<ul>" + many(lambda: f"<li>{link()}</li>", 2, 6) + "</ul>", f"<p>{prose()}</p>"))
    form = lambda: f"<form><label>{say(1, 4)}</label><input><p>{say(2, 14)}</p><button>{say(1, 2)}</button></form>"
    talk = lambda: box(("comments", "comment-list", "comment", "discussion", "replies", "disqus"), ("section", "div"), f"<h3>{say(1, 3)}</h3>" + many(lambda: f'<div class="{pick("comment", "reply")}"><p>{prose()}</p></div>', 1, 4))
    foot = lambda: box(("footer", "site-footer", "copyright", "bottom", "legal"), ("footer", "footer", "div"), pick("&copy; ", "", "<p>") + prose() + many(link, 0, 3))
    mark = "\ue000"
    piece = lambda: pick(
        *[lambda: f"<p>{mark}{prose()}</p>"] * 6,
        lambda: f"<p>{mark}{say(3, 20)} <a href='/y'>{say(1, 3)}</a> {say(3, 20)}.</p>",
        lambda: f"<p><b>{mark}{prose()}<br><p>{mark}{prose()}</p>",
        lambda: f"<h{pick(2, 3)}>{mark}{say(1, 8)}</h2>",
        lambda: "<ul>" + many(lambda: f"<li>{mark}{prose()}</li>", 2, 5) + "</ul>",
        lambda: f"<blockquote>{mark}{prose()}</blockquote>",
        lambda: f"<pre>{mark}{prose()}</pre>",
        lambda: f"<table><tr><td>{mark}{say(1, 6)}</td><td>{mark}{say(1, 6)}</td></tr></table>",
        lambda: f"<figure><figcaption>{mark}{say(3, 12)}</figcaption></figure>",
    )()
    aside = lambda: pick(advert, side, notice, form)() if maybe(0.12) else ""
    body = (f"<h1>{mark}{say(1, 10)}</h1>" if maybe(0.85) else "") + many(lambda: piece() + aside(), 1, 12)
    main = box(("content", "article", "post", "entry", "main", "story", "article-body", "post-content"), ("article", "article", "article", "main", "div", "section"), body + (talk() if maybe(0.15) else ""))
    if maybe(0.2):  # paragraphs in no element of their own
        main = body
    elif maybe(0.25):
        main = pick("<main>", '<div class="container">', '<div id="page">', "<section>") + main
    before = "".join(f() for f, p in ((head, 0.4), (menu, 0.8), (notice, 0.25), (advert, 0.5), (side, 0.15)) if maybe(p))
    after = "".join(f() for f, p in ((side, 0.3), (advert, 0.25), (talk, 0.3), (form, 0.25), (notice, 0.15), (foot, 0.85)) if maybe(p))
    page = blocks(f"<html><body>{before}{main}{after}</body></html>")
    labels = [int(mark in b[1]) for b in page]
    return [(b[0], b[1].replace(mark, "") or "x", b[2], b[3]) for b in page], labels


@lru_cache(maxsize=1)
def trained(pages: int = 360, seed: int = 3) -> Field:
    """The field fitted on ``pages`` generated pages; the same for every run."""
    rng = np.random.default_rng(seed)
    data = (labelled_page(rng) for _ in range(pages))
    return Field.fit([d for d in data if d[0]])


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b[1] for b, keep in zip(found, field.decode(found), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Null or empty html, and pages of no main block, give ''."""
    model = field or trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "html"):
                raw = data.tobytes()
                texts = [main_text(raw[a:b].decode("utf-8", "replace"), own) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                cut = [batch.column(k).slice(lo, hi - lo) for k in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
