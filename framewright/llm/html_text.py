"""Main text of web pages by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# ---- reading a page

_TOKEN = re.compile(r"""<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<]*+\Z""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_LETTERS = re.compile(r"[a-z]+")

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript iframe svg template select option button canvas audio video".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that say nothing about what they hold; they have no weight.
PLAIN = frozenset("html body div span b i em strong u small font center table tbody thead tfoot tr td th section sup sub code mark".split())


#: Elements that shape a text but do not say whose it is: they count for a word's score, and never take words out of the region.
SHAPE = frozenset("a p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 ins blockquote figure figcaption pre".split())

#: What events() tells: a run of text, a tag, an element that opens or closes with its names, and a comment.
TEXT, TAG, OPEN, CLOSE, MARK = range(5)


def events(html: str):
    """The page as (kind, what, block), in order and in time that grows with its length alone.

    What is the text, the tag, the names an element opens with or takes away, or the comment.
    A name is an element's tag, or a word of its class, id or role with a dot before it.
    """
    stack: list[tuple[str, list[str]]] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag stands
    blocks: list[int] = []  # and where its blocks do
    block, at, n = 0, 0, len(html)

    def close(to: int):
        while len(stack) > to:
            tag, names = stack.pop()
            places[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if names:
                yield CLOSE, names, block

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            yield TEXT, html[at:end], block
        if not m:
            return
        at = m.end()
        if m[1] is not None:
            yield MARK, m[1], block
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in BLOCK:
            block += 1
        if m[2]:
            if places.get(tag):
                yield from close(places[tag][-1])
            yield TAG, tag, block
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else n if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag in BLOCK and blocks:
            # An open paragraph ends where a block begins, a list item where the next one does.
            over = stack[blocks[-1]][0]
            if over == "p" or (over == tag and tag in ("li", "dd", "dt", "tr", "td", "th")):
                yield from close(blocks[-1])
        yield TAG, tag, block
        if tag in VOID:
            continue
        names = [] if tag in PLAIN else [tag]
        if m[4]:
            for x in _NAMES.finditer(m[4]):
                words = _LETTERS.findall((x[1] or x[2] or x[3] or "").lower())
                names += ["." + w.rstrip("s") for w in words if len(w) > 1]
            if _HIDDEN.search(m[4]):
                names.append(".hidden")
        if tag in BLOCK:
            blocks.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, names))
        if names:
            yield OPEN, names, block


# ---- weights from labelled pages


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages in many layouts, some without any name, whose main text stands between the comments main and /main."""
    rng = random.Random(seed)
    syllables = "ba de ki lo mu na pe ri so tu va we".split()
    places = "left right side top main page inner outer center site wide col block".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high))).capitalize() + "."

    def wrap(names: str, inside: str) -> str:
        name = rng.choice(names.split())
        kind, _, rest = name.partition(".")
        kind = kind or "div"
        if rest and rng.random() < 0.3:
            rest = f"{rng.choice(places)}-{rest}"
        return f'<{kind}{f" {rng.choice(["class", "id"])}={chr(34)}{rest}{chr(34)}" if rest else ""}>{inside}</{kind}>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def said(low: int, high: int) -> str:
        return rng.choice(["{}", "<p>{}</p>", "<p>{}</p>", "<span>{}</span>"]).format(words(low, high))

    around = {
        "top": lambda: wrap("header .header .masthead .topbar header.header", said(1, 8) + links(rng.randint(0, 4))),
        "menu": lambda: wrap("nav .nav .menu .navigation .navbar .breadcrumb .breadcrumbs .toc", rng.choice([links(rng.randint(2, 9)), said(2, 12)])),
        "advert": lambda: wrap(".ad .ads .advert .advertisement .sponsored .promo .banner .adsbygoogle aside.ad ins.ad", said(3, 60)),
        "notice": lambda: wrap(".notice .cookie .cookie-banner .consent .alert .popup .modal .gdpr dialog.modal .overlay", f"<p>{words(5, 40)}</p>"),
        "side": lambda: wrap("aside .sidebar .widget .related .recommended .trending .popular", f"<h3>{words(1, 4)}</h3>" + links(rng.randint(1, 6)) + f"<p>{words(3, 30)}</p>"),
        "share": lambda: wrap(".share .social .tag .tags .byline .meta .pagination .pager", rng.choice([links(rng.randint(1, 5)), said(1, 9)])),
        "form": lambda: wrap("form .newsletter .subscribe .signup .login .search form.search", f"<label>{words(1, 5)}</label><input name=q><p>{words(2, 20)}</p>"),
        "comments": lambda: wrap(".comments .comment-list .comment .commentlist .replies .respond section.comments ol.comments .disqus", f"<h3>{words(1, 3)}</h3>" + "".join(f"<p>{words(4, 60)}</p>" for _ in range(rng.randint(1, 6)))),
        "foot": lambda: wrap("footer .footer .copyright .legal .bottom footer.footer", said(3, 40) + links(rng.randint(0, 3))),
    }
    out = []
    for _ in range(n):
        some = lambda keys, p: "".join(around[k]() for k in keys if rng.random() < p)
        paragraph = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "{}<br><br>", "{}\n"])
        title = rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<div><b>{}</b></div>"])
        parts = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            parts.append(
                f"<h{k}>{words(1, 6)}</h{k}>" if kind < 0.12 and (k := rng.randint(2, 4))
                else f"<ul><li>{words(3, 20)}</li><li>{words(3, 20)}</li></ul>" if kind < 0.18
                else f"<blockquote>{words(5, 40)}</blockquote>" if kind < 0.22
                else wrap("section.discussion section.results section.part figure .figure .chapter", paragraph.format(words(8, 60))) if kind < 0.3
                else paragraph.format(words(1, 6)) if kind < 0.42
                else paragraph.format(f"{words(12, 90)} <a href=/x>{words(1, 2)}</a> {words(3, 20)}") if kind < 0.55
                else paragraph.format(words(12, 120))
            )
            if rng.random() < 0.08:
                parts.append("<!--/main-->" + around[rng.choice(["advert", "share", "form", "side"])]() + "<!--main-->")
        main = f"<!--main-->{title.format(words(2, 12))}{''.join(parts)}<!--/main-->" + some(["share", "comments"], 0.3)
        if rng.random() < 0.7:
            main = wrap("article main .content .post .entry .article .body .text .story article.post main.content section div div td", main)
        body = some(["notice", "top", "menu", "advert", "side"], 0.5) + f"<div>{main}</div>" + some(["share", "comments", "side", "form", "advert", "foot"], 0.5)
        for _ in range(rng.randint(0, 3)):
            body = f'<div class="{" ".join(rng.sample([*places, "wrapper", "container", "row", "layout"], 2))}">{body}</div>'
        out.append(f"<html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return out


#: Labelled pages that must hold a name before it gets a weight, and the least a word scores where no name speaks.
LEAST_SEEN, WORD = 3, 0.5
#: A word's score, either way, is at most this.
MOST = 3.0
#: What is not shown is no text, whatever other names say.
HIDDEN = {".hidden": -4 * MOST}


def fit(pages: list[str], ridge: float = 0.0005) -> dict:
    """Weights of names for words, by logistic regression over runs of text, and of tags.

    A word's score is the log-odds that a word under such names is main text; where no
    name speaks it is positive, as most text without a name is. A second regression, by the
    names that say whose a part is, tells which parts within the region are none of the text.
    A tag's score is negative always: the log of how rare it is in main text against all its places.
    """
    runs, inside_tags, all_tags = [], {}, {}
    for html in pages:
        main, names = False, Counter()
        for kind, what, _ in events(html):
            if kind == MARK:
                main = what == "main" if what in ("main", "/main") else main
            elif kind == TAG:
                all_tags[what] = all_tags.get(what, 0) + 1
                inside_tags[what] = inside_tags.get(what, 0) + main
            elif kind == OPEN:
                names.update(what)
            elif kind == CLOSE:
                names.subtract(what)
            elif n := len(what.split()):
                runs.append((frozenset(+names), n, main))
    words, base = _log_odds(runs, ridge)
    parts, part = _log_odds([(names - SHAPE, n, main) for names, n, main in runs], ridge)
    tags = {t: -0.02 - 0.1 * float(np.log((all_tags[t] + 2) / (inside_tags[t] + 1))) for t in all_tags}
    return {"words": words | HIDDEN, "base": max(WORD, base), "parts": parts | HIDDEN, "part": max(WORD, part), "tags": tags, "other": -0.1}


def _log_odds(runs: list[tuple[frozenset, int, bool]], ridge: float) -> tuple[dict[str, float], float]:
    """The weight of each name, and the constant, by Newton steps; a run weighs as the root of its words."""
    seen = Counter(name for names, _, _ in runs for name in names)
    at = {name: k for k, name in enumerate(sorted(name for name, k in seen.items() if k >= LEAST_SEEN))}
    x = np.zeros((len(runs), len(at) + 1))
    x[:, -1] = 1
    for k, (names, _, _) in enumerate(runs):
        x[k, [at[name] for name in names if name in at]] = 1
    y = np.array([float(main) for _, _, main in runs])
    weight = np.sqrt(np.array([n for _, n, _ in runs], float))
    weight /= weight.mean()
    w = np.zeros(len(at) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {name: float(w[k]) for name, k in at.items()}, float(w[-1])


# ---- the best region


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the largest sum, in one scan; (0, 0) if no score is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def scored(html: str, weights: dict) -> tuple[list[float], list[tuple[str, int] | None]]:
    """Each text and tag of a page with its score, and what it gives to the text of its block, if anything."""
    tags, other = weights["tags"], weights["other"]
    scores: list[float] = []
    texts: list[tuple[str, int] | None] = []
    open_names: dict[str, int] = {}
    now, own = weights["base"], weights["part"]
    for kind, what, block in events(html):
        if kind == OPEN or kind == CLOSE:
            sign = 1 if kind == OPEN else -1
            for name in what:
                if name not in weights["words"]:
                    continue
                k = open_names[name] = open_names.get(name, 0) + sign
                if k == (kind == OPEN):  # the first one that opens, the last one that closes
                    now += sign * weights["words"][name]
                    own += sign * weights["parts"].get(name, 0.0)
        elif kind == TAG:
            scores.append(tags.get(what, other))
            texts.append((" " if what == "br" else "", block) if what not in BLOCK else None)
        elif kind == TEXT:
            scores.append(max(-MOST, min(MOST, round(now, 9))) * len(what.split()))
            texts.append((what, block) if own > 1e-9 or what.isspace() else None)
    return scores, texts


def extract(html: str, weights: dict) -> str:
    """The main text: the blocks of the best region, without parts in it that their own names speak against."""
    scores, texts = scored(html, weights)
    first, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for item in texts[first:end]:
        if item:
            blocks.setdefault(item[1], []).append(item[0])
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_main_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """The main text of every page, from its whole html; weights come from the labelled pages.

    A null or empty page, or one without main text, gives an empty text. A page cut off
    anywhere, even within a tag or a reference, gives what it has. Repeated rows come
    back each; other columns are left out, and an empty table gives no rows.
    Returns page_id, url, text and n_chars (code points).
    """
    weights = fit(labelled or labelled_pages())

    def run(batches):
        for batch in batches:
            found = [extract(x, weights) if x else "" for x in batch.column(2).to_pylist()]
            # Numeric references can name lone surrogates, which no UTF-8 text can hold.
            found = [x if x.isascii() else x.encode("utf-8", "replace").decode() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
